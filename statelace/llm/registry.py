"""All queries of this package and the SQL they can be held against."""

from . import chat, embedding, fingerprint, html, merkle, mixing, packing, pii, simhash, substring, suffix, toxicity, whitening

MODULES = (suffix, embedding, toxicity, packing, html, pii, fingerprint, mixing, simhash, substring, chat, merkle, whitening)

QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
