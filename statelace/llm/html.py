"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block elements. The first pass decides what it can: blocks in navigation,
advertisement, form or comment containers and link lists are boilerplate; long blocks rich in stop words, or blocks
of some length in the article element, are content. The second pass gives short or middling blocks the label of
their nearest decided neighbours. Where a page has an article element, only blocks in it can be content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Names of HTML elements.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BOILERPLATE = frozenset(
    "nav footer aside form menu dialog fieldset button select noscript template svg math object canvas audio video".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that name what isn't the article; compounds with those of LAYOUT may also name a page that has such a part.
NOTICES = frozenset(
    "advert advertisement adsbygoogle alert captcha comment comments complementary consent contentinfo cookie cookies disqus footer gdpr "
    "hidden login masthead newsletter notice pagination paywall popup privacy promo promoted promotion recommended related replies respond "
    "share sharing signup skip sponsor sponsored subscribe".split()
)
LAYOUT = frozenset(
    "ad ads banner breadcrumb breadcrumbs menu modal nav navbar navigation overlay search sidebar social tags toolbar widget widgets".split()
)
# Words before such a name that say what a page has or lacks.
MODIFIERS = frozenset("has with no without is not show hide".split())
# Frequent function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on as with was are be by this from or an at not have has but they his her which you we "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des et un une du en que qui dans est pour par sur au avec ce il ne pas plus se son sont aux cette elle ou "
    "el los las una y del se por con para no su al lo como más pero sus o este sí porque esta entre cuando muy sin".split()
)
TOKEN = re.compile(r"<!--|<!\[CDATA\[|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?/]")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
TAG_END = re.compile(r"""(?:[^>"']+|"[^"]*"|'[^']*')*+>""")
# Scripts that write words without spaces.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

LONG, SHORT = 25, 8
RICH, SOME = 0.30, 0.15
LINKED = 0.5


#: Pages whose text has fewer stop words than this share are in a language without a list here.
LISTED = 0.05
#: Part of a page's words outside links from which an element whose class only may name a part of the page is the page.
MOST = 0.5
#: How an element says that it is boilerplate: surely; by a name that pages with such a part have, too; by a part's own name.
SURE, COMPOUND, NAME = range(3)


class Part:
    """An element that names itself boilerplate, how it does so, and what speaks for its being the page."""

    __slots__ = ("above", "how", "titled", "words")

    def __init__(self, above: Part | None, how: int):
        self.above, self.how, self.words, self.titled = above, how, 0, False


class Block:
    __slots__ = ("text", "linked", "words", "n", "article", "part", "heading", "title")

    def __init__(self, text: str, linked: int, article: bool, part: Part | None, heading: bool, title: bool):
        self.text, self.article, self.part, self.heading, self.title = text, article, part, heading, title
        self.words = text.split(" ")
        self.n = len(self.words) + len(UNSPACED.findall(text)) // 2
        self.linked = min(linked, self.n)

    @property
    def bad(self) -> bool:
        return self.part is not None


def _named(tag: str, attributes: str, article: bool) -> int | None:
    """How an element's attributes name it boilerplate, if they do."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return None
    found = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return SURE
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return SURE
            continue
        for one in value.split():
            words = re.split(r"[_-]+", one)
            for i, w in enumerate(words):
                if i and words[i - 1] in MODIFIERS:
                    continue
                header = w == "header" and not article
                if w in NOTICES or w in LAYOUT or header:
                    compound = len(words) > 1 and w not in NOTICES
                    found.append(SURE if name == "role" else COMPOUND if compound else NAME)
    if not found:
        return None
    return SURE if SURE in found else max(found)


def blocks(page: str) -> list[Block]:
    """Blocks of a page that have text, in order. Unclosed and cut-off tags are no error."""
    out: list[Block] = []
    stack: list[tuple[str, Part | None, bool]] = []  # tag, boilerplate, article
    open_at: dict[str, list[int]] = {}  # where in the stack each tag is open
    outer: list[int] = []  # where block elements are
    headings, last = 0, {}
    parts: list[str] = []
    linked, breaks, at = 0, 0, 0
    loose: Part | None = None  # an inline boilerplate element that is never closed; the next block ends it

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = stack[-1] if stack else ("", None, False)
            out.append(Block(text, linked, top[2], top[1] or loose, headings > 0, bool(open_at.get("h1"))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, breaks
        if text:
            parts.append(text)
            if open_at.get("a"):
                linked += len(text.split()) + len(UNSPACED.findall(text)) // 2
            if not text.isspace():
                breaks = 0

    def pop(i: int) -> None:
        nonlocal headings, loose
        if outer and outer[-1] >= i:
            flush()
            loose = None
        while len(stack) > i:
            tag = stack.pop()[0]
            open_at[tag].pop()
            headings -= tag in HEADING
            if outer and outer[-1] == len(stack):
                outer.pop()

    def closes(tag: str) -> bool:
        if tag not in last:
            last[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\b", page, re.IGNORECASE)), default=-1)
        return last[tag] >= at

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        if not m[2]:
            end = page.find(">", m.end())  # browsers end declarations and CDATA here, too
            at = len(page) if end < 0 else end + 1
            continue
        close = TAG_END.match(page, m.end())
        end = close.end() if close else page.find(">", m.end()) + 1
        if end <= 0:  # cut off inside the tag
            break
        tag, attributes, at = m[2].lower(), page[m.end() : end - 1], end
        if m[1]:
            if open_at.get(tag):
                pop(open_at[tag][-1])
            elif tag in BLOCK:
                flush()
                loose = None
            continue
        if tag in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\b", re.IGNORECASE).search(page, at)
            if not stop:
                at = len(page)
            else:
                gt = page.find(">", stop.end())
                at = gt + 1 if gt >= 0 else len(page)
            if tag not in ("textarea", "title"):
                parts.append(" ")
            continue
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                flush()
            continue
        if tag in BLOCK:
            # an open paragraph ends here; so does an open item before its sibling
            if outer:
                name = stack[outer[-1]][0]
                if name == "p" or (name == tag and tag in ("li", "dt", "dd", "option", "td", "th", "tr")):
                    pop(outer[-1])
            flush()
            loose = None
        if tag in VOID or attributes.endswith("/"):
            continue
        above = stack[-1] if stack else ("", None, False)
        article, part = above[2] or tag in ("article", "main"), above[1]
        if tag in BOILERPLATE or (tag == "header" and not article):
            if tag not in BLOCK:
                flush()
                if not closes(tag):
                    loose = loose or Part(None, SURE)
                    continue
            part = Part(part, COMPOUND if tag == "form" else SURE)
        elif tag == "main":
            part = None
        else:
            how = _named(tag, attributes, article)
            part = part if how is None else Part(part, how)
        if tag not in BLOCK and part is not above[1]:
            flush()
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK or tag in BOILERPLATE or part is not above[1]:
            outer.append(len(stack))
        headings += tag in HEADING
        stack.append((tag, part, article))
    flush()
    _spare(out)
    return out


def _spare(found: list[Block]) -> None:
    """An element that holds most of the page's words outside links is the page, if only its name or a form speaks against it.

    One that bears the name of such a part as it stands, or of a notice, must also hold the page's title, or nothing may be left without it.
    """
    total = rest = 0
    for b in found:
        n = b.n - b.linked
        total += n
        if b.part:
            b.part.words += n
            b.part.titled |= b.title
        elif n >= SHORT:
            rest += n
    parts: list[Part] = []
    known: set[int] = set()
    for b in found:
        chain, p = [], b.part
        while p and id(p) not in known:
            known.add(id(p))
            chain.append(p)
            p = p.above
        parts += reversed(chain)  # outer ones first
    for p in reversed(parts):
        if p.above:
            p.above.words += p.words
            p.above.titled |= p.titled
    spared = {id(p) for p in parts if p.how != SURE and p.words > MOST * total and (p.how == COMPOUND or p.titled or not rest)}
    real: dict[int, Part | None] = {}
    for p in parts:
        up = real[id(p.above)] if p.above else None
        real[id(p)] = up if id(p) in spared else p
    for b in found:
        b.part = real[id(b.part)] if b.part else None


def classify(found: list[Block]) -> list[bool]:
    """Which blocks are content."""
    has_article = any(b.article and not b.bad for b in found)
    stops = [sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in b.words) for b in found]
    free = [(s, len(b.words)) for b, s in zip(found, stops) if not b.bad and b.linked <= LINKED * b.n]
    # where no list fits the page's language, length and links decide
    listed = sum(s for s, _ in free) >= LISTED * sum(n for _, n in free)
    labels: list[bool | None] = []
    for b, s in zip(found, stops):
        n, stop = b.n, s / len(b.words) if listed else RICH
        if b.bad or (has_article and not b.article) or b.linked > LINKED * n:
            labels.append(False)
        elif b.article:
            labels.append(True if n >= SHORT or stop >= RICH else None)
        elif n >= LONG:
            labels.append(True if stop >= RICH else None if stop >= SOME else False)
        elif n >= SHORT and stop >= RICH and not b.linked:
            labels.append(True)
        else:
            labels.append(None)

    def nearest(order: range) -> list[int | None]:
        """The last decided block before each, among those in the article for blocks in it."""
        any_, inside, out = None, None, [None] * len(found)
        for i in order:
            out[i] = inside if found[i].article else any_
            if labels[i] is not None:
                any_ = i
                inside = i if found[i].article else inside
        return out

    backs, ons = nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1))
    out = []
    for i, (b, label, back, on) in enumerate(zip(found, labels, backs, ons)):
        if label is None:
            if back is None and on is None:
                label = b.article or not has_article and len(found) == 1
            elif back is None or on is None:
                label = labels[on if back is None else back]
            elif labels[back] == labels[on]:
                label = labels[back]
            elif b.heading:
                label = labels[on]  # a heading goes with what follows
            elif i - back != on - i:
                label = labels[back] if i - back < on - i else labels[on]
            else:
                label = b.article
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, good in zip(found, classify(found)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of ``pages``. Null or empty html, or no content: empty text. Pages of any length are read whole.

    Repeated rows stay; an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column("html")]
            yield pa.record_batch({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html": op5_html}
ORACLES: dict[str, str] = {}
