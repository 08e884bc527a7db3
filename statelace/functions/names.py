"""What file names say: subjects, base names, conditions, channel kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order in which subject patterns are tried.
SUBJECT_PATTERNS = (r"(?i)sub-?0*(\d+)", r"(?i)subj(?:ect)?[_-]?0*(\d+)", r"(?i)part(?:icipant)?[_-]?0*(\d+)", r"\bS0*(\d{1,3})\b", r"\bP0*(\d{1,3})\b", r"^0*(\d+)")

# Parts of the names of channels that aren't scalp electrodes.
AUXILIARY = (
    "EOG", "HEOG", "VEOG", "EYE", "LEOG", "REOG", "VPVA", "VNVB", "HPHL", "HNHR", "HOHL", "ROC", "LOC", "RLC", "LUC", "PG1", "PG2",
    "ECG", "EKG", "HEART", "CARD", "ERBS",
    "EMG", "LEMG", "REMG", "CHIN", "JAW", "ORBOCC", "MASS",
    "RESP", "ABDOMEN", "RESP ABDOMEN",
    "PHOTIC", "IBI", "BURSTS", "SUPPR",
    "REF", "GND", "TRIGGER", "SYNC", "STATUS",
    "NOSE", "NASION", "LPA", "RPA", "A1", "A2",
    "ARTF", "ARTIFACT", "BAD", "NULL",
)


def extract(name: Column, pattern: str) -> Column:
    """First group, never empty, of the first match; null if there is none. ``name`` is named once, so nothing is computed twice."""
    return F.get(F.regexp_extract_all(name, F.lit(pattern), F.lit(1)), 0)


def two_digits(number: Column) -> Column:
    return F.regexp_replace(number, r"^(\d)$", "0$1")


def subject_id(name: Column) -> Column:
    """Number of the subject, two digits at least; null if no pattern fits."""
    return two_digits(F.coalesce(*[extract(name, p) for p in SUBJECT_PATTERNS]))


def base_filename(name: Column) -> Column:
    """Name without _Pre, _Post, _trialN and task entities."""
    for pattern in (r"_(?:Pre|Post)(?=_|$)", r"_trial\d+", r"_task-[A-Za-z0-9]+"):
        name = F.regexp_replace(name, pattern, "")
    return name


def is_auxiliary(channel: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.upper(channel), F.lit(p)) for p in AUXILIARY])


def event_matches(name: Column, wanted: Column, mode: str = "exact") -> Column:
    """exact, case_insensitive, or partial: one contains the other whatever the case."""
    a, b = F.lower(name), F.lower(wanted)
    match mode:
        case "exact":
            return name == wanted
        case "case_insensitive":
            return a == b
        case "partial":
            return F.contains(a, b) | F.contains(b, a)
    raise ValueError(f"unknown mode {mode!r}")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def icc_band(icc: Column) -> Column:
    return F.when(icc < 0.5, "poor").when(icc < 0.75, "moderate").when(icc < 0.9, "good").otherwise("excellent")
