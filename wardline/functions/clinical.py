"""Parsing of clinical text: terms, sigs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of routes and of frequencies (times, period, unit), in order of preference.
ROUTES = [("oral", r"po|by mouth|orally|oral"), ("intravenous", r"iv|intravenous(ly)?"), ("intramuscular", r"im|intramuscular(ly)?"), ("subcutaneous", r"sc|sq|subq|subcutaneous(ly)?"), ("sublingual", r"sl|sublingual(ly)?"), ("rectal", r"pr|rectal(ly)?"), ("inhalation", r"inhaled|inhalation|nebulized|neb"), ("topical", r"topical(ly)?")]
FREQUENCIES = [
    (4, "d", r"qid|four times (a )?(day|daily)|q6h"),
    (3, "d", r"tid|three times (a )?(day|daily)|q8h"),
    (2, "d", r"bid|(twice|two times) (a )?(day|daily)|q12h"),
    (1, "wk", r"q(every)?\s*week(ly)?|once weekly|weekly|qweek"),
    (1, "d", r"qid|qhs|qam|qpm|at bedtime|nightly|every morning|once (a )?(day|daily)|once daily|daily|qd|qday|q24h|every day"),
]
DOSE = r"(?i)(\d+(?:\.\d+)?)\s*(mg|mcg|µg|ug|g|ml|units?|unit|iu|meq|mmol|puffs?|%)\b"
AS_NEEDED = r"prn|as needed|as required"
DOSE_TOKEN = r"(?i)\b\d+(?:\.\d+)?\s*(?:mg|mcg|µg|ug|g|kg|ml|l|iu|units?|unit|meq|mmol|mol|%|tablets?|tabs?|caps?|capsules?)\b"


def _said(s: Column, spellings: str) -> Column:
    return F.coalesce(s.rlike(rf"(?i)\b({spellings})\b"), F.lit(False))


def parse_dosage(s: Column) -> Column:
    """struct(dose_value, dose_unit, route, frequency, period, period_unit, as_needed) of a sig; what isn't said is null."""
    route, times, unit = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for name, spellings in reversed(ROUTES):
        route = F.when(_said(s, spellings), name).otherwise(route)
    for n, u, spellings in reversed(FREQUENCIES):
        times = F.when(_said(s, spellings), n).otherwise(times)
        unit = F.when(_said(s, spellings), u).otherwise(unit)
    value = F.nullif(F.regexp_extract(s, DOSE, 1), F.lit("")).try_cast("double")
    return F.struct(value.alias("dose_value"), F.nullif(F.lower(F.regexp_extract(s, DOSE, 2)), F.lit("")).alias("dose_unit"), route.alias("route"), times.alias("frequency"), F.when(times.isNotNull(), 1).alias("period"), unit.alias("period_unit"), _said(s, AS_NEEDED).alias("as_needed"))


#: Something of a sig is said only where this is found.
SIG_HINT = rf"(?i)\b({'|'.join([p for _, p in ROUTES] + [p for *_, p in FREQUENCIES] + [AS_NEEDED])})\b|{DOSE.removeprefix('(?i)')}"


def normalize_term(s: Column) -> Column:
    """A label for alias matching: lower case, without apostrophes, parentheses, doses and punctuation; null becomes empty."""
    x = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "['’]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\([^)]*\)", " "), DOSE_TOKEN, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9 ]+", " "), r"\s+", " "))


def alnum_only(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")
