"""Dates written in text, and the date of an extracted entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.fhir import bound, parse_date

#: Attributes that hold an entity's date, in order of preference.
DATE_KEYS = [
    "date", "effective_date", "onset_date", "performed_date", "recorded_date", "result_date", "collection_date", "collected_date",
    "specimen_date", "report_date", "reported_date", "visit_date", "encounter_date", "service_date", "diagnosis_date", "diagnosed_date",
    "administered_date", "administration_date", "start_date", "observation_date", "observed_date", "measured_date", "noted_date",
    "datetime", "timestamp",
]
#: Names of months; a month may also be said by its first three letters, September by four.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Entity classes that never take the date of their document.
UNDATED = ["family_history"]

_NAMES = "|".join([*MONTHS, *(m[:3] for m in MONTHS if len(m) > 3), "sept"])
#: Each needs a year of four digits, so that a dose, a ratio or a pressure is no date.
DATE_IN_TEXT = rf"(?i)\b(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}-\d{{1,2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}/\d{{4}}|(?:{_NAMES})\.?\s+\d{{1,2}},?\s+\d{{4}}|(?:{_NAMES})\.?\s+\d{{4}})\b"


def _stamp(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-M-d"))


def _read(found: Column) -> Column:
    """What ``DATE_IN_TEXT`` found, as a timestamp."""
    part = lambda pattern, i: F.nullif(F.regexp_extract(found, pattern, i), F.lit(""))
    iso, slashed, named = r"^(\d{4})-(\d{1,2})(?:-(\d{1,2}))?$", r"^(\d{1,2})/(?:(\d{1,2})/)?(\d{4})$", r"^([A-Za-z]{3})[a-zA-Z]*\.?\s+(?:(\d{1,2}),?\s+)?(\d{4})$"
    one = F.lit("1")
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m[:3], str(i))])
    a, b, year = part(slashed, 1), part(slashed, 2), part(slashed, 3)
    return (
        F.when(found.rlike(iso), _stamp(part(iso, 1), part(iso, 2), F.coalesce(part(iso, 3), one)))
        .when(found.rlike(slashed), F.coalesce(_stamp(year, a, F.coalesce(b, one)), F.when(b.isNotNull(), _stamp(year, b, a))))
        .when(found.isNotNull(), _stamp(part(named, 3), number[F.lower(part(named, 1))], F.coalesce(part(named, 2), one)))
    )


def first_date(s: Column) -> Column:
    """The first date written in a text; without a day it is the first of the month. Null if there is none or it can't be."""
    return bound(F.nullif(F.regexp_extract(s, DATE_IN_TEXT, 0), F.lit("")), _read)


def entity_date(attributes: Column, text: Column, cls: Column, document_date: Column) -> Column:
    """Date of an entity: date attributes, other attributes, its text, else its document's date where its class allows.

    ``attributes`` is a map of strings. Nothing is made up: without any of these the date is null.
    """
    listed = F.filter(F.array(*[F.try_element_at(attributes, F.lit(k)) for k in DATE_KEYS]), lambda x: x.isNotNull())
    said = F.get(F.filter(F.transform(listed, lambda x: F.coalesce(parse_date(x), first_date(x))), lambda d: d.isNotNull()), F.lit(0))
    others = F.map_values(F.map_filter(attributes, lambda k, v: ~k.isin(*DATE_KEYS)))
    elsewhere = F.get(F.filter(F.transform(others, first_date), lambda d: d.isNotNull()), F.lit(0))
    return F.coalesce(said, elsewhere, first_date(text), F.when(~F.coalesce(cls, F.lit("")).isin(*UNDATED), document_date))


def real_date(entity_date_: Column, cls: Column, document_date: Column) -> Column:
    """The document's date, read before de-identification, over an entity's date of which only the year was left."""
    return F.when(cls.isin(*UNDATED), entity_date_).otherwise(F.coalesce(document_date, entity_date_))
