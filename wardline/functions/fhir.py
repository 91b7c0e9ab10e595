"""Column expressions over FHIR resources held as VARIANT.

Paths that do not exist or have another shape give null, so object-or-list
fields are told apart by trying both. Empty strings count as missing.

A path that does not exist costs several times one that does, and a resource
lacks most fields there are. Where many are tried, ``fields`` takes a resource
apart once: a field it lacks is then a look-up in a map. All functions here
take either.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Resource types that become records, and the record type of each.
RECORD_TYPES = {
    "Condition": "condition", "Observation": "observation", "MedicationRequest": "medication", "MedicationStatement": "medication",
    "AllergyIntolerance": "allergy", "Procedure": "procedure", "Encounter": "encounter", "Immunization": "immunization",
    "DiagnosticReport": "diagnostic_report", "DocumentReference": "document", "ImagingStudy": "imaging", "ServiceRequest": "service_request",
    "CarePlan": "care_plan", "Communication": "communication", "Appointment": "appointment", "CareTeam": "care_team",
    "ImmunizationRecommendation": "immunization", "QuestionnaireResponse": "questionnaire_response",
}
#: Date fields in order of preference.
DATE_FIELDS = ["effectiveDateTime", "issued", "date", "authoredOn", "occurrenceDateTime", "recordedDate", "onsetDateTime", "created", "sent", "start"]
#: Fields of a resource and of its meta that do not count for its content hash.
VOLATILE, VOLATILE_META = ["_extraction_metadata", "text"], ["lastUpdated", "versionId", "source"]
#: CDA identifier roots that name persons or providers.
PERSON_ROOTS = ["2.16.840.1.113883.4.6", "2.16.840.1.113883.4.2"]
SOURCE_LABELS = {"fhir_r4": "FHIR R4", "fhir": "FHIR R4", "epic_ehi": "Epic EHI", "epic_ehi_single": "Epic EHI", "cda_r2": "CDA", "cda": "CDA", "ai_extracted": "AI extraction"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


@dataclass(frozen=True)
class Fields:
    """A resource as map<string,variant> of its fields, in a column that is computed once."""

    column: Column


def fields(r: Column | str) -> Column:
    """The map that ``Fields`` wraps; null if the resource is no object."""
    return F.try_variant_get(r, "$", "map<string,variant>")


#: The fields that ``typed`` reads, each as it is asked for here.
TYPES = {
    "resourceType": "string", "id": "variant", **{f: "string" for f in DATE_FIELDS}, "effectivePeriod": "variant", "period": "struct<`start`:string,`end`:string>", "meta": "struct<lastUpdated:string>",
    "identifier": "array<struct<system:string,value:string>>", "category": "array<struct<coding:array<struct<code:string>>,text:string>>",
}


@dataclass(frozen=True)
class Typed:
    """A resource's fields of ``TYPES`` as a struct, in a column that is computed once; other fields can't be asked for."""

    column: Column


@dataclass(frozen=True)
class Part:
    """A resource inside another variant, as an element of a list, that is read where it is."""

    column: Column
    at: str


def typed(r: Column | str | Part) -> Column:
    """The struct that ``Typed`` wraps, by one call for all fields; null if the resource is no object."""
    return get(r, "$", f"struct<{','.join(f'`{k}`:{v}' for k, v in TYPES.items())}>")


def get(r: Column | str | Fields | Typed | Part, path: str, kind: str) -> Column:
    """What is at a path, as ``kind``; null if it is not there or not of that kind."""
    if isinstance(r, Part):
        return F.try_variant_get(r.column, r.at + path[1:], kind)
    if not isinstance(r, Fields | Typed):
        return F.try_variant_get(r, path, kind)
    name, rest = re.fullmatch(r"\$\.(\w+)(.*)", path).groups()
    if isinstance(r, Typed) and TYPES[name] != "variant":
        return r.column[name][rest[1:]] if rest else r.column[name]
    field = r.column[name] if isinstance(r, Typed) else F.try_element_at(r.column, F.lit(name))
    return field if kind == "variant" and not rest else F.try_variant_get(field, f"${rest}", kind)


def text(r: Column | str | Fields, path: str) -> Column:
    """A scalar as text, null if absent, empty or not a scalar."""
    return F.nullif(get(r, path, "string"), F.lit(""))


def items(r: Column | str | Fields, path: str) -> Column:
    """A list as an array of variants; null if it is none."""
    return get(r, path, "array<variant>")


def first_of(r: Column | str | Fields, path: str, *inner: str) -> Column:
    """First non-missing value of one of ``inner`` over the elements of a list, element by element."""
    each = F.transform(items(r, path), lambda x: F.coalesce(*[text(x, p) for p in inner]))
    return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))


def number(r: Column | str | Fields, path: str) -> Column:
    """A JSON number as double; numeric text is not a number."""
    kind = F.schema_of_variant(get(r, path, "variant"))
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), get(r, path, "double"))


def _filled(x: Column) -> Column:
    """Whether a variant is there and no empty object."""
    return x.isNotNull() & (F.schema_of_variant(x) != "OBJECT<>")


def resource_type(r: Column | str | Fields) -> Column:
    return text(r, "$.resourceType")


def record_type(r: Column | str | Fields) -> Column:
    return _map(RECORD_TYPES)[resource_type(r)]


def parse_date(s: Column) -> Column:
    """ISO dates, from a year alone to an instant; time-only text is no date."""
    minutes = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(?=[Z+-]|$)", "$1:00")
    # Names s once: what stands behind it is long, and is computed as often as it is named.
    return F.regexp_extract(minutes, r"(?s)^[0-9]{4}.*", 0).try_cast("timestamp")


def effective_date(r: Column | str | Fields) -> Column:
    """The first date field that is set decides, even if it can't be read; then the period, then the last update."""
    period = F.when(_filled(get(r, "$.effectivePeriod", "variant")), text(r, "$.effectivePeriod.start")).otherwise(text(r, "$.period.start"))
    return parse_date(F.coalesce(*[text(r, f"$.{f}") for f in DATE_FIELDS], period, text(r, "$.meta.lastUpdated")))


def effective_date_end(r: Column | str | Fields) -> Column:
    return parse_date(F.coalesce(text(r, "$.effectivePeriod.end"), text(r, "$.period.end")))


def _coded(r: Column | str | Fields) -> Column:
    """The concept that names a resource: its code, or its type (object or first of a list) where there is no code."""
    code = get(r, "$.code", "variant")
    return F.when(_filled(code), code).otherwise(F.coalesce(get(r, "$.type[0]", "variant"), get(r, "$.type", "variant")))


def coding(r: Column | str | Fields) -> Column:
    """struct(code_system, code_value, code_display) of the first coding, or of the text alone."""

    def parts(x: Column) -> Column:
        system, code, display = (text(x, f"$.coding[0].{f}") for f in ("system", "code", "display"))
        return F.struct(system.alias("code_system"), code.alias("code_value"), F.when(F.coalesce(system, code, display).isNotNull(), display).otherwise(text(x, "$.text")).alias("code_display"))

    return bound(_coded(r), parts)


def categories(r: Column | str | Fields) -> Column:
    """Codes of all categories; a category's text only where it has no coding. Null if none."""
    some = lambda texts: F.filter(texts, lambda x: x != "")
    one = lambda c: F.when(F.size(c["coding"]) > 0, some(c["coding"]["code"])).otherwise(some(F.array(c["text"])))
    found = F.flatten(F.transform(get(r, "$.category", TYPES["category"]), one))
    return F.get(F.filter(F.array(found), lambda x: F.size(x) > 0), F.lit(0))


def status(r: Column | str | Fields) -> Column:
    return F.coalesce(text(r, "$.status"), text(r, "$.clinicalStatus.coding[0].code"))


def display_text(r: Column | str | Fields, kind: Column | None = None) -> Column:
    """What a person would call the record: its code's text or first display, else by type, else the type's name."""
    kind = resource_type(r) if kind is None else kind
    encounter = F.coalesce(text(r, "$.type[0].text"), F.concat(F.lit("Encounter ("), text(r, "$.class.code"), F.lit(")")), F.lit("Encounter"))
    family = F.concat(text(r, "$.condition[0].code.text"), F.coalesce(F.concat(F.lit(" ("), text(r, "$.relationship.text"), F.lit(")")), F.lit("")))
    by_type = (
        F.when(kind == "Encounter", encounter)
        .when(kind == "Immunization", F.coalesce(text(r, "$.vaccineCode.text"), first_of(r, "$.vaccineCode.coding", "$.display"), F.lit("Immunization")))
        .when(kind == "MedicationRequest", F.coalesce(text(r, "$.medicationReference.display"), text(r, "$.medicationCodeableConcept.text"), text(r, "$.dosageInstruction[0].text"), F.when(F.size(items(r, "$.dosageInstruction")) > 0, F.lit("Medication")), F.lit("Medication Request")))
        .when(kind == "DiagnosticReport", F.coalesce(F.concat(F.lit("Diagnostic Report: "), F.left(text(r, "$.conclusion"), F.lit(100))), F.lit("Diagnostic Report")))
        .when(kind == "DocumentReference", F.coalesce(text(r, "$.description"), F.lit("Document")))
        .when(kind == "Communication", F.coalesce(F.left(text(r, "$.payload[0].contentString"), F.lit(100)), F.lit("Communication")))
        .when(kind == "Appointment", F.coalesce(text(r, "$.description"), F.lit("Appointment")))
        .when(kind == "ServiceRequest", F.lit("Service Request"))
        .when(kind == "CarePlan", F.coalesce(text(r, "$.title"), F.lit("Care Plan")))
        .when(kind == "FamilyMemberHistory", F.coalesce(family, F.lit("Family History")))
        .when(kind == "CareTeam", F.coalesce(text(r, "$.name"), F.lit("Care Team")))
        .when(kind == "ImmunizationRecommendation", F.coalesce(text(r, "$.recommendation[0].vaccineCode[0].text"), first_of(r, "$.recommendation[0].vaccineCode[0].coding", "$.display"), F.lit("Immunization Recommendation")))
        .when(kind == "QuestionnaireResponse", F.coalesce(F.concat(F.lit("Questionnaire: "), text(r, "$.questionnaire")), F.lit("Questionnaire Response")))
        .otherwise(kind)
    )
    has_code = get(r, "$.code", "variant").isNotNull()
    shown = F.when(has_code, first_of(r, "$.code.coding", "$.display")).otherwise(F.coalesce(first_of(r, "$.type.coding", "$.display"), first_of(r, "$.type[0].coding", "$.display")))
    return F.coalesce(text(_coded(r), "$.text"), shown, by_type)


def provider(r: Column | str | Fields) -> Column:
    """First name among participants, then performers: a display, or a reference whose id is no bare UUID."""
    uuid = r"(?i)^(.*/)?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    named = lambda x, p: F.coalesce(F.nullif(F.trim(text(x, f"{p}.display")), F.lit("")), F.when(~text(x, f"{p}.reference").rlike(uuid), F.nullif(F.trim(text(x, f"{p}.reference")), F.lit(""))))
    people = F.coalesce(F.transform(items(r, "$.participant"), lambda x: named(x, "$.individual")), F.array().cast("array<string>"))
    doers = F.coalesce(F.transform(items(r, "$.performer"), lambda x: F.when(get(x, "$.actor", "variant").isNotNull(), named(x, "$.actor")).otherwise(named(x, "$"))), F.array().cast("array<string>"))
    return F.get(F.filter(F.concat(people, doers), lambda x: x.isNotNull()), F.lit(0))


def format_number(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def reading(r: Column | str | Fields, display: Column) -> Column:
    """struct(value, value_text, unit, ref_low, ref_high, interpretation) of an observation."""
    value = number(r, "$.valueQuantity.value")
    parts = F.filter(F.transform(items(r, "$.component"), lambda c: format_number(number(c, "$.valueQuantity.value"))), lambda x: x.isNotNull())
    pair = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "/"))
    said = F.coalesce(text(r, "$.valueString"), pair, text(r, "$.valueCodeableConcept.text"), first_of(r, "$.valueCodeableConcept.coding", "$.display", "$.code"), display)
    return F.struct(
        value.alias("value"),
        F.when(value.isNull(), said).alias("value_text"),
        F.when(value.isNotNull(), F.coalesce(text(r, "$.valueQuantity.unit"), F.lit(""))).otherwise("").alias("unit"),
        number(r, "$.referenceRange[0].low.value").alias("ref_low"),
        number(r, "$.referenceRange[0].high.value").alias("ref_high"),
        F.coalesce(text(r, "$.interpretation[0].coding[0].code"), F.lit("")).alias("interpretation"),
    )


def source_label(source_format: Column, source_system: Column) -> Column:
    """A system's own name unless it is a machine identifier, else the format's label, else the token in words."""
    system = F.trim(source_system)
    machine = F.lower(system).rlike(r"^(urn:|https?://|oid:)") | (system.rlike(r"^[0-9.]+$") & system.contains(".")) | (system == "")
    labels = _map(SOURCE_LABELS)
    named = F.when(source_system.isNotNull() & ~machine, F.coalesce(labels[F.lower(system)], system))
    return F.coalesce(named, labels[F.lower(F.trim(source_format))], F.initcap(F.replace(source_format, F.lit("_"), F.lit(" "))), F.lit("Unknown"))


def identity(r: Column | str | Fields, source_format: Column, kind: Column | None = None) -> Column:
    """struct(source_system, external_id) from identifiers, else the id; null where there is none to rely on."""
    kind = resource_type(r) if kind is None else kind
    some = lambda x: F.nullif(x, F.lit(""))
    given = get(r, "$.identifier", TYPES["identifier"])
    parts = lambda x: F.struct(some(x["system"]).alias("s"), some(x["value"]).alias("v"))
    ids, first = F.transform(given, parts), parts(F.get(given, F.lit(0)))
    acts = F.get(F.filter(ids, lambda x: x["v"].isNotNull() & ~F.coalesce(F.regexp_replace(x["s"], "^urn:oid:", ""), F.lit("")).isin(*PERSON_ROOTS)), F.lit(0))
    own = text(r, "$.id")
    make = lambda system, value: F.struct(system.alias("source_system"), F.concat(kind, F.lit("/"), value).alias("external_id"))
    fhir = F.when(first["v"].isNotNull(), make(F.coalesce(first["s"], F.lit("fhir")), first["v"])).when(own.isNotNull(), make(F.lit("fhir"), own))
    is_text = F.schema_of_variant(get(r, "$.id", "variant")) == "STRING"
    cda = F.when(acts["v"].isNotNull(), make(F.coalesce(acts["s"], F.lit("cda")), acts["v"])).when(is_text & ~own.contains("-"), make(F.lit("cda"), own))
    return F.when(kind.isNotNull(), F.when(source_format == "fhir_r4", fhir).when(source_format == "cda_r2", cda))


def resource_hash(r: Column | str | Fields | Part) -> Column:
    """SHA-256 of the resource without volatile fields; JSON of a variant has its keys sorted."""
    # A line that does not count is null, which is left out of the join.
    lines = lambda kv, skip, mark="": F.sort_array(F.map_values(F.transform_values(kv, lambda k, v: F.when(~k.isin(*skip), F.concat(F.lit(mark), k, F.lit(":"), F.to_json(v))))))
    plain = lines(r.column if isinstance(r, Fields) else get(r, "$", "map<string,variant>"), [*VOLATILE, "meta"])
    extra = lines(get(r, "$.meta", "map<string,variant>"), VOLATILE_META, "meta.")
    return F.sha2(F.array_join(F.concat(plain, F.coalesce(extra, F.array().cast("array<string>"))), "\n"), 256)


ABNORMAL = {"H": "HIGH", "L": "LOW", "HH": "CRIT HIGH", "LL": "CRIT LOW", "HU": "HIGH", "LU": "LOW", "A": "ABNORMAL", "AA": "CRIT ABNORMAL", "POS": "POSITIVE", "DET": "DETECTED"}
NORMAL = ["N", "NR", "WNL", "NEG", "ND"]
ENCOUNTER_CLASSES = {"AMB": "Ambulatory", "IMP": "Inpatient", "EMER": "Emergency", "VR": "Virtual", "HH": "Home Health", "OBSENC": "Observation", "ACUTE": "Acute", "SS": "Short Stay", "PRENC": "Pre-admission", "NONAC": "Non-acute", "FLD": "Field"}
MUTED = ["stopped", "completed", "cancelled", "inactive", "resolved", "remission", "not-done", "entered-in-error", "on-hold"]


def _concept(x: Column | str | Fields, path: str) -> Column:
    return F.trim(F.coalesce(text(x, f"{path}.text"), first_of(x, f"{path}.coding", "$.display", "$.code")))


def _facets(*parts: Column) -> Column:
    """Arrays of facets in order, each once, without nulls."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(p, empty) for p in parts]), lambda x: x.isNotNull()))


def _concepts(r: Column | str | Fields, path: str) -> Column:
    return F.transform(items(r, path), lambda x: _concept(x, "$"))


def preview(r: Column | str | Fields, kind: Column) -> Column:
    """struct(value, unit, flag, emphasis, facets, low, high) for a timeline row; null when there is nothing to show."""
    upper = lambda s: F.replace(F.upper(s), F.lit("-"), F.lit(" "))
    muted = lambda s: F.when(F.lower(s).isin(*MUTED), "muted").otherwise("normal")
    null = F.lit(None).cast("string")
    status_ = F.lower(text(r, "$.status"))
    clinical = F.lower(text(r, "$.clinicalStatus.coding[0].code"))
    quantity = format_number(get(r, "$.valueQuantity.value", "double"))
    unit = F.nullif(F.trim(text(r, "$.valueQuantity.unit")), F.lit(""))
    known = F.filter(F.flatten(F.transform(items(r, "$.category"), lambda c: F.coalesce(F.transform(items(c, "$.coding"), lambda x: F.lower(text(x, "$.code"))), F.array().cast("array<string>")))), lambda x: x.isin("laboratory", "vital-signs", "social-history"))
    category = F.coalesce(F.get(known, F.lit(0)), F.lit("laboratory"))
    marks = F.transform(items(r, "$.interpretation"), lambda i: F.upper(first_of(i, "$.coding", "$.code")))
    odd = F.filter(marks, lambda m: m.isin(*ABNORMAL))
    last_told = F.try_element_at(F.filter(marks, lambda m: m.isin(*ABNORMAL, *NORMAL)), F.lit(-1))
    low, high = get(r, "$.referenceRange[0].low.value", "double"), get(r, "$.referenceRange[0].high.value", "double")
    gauge = low.isNotNull() & high.isNotNull() & (low != high) & quantity.isNotNull()
    part = lambda code: F.get(F.filter(F.transform(items(r, "$.component"), lambda c: F.when(first_of(c, "$.code.coding", "$.code") == code, format_number(get(c, "$.valueQuantity.value", "double")))), lambda x: x.isNotNull()), F.lit(0))
    part_unit = F.trim(first_of(r, "$.component", "$.valueQuantity.unit"))
    pressure = F.concat(part("8480-6"), F.lit("/"), part("8462-4"))
    onset = F.coalesce(text(r, "$.onsetDateTime"), text(r, "$.onsetString"), text(r, "$.onsetPeriod.start"))
    onset_facet = F.concat(F.lit("onset "), F.when(onset.rlike(r"^\d{4}"), F.left(onset, F.lit(4))).otherwise(onset))
    verified = F.lower(text(r, "$.verificationStatus.coding[0].code"))
    negated = F.coalesce(verified.isin("refuted", "entered-in-error"), F.lit(False))
    doses = F.filter(F.transform(items(r, "$.dosageInstruction[0].doseAndRate"), lambda d: F.trim(F.concat_ws(" ", format_number(get(d, "$.doseQuantity.value", "double")), text(d, "$.doseQuantity.unit")))), lambda x: x != "")
    crit = F.lower(text(r, "$.criticality"))
    critical = F.coalesce(crit.isin("high", "low"), F.lit(False))
    reactions = F.flatten(F.transform(items(r, "$.reaction"), lambda x: F.coalesce(F.transform(items(x, "$.manifestation"), lambda m: _concept(m, "$")), F.array().cast("array<string>"))))
    dose_number = F.concat(F.lit("dose "), first_of(r, "$.protocolApplied", "$.doseNumberPositiveInt", "$.doseNumberString"))
    given = F.trim(F.concat_ws(" ", F.coalesce(format_number(get(r, "$.doseQuantity.value", "double")), text(r, "$.doseQuantity.value")), text(r, "$.doseQuantity.unit")))
    conclusion = F.trim(text(r, "$.conclusion"))
    snippet = F.concat(F.left(conclusion, F.lit(80)), F.when(F.length(conclusion) > 80, "…").otherwise(""))
    modality = F.transform(items(r, "$.series"), lambda s: _concept(s, "$.modality"))

    def make(value=null, unit=null, flag=null, emphasis=F.lit("normal"), facets=None, low=None, high=None):
        none = F.lit(None).cast("double")
        return F.struct(value.alias("value"), unit.alias("unit"), flag.alias("flag"), emphasis.alias("emphasis"), (facets if facets is not None else F.array().cast("array<string>")).alias("facets"), (low if low is not None else none).alias("low"), (high if high is not None else none).alias("high"))

    lab = make(F.coalesce(quantity, F.trim(text(r, "$.valueString"))), unit, _map(ABNORMAL)[F.try_element_at(odd, F.lit(-1))], F.when(last_told.isin(*ABNORMAL), "notable").otherwise("normal"), None, F.when(gauge, low), F.when(gauge, high))
    vital = F.when(pressure.isNotNull(), make(pressure, part_unit)).otherwise(make(quantity, unit))
    social = make(F.coalesce(_concept(r, "$.valueCodeableConcept"), F.trim(text(r, "$.valueString")), quantity))
    imaging = make(flag=upper(status_), facets=F.slice(_facets(F.array(snippet), _concepts(r, "$.category"), modality), 1, 3))
    found = (
        F.when((kind == "observation") & (category == "vital-signs"), vital)
        .when((kind == "observation") & (category == "social-history"), social)
        .when(kind == "observation", lab)
        .when(kind == "condition", make(flag=F.when(negated, "NEGATED").otherwise(upper(clinical)), emphasis=F.when(negated, "muted").otherwise(muted(clinical)), facets=_facets(F.array(onset_facet))))
        .when(kind == "medication", make(F.get(doses, F.lit(0)), flag=upper(status_), emphasis=muted(status_), facets=_facets(F.array(_concept(r, "$.dosageInstruction[0].route"), _concept(r, "$.dosageInstruction[0].timing.code")))))
        .when(kind == "allergy", make(flag=F.when(critical, F.upper(crit)).otherwise(F.upper(clinical)), emphasis=F.when(critical, F.when(crit == "high", "notable").otherwise("normal")).otherwise(muted(clinical)), facets=_facets(reactions)))
        .when(kind == "procedure", make(flag=upper(status_), emphasis=muted(status_), facets=_facets(F.array(_concept(r, "$.outcome")), _concepts(r, "$.bodySite"))))
        .when(kind == "immunization", make(F.nullif(given, F.lit("")), flag=upper(status_), emphasis=muted(status_), facets=_facets(F.array(dose_number))))
        .when(kind == "encounter", make(flag=F.coalesce(_map(ENCOUNTER_CLASSES)[F.upper(text(r, "$.class.code"))], text(r, "$.class.display")), facets=_facets(_concepts(r, "$.reasonCode"))))
        .when(kind.isin("imaging", "diagnostic_report"), imaging)
    )
    return F.when(F.coalesce(found["value"], found["flag"], F.get(found["facets"], F.lit(0)), found["low"].cast("string")).isNotNull(), found)


def record_title(r: Column | str | Fields, display: Column, kind: Column) -> Column:
    """A title for people: the display text unless it is a bare resource type, else from the resource, else the record type in words."""
    shown = F.nullif(F.trim(display), F.lit(""))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    derived = [F.coalesce(some(text(r, f"$.{p}.text")), some(first_of(r, f"$.{p}.coding", "$.display", "$.code"))) for p in ("code", "vaccineCode", "medicationCodeableConcept", "type[0]", "type", "medication")]
    words = F.replace(kind, F.lit("_"), F.lit(" "))
    named = F.when(kind == "imaging", "Imaging study").when(kind.isin(*RECORD_TYPES.values()), F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 100)))
    return F.coalesce(F.when(~shown.isin(*RECORD_TYPES), shown), *derived, some(text(r, "$.description")), some(text(r, "$.title")), named, shown, resource_type(r), F.lit("Record"))


def observation_subtype(category: Column) -> Column:
    """vital, social or lab: what the first telling category says, lab if none does."""
    told = F.transform(category, lambda c: F.when(c.rlike("(?i)vital"), "vital").when(c.rlike("(?i)social"), "social").when(c.rlike("(?i)lab"), "lab"))
    return F.coalesce(F.get(F.filter(told, lambda x: x.isNotNull()), F.lit(0)), F.lit("lab"))


def project(resources: DataFrame, r: str = "resource", source_format: str = "fhir_r4", only: str | None = None) -> DataFrame:
    """Resources (VARIANT column ``r``) to canonical record columns; types that are no records are dropped.

    ``only`` names the type where all resources have one, which leaves the
    rules of other types out of the plan.
    """
    # The filter would be pushed below a parse and repeat it; as an exploded column the resource is parsed once.
    rows = resources.withColumn(r, F.explode(F.array(r))).withColumn("_fields", F.explode(F.array(fields(r))))
    f = Fields(F.col("_fields"))
    if only:
        rows = rows.withColumn("fhir_resource_type", F.lit(only)).withColumn("record_type", F.lit(RECORD_TYPES[only]))
    else:
        rows = rows.withColumn("fhir_resource_type", resource_type(f)).withColumn("record_type", _map(RECORD_TYPES)[F.col("fhir_resource_type")]).filter(F.col("record_type").isNotNull())
    kind = F.col("fhir_resource_type")
    rows = rows.withColumn("coding", coding(f)).withColumn("identity", identity(f, F.lit(source_format), kind))
    return rows.select(
        *[c for c in resources.columns],
        "record_type",
        "fhir_resource_type",
        F.lit(source_format).alias("source_format"),
        effective_date(f).alias("effective_date"),
        effective_date_end(f).alias("effective_date_end"),
        status(f).alias("status"),
        categories(f).alias("category"),
        "coding.*",
        display_text(f, kind).alias("display_text"),
        "identity.source_system",
        "identity.external_id",
        resource_hash(f).alias("content_hash"),
    )


#: Parts of names of facilities, and of rooms, which are none.
FACILITIES = ["hospital", "clinic", "medical", "health", "center", "centre", "associates", "group", "practice", "pharmacy", "laborator", "imaging", "radiology", "institute", "department", "dept", "medicine", "care", "physicians", "specialists", "oncology", "cardiology", "orthopedic", "surgery", "urgent"]
ROOMS = ["room", "rm ", " rm", "bed", "exam", "suite", "floor", "wing", "bay", "chair", "cubicle", "pod ", "ward"]
#: Fields that name people, which no judge is shown.
PERSONAL = ["subject", "patient", "performer", "author", "recorder", "requester", "asserter", "participant", "informant", "text"]
NO_CONTENT = ["resourceType", "_extraction_metadata"]


def is_facility(name: Column) -> Column:
    low = F.lower(name)
    has = lambda words: low.rlike("|".join(words))
    return F.coalesce(has(FACILITIES) & ~has(ROOMS), F.lit(False))


def with_service_provider(resource_json: Column) -> Column:
    """An encounter's JSON with the first of its locations that names a facility as its service provider, if it has none."""
    places = F.from_json(F.get_json_object(resource_json, "$.location"), "array<struct<location:struct<display:string>>>")
    names = F.filter(F.transform(places, lambda p: p["location"]["display"]), is_facility)
    first = F.get(names, F.lit(0))
    open_ended = F.regexp_replace(resource_json, r"\}\s*$", "")
    named = F.concat(open_ended, F.lit(',"serviceProvider":'), F.to_json(F.struct(first.alias("display"))), F.lit("}"))
    lacks = (F.get_json_object(resource_json, "$.resourceType") == "Encounter") & F.get_json_object(resource_json, "$.serviceProvider").isNull()
    return F.when(lacks & first.isNotNull(), named).otherwise(resource_json)


def top_fields(resource_json: Column) -> Column:
    """The fields of a resource as map<string,variant>."""
    return F.from_json(resource_json, "map<string,variant>")


def judged_text(resource_json: Column, scrub) -> Column:
    """What a judge is shown of a resource: without fields that name people, and scrubbed."""
    return scrub(F.to_json(F.map_filter(top_fields(resource_json), lambda k, v: ~k.isin(*PERSONAL))))


def populated_fields(resource_json: Column) -> Column:
    """How many fields besides type and metadata have a value (empty texts and lists, zero, false and null are none)."""
    empty = ["", "[]", "{}", "0", "0.0", "false", "null"]
    return F.size(F.map_filter(top_fields(resource_json), lambda k, v: ~k.isin(*NO_CONTENT) & F.coalesce(~F.to_json(v).isin(*empty, '""'), F.lit(False))))
