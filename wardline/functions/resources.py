"""The FHIR resource and the display text of an extracted entity.

Each resource type is one struct, written as JSON; fields without a value are
left out. ``attrs`` is map<string,string>, what the extractor said of an entity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Visit kinds to class codes, relatives to role codes, attribute names of a visit summary.
VISITS = {"office": ("AMB", "ambulatory"), "telehealth": ("VR", "virtual"), "emergency": ("EMER", "emergency"), "inpatient": ("IMP", "inpatient encounter")}
RELATIVES = {
    "mother": ("MTH", "Mother"), "father": ("FTH", "Father"), "sibling": ("SIB", "Sibling"), "sister": ("SIS", "Sister"), "brother": ("BRO", "Brother"),
    "grandmother": ("GRMTH", "Grandmother"), "grandfather": ("GRFTH", "Grandfather"), "grandparent": ("GRPRN", "Grandparent"), "aunt": ("AUNT", "Aunt"), "uncle": ("UNCLE", "Uncle"), "child": ("CHILD", "Child"),
}
SUMMARIES = ["summary", "visit_summary", "chief_complaint", "narrative", "hpi", "history_of_present_illness"]
ONSETS = ["onset_date", "onset", "onset_datetime", "since", "since_date", "diagnosed", "diagnosis_date", "diagnosed_date"]
SYSTEMS = {
    "condition": "http://terminology.hl7.org/CodeSystem/condition-clinical", "allergy": "http://terminology.hl7.org/CodeSystem/allergyintolerance-clinical", "role": "http://terminology.hl7.org/CodeSystem/v3-RoleCode",
    "interpretation": "http://terminology.hl7.org/CodeSystem/v3-ObservationInterpretation", "vaccine": "http://hl7.org/fhir/sid/cvx", "cpt": "http://www.ama-assn.org/go/cpt", "loinc": "http://loinc.org",
}


def _some(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def attr(attrs: Column, *names: str) -> Column:
    """The first of some attributes that is not blank."""
    return F.coalesce(*[_some(F.try_element_at(attrs, F.lit(n))) for n in names])


def title(x: Column) -> Column:
    """Words and parts of hyphenated words with a capital; underscores are blanks."""
    return F.array_join(F.transform(F.split(F.replace(x, F.lit("_"), F.lit(" ")), "-"), F.initcap), "-")


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def narrative(x: Column) -> Column:
    return F.concat(F.lit('<div xmlns="http://www.w3.org/1999/xhtml">'), xml_escape(x), F.lit("</div>"))


def lab_measurement(text: Column, attrs: Column, parsed: Column) -> Column:
    """struct(value, unit, ref_low, ref_high, interpretation, analyte): attributes win, the parsed text fills in."""
    pick = lambda field, *names: F.coalesce(attr(attrs, *names), parsed[field].cast("string")).alias(field)
    return F.struct(pick("value", "value"), pick("unit", "unit", "units"), pick("ref_low", "ref_low", "reference_low", "low"), pick("ref_high", "ref_high", "reference_high", "high"), pick("interpretation", "interpretation", "flag", "abnormal_flag"), F.coalesce(attr(attrs, "test"), parsed["analyte"], text).alias("analyte"))


def _look_up(key: Column, table: dict[str, tuple[str, str]], i: int) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])]), key)


def _if(x: Column, *fields: Column) -> Column:
    """A struct where x has a value."""
    return F.when(x.isNotNull(), F.struct(*fields))


def _list(x: Column) -> Column:
    return F.when(x.isNotNull(), F.array(x))


def _said(x: Column, name: str = "text") -> Column:
    return _if(x, x.alias(name))


def _shown(x: Column) -> Column:
    return _said(x, "display")


def _coding(system: str, code: Column, *more: Column) -> Column:
    return F.array(F.struct(F.lit(SYSTEMS[system]).alias("system"), code.alias("code"), *more))


def dosage(text: Column, attrs: Column, sig: Column) -> Column:
    """A dosage instruction of what text and attributes say; null if they say nothing."""
    dose = _if(sig["dose_value"], F.array(F.struct(F.struct(sig["dose_value"].alias("value"), sig["dose_unit"].alias("unit")).alias("doseQuantity"))).alias("x"))["x"]
    repeat = _if(sig["frequency"], F.struct(sig["frequency"].alias("frequency"), sig["period"].alias("period"), sig["period_unit"].alias("periodUnit")).alias("repeat"))
    route = F.coalesce(attr(attrs, "route"), sig["route"])
    found = sig["dose_value"].isNotNull() | sig["frequency"].isNotNull() | route.isNotNull() | sig["as_needed"]
    return F.when(found, F.struct(F.coalesce(attr(attrs, "dosage", "dose"), F.trim(text)).alias("text"), dose.alias("doseAndRate"), _said(route).alias("route"), repeat.alias("timing"), F.when(sig["as_needed"], F.lit(True)).alias("asNeeded")))


def visit_text(text: Column, attrs: Column) -> Column:
    """What kind of visit an encounter's resource says it is."""
    return F.coalesce(attr(attrs, "visit_description", "encounter_type", "visit_type_text"), F.trim(text))


def visit_fields(text: Column, attrs: Column, provider: Column) -> dict[str, Column]:
    """The fields of an Encounter besides its type, in order; null where it lacks one."""
    visit = F.coalesce(attr(attrs, "visit_type"), F.lit("office"))
    summary, cpt = attr(attrs, *SUMMARIES), attr(attrs, "cpt_code")
    return {
        "status": F.lit("finished"),
        "class": F.struct(F.coalesce(_look_up(visit, VISITS, 0), F.lit("AMB")).alias("code"), F.coalesce(_look_up(visit, VISITS, 1), F.lit("ambulatory")).alias("display")),
        "type": F.array(F.struct(visit_text(text, attrs).alias("text"), F.when(cpt.isNotNull(), _coding("cpt", cpt)).alias("coding"))),
        "reasonCode": _list(_said(attr(attrs, "reason"))),
        "period": _said(attr(attrs, "date"), "start"),
        "participant": _list(_if(provider, _shown(provider).alias("individual"))),
        "serviceProvider": _shown(attr(attrs, "facility", "medical_center", "location", "service_provider", "organization")),
        "text": _if(summary, F.lit("additional").alias("status"), narrative(summary).alias("div")),
    }


def drug_fields(text: Column, attrs: Column, provider: Column, sig: Column) -> dict[str, Column]:
    """The fields of a MedicationRequest besides its type, in order; null where it lacks one."""
    concept = F.struct(F.trim(text).alias("text"))
    return {"status": F.lit("active"), "intent": F.lit("order"), "medicationCodeableConcept": concept, "dosageInstruction": _list(dosage(text, attrs, sig)), "requester": _shown(provider)}


def filled(fields: dict[str, Column]) -> Column:
    """Names of the fields that are there: of an entity with text, those that ``fhir.populated_fields`` counts in its resource."""
    return F.array_compact(F.array(*[F.when(x.isNotNull(), F.lit(name)) for name, x in fields.items()]))


def build(kind: Column, cls: Column, text: Column, attrs: Column, provider: Column, lab: Column, sig: Column) -> Column:
    """JSON of the resource of type ``kind`` for an entity of class ``cls``; ``lab`` and ``sig`` are its text parsed."""
    said = F.trim(text)
    concept = F.struct(said.alias("text"))
    state = F.coalesce(attr(attrs, "status"), F.lit("active"))
    clinical = F.when(state.isin("negated", "ruled_out", "absent"), "inactive").otherwise(state)
    m = lab_measurement(said, attrs, lab)
    number = m["value"].try_cast("double")
    low, high = m["ref_low"].try_cast("double"), m["ref_high"].try_cast("double")
    is_lab, is_social = cls == "lab_result", cls == "social_history"
    done = F.lower(F.coalesce(attr(attrs, "status"), F.lit("")))
    relative = F.coalesce(attr(attrs, "relationship"), F.lit("unknown"))
    cvx = attr(attrs, "cvx", "cvx_code")
    category = F.coalesce(attr(attrs, "category"), F.lit("imaging"))
    fields = {
        "MedicationRequest": [x.alias(name) for name, x in drug_fields(text, attrs, provider, sig).items()],
        "Condition": [F.struct(_coding("condition", clinical).alias("coding")).alias("clinicalStatus"), concept.alias("code"), attr(attrs, *ONSETS).alias("onsetDateTime")],
        "Observation": [
            F.lit("final").alias("status"),
            F.array(F.struct(F.array(F.struct(F.when(is_lab, "laboratory").when(is_social, "social-history").otherwise("vital-signs").alias("code"))).alias("coding"))).alias("category"),
            F.struct(F.when(is_lab, m["analyte"]).when(is_social, title(F.coalesce(attr(attrs, "category"), F.lit("social-history")))).otherwise(F.coalesce(attr(attrs, "type"), said)).alias("text")).alias("code"),
            F.when(is_lab & number.isNotNull(), F.struct(number.alias("value"), m["unit"].alias("unit"))).alias("valueQuantity"),
            F.when(is_lab, F.when(number.isNull(), m["value"])).when(is_social, F.coalesce(attr(attrs, "value"), said)).otherwise(said).alias("valueString"),
            F.when(is_lab & (low.isNotNull() | high.isNotNull()), F.array(F.struct(_said(low, "value").alias("low"), _said(high, "value").alias("high")))).alias("referenceRange"),
            F.when(is_lab & m["interpretation"].isNotNull(), F.array(F.struct(_coding("interpretation", m["interpretation"]).alias("coding")))).alias("interpretation"),
            F.when(is_lab, _list(_shown(provider))).alias("performer"),
        ],
        "Procedure": [F.lit("completed").alias("status"), concept.alias("code"), _list(_if(provider, _shown(provider).alias("actor"))).alias("performer")],
        "ServiceRequest": [F.lit("active").alias("status"), F.lit("order").alias("intent"), F.struct(F.coalesce(attr(attrs, "test"), said).alias("text")).alias("code"), _shown(provider).alias("requester")],
        "AllergyIntolerance": [F.struct(_coding("allergy", F.lit("active")).alias("coding")).alias("clinicalStatus"), concept.alias("code"), _list(_if(attr(attrs, "reaction"), F.array(_said(attr(attrs, "reaction"))).alias("manifestation"))).alias("reaction")],
        "Immunization": [
            F.when(done.rlike("not[ _-]done|refused|declined"), "not-done").when(done.rlike("entered[ -]in[ -]error"), "entered-in-error").otherwise("completed").alias("status"),
            F.struct(F.coalesce(attr(attrs, "vaccine", "vaccine_name", "immunization"), said).alias("text"), F.when(cvx.isNotNull(), _coding("vaccine", cvx)).alias("coding")).alias("vaccineCode"),
            attr(attrs, "occurrence_date", "date_administered", "date").alias("occurrenceDateTime"), _said(attr(attrs, "route")).alias("route"), _said(attr(attrs, "site")).alias("site"), _said(attr(attrs, "dose", "dose_quantity", "dosage"), "value").alias("doseQuantity"),
            _shown(attr(attrs, "manufacturer", "mfg", "maker")).alias("manufacturer"), attr(attrs, "lot", "lot_number", "lotnumber").alias("lotNumber"),
        ],
        "Encounter": [x.alias(name) for name, x in visit_fields(text, attrs, provider).items()],
        "DiagnosticReport": [
            F.lit("final").alias("status"), F.array(F.struct(F.array(F.struct(category.alias("code"), title(category).alias("display"))).alias("coding"))).alias("category"), F.struct(F.coalesce(attr(attrs, "procedure_name"), said).alias("text")).alias("code"),
            attr(attrs, "findings").alias("conclusion"), _list(_said(attr(attrs, "interpretation"))).alias("conclusionCode"), _list(_shown(F.coalesce(provider, attr(attrs, "lab", "performing_lab", "radiologist", "facility")))).alias("performer"),
        ],
        "FamilyMemberHistory": [
            F.lit("completed").alias("status"),
            F.struct(_coding("role", F.coalesce(_look_up(F.lower(relative), RELATIVES, 0), F.lit("FAMMEMB")), F.coalesce(_look_up(F.lower(relative), RELATIVES, 1), title(relative)).alias("display")).alias("coding")).alias("relationship"),
            F.array(F.struct(F.struct(F.coalesce(attr(attrs, "condition"), said).alias("text")).alias("code"), _list(_said(attr(attrs, "notes"))).alias("note"))).alias("condition"),
        ],
        "DocumentReference": [
            F.lit("current").alias("status"), F.struct(_coding("loinc", F.lit("51847-2"), F.lit("Assessment and Plan").alias("display")).alias("coding")).alias("type"),
            F.array(F.struct(F.struct(F.lit("text/plain").alias("contentType"), F.base64(F.encode(text, "utf-8")).alias("data")).alias("attachment"))).alias("content"), attr(attrs, "plan_items").alias("description"),
        ],
    }
    said_of = F.struct(cls.alias("entity_class"), text.alias("original_text"), F.when(F.size(attrs) > 0, attrs).alias("attributes"))
    out = F.lit(None).cast("string")
    for name, columns in fields.items():
        out = F.when(kind == name, F.to_json(F.struct(F.lit(name).alias("resourceType"), *columns, said_of.alias("_extraction_metadata")))).otherwise(out)
    return out


def display(cls: Column, text: Column, attrs: Column) -> Column:
    """What a list shows of an entity, by class."""
    a = lambda *names: attr(attrs, *names)
    said = F.trim(text)
    with_date = lambda x: F.concat(x, F.coalesce(F.concat(F.lit(" ("), a("date"), F.lit(")")), F.lit("")))
    plans = F.size(F.split(a("plan_items"), "; "))
    return (
        F.when(cls == "medication", F.concat_ws(" ", said, F.concat(a("value"), a("unit"))))
        .when(cls == "condition", F.concat(said, F.coalesce(F.concat(F.lit(" ("), a("status"), F.lit(")")), F.lit(""))))
        .when(cls == "lab_result", F.concat(F.coalesce(a("test"), said), F.coalesce(F.concat(F.lit(": "), a("value"), F.coalesce(a("unit"), F.lit(""))), F.lit(""))))
        .when(cls == "procedure", with_date(said))
        .when(cls == "allergy", F.concat_ws(" — ", said, a("reaction")))
        .when(cls == "immunization", with_date(F.coalesce(a("vaccine", "vaccine_name", "immunization"), said)))
        .when(cls == "encounter", F.concat_ws(" — ", F.concat(title(F.coalesce(a("visit_type"), F.lit("visit"))), F.lit(" encounter")), a("date")))
        .when(cls == "imaging_result", F.concat_ws(": ", F.coalesce(a("procedure_name"), said), a("findings")))
        .when(cls == "family_history", F.concat(title(F.coalesce(a("relationship"), F.lit("Family member"))), F.lit(": "), F.coalesce(a("condition"), said)))
        .when(cls == "assessment_plan", F.concat(F.lit("Assessment & Plan"), F.coalesce(F.concat(F.lit(" ("), plans.cast("string"), F.lit(" items)")), F.lit(""))))
        .when(cls == "social_history", F.concat(title(F.coalesce(a("category"), F.lit("Social"))), F.lit(": "), F.coalesce(a("value"), said)))
        .otherwise(said)
    )
