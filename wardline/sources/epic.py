"""Epic EHI tables (TSV) as FHIR resources, then records.

Each table is a function from trimmed columns to a resource struct; a row whose
gate is null is dropped. Structs become JSON without null fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.clinical import parse_dosage
from wardline.functions.fhir import project

FORMATS = ["M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss a", "M/d/yyyy", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss"]
TERMINOLOGY = "http://terminology.hl7.org/CodeSystem/"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One TSV table, all text; short rows get nulls, a byte order mark is dropped."""
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)


class Row:
    """Trimmed columns of a table; missing columns and blanks are null."""

    def __init__(self, df: DataFrame):
        self.columns = {c.upper(): c for c in df.columns}

    def __call__(self, *names: str) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{self.columns[n]}`")), F.lit("")) for n in names if n in self.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def date(self, *names: str) -> Column:
        value = self(*names)
        parsed = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in FORMATS])
        return F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss")


def _has(x: Column, *words: str) -> Column:
    low = F.lower(x)
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(low.contains(w), F.lit(False))
    return out


def _first(default: str, *rules: tuple[Column, str]) -> Column:
    out = F
    for test, value in rules:
        out = out.when(test, value)
    return out.otherwise(default)


def _text(x: Column) -> Column:
    """{"text": x}, or nothing."""
    return F.when(x.isNotNull(), F.struct(x.alias("text")))


def _shown(x: Column) -> Column:
    return F.when(x.isNotNull(), F.struct(x.alias("display")))


def _list(x: Column) -> Column:
    return F.when(x.isNotNull(), F.array(x))


def _coded(system: str, code: Column, display: str | None = None) -> Column:
    fields = [F.lit(TERMINOLOGY + system).alias("system"), code.alias("code")]
    return F.struct(F.array(F.struct(*fields, *([F.lit(display).alias("display")] if display else []))).alias("coding"))


def _period(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() | end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def _resource(kind: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("resourceType"), *[v.alias(k) for k, v in fields.items()]))


def _problem(r: Row):
    resolved = r.date("RESOLVED_DATE")
    state = r("PROBLEM_STATUS_C_NAME")
    clinical = _first("active", (_has(state, "resolved") | resolved.isNotNull(), "resolved"), (_has(state, "inactive"), "inactive"))
    kind = _coded("condition-category", F.lit("problem-list-item"), "Problem List Item")
    listed = F.struct(kind["coding"].alias("coding"), F.lit(None).cast("string").alias("text"))
    chronic = F.struct(F.lit(None).cast(listed_type()).alias("coding"), F.lit("chronic").alias("text"))
    gate = r("DESCRIPTION", "DX_ID_DX_NAME")
    return gate, _resource("Condition", code=_text(gate), clinicalStatus=_coded("condition-clinical", clinical), category=F.when(r("CHRONIC_YN") == "Y", F.array(listed, chronic)).otherwise(F.array(listed)), onsetDateTime=r.date("NOTED_DATE"), abatementDateTime=resolved, note=_list(_text(r("PROBLEM_CMT"))))


def listed_type() -> str:
    return "array<struct<system:string,code:string,display:string>>"


def _medical_history(r: Row):
    gate = r("DX_ID_DX_NAME")
    category = F.struct(_coded("condition-category", F.lit("problem-list-item"))["coding"].alias("coding"), F.lit("Medical History").alias("text"))
    return gate, _resource("Condition", code=_text(gate), clinicalStatus=_coded("condition-clinical", F.lit("active")), category=F.array(category), onsetDateTime=r.date("MEDICAL_HX_DATE"), note=_list(_text(r("MED_HX_ANNOTATION"))))


def _order_med(r: Row):
    gate = r("DISPLAY_NAME", "MEDICATION_ID_MEDICATION_NAME")
    state = r("ORDER_STATUS_C_NAME")
    sig = r("DOSAGE", "DESCRIPTION")
    d = parse_dosage(sig)
    rate = F.when(d["dose_value"].isNotNull(), F.array(F.struct(F.struct(d["dose_value"].alias("value"), d["dose_unit"].alias("unit")).alias("doseQuantity"))))
    timing = F.when(d["frequency"].isNotNull(), F.struct(F.struct(d["frequency"].alias("frequency"), d["period"].alias("period"), d["period_unit"].alias("periodUnit")).alias("repeat")))
    as_needed = F.when(d["frequency"].isNull() & d["as_needed"], F.lit(True))
    dosage = F.when(sig.isNotNull(), F.array(F.struct(sig.alias("text"), rate.alias("doseAndRate"), timing.alias("timing"), as_needed.alias("asNeeded"), _text(r("MED_ROUTE_C_NAME")).alias("route"))))
    quantity, refills = r("QUANTITY"), r("REFILLS")
    dispense = F.when(quantity.isNotNull() | refills.isNotNull(), F.struct(F.when(quantity.isNotNull(), F.struct(quantity.alias("value"))).alias("quantity"), refills.alias("numberOfRepeatsAllowed")))
    return gate, _resource("MedicationRequest", status=_first("active", (_has(state, "completed", "sent"), "completed"), (_has(state, "cancel", "discontinue"), "cancelled")), intent=F.lit("order"), medicationCodeableConcept=_text(gate), category=F.array(_text(F.lit("community"))), authoredOn=r.date("ORDERING_DATE"), dosageInstruction=dosage, dispenseRequest=dispense, effectivePeriod=_period(r.date("START_DATE"), r.date("END_DATE")), requester=_shown(r("MED_PRESC_PROV_ID_PROV_NAME")))


def _order_result(r: Row):
    gate, state, flag = r("COMPONENT_ID_NAME"), r("RESULT_STATUS_C_NAME"), F.lower(r("RESULT_FLAG_C_NAME"))
    unit = F.coalesce(r("REFERENCE_UNIT"), F.lit(""))
    quantity = lambda x: F.when(x.try_cast("double").isNotNull(), F.struct(x.try_cast("double").alias("value"), unit.alias("unit")))
    value = quantity(r("ORD_NUM_VALUE"))
    low, high = quantity(r("REFERENCE_LOW")), quantity(r("REFERENCE_HIGH"))
    mark = F.when(_has(flag, "high") | (flag == "h"), "H").when(_has(flag, "low") | (flag == "l"), "L").when(_has(flag, "abnormal"), "A").otherwise("N")
    loinc = r("COMPON_LNC_ID_LNC_LONG_NAME")
    code = F.struct(gate.alias("text"), F.when(loinc.isNotNull(), F.array(F.struct(F.lit("http://loinc.org").alias("system"), loinc.alias("display")))).alias("coding"))
    return gate, _resource("Observation", status=_first("final", (_has(state, "preliminary"), "preliminary"), (_has(state, "corrected"), "corrected")), category=F.array(_coded("observation-category", F.lit("laboratory"), "Laboratory")), code=code, effectiveDateTime=r.date("RESULT_DATE"), valueQuantity=value, valueString=F.when(value.isNull(), r("ORD_VALUE")), referenceRange=F.when(low.isNotNull() | high.isNotNull(), F.array(F.struct(low.alias("low"), high.alias("high")))), interpretation=F.when(flag.isNotNull(), F.array(_coded("v3-ObservationInterpretation", mark))))


def _encounter(r: Row):
    gate, state, money = r.date("CONTACT_DATE"), r("APPT_STATUS_C_NAME"), r("FIN_CLASS_C_NAME")
    dept = r("DEPARTMENT_ID_EXTERNAL_NAME")
    who, title = r("VISIT_PROV_ID_PROV_NAME", "PCP_PROV_ID_PROV_NAME"), r("VISIT_PROV_TITLE_NAME")
    shown = F.when(who.isNotNull(), F.concat_ws(", ", who, title))
    status = _first("finished", (_has(state, "complete"), "finished"), (_has(state, "cancelled", "canceled", "no show"), "cancelled"), (_has(state, "scheduled"), "planned"))
    return gate, _resource("Encounter", status=status, **{"class": F.struct(_first("AMB", (_has(money, "inpatient"), "IMP"), (_has(money, "emergency"), "EMER")).alias("code"))}, period=F.struct(gate.alias("start"), r.date("HOSP_DISCHRG_TIME").alias("end")), type=_list(_text(r("ENC_TYPE_C_NAME", "APPT_PRC_ID_PRC_NAME"))), location=F.when(dept.isNotNull(), F.array(F.struct(_shown(dept).alias("location")))), serviceProvider=_shown(r("LOC_ID_LOC_NAME", "DEPARTMENT_ID_DEPARTMENT_NAME", "DEPARTMENT_ID_EXTERNAL_NAME")), participant=F.when(shown.isNotNull(), F.array(F.struct(_shown(shown).alias("individual")))), reasonCode=_list(_text(r("CONTACT_COMMENT"))))


def _document(r: Row):
    gate, state = r("DOC_INFO_TYPE_C_NAME"), r("DOC_STAT_C_NAME")
    return gate, _resource("DocumentReference", status=_first("current", (_has(state, "inactive", "deleted"), "superseded")), type=_text(gate), description=F.coalesce(r("DOC_DESCR"), gate), date=r.date("DOC_RECV_TIME"), author=_list(_shown(r("RECV_BY_USER_ID_NAME"))), category=F.when(r("IS_SCANNED_YN") == "Y", F.array(_text(F.lit("scanned")))))


def _allergy(r: Row):
    gate, state, how = r("ALLERGEN_ID_ALLERGEN_NAME"), r("ALRGY_STATUS_C_NAME"), r("SEVERITY_C_NAME")
    severity = F.when(_has(how, "severe", "high"), "severe").when(_has(how, "moderate"), "moderate").when(_has(how, "mild", "low"), "mild")
    reaction = r("REACTION")
    seen = F.when(reaction.isNotNull() | severity.isNotNull(), F.array(F.struct(_list(_text(reaction)).alias("manifestation"), severity.alias("severity"))))
    return gate, _resource("AllergyIntolerance", code=_text(gate), clinicalStatus=_coded("allergyintolerance-clinical", _first("active", (_has(state, "inactive", "deleted"), "inactive"), (_has(state, "resolved"), "resolved"))), recordedDate=r.date("DATE_NOTED"), reaction=seen)


def _immunization(r: Row):
    gate, state, dose = r("IMMUNZATN_ID_NAME"), r("IMMNZTN_STATUS_C_NAME"), r("DOSE")
    return gate, _resource("Immunization", status=_first("completed", (_has(state, "not done", "refused"), "not-done"), (_has(state, "entered-in-error"), "entered-in-error")), vaccineCode=_text(gate), occurrenceDateTime=r.date("IMMUNE_DATE"), doseQuantity=F.when(dose.isNotNull(), F.struct(dose.alias("value"))), route=_text(r("ROUTE_C_NAME")), site=_text(r("SITE_C_NAME")), manufacturer=_shown(r("MFG_C_NAME")), lotNumber=r("LOT"))


def _procedure(r: Row):
    gate, state = r("DESCRIPTION", "PROC_NAME", "ORDER_TYPE_C_NAME", "DISPLAY_NAME"), r("ORDER_STATUS_C_NAME")
    doer = r("AUTHRZING_PROV_ID_PROV_NAME", "ORD_PROV_ID_PROV_NAME")
    return gate, _resource("Procedure", status=_first("completed", (_has(state, "pending", "ordered"), "preparation"), (_has(state, "cancel", "discontinue"), "not-done"), (_has(state, "in progress"), "in-progress")), code=_text(gate), performedDateTime=r.date("ORDER_INST", "ORDERING_DATE", "ORDER_DATE"), performer=F.when(doer.isNotNull(), F.array(F.struct(_shown(doer).alias("actor")))))


def _vital(r: Row):
    name, value = r("FLO_MEAS_NAME", "DISP_NAME", "FLO_MEAS_ID_FLO_MEAS_NAME"), r("MEAS_VALUE")
    n = value.try_cast("double")
    return F.when(value.isNotNull(), name), _resource("Observation", status=F.lit("final"), category=F.array(_coded("observation-category", F.lit("vital-signs"), "Vital Signs")), code=_text(name), effectiveDateTime=r.date("RECORDED_TIME", "ENTRY_TIME"), valueQuantity=F.when(n.isNotNull(), F.struct(n.alias("value"), F.coalesce(r("UNITS"), F.lit("")).alias("unit"))), valueString=F.when(n.isNull(), value))


def _referral(r: Row):
    reason, to, state = r("RSN_FOR_RFL_C_NAME"), r("REFERRAL_PROV_ID_PROV_NAME"), r("RFL_STATUS_C_NAME")
    start = r.date("START_DATE")
    return F.coalesce(reason, to), _resource("ServiceRequest", status=_first("active", (_has(state, "completed", "closed"), "completed"), (_has(state, "cancelled", "canceled"), "revoked"), (_has(state, "pending"), "draft")), intent=F.lit("order"), category=F.array(_text(F.lit("referral"))), code=_text(reason), authoredOn=start, occurrencePeriod=_period(start, r.date("EXP_DATE")), requester=_shown(r("REFERRING_PROV_ID_REFERRING_PROV_NAM")), performer=_list(_shown(to)))


def _encounter_dx(r: Row):
    gate = r("DX_ID_DX_NAME")
    return gate, _resource("Condition", code=_text(gate), clinicalStatus=_coded("condition-clinical", F.lit("active")), category=F.array(_coded("condition-category", F.lit("encounter-diagnosis"), "Encounter Diagnosis")), recordedDate=r.date("CONTACT_DATE"), _primaryDiagnosis=F.when(r("PRIMARY_DX_YN") == "Y", F.lit(True)), note=_list(_text(r("ANNOTATION"))))


def _social(r: Row):
    kind, value = r("SOCIAL_HX_TYPE_C_NAME", "HX_TYPE", "TOBACCO_USER_C_NAME"), r("SOCIAL_HX_COMMENT", "COMMENT", "SMOKING_TOBA_USE_C_NAME")
    return F.coalesce(kind, value), _resource("Observation", status=F.lit("final"), category=F.array(_coded("observation-category", F.lit("social-history"), "Social History")), code=_text(F.coalesce(kind, F.lit("Social History"))), effectiveDateTime=r.date("CONTACT_DATE", "ENTRY_DATE"), valueString=value)


def _family(r: Row):
    gate, age = r("FAM_MEDICAL_DX_ID_DX_NAME"), r("AGE_OF_ONSET")
    years = age.try_cast("int")
    onset = F.when(years.isNotNull(), F.struct(years.alias("value"), F.lit("years").alias("unit"), F.lit("http://unitsofmeasure.org").alias("system"), F.lit("a").alias("code")))
    return gate, _resource("FamilyMemberHistory", status=F.lit("completed"), relationship=_text(r("RELATION_C_NAME")), condition=F.array(F.struct(_text(gate).alias("code"), onset.alias("onsetAge"), F.when(years.isNull(), age).alias("onsetString"))))


#: Table name: mapper, the columns of its identity and the type of its resources.
TABLES: dict[str, tuple[Callable[[Row], tuple[Column, Column]], list[str], str]] = {
    "PROBLEM_LIST": (_problem, ["PROBLEM_LIST_ID"], "Condition"),
    "PROBLEM_LIST_ALL": (_problem, ["PROBLEM_LIST_ID"], "Condition"),
    "MEDICAL_HX": (_medical_history, ["PAT_ENC_CSN_ID", "LINE"], "Condition"),
    "ORDER_MED": (_order_med, ["ORDER_MED_ID"], "MedicationRequest"),
    "ORDER_RESULTS": (_order_result, ["ORDER_PROC_ID", "LINE"], "Observation"),
    "PAT_ENC": (_encounter, ["PAT_ENC_CSN_ID"], "Encounter"),
    "DOC_INFORMATION": (_document, ["DOC_INFO_ID"], "DocumentReference"),
    "ALLERGY": (_allergy, ["ALLERGY_ID"], "AllergyIntolerance"),
    "IMMUNE": (_immunization, ["IMMUNE_ID"], "Immunization"),
    "ORDER_PROC": (_procedure, ["ORDER_PROC_ID"], "Procedure"),
    "IP_FLWSHT_MEAS": (_vital, ["FSD_ID", "LINE"], "Observation"),
    "REFERRAL": (_referral, ["REFERRAL_ID"], "ServiceRequest"),
    "PAT_ENC_DX": (_encounter_dx, ["PAT_ENC_CSN_ID", "LINE"], "Condition"),
    "SOCIAL_HX": (_social, ["PAT_ENC_CSN_ID", "CONTACT_DATE"], "Observation"),
    "FAMILY_HX": (_family, ["PAT_ENC_CSN_ID", "LINE"], "FamilyMemberHistory"),
}


def to_resources(df: DataFrame, table_name: str) -> DataFrame:
    """(resource_json, source_system, external_id) of a table's rows; rows that can't be mapped are dropped.

    A row with a blank among its identity columns has no identity.
    """
    mapper, key, _ = TABLES[table_name.upper()]
    row = Row(df)
    gate, resource = mapper(row)
    parts = [row(k) for k in key]
    known = F.lit(True)
    for p in parts:
        known = known & p.isNotNull()
    return df.filter(gate.isNotNull()).select(resource.alias("resource_json"), F.when(known, F.lit(f"epic:{table_name.upper()}")).alias("source_system"), F.when(known, F.concat_ws("|", *parts)).alias("external_id"))


def records(spark: SparkSession, path: str, table_name: str) -> DataFrame:
    """Record rows of one table. Family history, no record type of its own, becomes a condition."""
    rows = to_resources(read(spark, path), table_name).withColumnsRenamed({"source_system": "epic_system", "external_id": "epic_id"}).withColumn("resource", F.parse_json("resource_json"))
    if table_name.upper() == "FAMILY_HX":
        from wardline.functions.fhir import display_text, resource_hash, status

        return rows.select(F.lit("condition").alias("record_type"), F.lit("FamilyMemberHistory").alias("fhir_resource_type"), display_text("resource", F.lit("FamilyMemberHistory")).alias("display_text"), status("resource").alias("status"), F.lit(None).cast("timestamp").alias("effective_date"), F.col("epic_system").alias("source_system"), F.col("epic_id").alias("external_id"), resource_hash("resource").alias("content_hash"), "resource_json")
    p = project(rows, source_format="epic_ehi", only=TABLES[table_name.upper()][2]).drop("source_system", "external_id")
    return p.select("record_type", "fhir_resource_type", "display_text", "status", "effective_date", F.col("epic_system").alias("source_system"), F.col("epic_id").alias("external_id"), "content_hash", "resource_json")


def patient(df: DataFrame) -> DataFrame:
    """Demographics of the first row of PATIENT.tsv, the one of the first file and place; the birth date without its time."""
    r = Row(df)
    place = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    return df.withColumn("_place", place).orderBy("_place").limit(1).select(F.trim(F.regexp_replace(r("PAT_NAME"), r"[\^,|\s]+", " ")).alias("name"), r("PAT_MRN_ID").alias("mrn"), F.substring_index(r("BIRTH_DATE"), " ", 1).alias("birth_date"), r("SEX", "SEX_C_NAME").alias("sex"))
