"""CDA documents and XDM manifests through Spark's XML source.

Sections known here: allergies, medications, problems, immunizations, results,
vital signs, procedures, encounters. Each entry becomes a record, each member
of an organizer one of its own. Other sections are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Section code, record type, resource type.
SECTIONS = [("48765-2", "allergy", "AllergyIntolerance"), ("10160-0", "medication", "MedicationRequest"), ("11450-4", "condition", "Condition"), ("11369-6", "immunization", "Immunization"), ("30954-2", "observation", "Observation"), ("8716-3", "observation", "Observation"), ("47519-4", "procedure", "Procedure"), ("46240-8", "encounter", "Encounter")]

_CODE = "STRUCT<_code: STRING, _codeSystem: STRING, _displayName: STRING>"
_MATERIAL = f"STRUCT<manufacturedProduct: STRUCT<manufacturedMaterial: STRUCT<code: {_CODE}>>>"
_VALUE = "STRUCT<_code: STRING, _codeSystem: STRING, _displayName: STRING, _value: STRING, _unit: STRING>"
_TIMED = f"STRUCT<id: ARRAY<STRUCT<_root: STRING, _extension: STRING>>, code: {_CODE}, effectiveTime: STRUCT<_value: STRING, low: STRUCT<_value: STRING>>>"
_OBSERVATION = f"STRUCT<id: ARRAY<STRUCT<_root: STRING, _extension: STRING>>, code: {_CODE}, effectiveTime: STRUCT<_value: STRING, low: STRUCT<_value: STRING>>, value: {_VALUE}, participant: STRUCT<participantRole: STRUCT<playingEntity: STRUCT<code: {_CODE}>>>>"
_ADMIN = f"STRUCT<id: ARRAY<STRUCT<_root: STRING, _extension: STRING>>, effectiveTime: ARRAY<STRUCT<_value: STRING, low: STRUCT<_value: STRING>>>, consumable: {_MATERIAL}>"
SECTION_SCHEMA = f"code {_CODE}, title STRING, entry ARRAY<STRUCT<act: STRUCT<entryRelationship: ARRAY<STRUCT<observation: {_OBSERVATION}>>>, observation: {_OBSERVATION}, organizer: STRUCT<component: ARRAY<STRUCT<observation: {_OBSERVATION}>>>, procedure: {_TIMED}, encounter: {_TIMED}, substanceAdministration: {_ADMIN}>>"
MANIFEST_SCHEMA = "_mimeType STRING, Slot ARRAY<STRUCT<_name: STRING, ValueList: STRUCT<Value: ARRAY<STRING>>>>"


def cda_date(s):
    """HL7 times: yyyyMMdd, with or without a time."""
    return F.coalesce(F.try_to_timestamp(F.left(s, F.lit(8)), F.lit("yyyyMMdd")), F.try_to_timestamp(F.left(s, F.lit(4)), F.lit("yyyy")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Record rows of the known sections of all CDA documents under ``path``."""
    s = spark.read.format("xml").option("rowTag", "section").option("ignoreNamespace", True).schema(SECTION_SCHEMA).load(path)
    s = s.withColumn("file", F.col("_metadata.file_name"))
    kinds = spark.createDataFrame(SECTIONS, "section_code string, record_type string, fhir_resource_type string")
    rows = s.join(F.broadcast(kinds), F.col("code._code") == F.col("section_code")).select("file", "record_type", "fhir_resource_type", F.col("title").alias("source_section"), F.posexplode("entry").alias("pos", "e"))
    single = F.coalesce(F.get(F.col("e.act.entryRelationship.observation"), F.lit(0)), F.col("e.observation"))
    rows = rows.select("*", F.posexplode(F.coalesce(F.col("e.organizer.component.observation"), F.array(single))).alias("part", "seen"))
    kind, seen, given = F.col("record_type"), F.col("seen"), F.col("e.substanceAdministration")
    done = F.when(kind == "encounter", F.col("e.encounter")).otherwise(F.col("e.procedure"))
    plain = lambda c: F.when(c.isNotNull(), F.struct(c["_code"].alias("_code"), c["_codeSystem"].alias("_codeSystem"), c["_displayName"].alias("_displayName")))
    code = (
        F.when(kind == "allergy", F.coalesce(seen["participant"]["participantRole"]["playingEntity"]["code"], plain(seen["value"])))
        .when(kind == "condition", plain(seen["value"]))
        .when(kind == "observation", seen["code"])
        .when(kind.isin("procedure", "encounter"), F.coalesce(done["code"], seen["code"]))
        .otherwise(given["consumable"]["manufacturedProduct"]["manufacturedMaterial"]["code"])
    )
    first = F.get(F.coalesce(seen["id"], done["id"], given["id"]), F.lit(0))
    time = lambda t: F.coalesce(t["low"]["_value"], t["_value"])
    when = F.coalesce(time(seen["effectiveTime"]), time(done["effectiveTime"]), time(F.get(given["effectiveTime"], F.lit(0))))
    measured = F.when(kind == "observation", seen["value"])
    out = rows.withColumns({"code": code, "first": first, "when": when, "measured": measured})
    return out.select("file", "pos", "part", "record_type", "fhir_resource_type", "source_section", F.lit("cda_r2").alias("source_format"), F.concat(F.lit("urn:oid:"), F.col("code._codeSystem")).alias("code_system"), F.col("code._code").alias("code_value"), F.col("code._displayName").alias("display_text"), cda_date(F.col("when")).alias("effective_date"), F.col("measured._value").try_cast("double").alias("value"), F.col("measured._unit").alias("unit"), F.col("first._root").alias("id_root"), F.col("first._extension").alias("id_extension")).filter(F.col("code_value").isNotNull() | F.col("display_text").isNotNull())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Documents of XDM manifests: uri, hash, size, creation_time, mime_type, patient_id, patient_name, patient_dob."""
    m = spark.read.format("xml").option("rowTag", "ExtrinsicObject").option("ignoreNamespace", True).schema(MANIFEST_SCHEMA).load(path)
    slot = lambda n: F.get(F.get(F.filter("Slot", lambda s: s["_name"] == n), F.lit(0))["ValueList"]["Value"], F.lit(0))
    info = F.get(F.filter("Slot", lambda s: s["_name"] == "sourcePatientInfo"), F.lit(0))["ValueList"]["Value"]
    pid = lambda k: F.nullif(F.regexp_replace(F.regexp_replace(F.get(F.filter(info, lambda v: v.startswith(f"PID-{k}|")), F.lit(0)), rf"^PID-{k}\|", ""), r"\^+$", ""), F.lit(""))
    return m.select(slot("URI").alias("uri"), slot("hash").alias("hash"), slot("size").cast("long").alias("size"), slot("creationTime").alias("creation_time"), F.col("_mimeType").alias("mime_type"), pid(3).alias("patient_id"), pid(5).alias("patient_name"), pid(7).alias("patient_dob"))


def verified(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Manifest XML documents with whether the file is there and its SHA-1 is the listed one; ``files`` is a binaryFile scan."""
    f = files.select(F.element_at(F.split("path", "/"), -1).alias("uri"), F.sha1("content").alias("actual"))
    return listed.filter(F.col("mime_type") == "text/xml").join(f, "uri", "left").withColumn("fine", F.col("actual").isNotNull() & (F.col("hash").isNull() | (F.lower("hash") == F.col("actual"))))
