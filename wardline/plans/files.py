"""Queries that read files: FHIR bundles, Epic tables, CDA documents and XDM manifests.

Each writes an export of the driver's tables to the shared folder first, as the
source system would, and reads it back through the source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wardline.functions import fhir
from wardline.session import table, work_dir
from wardline.sources import cda, epic, fhir_bundle


def q_bundle_files(spark, sf_dir):
    """A bundle a line for each order, its lines as observations and its customer as patient."""
    l = table(spark, sf_dir, "lineitem")
    one = F.struct(F.struct(F.lit("Observation").alias("resourceType"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.when(F.col("l_returnflag") != "R", "final").alias("status"), F.struct(F.array(F.struct(F.lit("http://loinc.org").alias("system"), (F.col("l_partkey") % 10).cast("string").alias("code"), F.concat(F.lit("part "), (F.col("l_partkey") % 10).cast("string")).alias("display"))).alias("coding")).alias("code"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("effectiveDateTime"), F.struct(F.col("l_quantity").alias("value")).alias("valueQuantity")).alias("resource"))
    person = F.to_json(F.struct(F.struct(F.lit("Patient").alias("resourceType"), F.col("l_orderkey").cast("string").alias("id")).alias("resource")))
    g = l.groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.to_json(one)), ",").alias("entries"))
    path = work_dir(spark, "bundles")
    g.select(F.when(F.col("l_orderkey") % 50 == 0, F.lit('{"resourceType":"Bundle","entry":[{"res')).otherwise(F.concat(F.lit('{"resourceType":"Bundle","entry":['), person, F.lit(","), F.col("entries"), F.lit("]}"))).alias("value")).write.text(path)
    r = fhir_bundle.records(spark, path, lines=True).withColumn("reading", fhir.reading("resource", F.col("display_text")))
    return r.groupBy("record_type", "code_value", "display_text", "status", F.to_date("effective_date").alias("day")).agg(F.count("*").alias("n"), F.sum("reading.value").alias("total"))


BUNDLES_SQL = """
SELECT 'observation' AS record_type, CAST(l_partkey % 10 AS VARCHAR) AS code_value, 'part ' || (l_partkey % 10) AS display_text, CASE WHEN l_returnflag <> 'R' THEN 'final' END AS status, CAST(l_shipdate AS DATE) AS day, count(*) AS n, sum(l_quantity) AS total
FROM lineitem WHERE l_orderkey % 50 <> 0 GROUP BY ALL
"""


def _tables() -> dict[str, dict]:
    """Columns of each exported table but ORDER_RESULTS (query q81), over customers; names that start with " " are trimmed."""
    k = F.col("c_custkey")
    key = k.cast("string")
    day = F.concat((k % 12 + 1).cast("string"), F.lit("/"), (k % 28 + 1).cast("string"), F.lit("/2024"))
    name = F.when(k % 11 != 0, F.concat(F.lit(" thing "), (k % 5).cast("string"))).otherwise(F.lit(" "))
    pick = lambda *words: F.get(F.array(*[F.lit(w) for w in words]), (k % len(words)).cast("int"))
    return {
        "PROBLEM_LIST": {"PROBLEM_LIST_ID": key, "DESCRIPTION": name, "NOTED_DATE": day, "PROBLEM_STATUS_C_NAME": pick("Active", "Resolved", "Inactive")},
        "PROBLEM_LIST_ALL": {"PROBLEM_LIST_ID": F.when(k % 2 == 0, key), "DX_ID_DX_NAME": name, "RESOLVED_DATE": F.when(k % 3 == 0, day)},
        "MEDICAL_HX": {"PAT_ENC_CSN_ID": key, "LINE": F.lit("1"), "DX_ID_DX_NAME": name, "MEDICAL_HX_DATE": day},
        "ORDER_MED": {"ORDER_MED_ID": key, "DISPLAY_NAME": name, "DOSAGE": F.lit("5 mg by mouth daily"), "ORDERING_DATE": day, "ORDER_STATUS_C_NAME": pick("Sent", "Discontinued", "New")},
        "PAT_ENC": {"PAT_ENC_CSN_ID": key, "CONTACT_DATE": F.when(k % 11 != 0, day), "APPT_STATUS_C_NAME": pick("Completed", "No Show", "Scheduled"), "ENC_TYPE_C_NAME": name},
        "DOC_INFORMATION": {"DOC_INFO_ID": key, "DOC_INFO_TYPE_C_NAME": name, "DOC_STAT_C_NAME": pick("Active", "Deleted"), "DOC_RECV_TIME": day},
        "ALLERGY": {"ALLERGY_ID": key, "ALLERGEN_ID_ALLERGEN_NAME": name, "REACTION": F.lit("hives"), "DATE_NOTED": day, "ALRGY_STATUS_C_NAME": pick("Active", "Resolved", "Deleted")},
        "IMMUNE": {"IMMUNE_ID": key, "IMMUNZATN_ID_NAME": name, "IMMUNE_DATE": day, "IMMNZTN_STATUS_C_NAME": pick("Given", "Refused")},
        "ORDER_PROC": {"ORDER_PROC_ID": key, "DESCRIPTION": name, "ORDER_STATUS_C_NAME": pick("Done", "Pending", "In Progress"), "ORDERING_DATE": day},
        "IP_FLWSHT_MEAS": {"FSD_ID": key, "LINE": F.when(k % 2 == 0, "2"), "FLO_MEAS_NAME": name, "MEAS_VALUE": F.when(k % 3 != 0, key), "RECORDED_TIME": day},
        "REFERRAL": {"REFERRAL_ID": key, "RSN_FOR_RFL_C_NAME": name, "RFL_STATUS_C_NAME": pick("Closed", "Canceled", "Pending", "Open"), "START_DATE": day},
        "PAT_ENC_DX": {"PAT_ENC_CSN_ID": key, "LINE": F.lit("3"), "DX_ID_DX_NAME": name, "CONTACT_DATE": day},
        "SOCIAL_HX": {"PAT_ENC_CSN_ID": key, "CONTACT_DATE": day, "SOCIAL_HX_TYPE_C_NAME": name, "SOCIAL_HX_COMMENT": F.when(k % 11 != 0, "never")},
        "FAMILY_HX": {"PAT_ENC_CSN_ID": key, "LINE": F.lit("4"), "FAM_MEDICAL_DX_ID_DX_NAME": name, "RELATION_C_NAME": F.lit("Mother")},
    }


def q_epic_files(spark, sf_dir):
    """Fourteen tables of an Epic export, written as TSV and read as records."""
    c = table(spark, sf_dir, "customer")
    folder, parts = work_dir(spark, "epic"), []
    for name, columns in _tables().items():
        c.select(*[F.coalesce(v, F.lit("")).alias(n) for n, v in columns.items()]).write.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{name}")
        r = epic.records(spark, f"{folder}/{name}", name).select(F.lit(name).alias("epic_table"), "record_type", "display_text", "status", F.to_date("effective_date").alias("day"), "external_id")
        parts.append(r.groupBy("epic_table", "record_type", "display_text", "status").agg(F.count("*").alias("n"), F.count("day").alias("n_dated"), F.max("day").alias("last_day"), F.count("external_id").alias("n_ids")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _epic_sql() -> str:
    day = "make_date(2024, CAST(k % 12 + 1 AS INTEGER), CAST(k % 28 + 1 AS INTEGER))"
    pick = lambda *w: "CASE k % " + str(len(w)) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(w)) + " END"
    # table, record type, status, day, which rows have an identity, which rows there are besides those with a name
    rows = [
        ("PROBLEM_LIST", "condition", pick("active", "resolved", "inactive"), day, "true", "true"),
        ("PROBLEM_LIST_ALL", "condition", "CASE WHEN k % 3 = 0 THEN 'resolved' ELSE 'active' END", "NULL", "k % 2 = 0", "true"),
        ("MEDICAL_HX", "condition", "'active'", day, "true", "true"),
        ("ORDER_MED", "medication", pick("completed", "cancelled", "active"), day, "true", "true"),
        ("PAT_ENC", "encounter", pick("finished", "cancelled", "planned"), day, "true", "true"),
        ("DOC_INFORMATION", "document", pick("current", "superseded"), day, "true", "true"),
        ("ALLERGY", "allergy", pick("active", "resolved", "inactive"), day, "true", "true"),
        ("IMMUNE", "immunization", pick("completed", "not-done"), day, "true", "true"),
        ("ORDER_PROC", "procedure", pick("completed", "preparation", "in-progress"), "NULL", "true", "true"),
        ("IP_FLWSHT_MEAS", "observation", "'final'", day, "k % 2 = 0", "k % 3 <> 0"),
        ("REFERRAL", "service_request", pick("completed", "revoked", "draft", "active"), day, "true", "true"),
        ("PAT_ENC_DX", "condition", "'active'", day, "true", "true"),
        ("SOCIAL_HX", "observation", "'final'", day, "true", "true"),
        ("FAMILY_HX", "condition", "'completed'", "NULL", "true", "true"),
    ]
    one = lambda t, kind, status, d, known, there: f"SELECT '{t}' AS epic_table, '{kind}' AS record_type, 'thing ' || (k % 5) || '{" (Mother)" if t == "FAMILY_HX" else ""}' AS display_text, {status} AS status, CAST({d} AS DATE) AS day, {known} AS known FROM c WHERE k % 11 <> 0 AND {there}"
    return f"WITH c AS (SELECT c_custkey AS k FROM customer), r AS ({' UNION ALL '.join(one(*x) for x in rows)}) SELECT epic_table, record_type, display_text, status, count(*) AS n, count(day) AS n_dated, max(day) AS last_day, count(CASE WHEN known THEN 1 END) AS n_ids FROM r GROUP BY 1, 2, 3, 4"


def q_cda_files(spark, sf_dir):
    """CDA documents, with an allergy, a drug, a problem, results, a procedure and a visit for each supplier."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    code = lambda tag, value, name: F.concat(F.lit(f'<{tag} code="'), value.cast("string"), F.lit(f'" codeSystem="2.16" displayName="{name} '), value.cast("string"), F.lit('"/>'))
    when = F.concat(F.lit('<effectiveTime value="2024'), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit('15"/>'))
    section = lambda loinc, body: F.concat(F.lit(f'<component><section><code code="{loinc}"/><title>T</title><entry>'), body, F.lit("</entry></section></component>"))
    act = lambda body: F.concat(F.lit("<act><entryRelationship><observation>"), when, body, F.lit("</observation></entryRelationship></act>"))
    allergen = F.concat(F.lit("<participant><participantRole><playingEntity>"), code("code", k % 3, "allergen"), F.lit("</playingEntity></participantRole></participant>"))
    drug = lambda name: F.concat(F.lit("<substanceAdministration>"), when, F.lit("<consumable><manufacturedProduct><manufacturedMaterial>"), code("code", k % 4, name), F.lit("</manufacturedMaterial></manufacturedProduct></consumable></substanceAdministration>"))
    result = lambda n: F.concat(F.lit("<component><observation>"), code("code", k % 5 + n, "test"), when, F.lit('<value value="'), (k + n).cast("string"), F.lit('" unit="mg"/></observation></component>'))
    timed = lambda tag: F.concat(F.lit(f"<{tag}>"), code("code", k % 2, tag), when, F.lit(f"</{tag}>"))
    sections = F.concat(
        section("48765-2", act(allergen)), section("10160-0", drug("drug")), section("11450-4", act(code("value", k % 6, "problem"))), section("11369-6", drug("vaccine")),
        section("30954-2", F.concat(F.lit("<organizer>"), result(0), result(1), F.lit("</organizer>"))), section("47519-4", timed("procedure")), section("46240-8", timed("encounter")), section("99999-9", timed("encounter")),
    )
    path = work_dir(spark, "cda")
    doc = F.concat(F.lit('<ClinicalDocument xmlns="urn:hl7-org:v3"><component><structuredBody>'), F.array_join(F.collect_list(sections), ""), F.lit("</structuredBody></component></ClinicalDocument>"))
    # A file holds one document.
    s.groupBy((k % 8).alias("document")).agg(doc.alias("value")).write.partitionBy("document").text(path)
    r = cda.records(spark, path)
    return r.groupBy("record_type", "code_value", "display_text", F.to_date("effective_date").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


CDA_SQL = """
WITH s AS (SELECT s_suppkey AS k, make_date(2024, CAST(s_suppkey % 12 + 1 AS INTEGER), 15) AS day FROM supplier),
r AS (SELECT 'allergy' AS record_type, k % 3 AS c, 'allergen' AS name, day, NULL AS v FROM s UNION ALL SELECT 'medication', k % 4, 'drug', day, NULL FROM s UNION ALL SELECT 'condition', k % 6, 'problem', day, NULL FROM s
  UNION ALL SELECT 'immunization', k % 4, 'vaccine', day, NULL FROM s UNION ALL SELECT 'observation', k % 5, 'test', day, k FROM s UNION ALL SELECT 'observation', k % 5 + 1, 'test', day, k + 1 FROM s
  UNION ALL SELECT 'procedure', k % 2, 'procedure', day, NULL FROM s UNION ALL SELECT 'encounter', k % 2, 'encounter', day, NULL FROM s)
SELECT record_type, CAST(c AS VARCHAR) AS code_value, name || ' ' || c AS display_text, day, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM r GROUP BY ALL
"""


def q_manifest_files(spark, sf_dir):
    """XDM manifests that list an export's documents: which are there and whole."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("document "), F.col("s_name")).alias("body"))
    folder = work_dir(spark, "xdm")
    slot = lambda name, value: F.concat(F.lit(f'<Slot name="{name}"><ValueList><Value>'), value, F.lit("</Value></ValueList></Slot>"))
    k = F.col("k")
    listed = F.concat(F.when(k % 3 == 0, F.lit('<ExtrinsicObject mimeType="application/pdf">')).otherwise(F.lit('<ExtrinsicObject mimeType="text/xml">')), slot("URI", F.concat(F.lit("DOC"), k.cast("string"), F.lit(".XML"))), slot("hash", F.when(k % 5 == 0, F.lit("0")).otherwise(F.upper(F.sha1("body")))), slot("size", F.octet_length("body").cast("string")), F.lit('<Slot name="sourcePatientInfo"><ValueList><Value>PID-5|Doe^Jane^^^^</Value></ValueList></Slot></ExtrinsicObject>'))
    whole = F.concat(F.lit("<RegistryObjectList>"), F.array_join(F.collect_list(listed), ""), F.lit("</RegistryObjectList>"))
    s.groupBy((k % 4).alias("part")).agg(whole.alias("value")).write.partitionBy("part").text(f"{folder}/METADATA")
    files = s.filter("k % 7 <> 0").select(F.concat(F.lit("/export/DOC"), k.cast("string"), F.lit(".XML")).alias("path"), F.encode("body", "utf-8").alias("content"))
    v = cda.verified(files, cda.manifest(spark, f"{folder}/METADATA"))
    return v.select("uri", "size", "patient_name", "fine")


MANIFEST_SQL = """
SELECT 'DOC' || s_suppkey || '.XML' AS uri, CAST(strlen('document ' || s_name) AS BIGINT) AS size, 'Doe^Jane' AS patient_name, s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 AS fine FROM supplier WHERE s_suppkey % 3 <> 0
"""

QUERIES = {
    "q96_bundle_files": (q_bundle_files, BUNDLES_SQL),
    "q97_epic_files": (q_epic_files, _epic_sql()),
    "q98_cda_files": (q_cda_files, CDA_SQL),
    "q99_manifest_files": (q_manifest_files, MANIFEST_SQL),
}
