"""Queries over details of resources and entities: periods, categories, identity and hash; updates taken back; classes of entities; the hybrid run."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import clinical, dates, entities, fhir
from wardline.operators import access as A
from wardline.operators import resolve as R
from wardline.operators import text as T
from wardline.plans.resolution import UPLOAD_SQL, _uploaded
from wardline.session import spread, table
from wardline.sources import files


def q_resource_fields(spark, sf_dir):
    """Observations of orders' lines: dates from periods or the last update, categories, identity, and hashes that only content moves."""
    l = spread(table(spark, sf_dir, "lineitem"))
    n = F.col("l_partkey")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    when = F.when(n % 4 == 0, say('"effectivePeriod":{"start":"', day, '","end":"2030-01-02"}')).when(n % 4 == 1, say('"effectivePeriod":{},"period":{"start":"', day, '"}')).when(n % 4 == 2, say('"effectiveDateTime":"', day, '","effectivePeriod":{"start":"1999-01-01"}')).otherwise('"period":{}')
    category = F.when(n % 3 == 0, '"category":[{"coding":[{"code":"Vital-Signs"},{"system":"s"},{"code":"x"}],"text":"not used"},{"text":"Social history"}],').when(n % 3 == 1, '"category":[{"text":"Laboratory"},{"coding":[]}],').otherwise("")
    named = F.when(n % 5 == 0, say('"identifier":[{"system":"urn:oid:1.2","value":"', n, '"}],')).when(n % 5 == 1, say('"identifier":[{"value":"', n, '"},{"value":"other"}],')).otherwise("")
    own = F.when(n % 5 != 4, say('"id":"a-', n, '",')).otherwise("")
    rows = l.select("l_orderkey", "l_linenumber", n.alias("n"), when.alias("when"), category.alias("category"), named.alias("named"), own.alias("own"))
    n, when, category, named, own = (F.col(c) for c in ("n", "when", "category", "named", "own"))
    doc = lambda stamp, value: say('{"resourceType":"Observation",', named, own, category, when, ',"meta":{"lastUpdated":"', F.lit(stamp), '","source":"m"},"valueQuantity":{"value":', value, "}}")
    turned = say('{"valueQuantity":{"value":', n, '},"meta":{"source":"m","lastUpdated":"2021-01-01"},', when, ",", category, named, own, '"resourceType":"Observation"}')
    # The three resources of a line are parsed at once: most of the cost of a parse is in its beginning.
    rows = rows.select("l_orderkey", "l_linenumber", "n", F.try_parse_json(say("[", doc("2020-05-06", n), ",", turned, ",", doc("2020-05-06", n + 1), "]")).alias("docs"))
    own, turned, other = (fhir.Part(F.col("docs"), f"$[{i}]") for i in range(3))
    rows = rows.select("l_orderkey", "l_linenumber", "n", fhir.typed(own).alias("x"), *[fhir.resource_hash(d).alias(c) for d, c in ((own, "hash"), (turned, "turned"), (other, "other"))])
    r = fhir.Typed(F.col("x"))
    rows = rows.select("l_orderkey", "l_linenumber", "n", fhir.effective_date(r).alias("day"), fhir.effective_date_end(r).alias("day_end"), fhir.categories(r).alias("codes"), fhir.identity(r, F.lit("fhir_r4")).alias("identity"), "hash", "turned", "other")
    return rows.select(
        "l_orderkey", "l_linenumber", "n", F.to_date("day").alias("day"), F.to_date("day_end").alias("day_end"), F.array_join("codes", "|").alias("categories"), fhir.observation_subtype(F.col("codes")).alias("subtype"),
        "identity.source_system", "identity.external_id", (F.col("hash") == F.col("turned")).alias("same_turned"), (F.col("hash") == F.col("other")).alias("same_other"),
        fhir.format_number(F.when(F.col("n") % 2 == 0, F.col("n") / 2).otherwise(F.col("n") + 0.25)).alias("shown"),
    )


FIELDS_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey AS n,
  CASE l_partkey % 4 WHEN 3 THEN DATE '2020-05-06' ELSE CAST(l_shipdate AS DATE) END AS day, CASE l_partkey % 4 WHEN 0 THEN DATE '2030-01-02' END AS day_end,
  CASE l_partkey % 3 WHEN 0 THEN 'Vital-Signs|x|Social history' WHEN 1 THEN 'Laboratory' END AS categories, CASE l_partkey % 3 WHEN 0 THEN 'vital' ELSE 'lab' END AS subtype,
  CASE l_partkey % 5 WHEN 0 THEN 'urn:oid:1.2' WHEN 4 THEN NULL ELSE 'fhir' END AS source_system, CASE l_partkey % 5 WHEN 0 THEN 'Observation/' || l_partkey WHEN 1 THEN 'Observation/' || l_partkey WHEN 4 THEN NULL ELSE 'Observation/a-' || l_partkey END AS external_id,
  true AS same_turned, false AS same_other, CASE l_partkey % 2 WHEN 0 THEN CAST(l_partkey // 2 AS VARCHAR) ELSE l_partkey || '.25' END AS shown
FROM lineitem
"""


def q_reverted_fields(spark, sf_dir):
    """Updates of orders' fields taken back: all are what they were, and what a merge shows of each."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    old = F.create_map(F.lit("status"), F.concat(F.lit('"'), "o_orderstatus", F.lit('"')), F.lit("id"), k.cast("string"), F.lit("note"), F.lit("null"))
    new = F.map_concat(F.create_map(F.lit("status"), F.when(k % 2 == 0, F.lit('"X"')).otherwise(F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))), F.lit("id"), F.lit("0")), F.when(k % 3 == 0, F.create_map(F.lit("extra"), F.lit("[1]"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    merged = R.revert_fields(R.merge_fields(o.select(k.alias("id"), old.alias("old"), new.alias("new"), F.col("o_orderstatus").alias("display_text"), F.lit("order").alias("record_type"), F.lit("fhir_r4").alias("source_format"), F.col("o_orderdate").alias("effective_date"))))
    entries = lambda c: F.array_sort(F.map_entries(c))
    shown = A.compact()
    return merged.select("id", F.array_join("fields_updated", ",").alias("fields_updated"), (entries("reverted") == entries("old")).alias("as_before"), (entries("updated") == entries("old")).alias("unchanged"), F.concat_ws("/", shown["display_text"], shown["record_type"], shown["source_format"]).alias("shown"))


REVERTED_SQL = """
WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'extra,' ELSE '' END || 'note' || CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'X' THEN ',status' ELSE '' END AS fields_updated, o_orderstatus AS s FROM orders)
SELECT id, fields_updated, true AS as_before, false AS unchanged, s || '/order/fhir_r4' AS shown FROM x
"""

#: A given class and text, the class it becomes, whether it is a panel, and its letters and digits.
ENTITIES = [
    ("medication", "Flu shot 2023", "immunization", False, "flushot2023"), ("procedure", "COVID-19 booster", "immunization", False, "covid19booster"), ("medication", "Metformin 500 mg", "medication", False, "metformin500mg"),
    ("lab_result", "Lipid Panel", "lab_result", True, "lipidpanel"), ("lab_result", "Exercise: daily", "social_history", False, "exercisedaily"), ("vital", "Pulse: 70", "vital", False, "pulse70"), ("condition", "Tetanus", "condition", False, "tetanus"),
]


def q_entity_classes(spark, sf_dir):
    """What lines of orders, as entities, are taken for, and the date that stands for a year."""
    l = table(spark, sf_dir, "lineitem")
    i = (F.col("l_partkey") % len(ENTITIES)).cast("int")
    pick = lambda n: F.get(F.array(*[F.lit(e[n]) for e in ENTITIES]), i)
    resource = F.concat(F.lit('{"resourceType":"Observation"'), F.when(F.col("l_partkey") % 2 == 0, ',"status":"final"').otherwise(""), F.when(F.col("l_partkey") % 3 == 0, ',"code":{"text":"x"}').otherwise(""), F.lit("}"))
    cls, said = pick(0), pick(1)
    year = F.to_timestamp(F.concat(F.year("l_shipdate").cast("string"), F.lit("-01-01")))
    rows = l.select(entities.entity_class(cls, said).alias("entity_class"), entities.is_panel(said).alias("panel"), clinical.alnum_only(said).alias("key"), F.array_join(entities.missing_fields(resource), ",").alias("missing"), F.to_date(dates.real_date(year, cls, F.when(F.col("l_partkey") % 2 == 0, F.col("l_shipdate").cast("timestamp")))).alias("day"))
    return rows.groupBy("entity_class", "panel", "key", "missing").agg(F.count("*").alias("n"), F.max("day").alias("last_day"))


def _classes_sql() -> str:
    case = lambda n: "CASE i " + " ".join(f"WHEN {i} THEN {repr(e[n]) if isinstance(e[n], str) else str(e[n]).lower()}" for i, e in enumerate(ENTITIES)) + " END"
    return f"""
WITH x AS (SELECT l_partkey % {len(ENTITIES)} AS i, l_partkey AS n, CAST(l_shipdate AS DATE) AS day FROM lineitem),
y AS (SELECT {case(2)} AS entity_class, {case(3)} AS panel, {case(4)} AS key, CASE WHEN n % 6 = 0 THEN '' WHEN n % 2 = 0 THEN 'code' WHEN n % 3 = 0 THEN 'status' ELSE 'status,code' END AS missing, CASE WHEN n % 2 = 0 THEN day ELSE make_date(year(day), 1, 1) END AS seen FROM x)
SELECT entity_class, panel, key, missing, count(*) AS n, max(seen) AS last_day FROM y GROUP BY ALL
"""


#: A section's type and text, and what the run gives of it: class, text, status and origin.
SECTIONS = [
    ("problems", "Patient has hypertension. Denies chest pain.", [("condition", "hypertension", "active", "dictionary")]),
    ("labs", "Mother has hypertension.", [("family_history", "hypertension", "active", "dictionary"), ("procedure", "told", "active", "model")]),
    ("problems", "A long section in which the dictionary knows no word at all.", [("procedure", "told", "active", "model")]),
    ("medications", "Takes lisinopril daily", [("medication", "lisinopril", "active", "dictionary")]),
    ("problems", "History of chest pain. If chest pain, call.", [("condition", "chest pain", "historical", "dictionary"), ("procedure", "told", "active", "model")]),
]
TERMS = [("hypertension", "DISEASE", "I10"), ("lisinopril", "CHEMICAL", "29046"), ("chest pain", "DISEASE", None)]


def q_hybrid_run(spark, sf_dir):
    """Sections of orders through the dictionary, and through a model where it is in doubt."""
    i = (F.col("o_orderkey") % len(SECTIONS)).cast("int")
    pick = lambda n: F.get(F.array(*[F.lit(s[n]) for s in SECTIONS]), i)
    sections = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("section_no"), pick(0).alias("section_type"), pick(1).alias("text"))
    model = lambda asked: asked.select("doc_id", "section_no", F.lit(0).alias("sentence_no"), F.lit(0).alias("pos"), F.lit("procedure").alias("entity_class"), F.lit("told").alias("text"), F.lit("active").alias("status"), F.lit(0.6).alias("confidence"))
    found = T.hybrid(sections, F.broadcast(spark.createDataFrame(TERMS, "term string, label string, code string")), model)
    return found.select("doc_id", "source_section", "entity_class", "text", "code", "status", "confidence", "origin")


def _hybrid_sql() -> str:
    code = {t: c for t, _, c in TERMS}
    rows = [(i, s, cls, said, code.get(said), status, 0.6 if origin == "model" else 0.9 if code[said] else 0.5, origin) for i, (s, _, found) in enumerate(SECTIONS) for cls, said, status, origin in found]
    values = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)
    return f"SELECT o_orderkey AS doc_id, source_section, entity_class, text, CAST(code AS VARCHAR) AS code, status, CAST(confidence AS DOUBLE) AS confidence, origin FROM orders JOIN (VALUES {values}) v(i, source_section, entity_class, text, code, status, confidence, origin) ON i = o_orderkey % {len(SECTIONS)}"


def _verdicts(prompt: str, attempt: int) -> str:
    """A judge that says one of four things by the sum of the ids, or fails."""
    n = sum(map(int, prompt.split())) % 5
    if n == 4:
        raise ValueError("bad request")
    return ['{"classification":"duplicate","confidence":0.9}', '{"classification":"distinct","confidence":3}', '{"classification":"twin"}', "no idea"][n]


def q_judged_pairs(spark, sf_dir):
    """Pairs of an upload put to a judge that is sometimes sure, sometimes vague and sometimes fails; sure pairs are not asked about."""
    judged = R.decide_by_calls(_uploaded(spark, sf_dir), F.concat_ws(" ", "id_a", "id_b"), providers={"judge": _verdicts}, routing={"dedup": "judge"}, backoff=0.0)
    return judged.select("id_a", "id_b", "verdict", F.bround("confidence", 6).alias("confidence"), "decision", "attempts", F.col("error").isNotNull().alias("failed"))


JUDGED_SQL = UPLOAD_SQL + """, j AS (SELECT id_a, id_b, score >= 0.95 AS auto, (id_a + id_b) % 5 AS n FROM scored WHERE score >= 0.6)
SELECT id_a, id_b, CASE WHEN auto OR n = 0 THEN 'duplicate' WHEN n = 1 THEN 'distinct' ELSE 'related' END AS verdict, CAST(CASE WHEN auto THEN 1.0 ELSE list_extract([0.9, 1.0, 0.5, 0.0, 0.0], CAST(n + 1 AS INTEGER)) END AS DOUBLE) AS confidence,
  CASE WHEN auto OR n = 0 THEN 'merge' WHEN n = 1 THEN 'dismiss' ELSE 'pending' END AS decision, CAST(NOT auto AS INTEGER) AS attempts, NOT auto AND n = 4 AS failed FROM j
"""


#: Ends of names, what files begin with, the kind each is and whether it is what it says.
FILES = [
    (".ZIP", "PK", "zip", True), (".json", "{}", "fhir_r4", True), (".tsv", "A", "epic_ehi", True), (".xml", "<?xml?><ClinicalDocument/>", "cda_r2", True), (".xml", "<other/>", "unknown", True), (".pdf", "%PDF-1.7", "pdf", True),
    (".pdf", "PDF", "pdf", False), (".rtf", "{\\rtf1 x}", "rtf", True), (".rtf", "plain", "rtf", False), (".TIFF", "II*", "tiff", False), (".txt", "x", "unknown", True),
]


def q_file_kinds(spark, sf_dir):
    """Customers' files by name and first bytes."""
    c = table(spark, sf_dir, "customer")
    i = (F.col("c_custkey") % len(FILES)).cast("int")
    pick = lambda n: F.get(F.array(*[F.lit(f[n]) for f in FILES]), i)
    path, content = F.concat(F.lit("/in/"), "c_name", pick(0)), F.encode(F.concat(pick(1), F.repeat(F.lit(" "), 600), F.lit("<ClinicalDocument/>")), "utf-8")
    found = c.select(files.kind(path, content).alias("kind"), files.magic_ok(path, content).alias("magic_ok"))
    return found.groupBy("kind", "magic_ok").agg(F.count("*").alias("n"))


def _kinds_sql() -> str:
    values = ", ".join(f"({i}, '{kind}', {str(fine).lower()})" for i, (_, _, kind, fine) in enumerate(FILES))
    return f"SELECT kind, magic_ok, count(*) AS n FROM customer JOIN (VALUES {values}) v(i, kind, magic_ok) ON i = c_custkey % {len(FILES)} GROUP BY ALL"


QUERIES = {
    "q108_resource_fields": (q_resource_fields, FIELDS_SQL),
    "q109_reverted_fields": (q_reverted_fields, REVERTED_SQL),
    "q110_entity_classes": (q_entity_classes, _classes_sql()),
    "q111_hybrid_run": (q_hybrid_run, _hybrid_sql()),
    "q112_judged_pairs": (q_judged_pairs, JUDGED_SQL),
    "q113_file_kinds": (q_file_kinds, _kinds_sql()),
}
