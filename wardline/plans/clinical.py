"""Queries over resources, entities, terms, reviews and Epic tables, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import entities as E
from wardline.functions import fhir
from wardline.functions.dates import entity_date, first_date
from wardline.operators import resolve as R
from wardline.operators import review as V
from wardline.operators import terminology
from wardline.operators import text as T
from wardline.plans.records import RECORDS_SQL, active, records
from wardline.plans.resolution import SCAN_SQL
from wardline.sources import epic, fhir_bundle
from wardline.session import spread, table


def _resources(spark, sf_dir):
    """Active records as resources with a reading, a range, a flag and someone who did it."""
    r = spread(active(records(spark, sf_dir)))
    i = F.col("id")
    quantity = F.when(i % 9 != 0, F.struct(F.floor("value").alias("value"), F.lit("u").alias("unit")))
    flags = F.array(*[F.struct(F.array(F.struct(F.lit(c).alias("code"))).alias("coding")) for c in ("H", "L", "N")])
    flag = F.when(i % 4 < 3, F.array(F.get(flags, (i % 4).cast("int"))))
    span = F.when(i % 5 != 0, F.array(F.struct(F.struct(F.lit(10).alias("value")).alias("low"), F.struct(F.lit(90).alias("value")).alias("high"))))
    who = F.when(i % 2 == 0, F.array(F.struct(F.concat(F.lit("Dr "), (i % 7).cast("string")).alias("display"))))
    state = F.when(i % 3 == 0, "completed").when(i % 3 == 1, "active").otherwise("on-hold")
    doc = F.struct(F.col("fhir_resource_type").alias("resourceType"), state.alias("status"), F.struct(F.array(F.struct(state.alias("code"))).alias("coding")).alias("clinicalStatus"), F.when(i % 8 < 5, F.struct(F.concat(F.lit("title "), (i % 8).cast("string")).alias("text"))).alias("code"), quantity.alias("valueQuantity"), span.alias("referenceRange"), flag.alias("interpretation"), F.struct(F.when(i % 2 == 0, "AMB").otherwise("IMP").alias("code")).alias("class"), who.alias("performer"))
    return r.withColumn("resource", F.parse_json(F.to_json(doc)))


def q_previews(spark, sf_dir):
    """What a timeline row shows: value, unit, flag, emphasis, gauge and who did it."""
    r = _resources(spark, sf_dir).withColumn("p", fhir.preview("resource", F.col("record_type")))
    return r.select("id", "p.value", "p.unit", "p.flag", "p.emphasis", F.col("p.low").alias("gauge_low"), F.col("p.high").alias("gauge_high"), fhir.provider("resource").alias("provider"))


PREVIEW_SQL = f"""
WITH {RECORDS_SQL}, x AS (SELECT *, record_type = 'observation' AS o, CASE id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'ACTIVE' ELSE 'ON HOLD' END AS state, id % 9 <> 0 AS has FROM active)
SELECT id, CASE WHEN o AND has THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value, CASE WHEN o AND has THEN 'u' END AS unit,
  CASE WHEN o THEN (CASE id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END) WHEN record_type = 'encounter' THEN (CASE WHEN id % 2 = 0 THEN 'Ambulatory' ELSE 'Inpatient' END) ELSE state END AS flag,
  CASE WHEN o AND NOT has AND id % 4 >= 2 THEN NULL WHEN o THEN (CASE WHEN id % 4 < 2 THEN 'notable' ELSE 'normal' END) WHEN record_type = 'encounter' THEN 'normal' ELSE (CASE WHEN id % 3 = 1 THEN 'normal' ELSE 'muted' END) END AS emphasis,
  CASE WHEN o AND has AND id % 5 <> 0 THEN 10.0::DOUBLE END AS gauge_low, CASE WHEN o AND has AND id % 5 <> 0 THEN 90.0::DOUBLE END AS gauge_high,
  CASE WHEN id % 2 = 0 THEN 'Dr ' || (id % 7) END AS provider
FROM x
"""


def q_titles(spark, sf_dir):
    """A title of each record, and the kind of observation it is."""
    r = _resources(spark, sf_dir)
    shown = F.when(F.col("id") % 3 == 0, F.col("display_text")).when(F.col("id") % 3 == 1, F.col("fhir_resource_type"))
    category = F.when(F.col("id") % 4 == 0, F.array(F.lit("exam"), F.lit("Vital-Signs"))).when(F.col("id") % 4 == 1, F.array(F.lit("social-history"), F.lit("laboratory"))).when(F.col("id") % 4 == 2, F.array(F.lit("other")))
    return r.select("id", fhir.record_title("resource", shown, F.col("record_type")).alias("title"), fhir.observation_subtype(category).alias("subtype"))


TITLES_SQL = f"""
WITH {RECORDS_SQL}
SELECT id, CASE WHEN id % 3 = 0 THEN display_text WHEN id % 8 < 5 THEN 'title ' || (id % 8) ELSE upper(record_type[1]) || record_type[2:] END AS title, CASE id % 4 WHEN 0 THEN 'vital' WHEN 1 THEN 'social' ELSE 'lab' END AS subtype
FROM active
"""


def q_lab_lines(spark, sf_dir):
    """Result lines written from order rows, read back: analyte, value, unit, range and flag. A line that is written often is read once."""
    l = table(spark, sf_dir, "lineitem")
    q = F.floor("l_quantity").cast("string")
    line = F.concat(F.lit("Marker "), F.element_at(F.array(*[F.lit(x) for x in "ABCDEFG"]), (F.col("l_partkey") % 7 + 1).cast("int")), F.lit(": "), q, F.when(F.col("l_linenumber") % 2 == 0, " mg/dL").otherwise(" mmol/L"), F.when(F.col("l_suppkey") % 3 == 0, " (5-40)").otherwise(""), F.when(F.col("l_returnflag") == "R", " high").when(F.col("l_returnflag") == "A", " L").otherwise(""))
    lines = l.groupBy(line.alias("line")).agg(F.count("*").alias("n"))
    d = lines.select("n", F.explode(F.array(E.parse_lab(F.col("line")))).alias("d")).select("n", "d.*")
    return d.groupBy(*[c for c in d.columns if c != "n"]).agg(F.sum("n").alias("n"))


LAB_SQL = """
SELECT 'Marker ' || substr('ABCDEFG', CAST(l_partkey % 7 + 1 AS INTEGER), 1) AS analyte, floor(l_quantity) AS value, CASE WHEN l_linenumber % 2 = 0 THEN 'mg/dL' ELSE 'mmol/L' END AS unit,
  CASE WHEN l_suppkey % 3 = 0 THEN 5.0::DOUBLE END AS ref_low, CASE WHEN l_suppkey % 3 = 0 THEN 40.0::DOUBLE END AS ref_high, CASE l_returnflag WHEN 'R' THEN 'H' WHEN 'A' THEN 'L' END AS interpretation, count(*) AS n
FROM lineitem GROUP BY ALL
"""


def q_first_dates(spark, sf_dir):
    """The first date in a note written about each order, in one of six forms or none, after numbers that are no dates."""
    o = spread(table(spark, sf_dir, "orders"))
    i = F.col("o_orderkey") % len(FORMS)
    said = F.get(F.array(*[F.date_format("o_orderdate", form) if form else F.lit("37.5/38") for form in FORMS]), i.cast("int"))
    note = F.concat(F.lit("BP 120/80, 20 mg, no. 20241. Café: seen "), said, F.lit("; next 2031-01-05"))
    return o.select("o_orderkey", F.to_date(first_date(note)).alias("first_date"))


#: Forms of dates; the last is no date.
FORMS = ["yyyy-MM-dd", "yyyy-M", "M/d/yyyy", "M/yyyy", "MMMM d, yyyy", "MMM yyyy", None]
FIRST_DATES_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN DATE '2031-01-05' WHEN o_orderkey % 7 IN (1, 3, 5) THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS first_date FROM orders
"""


def q_entity_dates(spark, sf_dir):
    """Dates of entities made from orders: by attribute, by another attribute, by text, by document."""
    o = spread(table(spark, sf_dir, "orders"))
    i, day = F.col("o_orderkey"), F.col("o_orderdate")
    short = F.date_format(day, "M/d/yyyy")
    none = F.lit(None).cast("string")
    attributes = F.create_map(F.lit("onset_date"), F.when(i % 4 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(none), F.lit("note"), F.when(i % 4 == 1, F.concat(F.lit("seen "), short)).otherwise("120/80"), F.lit("date"), F.when(i % 8 == 0, "1990").otherwise(none))
    said = F.when(i % 4 == 2, F.concat(F.lit("since "), F.date_format(day, "MMMM d, yyyy"), F.lit(", 5 mg"))).otherwise("no date 5 mg")
    cls = F.when(i % 3 == 0, "family_history").otherwise("condition")
    return o.select("o_orderkey", F.to_date(entity_date(attributes, said, cls, F.lit("2001-02-03").cast("timestamp"))).alias("entity_date"))


ENTITY_DATES_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN DATE '1990-01-01' WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 3 <> 0 THEN DATE '2001-02-03' END AS entity_date FROM orders
"""


#: A small alias table for the part names of the driver's tables.
ALIASES = [("steel", "M-1", "Steel"), ("brass", "M-2", "Brass"), ("standard", "G-1", "Standard grade"), ("promo", "G-2", "Promotional grade"), ("large brushed copper", "P-1", "Brushed copper, large")]


def q_term_codes(spark, sf_dir):
    """Codes of part types by alias: the whole type, else its first word, else its last."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return terminology.look_up(p, spark.createDataFrame(ALIASES, "alias string, code string, display string"), "p_type", last_word=True).select("p_partkey", "code", "display", "matched")


TERM_CODES_SQL = f"""
WITH a AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{c}', '{d}')" for a, c, d in ALIASES)}) v(alias, code, display)), k AS (SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS key FROM part)
SELECT p_partkey, coalesce(x.code, f.code, l.code) AS code, coalesce(x.display, f.display, l.display) AS display, CASE WHEN x.code IS NOT NULL THEN 'exact' WHEN f.code IS NOT NULL THEN 'first word' WHEN l.code IS NOT NULL THEN 'last word' END AS matched
FROM k LEFT JOIN a x ON x.alias = key LEFT JOIN a f ON key LIKE '% %' AND f.alias = split_part(key, ' ', 1) LEFT JOIN a l ON key LIKE '% %' AND l.alias = split_part(key, ' ', -1)
"""


def _candidates(spark, sf_dir):
    """Pairs worth a look as candidates of the upload that brought their later record; a third was merged by itself."""
    pairs = R.score(R.pairs(active(records(spark, sf_dir)))).filter(F.col("score") >= 0.7)
    return pairs.select(F.concat_ws("-", "id_a", "id_b").alias("candidate_id"), "id_a", "id_b", F.floor(F.col("id_b") / 500).cast("long").alias("upload_id"), F.when((F.col("id_a") + F.col("id_b")) % 3 == 0, "merged").otherwise("pending").alias("status"))


def _resolved(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    n = (F.col("id_a") + F.col("id_b")) % 7
    action = F.when(n == 0, "merge").when(n == 1, "update").when(n == 2, "dismiss").when(n == 3, "keep_both").when(n == 4, "later")
    asked = c.filter("status = 'pending'").select("candidate_id", action.alias("action")).filter("action IS NOT NULL")
    left = records(spark, sf_dir).filter("id % 41 <> 0")
    return V.resolve_review(c, asked, left)


def q_review(spark, sf_dir):
    """Candidates of each upload by status after a review, pairs of which a record is gone left alone."""
    return _resolved(spark, sf_dir).groupBy("upload_id", "status").agg(F.count("*").alias("n"))


def q_review_uploads(spark, sf_dir):
    """What is still pending in each upload after a review, and its state."""
    return V.upload_states(_resolved(spark, sf_dir))


def q_review_undo(spark, sf_dir):
    """Merges taken back: from the review to pending."""
    c = _candidates(spark, sf_dir)
    undone = V.undo(c, c.filter("id_a % 2 = 0").select("candidate_id"), "pending")
    return undone.groupBy("upload_id", "status").agg(F.count("*").alias("n"))


CANDIDATES_SQL = SCAN_SQL + """, c AS (SELECT id_a, id_b, id_b // 500 AS upload_id, CASE WHEN (id_a + id_b) % 3 = 0 THEN 'merged' ELSE 'pending' END AS status, (id_a + id_b) % 7 AS m FROM scored WHERE score >= 0.7),
resolved AS (SELECT upload_id, CASE WHEN status = 'pending' AND id_a % 41 <> 0 AND id_b % 41 <> 0 AND m < 2 THEN 'merged' WHEN status = 'pending' AND id_a % 41 <> 0 AND id_b % 41 <> 0 AND m IN (2, 3) THEN 'dismissed' ELSE status END AS status FROM c)"""


def q_replaced(spark, sf_dir):
    """Provenance of records that a second extraction of their file replaces."""
    files = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 500).cast("long").alias("source_file_id")).filter("source_file_id % 3 = 0").distinct()
    return V.replace_extracted(records(spark, sf_dir), files, F.lit("2030-01-01").cast("timestamp_ntz"))[1]


def q_filled(spark, sf_dir):
    """Customers whose blank fields come from the first order that has them."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    blank = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("sex"))
    come = o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("name "), F.col("o_orderpriority"))).otherwise(" ").alias("name"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("sex"))
    return V.fill_blanks(blank, come, "c_custkey", ["name", "sex"], ["o_orderkey"])


FILLED_SQL = """
WITH n AS (SELECT o_custkey, arg_min('name ' || o_orderpriority, o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), s AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, n.v) AS name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, s.v) AS sex
FROM customer LEFT JOIN n ON n.o_custkey = c_custkey LEFT JOIN s ON s.o_custkey = c_custkey
"""


def q_scrub_arguments(spark, sf_dir):
    """Names, number and date known of the patients of each owner."""
    c = table(spark, sf_dir, "customer")
    p = c.select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("id"), F.concat(F.lit("Name "), (F.col("c_custkey") % 40).cast("string")).alias("name"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("M"), F.col("c_custkey").cast("string"))).alias("mrn"), F.when(F.col("c_acctbal") > 5000, F.lit("1950-01-01")).alias("dob"))
    return V.scrub_arguments(p, "owner").select("owner", F.size("names").cast("long").alias("n_names"), F.array_join("names", "|").alias("names"), "mrn", "dob")


SCRUB_SQL = """
WITH p AS (SELECT c_nationkey AS owner, c_custkey AS id, 'Name ' || (c_custkey % 40) AS name, CASE WHEN c_custkey % 5 = 0 THEN 'M' || c_custkey END AS mrn, CASE WHEN c_acctbal > 5000 THEN '1950-01-01' END AS dob FROM customer),
n AS (SELECT owner, count(*) AS n_names, string_agg(name, '|' ORDER BY id) AS names FROM (SELECT owner, name, min(id) AS id FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT owner, n_names, names, mrn, dob FROM n JOIN (SELECT owner, arg_min(mrn, id) FILTER (WHERE mrn IS NOT NULL) AS mrn, arg_min(dob, id) FILTER (WHERE dob IS NOT NULL) AS dob FROM p GROUP BY 1) USING (owner)
"""


def q_references(spark, sf_dir):
    """How assessments refer to the other records of their document."""
    r = active(records(spark, sf_dir))
    cls = F.when(F.col("id") % 97 == 0, "assessment_plan").when(F.col("record_type") == "observation", "lab_result").otherwise(F.col("record_type"))
    return V.document_references(r.select(F.col("source_file_id").alias("doc_id"), "id", cls.alias("entity_class")))


REFERENCES_SQL = f"""
WITH {RECORDS_SQL}, e AS (SELECT source_file_id AS doc_id, id, CASE WHEN id % 97 = 0 THEN 'assessment_plan' WHEN record_type = 'observation' THEN 'lab_result' ELSE record_type END AS cls FROM active)
SELECT p.id AS document_record_id, o.id AS referenced_record_id, CASE o.cls WHEN 'medication' THEN 'prescribes' WHEN 'lab_result' THEN 'supports' ELSE 'addresses' END AS reference_type
FROM e p JOIN e o USING (doc_id) WHERE p.cls = 'assessment_plan' AND o.cls NOT IN ('assessment_plan', 'encounter')
"""


def q_best_encounters(spark, sf_dir):
    """One encounter per file and day."""
    r = active(records(spark, sf_dir)).filter("record_type = 'encounter' AND effective_date IS NOT NULL")
    i = F.col("id")
    e = r.select(F.col("source_file_id").alias("doc_id"), i.alias("pos"), "effective_date", (i % 7 == 0).alias("boilerplate"), F.when(i % 3 == 0, "someone").alias("provider"), (i % 5).cast("int").alias("n_fields"))
    return T.best_encounters(e).select("doc_id", "pos", F.col("score").cast("long").alias("score"))


ENCOUNTERS_SQL = f"""
WITH {RECORDS_SQL}, e AS (SELECT source_file_id AS doc_id, id AS pos, CAST(effective_date AS DATE) AS day, CASE WHEN id % 7 = 0 THEN 0 ELSE 1000 END + CASE WHEN id % 3 = 0 THEN 100 ELSE 0 END + 50 + id % 5 AS score FROM active WHERE record_type = 'encounter' AND effective_date IS NOT NULL)
SELECT doc_id, pos, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, day ORDER BY score DESC, pos) AS place FROM e) WHERE place = 1
"""


def q_best_medications(spark, sf_dir):
    """One row per drug of a file: by code, or by name where there is no code."""
    r = active(records(spark, sf_dir)).filter("record_type = 'medication'")
    m = r.select(F.col("source_file_id").alias("doc_id"), F.col("id").alias("pos"), "code_value", F.element_at(F.array(F.lit("aspirin 81 mg"), F.lit("Metformin"), F.lit("zolpidem")), (F.col("id") % 3 + 1).cast("int")).alias("text"), (F.col("id") % 5).cast("int").alias("n_fields"))
    return T.best_medications(m).select("doc_id", "pos", "code_value", "text")


MEDICATIONS_SQL = f"""
WITH {RECORDS_SQL}, m AS (SELECT source_file_id AS doc_id, id AS pos, code_value, list_extract(['aspirin 81 mg', 'Metformin', 'zolpidem'], id % 3 + 1) AS text, id % 5 AS n_fields FROM active WHERE record_type = 'medication')
SELECT doc_id, pos, code_value, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, code_value, CASE WHEN code_value IS NULL THEN text END ORDER BY n_fields DESC, pos) AS place FROM m) WHERE place = 1
"""


def q_first_entities(spark, sf_dir):
    """The first of entities whose texts differ in brackets and dates only."""
    p = table(spark, sf_dir, "part")
    e = p.select(F.floor(F.col("p_partkey") / 100).cast("long").alias("doc_id"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 3).alias("entity_class"), F.concat(F.col("p_type"), F.lit(" ("), F.col("p_brand"), F.lit(")  2021-03-"), (F.col("p_partkey") % 9 + 10).cast("string")).alias("text"))
    return T.first_entities(e).select("doc_id", "pos", "entity_class")


FIRST_SQL = """
SELECT doc_id, pos, entity_class FROM (SELECT p_partkey // 100 AS doc_id, p_partkey AS pos, p_size % 3 AS entity_class, row_number() OVER (PARTITION BY p_partkey // 100, p_size % 3, lower(p_type) ORDER BY p_partkey) AS place FROM part) WHERE place = 1
"""

#: Words before an entity, and what an entity of class DISEASE becomes after them.
SAID = [("patient has", "condition"), ("No sign of", None), ("Mother has", "family_history"), ("history of", "condition"), ("if", None), ("Denied, but sister has", "family_history"), ("knows of", "condition")]


def q_dispositions(spark, sf_dir):
    """What spans become, by the words before them."""
    e = table(spark, sf_dir, "events")
    before = F.get(F.array(*[F.lit(s) for s, _ in SAID]), (F.col("event_id") % len(SAID)).cast("int"))
    a = T.assertion(before, F.lit(""))
    label = F.when(F.col("event_id") % 2 == 0, "DISEASE").otherwise("CHEMICAL")
    x = e.select(label.alias("label"), before.alias("said"), T.disposition(label, a).alias("entity_class"), T.entity_status(a).alias("status"))
    return x.groupBy("label", "said", "entity_class", "status").agg(F.count("*").alias("n"))


DISPOSITIONS_SQL = f"""
WITH s AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{s}', {repr(c) if c else 'NULL'})" for i, (s, c) in enumerate(SAID))}) v(i, said, cls)), e AS (SELECT event_id % 2 = 0 AS disease, event_id % {len(SAID)} AS i FROM events)
SELECT CASE WHEN disease THEN 'DISEASE' ELSE 'CHEMICAL' END AS label, said, CASE WHEN disease THEN cls WHEN i IN (1, 4, 5) THEN NULL ELSE 'medication' END AS entity_class, CASE WHEN said = 'history of' THEN 'historical' ELSE 'active' END AS status, count(*) AS n
FROM e JOIN s USING (i) GROUP BY ALL
"""


def q_field_updates(spark, sf_dir):
    """Orders updated field by field by a newer version, and the update taken back."""
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    fields = lambda status, priority, extra: F.map_filter(F.create_map(F.lit("resourceType"), F.lit("Order"), F.lit("status"), status, F.lit("priority"), priority, F.lit("id"), i.cast("string"), F.lit("extra"), extra), lambda k, v: v.isNotNull())
    old = fields(F.col("o_orderstatus"), F.col("o_orderpriority"), F.when(i % 3 == 0, "x"))
    new = fields(F.when(i % 2 == 0, "Z").otherwise(F.col("o_orderstatus")), F.col("o_orderpriority"), F.when(i % 5 == 0, "y"))
    m = R.revert_fields(R.merge_fields(o.select("o_orderkey", old.alias("old"), new.alias("new"))))
    flat = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("o_orderkey", F.array_join("fields_updated", ",").alias("fields_updated"), F.try_element_at("updated", F.lit("status")).alias("status"), F.try_element_at("updated", F.lit("extra")).alias("extra"), (flat("reverted") == flat("old")).alias("restored"))


FIELDS_SQL = """
WITH x AS (SELECT o_orderkey, o_orderstatus AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS e, CASE WHEN o_orderkey % 5 = 0 THEN 'y' END AS f FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN e IS DISTINCT FROM f THEN 'extra' END, CASE WHEN s <> t THEN 'status' END) AS fields_updated, t AS status, CASE WHEN e IS DISTINCT FROM f THEN f ELSE e END AS extra, true AS restored FROM x
"""


def q_epic_results(spark, sf_dir):
    """Result rows of an Epic export as records."""
    l = spread(table(spark, sf_dir, "lineitem"))
    rows = l.select(
        F.col("l_orderkey").cast("string").alias("ORDER_PROC_ID"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_linenumber").cast("string")).otherwise(" ").alias("LINE"),
        F.when(F.col("l_partkey") % 11 != 0, F.concat(F.lit(" component "), (F.col("l_partkey") % 10).cast("string"))).alias("COMPONENT_ID_NAME"), F.floor("l_quantity").cast("string").alias("ORD_NUM_VALUE"),
        F.lit("5").alias("REFERENCE_LOW"), F.lit("40").alias("REFERENCE_HIGH"), F.lit("mg/dL").alias("REFERENCE_UNIT"), F.date_format("l_shipdate", "M/d/yyyy h:mm:ss a").alias("RESULT_DATE"),
        F.when(F.col("l_linestatus") == "O", "Preliminary result").otherwise("Final").alias("RESULT_STATUS_C_NAME"), F.when(F.col("l_returnflag") == "R", "High").when(F.col("l_returnflag") == "A", "L").alias("RESULT_FLAG_C_NAME"),
    )
    p = fhir.project(epic.to_resources(rows, "ORDER_RESULTS").withColumnsRenamed({"source_system": "system", "external_id": "key"}).withColumn("resource", F.parse_json("resource_json")), source_format="epic_ehi", only="Observation")
    reading = fhir.reading("resource", F.col("display_text"))
    return p.select("key", "system", "record_type", "display_text", "status", F.to_date("effective_date").alias("day"), reading["value"].alias("value"), reading["interpretation"].alias("interpretation"), reading["ref_high"].alias("ref_high")).groupBy("system", "record_type", "display_text", "status", "day", "interpretation", "ref_high").agg(F.count("*").alias("n"), F.count("key").alias("n_keys"), F.sum("value").alias("total"))


EPIC_SQL = """
SELECT CASE WHEN l_suppkey % 9 <> 0 THEN 'epic:ORDER_RESULTS' END AS system, 'observation' AS record_type, 'component ' || (l_partkey % 10) AS display_text, CASE WHEN l_linestatus = 'O' THEN 'preliminary' ELSE 'final' END AS status, CAST(l_shipdate AS DATE) AS day,
  CASE l_returnflag WHEN 'R' THEN 'H' WHEN 'A' THEN 'L' ELSE '' END AS interpretation, 40.0::DOUBLE AS ref_high, count(*) AS n, count(CASE WHEN l_suppkey % 9 <> 0 THEN 1 END) AS n_keys, sum(floor(l_quantity)) AS total
FROM lineitem WHERE l_partkey % 11 <> 0 GROUP BY ALL
"""


def q_encounter_people(spark, sf_dir):
    """Bundles of orders and their suppliers: names of those an encounter refers to, filled in from the bundle."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    person = F.struct(F.when(F.col("l_linenumber") == 2, F.lit("On call")).alias("display"), F.concat(F.lit("Practitioner/"), F.col("l_suppkey").cast("string")).alias("reference"))
    who = F.struct(F.lit("Practitioner").alias("resourceType"), F.col("l_suppkey").cast("string").alias("id"), F.array(F.struct(F.col("s_name").alias("text"))).alias("name"))
    g = l.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", F.struct(person.alias("individual")).alias("p"), F.when(F.col("s_name").isNotNull() & (F.col("l_suppkey") % 4 != 0), F.to_json(F.struct(who.alias("resource")))).alias("w")))).alias("x"))
    enc = F.to_json(F.struct(F.struct(F.lit("Encounter").alias("resourceType"), F.transform("x", lambda y: y["p"]).alias("participant")).alias("resource")))
    body = F.concat(F.lit('{"resourceType":"Bundle","entry":['), F.array_join(F.concat(F.array(enc), F.filter(F.transform("x", lambda y: y["w"]), lambda w: w.isNotNull())), ","), F.lit("]}"))
    rows = fhir_bundle.from_documents(g.select(F.col("l_orderkey").cast("string").alias("file"), F.parse_json(body).alias("doc")))
    people = fhir_bundle.encounter_people(rows)
    return people.select(F.col("file").cast("long").alias("l_orderkey"), F.array_join("people", "|", "?").alias("people"))


PEOPLE_SQL = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 2 THEN 'On call' WHEN l_suppkey % 4 <> 0 THEN s_name END AS who FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey)
SELECT l_orderkey, string_agg(coalesce(who, '?'), '|' ORDER BY l_linenumber, l_suppkey) AS people FROM x GROUP BY 1
"""

QUERIES = {
    "q63_timeline_previews": (q_previews, PREVIEW_SQL),
    "q64_record_titles": (q_titles, TITLES_SQL),
    "q65_lab_lines": (q_lab_lines, LAB_SQL),
    "q66_first_dates": (q_first_dates, FIRST_DATES_SQL),
    "q67_entity_dates": (q_entity_dates, ENTITY_DATES_SQL),
    "q68_term_codes": (q_term_codes, TERM_CODES_SQL),
    "q69_review_resolve": (q_review, CANDIDATES_SQL + " SELECT upload_id, status, count(*) AS n FROM resolved GROUP BY 1, 2"),
    "q70_review_uploads": (q_review_uploads, CANDIDATES_SQL + ", s AS (SELECT upload_id, count(*) FILTER (WHERE status = 'pending') AS n_pending FROM resolved GROUP BY 1) SELECT *, CASE WHEN n_pending = 0 THEN 'completed' ELSE 'awaiting_review' END AS ingestion_status FROM s"),
    "q71_review_undo": (q_review_undo, CANDIDATES_SQL + " SELECT upload_id, CASE WHEN status = 'merged' AND id_a % 2 = 0 THEN 'pending' ELSE status END AS status, count(*) AS n FROM c GROUP BY 1, 2"),
    "q72_reextraction": (q_replaced, f"WITH {RECORDS_SQL} SELECT id AS record_id, 'reextraction_replace' AS action, source_file_id, 'extraction_worker' AS agent FROM records WHERE ai_extracted AND deleted_at IS NULL AND source_file_id % 3 = 0"),
    "q73_fill_blanks": (q_filled, FILLED_SQL),
    "q74_scrub_arguments": (q_scrub_arguments, SCRUB_SQL),
    "q75_document_references": (q_references, REFERENCES_SQL),
    "q76_best_encounters": (q_best_encounters, ENCOUNTERS_SQL),
    "q77_best_medications": (q_best_medications, MEDICATIONS_SQL),
    "q78_first_entities": (q_first_entities, FIRST_SQL),
    "q79_dispositions": (q_dispositions, DISPOSITIONS_SQL),
    "q80_field_updates": (q_field_updates, FIELDS_SQL),
    "q81_epic_results": (q_epic_results, EPIC_SQL),
    "q82_encounter_people": (q_encounter_people, PEOPLE_SQL),
}
