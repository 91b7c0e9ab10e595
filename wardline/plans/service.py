"""Queries behind the service's screens: scopes, searches, merges, histories, summaries, scoring, extraction tails."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from wardline.functions import fhir
from wardline.functions.deident import scrub
from wardline.operators import access as A
from wardline.operators import scorer
from wardline.operators import text as T
from wardline.operators.review import reference_totals
from wardline.plans.records import RECORDS_SQL, active, records
from wardline.plans.resolution import SCAN_SQL, _scored
from wardline.session import spread, table

KEY = b"0123456789abcdef0123456789abcdef"


def q_scope(spark, sf_dir):
    """Of three ways to choose records the first given counts; days are included at both ends."""
    r = active(records(spark, sf_dir))
    a = A.scope(r, record_types=["medication", "condition"], category="observation", date_from=dt.date(2024, 1, 5), date_to=dt.date(2024, 1, 20))
    b = A.scope(r, category="full", date_to=dt.date(2024, 1, 10))
    c = A.scope(r, record_ids=[3, 8, 21], record_types=["medication"])
    named = lambda df, n: df.select(F.lit(n).alias("choice"), "id", "record_type")
    return named(a, "types").union(named(b, "full")).union(named(c, "ids"))


SCOPE_SQL = f"""
WITH {RECORDS_SQL}
SELECT 'types' AS choice, id, record_type FROM active WHERE record_type IN ('medication', 'condition') AND effective_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
UNION ALL SELECT 'full', id, record_type FROM active WHERE effective_date <= DATE '2024-01-10'
UNION ALL SELECT 'ids', id, record_type FROM active WHERE id IN (3, 8, 21)
"""


def q_table_search(spark, sf_dir):
    r = A.table_search(active(records(spark, sf_dir)), "CODE 23", ["display_text", "code_display", "source_format", "code_value"], "observation")
    return r.select("id", "display_text", "code_value", A.real_value(F.col("display_text"), F.when(F.col("id") % 2 == 0, F.col("display_text"))).alias("real"), A.category_label(F.col("source_section"), F.array("record_type")).alias("label"))


SEARCH_SQL = f"""
WITH {RECORDS_SQL}
SELECT id, display_text, code_value, id % 2 <> 0 AS real, coalesce(source_section, record_type) AS label FROM active
WHERE record_type = 'observation' AND contains(lower(display_text || ' ' || coalesce(code_display, '') || ' ' || source_format || ' ' || coalesce(code_value, '')), 'code 23')
"""


def _candidates(spark, sf_dir):
    n = F.col("id_a") + F.col("id_b")
    s = _scored(spark, sf_dir).filter("score >= 0.5").select("user_id", "id_a", "id_b", "score", F.col("effective_date_a").alias("at"))
    return s.select("user_id", (F.col("id_a") * 1000000 + F.col("id_b")).alias("candidate_id"), "id_a", "id_b", F.when(n % 2 == 0, "merged").otherwise("pending").alias("status"), (F.col("score") >= 0.9).alias("auto_resolved"), F.when(n % 3 != 0, F.col("at")).alias("resolved_at"))


CANDIDATES_SQL = SCAN_SQL + """, c AS (
  SELECT s.user_id, id_a * 1000000 + id_b AS candidate_id, id_a, id_b, CASE WHEN (id_a + id_b) % 2 = 0 THEN 'merged' ELSE 'pending' END AS status, score >= 0.9 AS auto_resolved, CASE WHEN (id_a + id_b) % 3 <> 0 THEN a.effective_date END AS resolved_at
  FROM scored s JOIN active a ON a.id = id_a WHERE score >= 0.5
)"""


def q_merges_page(spark, sf_dir):
    """The automatic merges of each user whose texts hold an I, the last first, with counts of both kinds."""
    p = A.merges_page(_candidates(spark, sf_dir).drop("user_id"), active(records(spark, sf_dir)), search="i", source="auto")
    return p.select("user_id", "place", "candidate_id", "text_a", "text_b", "n_auto", "n_manual")


MERGES_SQL = CANDIDATES_SQL + """, m AS (
  SELECT c.*, a.display_text AS text_a, b.display_text AS text_b FROM c JOIN active a ON a.id = id_a JOIN active b ON b.id = id_b WHERE c.status = 'merged' AND (a.display_text ILIKE '%i%' OR b.display_text ILIKE '%i%')
), n AS (SELECT user_id, count(*) FILTER (WHERE auto_resolved) AS n_auto, count(*) FILTER (WHERE NOT auto_resolved) AS n_manual FROM m GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY resolved_at DESC NULLS LAST, candidate_id) AS place FROM m WHERE auto_resolved)
SELECT user_id, place, candidate_id, text_a, text_b, n_auto, n_manual FROM p JOIN n USING (user_id) WHERE place <= 20
"""


def q_visible(spark, sf_dir):
    """Candidates a reader of even users may see, and the batch each is saved in."""
    mine = active(records(spark, sf_dir)).filter("user_id % 2 = 0")
    return A.batches(A.visible_candidates(_candidates(spark, sf_dir), mine), "user_id", "candidate_id", 5).groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("candidate_id").alias("first_candidate"))


VISIBLE_SQL = CANDIDATES_SQL + """, v AS (SELECT *, CAST((row_number() OVER (PARTITION BY user_id ORDER BY candidate_id) - 1) // 5 AS INTEGER) AS batch FROM c WHERE user_id % 2 = 0)
SELECT user_id, batch, count(*) AS n, min(candidate_id) AS first_candidate FROM v GROUP BY 1, 2
"""


def q_upload_history(spark, sf_dir):
    """The last uploads of each customer, of those still open."""
    o = table(spark, sf_dir, "orders")
    return A.history(o, "o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus") != "F", 10).select("o_custkey", "place", "o_orderkey", "o_orderdate")


HISTORY_SQL = """
SELECT o_custkey, place, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'F') WHERE place <= 10
"""


def q_basket(spark, sf_dir):
    """Each user's chosen records, deleted ones too."""
    r = records(spark, sf_dir)
    items = r.filter("id % 5 = 0").select("user_id", F.col("id").alias("record_id"), F.col("created_at").alias("chosen_at"))
    return A.basket(items, r).select("user_id", "place", "record_id", "display_text")


BASKET_SQL = f"WITH {RECORDS_SQL} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place, id AS record_id, display_text FROM records WHERE id % 5 = 0"


def q_summaries(spark, sf_dir):
    """Summaries as stored and read back: text, JSON or both; sealed and opened on the way."""
    p = table(spark, sf_dir, "part")
    said, data = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")), F.when(F.col("p_partkey") % 3 != 1, F.to_json(F.struct("p_size")))
    key = F.lit(KEY)
    stored = p.select("p_partkey", "p_brand", F.encode(A.summary_text(said, data), "utf-8").alias("plain"))
    # Old rows were stored before sealing and pass as they are.
    kept = stored.withColumn("stored", F.when(F.col("p_partkey") % 7 == 0, F.col("plain")).otherwise(A.seal(F.col("plain"), key)))
    back = kept.withColumn("read", A.read_summary(F.decode(A.unseal(F.col("stored"), key), "utf-8")))
    return back.select("p_partkey", "read.said", "read.data", (F.col("stored") != F.col("plain")).alias("sealed"), A.blind_index(F.concat(F.lit(" "), F.upper("p_brand")), KEY).alias("brand_index"))


def _hmac_sql(text: str) -> str:
    """HMAC-SHA256 of a text by its definition."""
    inner, outer = (bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({text}))))"


SUMMARIES_SQL = f"""
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS said, CASE WHEN p_partkey % 3 <> 1 THEN '{{"p_size":' || p_size || '}}' END AS data, p_partkey % 7 <> 0 AS sealed, {_hmac_sql('lower(p_brand)')} AS brand_index FROM part
"""


def q_facilities(spark, sf_dir):
    """Encounters of orders: the first place that names a facility becomes the provider; what a judge sees of them; fields filled."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    k = F.col("o_orderkey")
    names = F.array(F.when(k % 3 == 0, "Exam Room 4").when(k % 3 == 1, "Main Street").otherwise("North Clinic"), F.when(k % 4 == 0, F.concat(F.lit("Hospital "), (k % 9).cast("string"))).when(k % 4 == 1, "Ward B, City Hospital"))
    places = F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.struct(F.struct(n.alias("display")).alias("location")))
    doc = F.to_json(F.struct(F.lit("Encounter").alias("resourceType"), F.col("o_orderstatus").alias("status"), places.alias("location"), F.when(k % 5 == 0, F.struct(F.lit("Own").alias("display"))).alias("serviceProvider"), F.struct(F.lit("Ada").alias("display")).alias("subject"), F.lit("mail a@b.org").alias("note"), F.when(k % 2 == 0, F.lit("")).alias("text")))
    x = o.select(k.alias("o_orderkey"), fhir.with_service_provider(doc).alias("doc"))
    seen = fhir.bound(fhir.judged_text(F.col("doc"), scrub), lambda t: F.struct(F.get_json_object(t, "$.note").alias("note"), F.get_json_object(t, "$.subject").isNull().alias("nameless")))
    x = x.withColumn("seen", seen)
    return x.select("o_orderkey", F.get_json_object("doc", "$.serviceProvider.display").alias("provider"), "seen.note", "seen.nameless", fhir.populated_fields(F.col("doc")).alias("n_fields"))


FACILITIES_SQL = """
WITH x AS (SELECT o_orderkey AS k, CASE WHEN k % 5 = 0 THEN 'Own' WHEN k % 3 = 2 THEN 'North Clinic' WHEN k % 4 = 0 THEN 'Hospital ' || (k % 9) END AS provider FROM orders)
SELECT k AS o_orderkey, provider, 'mail [EMAIL]' AS note, true AS nameless, CAST(4 + CASE WHEN provider IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_fields FROM x
"""


def q_engines(spark, sf_dir):
    """Engines tried for each order's page."""
    k = F.col("o_orderkey")
    pick = lambda n: F.when(n % 3 == 0, "ok").when(n % 3 == 1, "refused").otherwise("error")
    results = F.create_map(F.lit("cloud"), pick(k), F.lit("local"), pick(k + 1), F.lit("tiny"), pick(k + 2))
    chosen = F.when(k % 4 == 0, "cloud").when(k % 4 == 1, "local").otherwise("tiny")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(A.engines(chosen, F.array(F.lit("cloud")), results), ">").alias("tried"))


ENGINES_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'cloud' WHEN o_orderkey % 4 = 1 THEN CASE WHEN (o_orderkey + 1) % 3 = 0 THEN 'local' ELSE 'local>tiny' END ELSE CASE WHEN (o_orderkey + 2) % 3 = 0 THEN 'tiny' ELSE 'tiny>local' END END AS tried FROM orders
"""


def scored_notes(spark, sf_dir):
    """What notes hold, must not give, tell of relatives, and what was extracted."""
    l = table(spark, sf_dir, "lineitem").withColumn("note", F.col("l_orderkey"))
    n = F.col("l_partkey")
    word = F.concat(F.when(n % 3 == 0, "HTN").when(n % 3 == 1, "breast ca").otherwise("142 over 90"), F.lit(" case "), (n % 5).cast("string"))
    full = F.concat(F.when(n % 3 == 0, "hypertension").when(n % 3 == 1, "breast cancer").otherwise("142/90"), F.lit(" case "), (n % 5).cast("string"))
    cls = F.when(F.col("l_linenumber") % 2 == 0, "condition").otherwise("medication")
    expected = l.filter("l_linenumber <= 2").select("note", cls.alias("entity_class"), word.alias("text"))
    found = l.filter("l_suppkey % 3 <> 0").select("note", F.when(F.col("l_suppkey") % 3 == 1, cls).otherwise("dosage").alias("entity_class"), F.concat(full, F.when(F.col("l_suppkey") % 2 == 0, F.lit(" today!")).otherwise("")).alias("text"))
    barred = l.filter("l_linenumber = 3").select("note", F.lit("medication").alias("entity_class"), word.alias("text"), F.when(n % 2 == 0, "negation").otherwise("attribution").alias("reason"))
    kin = l.filter("l_linenumber = 4").select("note", word.alias("text"))
    return expected, barred, kin, found


def q_extraction_scores(spark, sf_dir):
    """Extracted entities against what notes hold, by note."""
    return scorer.evaluate(*scored_notes(spark, sf_dir))


SCORES_SQL = """
WITH w AS (SELECT l_orderkey AS note, l_linenumber AS i, l_suppkey AS s, l_partkey AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'condition' ELSE 'medication' END AS cls,
  CASE l_partkey % 3 WHEN 0 THEN 'hypertension' WHEN 1 THEN 'breast cancer' ELSE '142/90' END || ' case ' || (l_partkey % 5) AS said FROM lineitem),
f AS (SELECT note, CASE WHEN s % 3 = 1 THEN cls ELSE 'dosage' END AS cls, said || CASE WHEN s % 2 = 0 THEN ' today' ELSE '' END AS said FROM w WHERE s % 3 <> 0),
e AS (SELECT note, cls, said, EXISTS (SELECT 1 FROM f WHERE f.note = w.note AND f.cls = w.cls AND contains(f.said, w.said)) AS hit FROM w WHERE i <= 2),
g AS (SELECT note, EXISTS (SELECT 1 FROM w WHERE i <= 2 AND f.note = w.note AND f.cls = w.cls AND contains(f.said, w.said)) AS hit FROM f WHERE cls <> 'dosage'),
b AS (SELECT note, n % 2 = 0 AS neg, EXISTS (SELECT 1 FROM f WHERE f.note = w.note AND f.cls = 'medication' AND contains(f.said, w.said)) AS hit FROM w WHERE i = 3),
k AS (SELECT note FROM w WHERE i = 4),
c AS (SELECT note, (SELECT count(*) FROM e WHERE e.note = x.note) AS wanted, (SELECT count(*) FROM e WHERE e.note = x.note AND hit) AS tp, (SELECT count(*) FROM g WHERE g.note = x.note AND NOT hit) AS fp,
  (SELECT count(*) FROM b WHERE b.note = x.note AND neg) AS n_neg, (SELECT count(*) FROM b WHERE b.note = x.note AND neg AND hit) AS v_neg, (SELECT count(*) FROM b WHERE b.note = x.note AND NOT neg) AS n_attr, (SELECT count(*) FROM b WHERE b.note = x.note AND NOT neg AND hit) AS v_attr,
  (SELECT count(*) FROM k WHERE k.note = x.note) AS n_kin FROM (SELECT note FROM e UNION SELECT note FROM g UNION SELECT note FROM b UNION SELECT note FROM k UNION SELECT note FROM f WHERE cls <> 'dosage') x),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN wanted = tp THEN 1.0 ELSE 0.0 END AS p, CASE WHEN wanted > 0 THEN tp / wanted ELSE 1.0 END AS q FROM c)
SELECT note, tp, fp, wanted - tp AS fn, round_even(p, 4) AS precision, round_even(q, 4) AS recall, CASE WHEN p + q > 0 THEN round_even(2 * p * q / (p + q), 4) ELSE 0.0 END AS f1,
  CASE WHEN n_neg > 0 THEN round_even(1 - v_neg / n_neg, 4) ELSE 1.0 END AS negation_accuracy, CASE WHEN n_attr + n_kin > 0 THEN round_even((n_attr - v_attr) / (n_attr + n_kin), 4) ELSE 1.0 END AS attribution_accuracy FROM r
"""


def q_chunk_results(spark, sf_dir):
    """Orders as documents whose lines are chunks: those that failed, and what the others found with its section."""
    l = table(spark, sf_dir, "lineitem")
    one = F.struct(F.col("l_returnflag").alias("entity_class"), F.col("l_partkey").cast("string").alias("text"))
    r = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_no"), F.when(F.col("l_suppkey") % 2 == 0, "labs").otherwise("vitals").alias("section_type"), F.when(F.col("l_suppkey") % 5 == 0, "late").when(F.col("l_suppkey") % 5 == 1, " ").alias("error"), F.when(F.col("l_suppkey") % 7 != 0, F.array(one, one)).alias("entities"))
    found, counts = T.collect_chunks(r)
    per = found.groupBy("doc_id").agg(F.count("*").alias("n_entities"), F.count_if(F.col("source_section") == "labs").alias("n_labs"))
    return counts.join(per, "doc_id", "left").fillna(0)


CHUNK_RESULTS_SQL = """
WITH x AS (SELECT l_orderkey AS doc_id, l_suppkey % 5 = 0 OR l_suppkey % 7 = 0 AS failed, l_suppkey % 2 = 0 AS labs FROM lineitem)
SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE failed) AS n_failed, 2 * count(*) FILTER (WHERE NOT failed) AS n_entities, 2 * count(*) FILTER (WHERE NOT failed AND labs) AS n_labs FROM x GROUP BY 1
"""


def _entities(spark, sf_dir):
    """Lines of orders as entities of documents."""
    l = table(spark, sf_dir, "lineitem")
    i, n = F.col("l_linenumber"), F.col("l_partkey")
    pos = (i * 10_000_000 + n) * 100_000 + F.col("l_suppkey")
    cls = F.when(n % 6 == 0, "encounter").when(n % 6 == 1, "condition").when(n % 6 == 2, "medication").when(n % 6 == 3, "assessment_plan").when(n % 6 == 4, "provider").otherwise("procedure")
    text = F.when(n % 18 == 0, "After Visit Summary").when(n % 6 == 2, F.concat(F.lit("Drug "), (n % 10).cast("string"))).when(n % 6 == 4, F.lit(" Dr Reed ")).when(n % 6 == 5, F.when(n % 4 == 0, "recommend biopsy").otherwise("Appendectomy")).otherwise(F.concat(F.lit("Thing "), (n % 3).cast("string")))
    return l.select(F.col("l_orderkey").alias("doc_id"), pos.alias("pos"), cls.alias("entity_class"), text.alias("text"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("status"), F.when(n % 12 == 4, F.concat(F.lit("Dr "), i.cast("string"))).alias("name"), F.when(n % 4 == 0, F.col("l_shipdate")).alias("entity_date"), F.when(F.col("l_orderkey") % 2 == 0, F.lit("2024-02-03").cast("timestamp_ntz")).alias("visit_date"))


ENTITIES_SQL = """
e AS (SELECT l_orderkey AS doc_id, (l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey AS pos, l_partkey AS n, l_partkey % 6 AS m,
  CASE WHEN l_partkey % 18 = 0 THEN 'After Visit Summary' ELSE CASE l_partkey % 6 WHEN 2 THEN 'Drug ' || (l_partkey % 10) WHEN 4 THEN ' Dr Reed ' WHEN 5 THEN CASE WHEN l_partkey % 4 = 0 THEN 'recommend biopsy' ELSE 'Appendectomy' END ELSE 'Thing ' || (l_partkey % 3) END END AS text,
  CASE WHEN l_partkey % 12 = 4 THEN 'Dr ' || l_linenumber END AS name, CASE WHEN l_partkey % 4 = 0 THEN l_shipdate END AS entity_date, CASE WHEN l_orderkey % 2 = 0 THEN TIMESTAMP '2024-02-03' END AS visit_date FROM lineitem),
facts AS (SELECT doc_id, coalesce(arg_min(entity_date, pos) FILTER (WHERE m = 0 AND entity_date IS NOT NULL), max(visit_date)) AS document_date, arg_min(coalesce(name, trim(text)), pos) FILTER (WHERE m = 4) AS document_provider FROM e GROUP BY 1)"""


def q_document_facts(spark, sf_dir):
    return T.document_facts(_entities(spark, sf_dir))


def q_confirmed(spark, sf_dir):
    """Records of confirmed documents, those an encounter is linked to, and references of assessments."""
    rows, _ = T.confirm(spread(_entities(spark, sf_dir), "doc_id"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_records"), F.count("effective_date").alias("n_dated"), F.count("linked_encounter_id").alias("n_linked"), *reference_totals("prescribes"))


CONFIRMED_SQL = f"""
WITH {ENTITIES_SQL}, r AS (SELECT e.*, coalesce(entity_date, document_date) AS seen FROM e JOIN facts USING (doc_id) WHERE m <> 4 AND text <> 'recommend biopsy'),
v AS (SELECT *, CAST(seen AS DATE) AS day, text = 'After Visit Summary' AS chrome, coalesce(min(CAST(seen AS DATE)) OVER d < max(CAST(seen AS DATE)) OVER d, false) AS several FROM r WHERE m = 0 WINDOW d AS (PARTITION BY doc_id)),
met AS (SELECT doc_id, pos, m, seen FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN several THEN coalesce(CAST(day AS VARCHAR), CAST(pos AS VARCHAR)) END ORDER BY chrome, seen IS NULL, pos) AS k FROM v WHERE NOT (several AND day IS NULL AND chrome)) WHERE k = 1),
others AS (SELECT doc_id, pos, m, seen FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, m, text ORDER BY pos) AS k FROM r WHERE m <> 0) WHERE k = 1),
kept AS (SELECT * FROM met UNION ALL SELECT * FROM others),
n AS (SELECT doc_id, count(*) AS n_records, count(seen) AS n_dated, CASE WHEN count(*) FILTER (WHERE m = 0) > 0 THEN count(*) FILTER (WHERE m <> 0) ELSE 0 END AS n_linked, count(*) FILTER (WHERE m = 3) AS plans, count(*) FILTER (WHERE m IN (1, 2, 5)) AS others, count(*) FILTER (WHERE m = 2) AS drugs FROM kept GROUP BY 1)
SELECT doc_id, n_records, n_dated, n_linked, plans * others AS n_references, plans * drugs AS n_prescribes FROM n
"""


QUERIES = {
    "q83_prompt_scope": (q_scope, SCOPE_SQL),
    "q84_table_search": (q_table_search, SEARCH_SQL),
    "q85_merges_page": (q_merges_page, MERGES_SQL),
    "q86_visible_candidates": (q_visible, VISIBLE_SQL),
    "q87_upload_history": (q_upload_history, HISTORY_SQL),
    "q88_summary_basket": (q_basket, BASKET_SQL),
    "q89_sealed_summaries": (q_summaries, SUMMARIES_SQL),
    "q90_encounter_facilities": (q_facilities, FACILITIES_SQL),
    "q91_engines_tried": (q_engines, ENGINES_SQL),
    "q92_extraction_scores": (q_extraction_scores, SCORES_SQL),
    "q93_chunk_results": (q_chunk_results, CHUNK_RESULTS_SQL),
    "q94_document_facts": (q_document_facts, f"WITH {ENTITIES_SQL} SELECT * FROM facts"),
    "q95_confirmed_documents": (q_confirmed, CONFIRMED_SQL),
}
