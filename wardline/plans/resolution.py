"""Queries over entity resolution, upsert and jobs, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.operators import jobs as J
from wardline.operators import resolve as R
from wardline.operators import upsert as U
from wardline.plans.records import RECORDS_SQL, active, records
from wardline.session import table


def _scored(spark, sf_dir):
    return R.score(R.pairs(active(records(spark, sf_dir))))


def _uploaded(spark, sf_dir):
    r = active(records(spark, sf_dir))
    return R.score(R.pairs_between(r.filter("ai_extracted"), r.filter("NOT ai_extracted")))


def _pair_sql(name: str, source_a: str, source_b: str, order: str) -> str:
    return f"""
{name} AS (
  SELECT *, greatest(0.0, least(1.0, 0.0 + c + t + d + s + x + n)) AS score FROM (
    SELECT a.user_id, a.record_type, a.bucket, a.id AS id_a, b.id AS id_b,
      CASE WHEN a.code_value = b.code_value THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS c,
      CASE WHEN lower(a.display_text) = lower(b.display_text) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS t,
      CASE WHEN gap < 1 THEN 0.2::DOUBLE WHEN gap > 7 THEN (-0.35)::DOUBLE ELSE 0.0::DOUBLE END AS d,
      CASE WHEN a.status = b.status THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS s,
      CASE WHEN a.source_format <> b.source_format THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS x,
      CASE WHEN a.source_section = b.source_section THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS n
    FROM ({source_a}) a JOIN ({source_b}) b ON a.user_id = b.user_id AND a.record_type = b.record_type AND a.bucket = b.bucket {order},
      LATERAL (SELECT abs(epoch_us(a.effective_date) - epoch_us(b.effective_date)) / 86400000000.0 AS gap)
  )
)"""


_BUCKETED = "SELECT *, coalesce(nullif(code_value, ''), lower(left(display_text, 50))) AS bucket FROM active"
_EARLIER = "AND (a.effective_date IS NULL, coalesce(a.effective_date, TIMESTAMP '1970-01-01'), a.id) < (b.effective_date IS NULL, coalesce(b.effective_date, TIMESTAMP '1970-01-01'), b.id)"
SCAN_SQL = f"WITH {RECORDS_SQL}, {_pair_sql('scored', _BUCKETED, _BUCKETED, _EARLIER)}"
UPLOAD_SQL = f"WITH {RECORDS_SQL}, {_pair_sql('scored', _BUCKETED + ' WHERE NOT ai_extracted', _BUCKETED + ' WHERE ai_extracted', '')}"
DECIDED_SQL = UPLOAD_SQL + """, decided AS (
  SELECT *, CASE WHEN score >= 0.95 THEN 'merge' WHEN score >= 0.85 THEN 'merge' WHEN score < 0.65 THEN 'dismiss' ELSE 'pending' END AS decision,
    CASE WHEN score >= 0.85 THEN 'duplicate' WHEN score >= 0.75 THEN 'update' WHEN score >= 0.65 THEN 'related' ELSE 'distinct' END AS verdict
  FROM scored WHERE score >= 0.5 AND score >= 0.6
)"""
BEST_SQL = DECIDED_SQL + """, best AS (
  SELECT id_a AS primary_id, id_b AS secondary_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id_b ORDER BY score DESC, id_a) AS rn FROM decided WHERE decision = 'merge') WHERE rn = 1
)"""


def q_scan(spark, sf_dir):
    return _scored(spark, sf_dir).filter(F.col("score") >= R.SCAN_KEEP).select("user_id", "record_type", "bucket", "id_a", "id_b", F.bround("score", 6).alias("score"))


def q_upload(spark, sf_dir):
    return R.decide(_uploaded(spark, sf_dir)).select("id_a", "id_b", F.bround("score", 6).alias("score"), "verdict", "decision")


def q_bands(spark, sf_dir):
    return _scored(spark, sf_dir).filter(F.col("score") >= R.UPLOAD_KEEP).groupBy(R.band().alias("band")).agg(F.count("*").alias("n"))


def q_summary(spark, sf_dir):
    d = R.decide(_uploaded(spark, sf_dir))
    return d.groupBy("record_type").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("decision") == "merge").alias("n_merge"), F.count_if(F.col("decision") == "dismiss").alias("n_dismiss"), F.count_if(F.col("decision") == "pending").alias("n_pending"), F.count_if("auto_resolved").alias("n_auto"))


def q_merged(spark, sf_dir):
    merges = R.best_merge(R.decide(_uploaded(spark, sf_dir)))
    return R.apply_merges(active(records(spark, sf_dir)), merges).select("id", "is_duplicate", "merged_into_id")


def q_undone(spark, sf_dir):
    merges = R.best_merge(R.decide(_uploaded(spark, sf_dir)))
    r = active(records(spark, sf_dir))
    return R.undo_merges(R.apply_merges(r, merges), merges).select("id", "is_duplicate", "merged_into_id", "display_text")


def q_greedy(spark, sf_dir):
    return R.greedy_merges(R.score(R.pairs(active(records(spark, sf_dir)), within_days=7)), threshold=0.9)


#: The pairs at the threshold of a bucket, folded in scan order.
GREEDY_SQL = SCAN_SQL + """, hit AS (
  SELECT s.user_id, s.record_type, s.bucket, list({'a': id_a, 'b': id_b, 's': score, 'gone': []::BIGINT[], 'merges': []::STRUCT(a BIGINT, b BIGINT, s DOUBLE)[]}
    ORDER BY a.effective_date NULLS LAST, id_a, b.effective_date NULLS LAST, id_b) AS pairs
  FROM scored s JOIN active a ON a.id = id_a JOIN active b ON b.id = id_b WHERE score >= 0.9 GROUP BY 1, 2, 3
), walked AS (
  SELECT list_reduce(list_prepend({'a': 0::BIGINT, 'b': 0::BIGINT, 's': 0.0::DOUBLE, 'gone': []::BIGINT[], 'merges': []::STRUCT(a BIGINT, b BIGINT, s DOUBLE)[]}, pairs), lambda w, x: {'a': x.a, 'b': x.b, 's': x.s,
    'gone': CASE WHEN list_contains(w.gone, x.a) OR list_contains(w.gone, x.b) THEN w.gone ELSE list_append(w.gone, x.b) END,
    'merges': CASE WHEN list_contains(w.gone, x.a) OR list_contains(w.gone, x.b) THEN w.merges ELSE list_append(w.merges, {'a': x.a, 'b': x.b, 's': x.s}) END}).merges AS merges FROM hit
), m AS (SELECT unnest(merges) AS m FROM walked)
SELECT m.a AS primary_id, m.b AS secondary_id, m.s AS score FROM m
"""


def q_unknown_pairs(spark, sf_dir):
    """Candidates left after those already known, in either order (every third pair is known, turned round)."""
    s = R.pairs(active(records(spark, sf_dir)))
    known = s.filter((F.col("id_a") + F.col("id_b")) % 3 == 0).select(F.col("id_b").alias("record_a_id"), F.col("id_a").alias("record_b_id"))
    return R.without_known(s, known).groupBy("user_id").agg(F.count("*").alias("n"))


def q_bulk(spark, sf_dir):
    s = _scored(spark, sf_dir).filter(F.col("score") >= R.UPLOAD_KEEP)
    c = s.select((F.col("id_a") * 1000000 + F.col("id_b")).alias("candidate_id"), "score", F.lit("pending").alias("status"))
    return R.resolve_bulk(c, "dismiss", low=60, high=80).groupBy("status").agg(F.count("*").alias("n"))


def q_review_page(spark, sf_dir):
    """Candidates joined with both records, best score first, a page per user."""
    r = active(records(spark, sf_dir))
    s = _scored(spark, sf_dir).filter(F.col("score") >= R.UPLOAD_KEEP).select("user_id", "id_a", "id_b", "score")
    side = lambda n: r.select(F.col("id").alias(f"id_{n}"), F.col("display_text").alias(f"text_{n}"), F.col("source_format").alias(f"format_{n}"))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "id_a", "id_b")
    page = s.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 20)
    return page.join(side("a"), "id_a").join(side("b"), "id_b").select("user_id", F.col("place").cast("long").alias("place"), "id_a", "id_b", "text_a", "text_b", "format_a", "format_b")


IDENTITY, ARRIVAL = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def _planned(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*IDENTITY, *ARRIVAL, "l_returnflag", U.content_hash(F.col("l_partkey"), F.col("l_returnflag")).alias("content_hash"))
    base = rows.filter(F.col("l_orderkey") % 4 == 0).groupBy(*IDENTITY).agg(F.min("content_hash").alias("content_hash")).withColumn("version", F.lit(3))
    return U.plan_batch(rows, base, IDENTITY, ARRIVAL)


PLAN_SQL = """
WITH rows AS (
  SELECT *, sha256('{"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '"}') AS content_hash FROM lineitem
), base AS (SELECT l_orderkey, l_linenumber, min(content_hash) AS base_hash, 3 AS base_version FROM rows WHERE l_orderkey % 4 = 0 GROUP BY 1, 2),
ordered AS (
  SELECT r.*, base_hash, base_version, coalesce(lag(content_hash) OVER w, base_hash) AS before_hash,
    row_number() OVER w AS arrival
  FROM rows r LEFT JOIN base b USING (l_orderkey, l_linenumber)
  WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity)
), stepped AS (
  SELECT *, before_hash IS NULL OR before_hash <> content_hash AS changes,
    sum(CASE WHEN before_hash IS NULL OR before_hash <> content_hash THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY arrival) AS step
  FROM ordered
), planned AS (
  SELECT *, CASE WHEN NOT changes THEN 'skip' WHEN base_version IS NULL AND step = 1 THEN 'insert' ELSE 'update' END AS action, CAST(coalesce(base_version, 0) + step AS INTEGER) AS version FROM stepped
), kept AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY version DESC) AS n FROM planned WHERE action <> 'skip')
"""


def q_plan(spark, sf_dir):
    return _planned(spark, sf_dir).select(*IDENTITY, "l_partkey", "l_suppkey", "l_extendedprice", "action", "version")


def q_current(spark, sf_dir):
    return U.current(_planned(spark, sf_dir), IDENTITY).select(*IDENTITY, "l_partkey", "version")


def q_history(spark, sf_dir):
    return U.history(_planned(spark, sf_dir), IDENTITY).select(*IDENTITY, "l_partkey", "version")


def q_collapse(spark, sf_dir):
    r = active(records(spark, sf_dir)).withColumn("day", F.col("effective_date").cast("date"))
    c = U.collapse(r, ["user_id", "record_type", "code_system", "code_value", "day"], ["id"], "source_system")
    return c.select("id", "n_rows", F.array_join("sources", ",").alias("sources"))


COLLAPSE_SQL = f"""
WITH {RECORDS_SQL}
SELECT min(id) AS id, count(*) AS n_rows, string_agg(DISTINCT source_system, ',' ORDER BY source_system) AS sources
FROM active GROUP BY user_id, record_type, code_system, code_value, CAST(effective_date AS DATE)
"""


def q_cascade(spark, sf_dir):
    """Soft delete of all records of some files; the files are those with the most extracted rows."""
    r = records(spark, sf_dir)
    files = r.groupBy("source_file_id").agg(F.count_if("ai_extracted").alias("n")).filter(F.col("n") > 71).select("source_file_id")
    return U.soft_delete(r, files, "source_file_id", F.lit("2024-02-01").cast("timestamp_ntz")).groupBy("source_file_id").agg(F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"), F.max("deleted_at").alias("last_deleted"))


CASCADE_SQL = f"""
WITH {RECORDS_SQL}, files AS (SELECT source_file_id FROM records GROUP BY 1 HAVING count(*) FILTER (WHERE ai_extracted) > 71),
done AS (SELECT r.source_file_id, CASE WHEN r.deleted_at IS NULL AND f.source_file_id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE r.deleted_at END AS deleted_at FROM records r LEFT JOIN files f USING (source_file_id))
SELECT source_file_id, count(deleted_at) AS n_deleted, max(deleted_at) AS last_deleted FROM done GROUP BY 1
"""


def q_same_file(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("completed")
    files = d.select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("file_hash"), F.lit(0).alias("created_at"), status.alias("status"))
    return U.earliest_same_file(files, ["completed"])


SAME_FILE_SQL = """
WITH files AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'completed' END AS status FROM documents),
origin AS (SELECT text, min(doc_id) AS original_id FROM files WHERE status = 'completed' GROUP BY text)
SELECT doc_id AS file_id, original_id FROM files JOIN origin USING (text) WHERE original_id < doc_id
"""


def q_backfill(spark, sf_dir):
    r = records(spark, sf_dir)
    return U.backfill_identity(r, (F.col("id") % 1000).cast("string"), ["id"]).select("id", "external_id")


BACKFILL_SQL = f"""
WITH {RECORDS_SQL}, wanted AS (SELECT *, CASE WHEN external_id IS NULL THEN CAST(id % 1000 AS VARCHAR) END AS claim FROM records),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, source_system, claim ORDER BY id) AS n FROM wanted)
SELECT p.id, CASE WHEN p.claim IS NOT NULL AND p.n = 1 AND NOT EXISTS (SELECT 1 FROM records t WHERE t.user_id = p.user_id AND t.source_system = p.source_system AND t.external_id = p.claim) THEN p.claim ELSE p.external_id END AS external_id
FROM placed p
"""


def q_basket(spark, sf_dir):
    r = active(records(spark, sf_dir))
    key = ["user_id", "code_value"]
    return U.add_missing(r.filter("source_format = 'fhir_r4' AND status = 'final'").select(*key), r.filter("code_value IS NOT NULL"), key)


BASKET_SQL = f"""
WITH {RECORDS_SQL}
SELECT DISTINCT user_id, code_value FROM active w WHERE code_value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM active b WHERE b.source_format = 'fhir_r4' AND b.status = 'final' AND b.user_id = w.user_id AND b.code_value = w.code_value)
"""


def job_table(spark, sf_dir):
    """Orders as upload jobs of their customers."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 4).alias("retries"))


JOBS_SQL = "jobs AS (SELECT o_orderkey AS job_id, o_custkey AS owner, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status, o_totalprice AS size, o_orderdate AS created_at, o_orderkey % 4 AS retries FROM orders)"


def q_progress(spark, sf_dir):
    return J.batch_progress(job_table(spark, sf_dir))


PROGRESS_SQL = f"""
WITH {JOBS_SQL}
SELECT owner, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed,
  round_even(coalesce(sum(CASE WHEN status = 'completed' THEN size ELSE 0 END), 0), 2) AS size_done, round_even(count(*) FILTER (WHERE status IN ('completed', 'failed')) * 100.0::DOUBLE / count(*), 1) AS percent
FROM jobs GROUP BY owner
"""


def q_queue(spark, sf_dir):
    return J.claim_order(job_table(spark, sf_dir), 3).select("owner", F.col("place").cast("long").alias("place"), "job_id")


QUEUE_SQL = f"WITH {JOBS_SQL} SELECT owner, place, job_id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created_at, job_id) AS place FROM jobs WHERE status = 'pending') WHERE place <= 3"


def q_recover(spark, sf_dir):
    jobs = J.recover_stuck(job_table(spark, sf_dir), F.lit("1998-01-01").cast("timestamp_ntz"), 30, 2)
    return jobs.select("job_id", "new_status", F.col("new_retries").cast("long").alias("new_retries"))


RECOVER_SQL = f"""
WITH {JOBS_SQL}, s AS (SELECT *, status = 'processing' AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AS stuck FROM jobs)
SELECT job_id, CASE WHEN stuck AND retries >= 2 THEN 'failed' WHEN stuck THEN 'pending' ELSE status END AS new_status, CAST(retries + CASE WHEN stuck AND retries < 2 THEN 1 ELSE 0 END AS BIGINT) AS new_retries FROM s
"""


def q_cancel(spark, sf_dir):
    jobs = job_table(spark, sf_dir)
    return jobs.groupBy("status", J.cancel_outcome(F.col("status"), F.col("retries") > 1).alias("outcome")).agg(F.count("*").alias("n"))


CANCEL_SQL = f"""
WITH {JOBS_SQL}
SELECT status, CASE WHEN status = 'completed' THEN 'refused' WHEN status = 'pending' THEN 'cancelled' WHEN retries > 1 THEN 'cancelled' ELSE 'requested' END AS outcome, count(*) AS n FROM jobs GROUP BY 1, 2
"""


def q_audit(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = J.audit_rows(p.select((F.col("p_partkey") % 10).alias("actor"), F.col("p_partkey").alias("logged_at"), F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("query")))
    order = Window.partitionBy("actor").orderBy(F.desc("logged_at"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= 50).select("actor", "logged_at", "query_hash", "query_chars")


AUDIT_SQL = """
SELECT actor, logged_at, query_hash, query_chars FROM (
  SELECT p_partkey % 10 AS actor, p_partkey AS logged_at, left(sha256(lower(trim(p_name))), 16) AS query_hash, length(trim(p_name)) AS query_chars, row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_partkey DESC) AS place FROM part
) WHERE place <= 50
"""


def q_patients(spark, sf_dir):
    """Uploads joined with their patients and countries: counts and sizes per country and segment."""
    j, c, n = job_table(spark, sf_dir), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    g = j.join(c, F.col("owner") == F.col("c_custkey")).groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n_jobs"), F.bround(F.sum("size"), 2).alias("size"), F.count_distinct("owner").alias("n_patients"))
    return g.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("segment"), "n_jobs", "size", "n_patients")


PATIENTS_SQL = f"""
WITH {JOBS_SQL}
SELECT n_name AS country, c_mktsegment AS segment, count(*) AS n_jobs, round_even(sum(size), 2) AS size, count(DISTINCT owner) AS n_patients
FROM jobs JOIN customer ON owner = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
"""

QUERIES = {
    "q20_scan_candidates": (q_scan, SCAN_SQL + " SELECT user_id, record_type, bucket, id_a, id_b, round_even(score, 6) AS score FROM scored WHERE score >= 0.7"),
    "q21_upload_decisions": (q_upload, DECIDED_SQL + " SELECT id_a, id_b, round_even(score, 6) AS score, verdict, decision FROM decided"),
    "q22_score_bands": (q_bands, SCAN_SQL + " SELECT CAST(floor(round_even(score * 100, 0) / 10) * 10 AS BIGINT) AS band, count(*) AS n FROM scored WHERE score >= 0.5 GROUP BY 1"),
    "q23_dedup_summary": (q_summary, DECIDED_SQL + " SELECT record_type, count(*) AS n_pairs, count(*) FILTER (WHERE decision = 'merge') AS n_merge, count(*) FILTER (WHERE decision = 'dismiss') AS n_dismiss, count(*) FILTER (WHERE decision = 'pending') AS n_pending, count(*) FILTER (WHERE decision <> 'pending') AS n_auto FROM decided GROUP BY 1"),
    "q24_apply_merges": (q_merged, BEST_SQL + " SELECT id, is_duplicate OR primary_id IS NOT NULL AS is_duplicate, primary_id AS merged_into_id FROM active LEFT JOIN best ON id = secondary_id"),
    "q25_undo_merges": (q_undone, f"WITH {RECORDS_SQL} SELECT id, is_duplicate, CAST(NULL AS BIGINT) AS merged_into_id, display_text FROM active"),
    "q26_greedy_merges": (q_greedy, GREEDY_SQL),
    "q27_unknown_pairs": (q_unknown_pairs, SCAN_SQL + " SELECT user_id, count(*) AS n FROM scored WHERE (id_a + id_b) % 3 <> 0 GROUP BY 1"),
    "q28_bulk_resolve": (q_bulk, SCAN_SQL + " SELECT CASE WHEN round_even(score * 100, 0) >= 60 AND round_even(score * 100, 0) < 80 THEN 'dismissed' ELSE 'pending' END AS status, count(*) AS n FROM scored WHERE score >= 0.5 GROUP BY 1"),
    "q29_review_page": (q_review_page, SCAN_SQL + ", placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id_a, id_b) AS place FROM scored WHERE score >= 0.5) SELECT p.user_id, place, id_a, id_b, a.display_text AS text_a, b.display_text AS text_b, a.source_format AS format_a, b.source_format AS format_b FROM placed p JOIN active a ON a.id = id_a JOIN active b ON b.id = id_b WHERE place <= 20"),
    "q30_upsert_plan": (q_plan, PLAN_SQL + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, action, version FROM planned"),
    "q31_upsert_current": (q_current, PLAN_SQL + " SELECT l_orderkey, l_linenumber, l_partkey, version FROM kept WHERE n = 1"),
    "q32_version_history": (q_history, PLAN_SQL + " SELECT l_orderkey, l_linenumber, l_partkey, version FROM kept WHERE n > 1"),
    "q33_collapse": (q_collapse, COLLAPSE_SQL),
    "q34_delete_cascade": (q_cascade, CASCADE_SQL),
    "q35_same_file": (q_same_file, SAME_FILE_SQL),
    "q36_backfill_identity": (q_backfill, BACKFILL_SQL),
    "q37_basket_add": (q_basket, BASKET_SQL),
    "q38_batch_progress": (q_progress, PROGRESS_SQL),
    "q39_job_queue": (q_queue, QUEUE_SQL),
    "q40_recover_stuck": (q_recover, RECOVER_SQL),
    "q41_cancel_outcomes": (q_cancel, CANCEL_SQL),
    "q42_audit_page": (q_audit, AUDIT_SQL),
    "q43_patients_uploads": (q_patients, PATIENTS_SQL),
}
