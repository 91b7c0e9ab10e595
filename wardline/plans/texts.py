"""Queries over texts: de-identification, hashing, chunks, terms, conversations, pages, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardline.functions import fhir
from wardline.functions.clinical import normalize_term, parse_dosage
from wardline.functions.deident import PATTERNS, scrub_report
from wardline.operators import text as T
from wardline.plans.records import RECORDS_SQL, active, records
from wardline.session import spread, table



def q_phi_report(spark, sf_dir):
    """How many identifiers of each kind all documents hold, and in how many documents."""
    d = scrub_report(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # Outer, or else the optimizer scrubs once more to leave out documents without a find.
    found = d.select("doc_id", F.explode_outer("counts").alias("kind", "n")).filter("kind IS NOT NULL")
    return found.groupBy("kind").agg(F.sum("n").cast("long").alias("n"), F.count("*").alias("n_docs"))


def q_scrubbed(spark, sf_dir):
    d = scrub_report(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return d.select("doc_id", F.length("scrubbed").cast("long").alias("chars"), F.coalesce(F.aggregate(F.map_values("counts"), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_found"))


def q_content_groups(spark, sf_dir):
    """Documents of equal content: the first of each group and how many there are."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


def q_chunks(spark, sf_dir):
    return T.chunk_documents(table(spark, sf_dir, "documents")).select("doc_id", "chunk_no", "section_type", F.length("chunk").cast("long").alias("chars"))


def q_conversation_text(spark, sf_dir):
    """Each conversation as one text in turn order, with its last user turn."""
    c = table(spark, sf_dir, "conversations")
    x = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = c.groupBy("conv_id").agg(x.alias("x"), F.max(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("last_user"))
    joined = F.array_join(F.transform("x", lambda t: F.concat(F.lit("["), F.upper(t["role"]), F.lit("] "), t["text"])), "\n\n---\n\n")
    return g.select("conv_id", F.size("x").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("text_sha256"), F.col("last_user.turn").alias("last_user_turn"))


CONVERSATION_SQL = """
SELECT conv_id, count(*) AS n_turns, sha256(string_agg('[' || upper(role) || '] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS text_sha256, max(turn) FILTER (WHERE role = 'user') AS last_user_turn
FROM conversations GROUP BY conv_id
"""


def q_page_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return p.select("page_id", host.alias("host"), F.trim(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)).alias("title"), F.regexp_count("html", F.lit(r"<p[ >]")).cast("long").alias("n_paragraphs"))


PAGES_SQL = r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS n_paragraphs FROM pages
"""


def q_scorer(spark, sf_dir):
    """A rule's precision and recall against labels, by source."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    truth = labels.filter("quality IS NOT NULL").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("actual"))
    shout = F.regexp_count("text", F.lit("[!#$%&*|]")) * 20 > F.length("text")
    return T.precision_recall(d.select(F.col("doc_id").alias("id"), (~shout).alias("predicted"), "source"), truth, ["source"])


SCORER_SQL = """
WITH p AS (SELECT l.quality = 1 AS actual, NOT (len(regexp_extract_all(text, '[!#$%&*|]')) * 20 > length(text)) AS predicted, source FROM documents JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
c AS (SELECT source, count(*) FILTER (WHERE predicted AND actual) AS tp, count(*) FILTER (WHERE predicted AND NOT actual) AS fp, count(*) FILTER (WHERE NOT predicted AND actual) AS fn FROM p GROUP BY source)
SELECT source, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 4) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round_even(tp / (tp + fn), 4) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN round_even(2 * tp / (2 * tp + fp + fn), 4) ELSE 0 END AS f1 FROM c
"""


def q_dosages(spark, sf_dir):
    """Sigs written from order rows, parsed back."""
    l = spread(table(spark, sf_dir, "lineitem"))
    n = F.col("l_quantity").cast("long")
    sig = F.concat_ws(" ", F.lit("take"), n.cast("string"), F.when(n % 2 == 0, "mg").otherwise("mL"), F.when(n % 3 == 0, "by mouth").when(n % 3 == 1, "IV"), F.when(n % 5 == 0, "twice daily").when(n % 5 == 1, "q8h").when(n % 5 == 2, "weekly"), F.when(F.col("l_returnflag") == "R", "as needed"))
    d = l.select(parse_dosage(sig).alias("d"))
    return d.select("d.*").groupBy("dose_value", "dose_unit", "route", "frequency", "period_unit", "as_needed").agg(F.count("*").alias("n"))


DOSAGE_SQL = """
WITH s AS (SELECT CAST(floor(l_quantity) AS BIGINT) AS q, l_returnflag = 'R' AS as_needed FROM lineitem)
SELECT CAST(q AS DOUBLE) AS dose_value, CASE WHEN q % 2 = 0 THEN 'mg' ELSE 'ml' END AS dose_unit, CASE WHEN q % 3 = 0 THEN 'oral' WHEN q % 3 = 1 THEN 'intravenous' END AS route,
  CASE WHEN q % 5 = 0 THEN 2 WHEN q % 5 = 1 THEN 3 WHEN q % 5 = 2 THEN 1 END AS frequency, CASE WHEN q % 5 < 2 THEN 'd' WHEN q % 5 = 2 THEN 'wk' END AS period_unit, as_needed, count(*) AS n
FROM s GROUP BY ALL
"""


def q_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", normalize_term(F.concat(F.col("p_name"), F.lit("'s "), F.col("p_type"), F.lit(" ("), F.col("p_brand"), F.lit(") "), F.col("p_size").cast("string"), F.lit(" mg"))).alias("term"))


TERMS_SQL = r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name) || 's ' || lower(p_type) || '  ', '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS term FROM part
"""


def fhir_resources(spark, sf_dir):
    """Each active record written as a FHIR resource (JSON) and parsed again."""
    r = spread(active(records(spark, sf_dir)))
    day = F.date_format("effective_date", "yyyy-MM-dd'T'HH:mm:ss")
    code = F.struct(F.array(F.struct(F.col("code_system").alias("system"), F.col("code_value").alias("code"), F.col("code_display").alias("display"))).alias("coding"))
    doc = F.to_json(F.struct(F.col("fhir_resource_type").alias("resourceType"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, F.col("status")).alias("status"), F.struct(F.array(F.struct(F.col("status").alias("code"))).alias("coding")).alias("clinicalStatus"), F.when(F.col("code_value").isNotNull(), code).alias("code"), F.when(F.col("id") % 3 == 0, day).alias("issued"), F.when(F.col("id") % 3 == 1, F.struct(day.alias("start"))).alias("period"), F.when(F.col("id") % 3 == 2, F.struct(day.alias("lastUpdated"))).alias("meta"), F.struct(F.col("value").alias("value"), F.lit("u").alias("unit")).alias("valueQuantity")))
    return r.select("id", F.parse_json(doc).alias("resource"))


def q_fhir_projection(spark, sf_dir):
    p = fhir.project(fhir_resources(spark, sf_dir)).withColumn("reading", fhir.reading("resource", F.col("display_text")))
    return p.select("id", "record_type", "code_system", "code_value", "display_text", "status", F.col("effective_date").cast("timestamp_ntz").alias("effective_date"), "external_id", F.col("reading.value").alias("value"))


FHIR_SQL = f"""
WITH {RECORDS_SQL}
SELECT id, record_type, code_system, code_value, coalesce(code_display, CASE fhir_resource_type WHEN 'MedicationRequest' THEN 'Medication Request' ELSE fhir_resource_type END) AS display_text, status, date_trunc('second', effective_date) AS effective_date, fhir_resource_type || '/' || id AS external_id, value
FROM active
"""


def q_source_labels(spark, sf_dir):
    r = records(spark, sf_dir)
    system = F.when(F.col("id") % 3 == 0, F.lit("urn:oid:2.16")).when(F.col("id") % 3 == 1, F.lit("2.16.840")).otherwise(F.concat(F.lit(" Clinic "), (F.col("id") % 7).cast("string"), F.lit(" ")))
    return r.groupBy(fhir.source_label(F.col("source_format"), system).alias("label")).agg(F.count("*").alias("n"))


LABELS_SQL = f"""
WITH {RECORDS_SQL}
SELECT CASE WHEN id % 3 = 2 THEN 'Clinic ' || (id % 7) WHEN source_format = 'fhir_r4' THEN 'FHIR R4' WHEN source_format = 'epic_ehi' THEN 'Epic EHI' WHEN source_format = 'cda_r2' THEN 'CDA' ELSE 'AI extraction' END AS label, count(*) AS n FROM records GROUP BY 1
"""


HOUR, LIMIT = 3_600_000_000, 3


def q_rate_limit(spark, sf_dir):
    """Events a per-user limit of 3 an hour lets through: refused ones do not count.

    A gap of an hour forgets all, so a user's events are cut there and each
    part is folded in order by itself.
    """
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    cut = e.withColumn("new", F.coalesce(F.col("us") - F.lag("us").over(order) >= HOUR, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def step(state, event):
        recent = F.filter(state["recent"], lambda t: t > event["us"] - HOUR)
        fine = F.size(recent) < LIMIT
        return F.struct(F.when(fine, F.concat(recent, F.array(event["us"]))).otherwise(recent).alias("recent"), (state["n"] + fine.cast("long")).alias("n"))

    begin = F.struct(F.array().cast("array<bigint>").alias("recent"), F.lit(0).cast("long").alias("n"))
    parts = cut.groupBy("user_id", "part").agg(F.sort_array(F.collect_list(F.struct("us", "event_id"))).alias("x"))
    return parts.groupBy("user_id").agg(F.sum(F.aggregate("x", begin, step, lambda s: s["n"])).alias("n_allowed"), F.sum(F.size("x")).cast("long").alias("n"))


RATE_SQL = f"""
WITH x AS (SELECT user_id, list({{'us': epoch_us(ts), 'recent': []::BIGINT[], 'n': 0::BIGINT}} ORDER BY ts, event_id) AS events FROM events GROUP BY user_id)
SELECT user_id, list_reduce(list_prepend({{'us': 0::BIGINT, 'recent': []::BIGINT[], 'n': 0::BIGINT}}, events), lambda s, e: {{'us': e.us,
    'recent': CASE WHEN len(list_filter(s.recent, lambda t: t > e.us - {HOUR})) < {LIMIT} THEN list_append(list_filter(s.recent, lambda t: t > e.us - {HOUR}), e.us) ELSE list_filter(s.recent, lambda t: t > e.us - {HOUR}) END,
    'n': s.n + CASE WHEN len(list_filter(s.recent, lambda t: t > e.us - {HOUR})) < {LIMIT} THEN 1 ELSE 0 END}}).n AS n_allowed, len(events) AS n
FROM x
"""


def q_encounter_links(spark, sf_dir):
    """The last encounter of a user's day is linked to the other records of that day."""
    r = active(records(spark, sf_dir)).filter("effective_date IS NOT NULL").withColumn("day", F.to_date("effective_date"))
    by = Window.partitionBy("user_id", "day").orderBy("effective_date", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return r.withColumn("encounter", F.last(F.when(F.col("record_type") == "encounter", F.col("id")), ignorenulls=True).over(by)).filter("record_type <> 'encounter'").select("id", "encounter")


ENCOUNTER_SQL = f"""
WITH {RECORDS_SQL}, d AS (SELECT *, CAST(effective_date AS DATE) AS day FROM active WHERE effective_date IS NOT NULL), e AS (SELECT user_id, day, arg_max(id, (effective_date, id)) AS encounter FROM d WHERE record_type = 'encounter' GROUP BY 1, 2)
SELECT d.id, e.encounter FROM d LEFT JOIN e USING (user_id, day) WHERE d.record_type <> 'encounter'
"""


def _phi_steps() -> tuple[str, str, list[tuple[str, str]]]:
    """CTEs, the last one's name and (kind, count column): the same fold over text whose letters outside ASCII are plain ones, since the oracle's word edges know ASCII only."""
    expr, counts = "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')", []
    from wardline.functions.deident import AGES, DATES

    quote = lambda p: p.replace("'", "''")
    steps = [(k, p, t) for k, p, t in PATTERNS]
    ctes, source = [f"s0 AS (SELECT doc_id, {expr} AS t FROM documents)"], "s0"
    for i, (k, p, t) in enumerate([*steps, *[("dates_generalized", p, r"\1") for p in DATES], *[("ages_generalized", p, to.replace("${1}", r"\1").replace("$1", r"\1")) for p, to in AGES]], 1):
        carried = ", ".join(f"n{j}" for j in range(1, i))
        ctes.append(f"s{i} AS (SELECT doc_id, {carried + ', ' if carried else ''}len(regexp_extract_all(t, '{quote(p)}')) AS n{i}, regexp_replace(t, '{quote(p)}', '{t}', 'g') AS t FROM {source})")
        source = f"s{i}"
        counts.append((k, f"n{i}"))
    return ", ".join(ctes), source, counts


def _phi_sql() -> str:
    ctes, source, counts = _phi_steps()
    parts = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {n} AS n FROM {source}" for k, n in counts)
    return f"WITH {ctes}, kinds AS ({parts}), per AS (SELECT doc_id, kind, sum(n) AS n FROM kinds GROUP BY 1, 2) SELECT kind, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_docs FROM per WHERE n > 0 GROUP BY kind"


def _scrubbed_sql() -> str:
    ctes, source, counts = _phi_steps()
    return f"WITH {ctes} SELECT doc_id, length(t) AS chars, CAST({' + '.join(n for _, n in counts)} AS BIGINT) AS n_found FROM {source}"


#: Documents without headings are one section; its parts are folded into chunks, and those into packed ones.
CHUNKS_SQL = r"""
WITH d AS (SELECT doc_id, text, contains(text, chr(10) || chr(10)) AS paged FROM documents WHERE text <> ''),
parts AS (SELECT doc_id, text, CASE WHEN paged THEN chr(10) || chr(10) ELSE ' ' END AS glue, CASE WHEN paged THEN string_split(text, chr(10) || chr(10)) ELSE string_split(replace(text, '. ', '.' || chr(10)), chr(10)) END AS parts FROM d),
folded AS (
  SELECT doc_id, text, list_reduce(list_prepend({'part': '', 'glue': '', 'chunks': []::VARCHAR[], 'now': ''}, list_transform(parts, lambda p: {'part': p, 'glue': glue, 'chunks': []::VARCHAR[], 'now': ''})),
    lambda s, x: {'part': '', 'glue': '', 'chunks': CASE WHEN s.now <> '' AND length(s.now || x.glue || x.part) > 2000 THEN list_append(s.chunks, s.now) ELSE s.chunks END,
      'now': CASE WHEN s.now = '' THEN x.part WHEN length(s.now || x.glue || x.part) > 2000 THEN right(s.now, 200) || x.glue || x.part ELSE s.now || x.glue || x.part END}) AS f
  FROM parts
), chunked AS (SELECT doc_id, CASE WHEN length(text) <= 2000 THEN [text] WHEN f.now <> '' THEN list_append(f.chunks, f.now) ELSE f.chunks END AS chunks FROM folded),
packed AS (
  SELECT doc_id, list_filter(list_reduce(list_prepend({'chunk': '', 'done': []::VARCHAR[]}, list_transform(chunks, lambda c: {'chunk': c, 'done': []::VARCHAR[]})),
    lambda s, x: {'chunk': '', 'done': CASE WHEN len(s.done) > 0 AND s.done[-1] <> '' AND length(s.done[-1]) + length(x.chunk) + 1 <= 2000 THEN list_append(s.done[:-2], s.done[-1] || chr(10) || x.chunk) ELSE list_append(s.done, x.chunk) END}).done, lambda c: c <> '') AS chunks
  FROM chunked
)
SELECT doc_id, CAST(unnest(range(0, len(chunks))) AS INTEGER) AS chunk_no, 'other' AS section_type, CAST(unnest(list_transform(chunks, lambda c: length(c))) AS BIGINT) AS chars FROM packed
"""


QUERIES = {
    "q50_phi_report": (q_phi_report, _phi_sql()),
    "q51_scrubbed_texts": (q_scrubbed, _scrubbed_sql()),
    "q52_content_groups": (q_content_groups, "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "q53_chunks": (q_chunks, CHUNKS_SQL),
    "q54_conversation_text": (q_conversation_text, CONVERSATION_SQL),
    "q55_page_titles": (q_page_titles, PAGES_SQL),
    "q56_scorer": (q_scorer, SCORER_SQL),
    "q57_dosages": (q_dosages, DOSAGE_SQL),
    "q58_terms": (q_terms, TERMS_SQL),
    "q59_fhir_projection": (q_fhir_projection, FHIR_SQL),
    "q60_source_labels": (q_source_labels, LABELS_SQL),
    "q61_rate_limit": (q_rate_limit, RATE_SQL),
    "q62_encounter_links": (q_encounter_links, ENCOUNTER_SQL),
}
