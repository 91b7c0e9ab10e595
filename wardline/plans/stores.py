"""Queries over what is kept beside tables: large bundles, sealed files, archives, logs of changes; and over calls, close terms, names and scores by class.

Where files are read, an export of the driver's tables is written to the shared
folder first.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from wardline.functions import fhir, names
from wardline.operators import calls, scorer, terminology
from wardline.plans.service import scored_notes
from wardline.session import spread, table, work_dir
from wardline.sources import archives, files, large_bundle, sealed
from wardline.streaming import upsert_log


def q_large_bundles(spark, sf_dir):
    """Eight bundles that each fill a file, read in blocks by many tasks."""
    l = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 8).alias("part"), F.lit(1).alias("n"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_quantity")
    ends = spark.range(8).select(F.col("id").alias("part"), F.explode(F.array(F.lit(0), F.lit(2))).alias("n"))
    # A file is written by one task, a row at a time; rows are dealt out and sorted before they become text.
    rows = l.unionByName(ends, allowMissingColumns=True).repartitionByRange(8, "part").sortWithinPartitions("part", "n")
    code = (F.col("l_partkey") % 10).cast("string")
    one = F.struct(F.struct(F.lit("Observation").alias("resourceType"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.when(F.col("l_returnflag") != "R", "final").alias("status"), F.struct(F.array(F.struct(F.lit("http://loinc.org").alias("system"), code.alias("code"), F.concat(F.lit('part } "'), code).alias("display"))).alias("coding")).alias("code"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("effectiveDateTime"), F.struct(F.col("l_quantity").alias("value")).alias("valueQuantity")).alias("resource"))
    head = F.lit('{"resourceType":"Bundle","link":[{"relation":"self"}],"entry":[{"resource":{"resourceType":"Patient","id":"p"}}')
    path = work_dir(spark, "large-bundles")
    rows.select("part", F.when(F.col("n") == 0, head).when(F.col("n") == 2, F.lit("]}")).otherwise(F.concat(F.lit(","), F.to_json(one))).alias("value")).write.partitionBy("part").text(path)
    r = large_bundle.records(spark, path).withColumn("reading", fhir.reading("resource", F.col("display_text")))
    return r.groupBy("record_type", "code_value", "display_text", "status", F.to_date("effective_date").alias("day")).agg(F.count("*").alias("n"), F.sum("reading.value").alias("total"))


LARGE_SQL = """
SELECT 'observation' AS record_type, CAST(l_partkey % 10 AS VARCHAR) AS code_value, 'part } "' || (l_partkey % 10) AS display_text, CASE WHEN l_returnflag <> 'R' THEN 'final' END AS status, CAST(l_shipdate AS DATE) AS day, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY ALL
"""

FILE_KEY, FRAME = b"0123456789abcdef0123456789abcdef", 1000


def q_sealed_files(spark, sf_dir):
    """Documents as files, sealed in frames, kept, and opened again; every seventh was kept before sealing."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = sealed.frames(d.select(F.col("doc_id").cast("string").alias("file"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content")), FRAME)
    old = F.col("file").cast("long") % 7 == 0
    path = work_dir(spark, "sealed")
    sealed.seal_frames(cut, F.lit(FILE_KEY)).withColumn("sealed", F.lit(True)).filter(~old).unionByName(cut.filter(old).withColumn("sealed", F.lit(False))).write.parquet(path)
    kept = spark.read.parquet(path)
    back = sealed.open_frames(kept, F.lit(FILE_KEY))
    hashes = back.groupBy("file").agg(F.count("*").alias("n_frames"), F.max("file_hash").alias("file_hash"), F.max("sealed").alias("sealed"))
    whole = sealed.whole_files(back).select("file", F.sha2("content", 256).alias("content_hash"))
    return hashes.join(whole, "file").select(F.col("file").cast("long").alias("doc_id"), "n_frames", "file_hash", "content_hash", "sealed")


SEALED_SQL = f"""
SELECT doc_id, greatest(1, CAST(ceil(strlen(coalesce(text, '')) / {FRAME}) AS BIGINT)) AS n_frames, sha256(coalesce(text, '')) AS file_hash, sha256(coalesce(text, '')) AS content_hash, doc_id % 7 <> 0 AS sealed FROM documents
"""


def q_close_terms(spark, sf_dir):
    """Names of parts, one letter lost or doubled or ten changed, against all names in an index of close spellings."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    # Thirty-two letters each, as unlike each other as can be.
    alias = F.translate(F.md5(F.concat(F.lit("part "), k.cast("string"))), "0123456789", "ghijklmnop")
    known = p.select(alias.alias("alias"), F.concat(F.lit("P"), k.cast("string")).alias("code"), F.col("p_name").alias("display"))
    at = (k % 30 + 2).cast("int")
    lost = F.concat(F.substr(alias, F.lit(1), at - 1), F.substr(alias, at + 1))
    twice = F.concat(F.substr(alias, F.lit(1), at), F.substr(alias, at))
    term = F.when(k % 4 == 0, lost).when(k % 4 == 1, twice).when(k % 4 == 2, alias).otherwise(F.concat(F.lit("zzzzzzzzzz"), F.substr(alias, F.lit(11))))
    asked = p.select("p_partkey", term.alias("term"))
    path = work_dir(spark, "close-index")
    terminology.close_index(known).write.parquet(path)
    return terminology.look_up(asked, known, "term", fuzzy=True, index=spark.read.parquet(path)).select("p_partkey", "code", "display", "matched")


CLOSE_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN 'P' || p_partkey END AS code, CASE WHEN p_partkey % 4 <> 3 THEN p_name END AS display, CASE p_partkey % 4 WHEN 2 THEN 'exact' WHEN 3 THEN NULL ELSE 'close' END AS matched FROM part
"""


def q_upsert_log(spark, sf_dir):
    """Orders in three batches, the second of a third of them (of which every other one is unchanged) and run twice, kept as a log of changes."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    folder = work_dir(spark, "upsert-log")
    batch = lambda n, rows, value: rows.select(F.lit("orders").alias("source_system"), F.when(k % 50 != 0, k.cast("string")).alias("external_id"), (k * 10 + n).alias("arrival"), k.alias("o_orderkey"), value.alias("value")).withColumn("content_hash", F.sha2("value", 256))
    status = F.col("o_orderstatus")
    batches = [batch(0, o, status), batch(1, o.filter(k % 3 == 0), F.when(k % 2 == 0, F.concat(status, F.lit("*"))).otherwise(status)), batch(2, o.filter(k % 9 == 0), F.lit("last"))]
    for n in (0, 1, 1, 2):
        upsert_log.upsert(spark, batches[n], folder, n, ["source_system", "external_id"], ["arrival"], buckets=16, folders=2)
    return upsert_log.read(spark, folder, ["source_system", "external_id"], ["arrival"]).select("o_orderkey", "external_id", "value", "version", (F.col("arrival") % 10).alias("batch_no"))


LOG_SQL = """
WITH x AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderkey % 50 <> 0 AS known FROM orders),
b AS (SELECT k, known, 0 AS n, s AS v FROM x UNION ALL SELECT k, known, 1, CASE WHEN k % 2 = 0 THEN s || '*' ELSE s END FROM x WHERE k % 3 = 0 UNION ALL SELECT k, known, 2, 'last' FROM x WHERE k % 9 = 0),
c AS (SELECT *, NOT known OR lag(v) OVER (PARTITION BY k ORDER BY n) IS DISTINCT FROM v AS changes FROM b),
d AS (SELECT *, CASE WHEN known THEN count(*) OVER (PARTITION BY k ORDER BY n) ELSE 1 END AS version, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS back FROM c WHERE changes)
SELECT k AS o_orderkey, CASE WHEN known THEN CAST(k AS VARCHAR) END AS external_id, v AS value, CAST(version AS INTEGER) AS version, CAST(n AS BIGINT) AS batch_no FROM d WHERE back = 1 OR NOT known
"""


def _unsure(prompt: str, attempt: int) -> str:
    """A provider that is late as often as the number in its prompt says, and refuses some."""
    number = int(prompt.split()[1])
    if number == 5:
        raise ValueError("bad request")
    if attempt <= number:
        raise TimeoutError("connection lost")
    return calls.offline(prompt, attempt)


def q_model_calls(spark, sf_dir):
    """Lines of orders as chunks given to a model that is late or refuses; what came back, by document."""
    l = table(spark, sf_dir, "lineitem")
    n = F.col("l_partkey") % 6
    pos = (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
    chunk = F.concat(F.lit("call "), n.cast("string"), F.lit("\ncondition: thing "), (F.col("l_partkey") % 3).cast("string"), F.lit("\nmedication: drug"))
    asked = l.select(F.col("l_orderkey").alias("doc_id"), pos.alias("chunk_no"), F.lit("labs").alias("section_type"), chunk.alias("chunk"))
    told = calls.extract_chunks(spread(asked), providers={"unsure": _unsure}, routing={"extraction": "unsure"}, backoff=0.0)
    sums = told.groupBy("doc_id").agg(F.sum("attempts").alias("n_attempts"), F.count_if(F.col("error") == "bad request").alias("n_refused"), F.count("*").alias("n_chunks"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.coalesce(F.sum(F.array_size("entities")), F.lit(0)).cast("long").alias("n_entities"))
    return sums


CALLS_SQL = """
WITH x AS (SELECT l_orderkey AS doc_id, l_partkey % 6 AS n FROM lineitem)
SELECT doc_id, CAST(sum(CASE WHEN n = 5 THEN 1 ELSE least(n + 1, 3) END) AS BIGINT) AS n_attempts, count(*) FILTER (WHERE n = 5) AS n_refused, count(*) AS n_chunks, count(*) FILTER (WHERE n >= 3) AS n_failed, 2 * count(*) FILTER (WHERE n < 3) AS n_entities FROM x GROUP BY 1
"""

#: Customers whose files one archive holds.
ARCHIVE = 500


def _archive_writer(folder: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in zip(rows["name"], rows["body"], strict=True):
                z.writestr(name, body)
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{int(rows['archive'].iloc[0])}.zip") as f:
            f.write(held.getvalue())
        return pd.DataFrame({"n": [len(rows)]})

    return run


def q_archive_members(spark, sf_dir):
    """Archives of customers' files, unpacked member by member and routed to their readers; one archive in ten has a name that leads out of it."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    archive = F.floor(k / ARCHIVE).cast("long")
    kind = F.get(F.array(*map(F.lit, [".json", "/PROBLEM_LIST.tsv", "/METADATA.XML", ".pdf", ".xml", "/readme.txt"])), (k % 6).cast("int"))
    name = F.concat(F.when((archive % 10 == 9) & (k % ARCHIVE == 0), "../").otherwise("in/"), k.cast("string"), kind)
    folder = work_dir(spark, "archives")
    made = c.select(archive.alias("archive"), name.alias("name"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("body"))
    made.groupBy("archive").applyInPandas(_archive_writer(folder), "n long").agg(F.sum("n")).collect()
    parts = archives.members(archives.directory(spark, folder), part=1 << 16)
    g = files.routed(parts).withColumn("route", F.when(F.col("error").isNotNull(), "refused").otherwise(F.col("route")))
    return g.groupBy("route").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("n_bytes"))


ARCHIVES_SQL = f"""
WITH x AS (SELECT c_custkey // {ARCHIVE} AS a, list_extract(['fhir_r4', 'epic_ehi', 'xdm', 'unstructured', 'cda_r2', 'skip'], CAST(c_custkey % 6 + 1 AS INTEGER)) AS route, strlen(c_name || ' ' || c_mktsegment) AS size, c_custkey % {ARCHIVE} = 0 AS leads FROM customer),
y AS (SELECT *, bool_or(leads) OVER (PARTITION BY a) AND a % 10 = 9 AS bad FROM x)
SELECT route, count(*) AS n, CAST(sum(size) AS BIGINT) AS n_bytes FROM y WHERE NOT bad GROUP BY 1
UNION ALL SELECT 'refused', count(DISTINCT a), 0 FROM y WHERE bad HAVING count(*) > 0
"""


def q_name_redaction(spark, sf_dir):
    """Notes about orders with spans a recogniser found, too wide as they are: names go, eponyms, specialities and drugs stay."""
    o = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))
    k = F.col("id")
    who = F.get(F.array(*map(F.lit, ["Ada  Reed", "Zoé Crohn", "Metformin", "Cardiology Ward", "MR X"])), (k % 5).cast("int"))
    text = F.concat(F.lit("Seen by "), who, F.lit(" today, then Bo"), F.when(k % 2 == 0, "").otherwise(" Lee"), F.lit("."))
    x = o.select("id", text.alias("text"), F.length(who).alias("w"))
    wide = F.struct(F.lit(8).alias("start"), (F.col("w") + 14).alias("end"), F.lit("PERSON").alias("label"))
    again = F.struct((F.col("w") + 20).alias("start"), F.length("text").alias("end"), F.lit("PERSON").alias("label"))
    place = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("PLACE").alias("label"))
    spans = x.select("id", F.explode(F.array(wide, again, again, place)).alias("s")).select("id", "s.*")
    drugs = spark.createDataFrame([("metformin",), ("lee",)], "term string")
    return names.redact_names(x.select("id", "text"), spans, drugs)


NAMES_SQL = """
WITH x AS (SELECT o_orderkey AS id, o_orderkey % 5 AS w, o_orderkey % 2 AS two FROM orders)
SELECT id, 'Seen by ' || list_extract(['Ada  Reed', 'Zoé Crohn', 'Metformin', 'Cardiology Ward', 'MR X'], w + 1) || ' today, then Bo' || CASE WHEN two = 0 THEN '' ELSE ' Lee' END || '.' AS text,
  'Seen by ' || list_extract(['[NAME]', '[NAME] Crohn', 'Metformin', 'Cardiology [NAME]', 'MR [NAME]'], w + 1) || ' today, then [NAME].' AS redacted, CASE WHEN w = 2 THEN 1 ELSE 2 END AS n_names FROM x
"""


def q_class_scores(spark, sf_dir):
    """Scores of each note and class, with what was missed."""
    compared = scorer.compare(*scored_notes(spark, sf_dir))
    scores = scorer.by_class(compared, carry=("missed", "violated"))
    return scores.withColumns({"missed": F.array_join(F.array_sort("missed"), "; "), "n_violated": F.array_size("violated")}).drop("violated")


CLASS_SQL = """
WITH w AS (SELECT l_orderkey AS note, l_linenumber AS i, l_suppkey AS s, l_partkey AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'condition' ELSE 'medication' END AS cls,
  CASE l_partkey % 3 WHEN 0 THEN 'HTN' WHEN 1 THEN 'breast ca' ELSE '142 over 90' END || ' case ' || (l_partkey % 5) AS raw, CASE l_partkey % 3 WHEN 0 THEN 'hypertension' WHEN 1 THEN 'breast cancer' ELSE '142/90' END || ' case ' || (l_partkey % 5) AS said FROM lineitem),
f AS (SELECT note, CASE WHEN s % 3 = 1 THEN cls ELSE 'dosage' END AS cls, said || CASE WHEN s % 2 = 0 THEN ' today' ELSE '' END AS said FROM w WHERE s % 3 <> 0),
e AS (SELECT note, cls, raw, said, EXISTS (SELECT 1 FROM f WHERE f.note = w.note AND f.cls = w.cls AND contains(f.said, w.said)) AS hit FROM w WHERE i <= 2),
g AS (SELECT note, cls, EXISTS (SELECT 1 FROM w WHERE i <= 2 AND f.note = w.note AND f.cls = w.cls AND contains(f.said, w.said)) AS hit FROM f WHERE cls <> 'dosage'),
b AS (SELECT note, EXISTS (SELECT 1 FROM f WHERE f.note = w.note AND f.cls = 'medication' AND contains(f.said, w.said)) AS hit FROM w WHERE i = 3),
p AS (SELECT note, cls, count(*) FILTER (WHERE NOT hit) AS fp FROM g GROUP BY 1, 2),
v AS (SELECT note, count(*) FILTER (WHERE hit) AS n FROM b GROUP BY 1),
c AS (SELECT note, cls, count(*) AS wanted, count(*) FILTER (WHERE hit) AS tp, coalesce(string_agg(raw, '; ' ORDER BY raw) FILTER (WHERE NOT hit), '') AS missed FROM e GROUP BY 1, 2),
r AS (SELECT c.*, coalesce(fp, 0) AS fp, CASE WHEN tp + coalesce(fp, 0) > 0 THEN tp / (tp + coalesce(fp, 0)) WHEN wanted = tp THEN 1.0 ELSE 0.0 END AS p, tp / wanted AS q, CASE WHEN c.cls = 'medication' THEN coalesce(v.n, 0) ELSE 0 END AS n_violated FROM c LEFT JOIN p USING (note, cls) LEFT JOIN v USING (note))
SELECT note, cls AS entity_class, tp, fp, wanted - tp AS fn, round_even(p, 4) AS precision, round_even(q, 4) AS recall, CASE WHEN p + q > 0 THEN round_even(2 * p * q / (p + q), 4) ELSE 0.0 END AS f1, missed, CAST(n_violated AS INTEGER) AS n_violated FROM r
"""


QUERIES = {
    "q100_large_bundles": (q_large_bundles, LARGE_SQL),
    "q101_sealed_files": (q_sealed_files, SEALED_SQL),
    "q102_close_terms": (q_close_terms, CLOSE_SQL),
    "q103_upsert_log": (q_upsert_log, LOG_SQL),
    "q104_model_calls": (q_model_calls, CALLS_SQL),
    "q105_archive_members": (q_archive_members, ARCHIVES_SQL),
    "q106_name_redaction": (q_name_redaction, NAMES_SQL),
    "q107_class_scores": (q_class_scores, CLASS_SQL),
}
