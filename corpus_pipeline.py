"""The corpus pipeline: quality, language, near-copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import language_id, packing, quality, simhash_dedup, substring_dedup
from wardline.llm.common import fresh, shared_dir
from wardline.session import spread, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``quality.ACCEPT``; the classifier learns from the labels under ``sf_dir``.

    Null and empty texts get the score of no words. Very long texts are read
    whole. Repeated rows score alike, so all stay or go; a score that ties
    with the threshold stays. Columns called as the score keep their values.
    Empty table: no rows.
    """
    name = fresh("quality_score", docs)
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), name)
    return scored.filter(F.col(name) >= quality.ACCEPT).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be named; a missing lang is filled in.

    Null and empty texts and those without letters go, and those with hardly a
    word in a script that some language was learned with. Very long texts are
    read whole. Repeated rows are labelled alike; of languages that tie the
    commoner one counts. Empty table: no rows.
    """
    pred, share = fresh("lang_pred", docs), fresh("lang_score", docs)
    found = language_id.identify(docs, language_id.train(docs), spans=False, into=(pred, share))
    kept = found.filter((F.col(pred) != language_id.UNDETERMINED) & (F.col(share) >= language_id.ACCEPT))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document of smallest doc_id, or one without if none has any.

    Rows with one doc_id are one document. Rows without are named by their
    text, and one row of each text stays (that of the least hash of all its
    columns). Null and empty texts are copies of one another. Very long texts
    are read whole. Empty table: no rows.
    """
    key = fresh("copy_key", docs)
    # Rows without id are named by their text, above all real ids.
    named = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), named))
    groups = simhash_dedup.simhash_dedup(keyed.select(F.col(key).alias("doc_id"), "text"))
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    # Equal texts without id fall together before the join, on the map side already.
    nameless = keyed.filter("doc_id IS NULL").groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*", key)
    keyed = keyed.filter("doc_id IS NOT NULL").unionByName(nameless.select(*keyed.columns))
    return keyed.join(kept, keyed[key] == kept["kept_id"], "left_semi").drop(key)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that start earlier; n_chars follows the text.

    Null texts and rows without doc_id pass unchanged, empty texts stay empty.
    Very long texts are read whole. Of copies the one of smaller doc_id keeps
    its words; rows repeated with their doc_id are treated alike. Empty table:
    no rows.
    """
    clean = substring_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences.

    Null and empty texts are the end id alone; very long texts are cut into
    pieces of a whole sequence. Repeated rows and rows without doc_id are
    packed like others; pieces of equal length take their places by doc_id and
    piece. Empty table: no rows.
    """
    return packing.pack_documents(docs, added=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("simhash near-dedup", near_copy_stage),
    ("substring dedup", passage_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier, the language model and the packing plan are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what one returns is written as Parquet to the shared folder and read by the next."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spread(table(spark, sf_dir, "documents"))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
