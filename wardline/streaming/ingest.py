"""Streaming ingest: new files are found, hashed, de-duplicated, projected and upserted in micro-batches.

The checkpoint of the query takes the place of a polled job table: a batch
that fails is run again, and the upsert makes that harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wardline.functions.fhir import project
from wardline.sources.fhir_bundle import from_documents
from wardline.streaming import progress, upsert_log

IDENTITY, ARRIVAL = ["source_system", "external_id"], ["file", "pos"]
#: Columns of the kept table; the resource is stored as JSON text.
COLUMNS = ["record_type", "fhir_resource_type", "effective_date", "status", "code_system", "code_value", "display_text", *IDENTITY, "content_hash", "resource_json", "file", "pos"]


def bundle_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles that arrive in ``folder`` as (file, value)."""
    return spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("file"), "value")


def batch_records(docs: DataFrame) -> DataFrame:
    """Records of one micro-batch (file, value); copies of a file in it count once."""
    once = docs.groupBy(F.sha2("value", 256).alias("h")).agg(F.min_by(F.struct("file", "value"), "file").alias("d")).select("d.*")
    rows = project(from_documents(once.select("file", F.try_parse_json("value").alias("doc"))))
    return rows.withColumn("resource_json", F.to_json("resource")).select(*COLUMNS)


def upsert_batch(spark: SparkSession, incoming: DataFrame, folder: str, batch_id: int) -> dict[str, int]:
    """Apply one micro-batch to the kept table and count its records on the way; one that is repeated changes nothing and counts nothing."""
    if upsert_log.manifest(spark, folder)["batch"] >= batch_id:
        return {}
    seen = Observation(f"records of batch {batch_id}")
    upsert_log.upsert(spark, progress.observed(incoming, seen, skipped=F.col("external_id").isNull()), folder, batch_id, IDENTITY, ARRIVAL)
    return seen.get


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The kept table after its last whole batch."""
    return upsert_log.read(spark, folder, IDENTITY, ARRIVAL)


def run(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int | None = None, tell=None):
    """Ingest all bundles now in ``source`` and stop; call again, or with another trigger, for later ones.

    ``tell`` is called after each batch with its number and the counts of its
    records (``skipped`` are those without identity).
    """
    stream = bundle_stream(spark, source)
    if files_per_batch:
        stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(source).select(F.col("_metadata.file_path").alias("file"), "value")

    def step(df: DataFrame, batch_id: int) -> None:
        counted = upsert_batch(df.sparkSession, batch_records(df), target, batch_id)
        if tell and counted:
            tell(batch_id, counted)

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
