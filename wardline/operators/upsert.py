"""Idempotent upsert with identity, content hash and version history; replace, delete and collapse operations.

One ingest is one batch. Rows of one identity are taken in arrival order: a row
whose hash equals the one before it is skipped, any other makes the next
version, the last one stays. (A row-by-row inserter compares only with the
first row it saw; here A, B, A ends as A in version 3.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of some columns; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def plan_batch(incoming: DataFrame, existing: DataFrame, identity: list[str], arrival: list[str], hash_column: str = "content_hash") -> DataFrame:
    """Add action (insert, update, skip) and version to each incoming row.

    ``existing`` has one row per identity with ``hash_column`` and version. Rows
    with a null in their identity are always inserted as version 1.
    """
    known = F.lit(True)
    for c in identity:
        known = known & F.col(c).isNotNull()
    base = existing.select(*identity, F.col(hash_column).alias("_base_hash"), F.col("version").alias("_base_version"))
    rows = incoming.join(base, identity, "left").withColumn("_known", known)
    # Rows without identity are spread by their arrival so that they do not meet in one task.
    order = Window.partitionBy(*identity, F.when(~F.col("_known"), F.xxhash64(*arrival))).orderBy(*arrival)
    before = F.coalesce(F.lag(hash_column).over(order), F.col("_base_hash"))
    rows = rows.withColumn("_changes", ~F.col("_known") | before.isNull() | (before != F.col(hash_column)))
    step = F.sum(F.when(F.col("_changes"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = ~F.col("_known") | (F.col("_base_version").isNull() & (step == 1))
    version = F.when(~F.col("_known"), F.lit(1)).otherwise(F.coalesce("_base_version", F.lit(0)) + step)
    action = F.when(~F.col("_changes"), "skip").when(first, "insert").otherwise("update")
    return rows.withColumn("action", action).withColumn("version", version.cast("int")).drop("_base_hash", "_base_version", "_known", "_changes")


def current(planned: DataFrame, identity: list[str]) -> DataFrame:
    """The row that stays per identity: its highest version that was not skipped."""
    order = Window.partitionBy(*identity).orderBy(F.desc("version"))
    return planned.filter(F.col("action") != "skip").withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == 1).drop("_place")


def history(planned: DataFrame, identity: list[str]) -> DataFrame:
    """Earlier versions: every version that was replaced, one row each."""
    order = Window.partitionBy(*identity).orderBy(F.desc("version"))
    return planned.filter(F.col("action") != "skip").withColumn("_place", F.row_number().over(order)).filter(F.col("_place") > 1).drop("_place")


def collapse(df: DataFrame, key: list[str], arrival: list[str], source: str) -> DataFrame:
    """First row per key (nulls are a key like any other) with the distinct sources and the number of rows it stands for."""
    first = F.min_by(F.struct(*df.columns), F.struct(*arrival))
    g = df.groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(key)]).agg(first.alias("row"), F.array_sort(F.collect_set(source)).alias("sources"), F.count("*").alias("n_rows"))
    return g.select("row.*", "sources", "n_rows")


def soft_delete(df: DataFrame, keys: DataFrame, on: str, at: Column) -> DataFrame:
    """Set deleted_at of live rows whose ``on`` is in ``keys``."""
    hit = df.join(keys.select(on, F.lit(True).alias("_hit")).distinct(), on, "left")
    return hit.withColumn("deleted_at", F.when(F.col("deleted_at").isNull() & F.col("_hit"), at).otherwise(F.col("deleted_at"))).drop("_hit")


def earliest_same_file(files: DataFrame, done: list[str]) -> DataFrame:
    """Files whose content an earlier file in a ``done`` status has: (file_id, original_id)."""
    order = Window.partitionBy("file_hash").orderBy("created_at", "file_id")
    origin = files.filter(F.col("status").isin(done)).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == 1).select("file_hash", F.col("file_id").alias("original_id"), F.col("created_at").alias("original_at"))
    return files.join(origin, "file_hash").filter((F.col("original_at") < F.col("created_at")) | ((F.col("original_at") == F.col("created_at")) & (F.col("original_id") < F.col("file_id")))).select("file_id", "original_id")


def backfill_identity(df: DataFrame, claim: Column, arrival: list[str]) -> DataFrame:
    """Fill null external_id with ``claim``; the first claimant of a user and system keeps it, and only if nobody has it."""
    wanted = df.withColumn("_claim", F.when(F.col("external_id").isNull(), claim))
    order = Window.partitionBy("user_id", "source_system", "_claim").orderBy(*arrival)
    taken = df.filter(F.col("external_id").isNotNull()).select("user_id", "source_system", F.col("external_id").alias("_claim"), F.lit(True).alias("_taken")).distinct()
    rows = wanted.join(taken, ["user_id", "source_system", "_claim"], "left").withColumn("_place", F.row_number().over(order))
    free = F.col("_claim").isNotNull() & F.col("_taken").isNull() & (F.col("_place") == 1)
    return rows.withColumn("external_id", F.when(free, F.col("_claim")).otherwise(F.col("external_id"))).drop("_claim", "_taken", "_place")


def add_missing(basket: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``wanted`` not in ``basket`` yet, once each."""
    return wanted.select(*key).distinct().join(basket, key, "left_anti")
