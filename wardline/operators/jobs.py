"""Upload jobs as pure functions of their status columns, and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, ENDED = ("pending", "processing"), ("completed", "failed", "cancelled", "duplicate_file")


def claim_order(jobs: DataFrame, limit: int) -> DataFrame:
    """The next pending jobs of each owner, oldest first."""
    order = Window.partitionBy("owner").orderBy("created_at", "job_id")
    return jobs.filter(F.col("status") == "pending").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def recover_stuck(jobs: DataFrame, now: Column, after_days: int, max_retries: int) -> DataFrame:
    """Processing jobs older than the limit go back to pending with one more retry, or fail after ``max_retries``."""
    stuck = (F.col("status") == "processing") & (F.col("created_at") < now - F.make_dt_interval(F.lit(after_days)))
    spent = F.col("retries") >= max_retries
    status = F.when(stuck & spent, "failed").when(stuck, "pending").otherwise(F.col("status"))
    return jobs.withColumn("new_status", status).withColumn("new_retries", F.col("retries") + F.when(stuck & ~spent, 1).otherwise(0))


def cancel_outcome(status: Column, stale: Column) -> Column:
    """What a cancel request does to a job."""
    return F.when(status.isin(*ENDED), "refused").when(status == "pending", "cancelled").when((status == "processing") & stale, "cancelled").when(status == "processing", "requested").otherwise("refused")


def batch_progress(jobs: DataFrame) -> DataFrame:
    """Counts per owner in one pass, and the share done in whole per cent."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    g = jobs.groupBy("owner").agg(F.count("*").alias("total"), n("completed").alias("completed"), n("processing").alias("processing"), n("pending").alias("pending"), n("failed").alias("failed"), F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("size")).otherwise(0.0)), F.lit(0.0)).alias("size_done"))
    return g.withColumn("percent", F.bround((F.col("completed") + F.col("failed")) * 100.0 / F.col("total"), 1)).withColumn("size_done", F.bround("size_done", 2))


def audit_rows(searches: DataFrame) -> DataFrame:
    """Append-only audit rows; the searched text is kept as a short hash and a length only."""
    q = F.lower(F.trim("query"))
    return searches.select("actor", "logged_at", F.left(F.sha2(q, 256), F.lit(16)).alias("query_hash"), F.length(q).cast("long").alias("query_chars"))
