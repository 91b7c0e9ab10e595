"""A kept table as changes in hash buckets, for upserts of micro-batches.

``data/batch=n/bucket=b`` holds the rows of bucket b that batch n inserted or
updated, ``versions/batch=n`` those it replaced. ``manifest/n.json`` says after
batch n which folders each bucket consists of; it is written beside and renamed,
so readers see a batch whole or not at all, and a batch that is run again finds
itself done. A batch reads and writes the buckets it touches alone; a bucket of
more than ``FOLDERS`` folders is rewritten as one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators.upsert import current, history, plan_batch

BUCKETS, FOLDERS = 64, 8


def _bucket(identity: list[str], arrival: list[str], buckets: int) -> Column:
    known = _known(identity)
    return F.pmod(F.when(known, F.xxhash64(*identity)).otherwise(F.xxhash64(*arrival)), F.lit(buckets)).cast("int")


def _known(identity: list[str]) -> Column:
    known = F.lit(True)
    for c in identity:
        known = known & F.col(c).isNotNull()
    return known


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def manifest(spark: SparkSession, folder: str) -> dict:
    """The newest manifest: batch (-1: none yet), buckets (number as text to folders) and the table's schema."""
    fs, path = _fs(spark, folder)
    at = path(f"{folder}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    names = [n for n in names if n.endswith(".json")]
    if not names:
        return {"batch": -1, "buckets": {}, "schema": None}
    # A row of text a bucket at most; read by Spark, as the folder can be in any store.
    return json.loads(spark.read.text(f"{folder}/manifest/{max(names)}", wholetext=True).first()[0])


def _publish(spark: SparkSession, folder: str, found: dict) -> None:
    fs, path = _fs(spark, folder)
    name = f"{folder}/manifest/{found['batch']:012d}.json"
    with_mark = path(f"{name}.new")
    out = fs.create(with_mark, True)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    if not fs.rename(with_mark, path(name)):
        raise RuntimeError(f"batch {found['batch']} has been written by another run")


def _rows(spark: SparkSession, folder: str, found: dict, buckets: list[str] | None = None) -> DataFrame | None:
    """All rows of the folders that some buckets consist of."""
    chosen = {f for b, fs in found["buckets"].items() if buckets is None or b in buckets for f in fs}
    if not chosen:
        return None
    return spark.read.schema(T.StructType.fromJson(found["schema"])).option("basePath", f"{folder}/data").parquet(*[f"{folder}/data/{f}" for f in sorted(chosen)])


def _latest(rows: DataFrame, identity: list[str], arrival: list[str]) -> DataFrame:
    order = Window.partitionBy("bucket", *identity, F.when(~_known(identity), F.xxhash64(*arrival))).orderBy(F.desc("version"))
    return rows.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def read(spark: SparkSession, folder: str, identity: list[str], arrival: list[str]) -> DataFrame | None:
    """The table as it is after the last whole batch: one row of each identity, and every row without one."""
    rows = _rows(spark, folder, manifest(spark, folder))
    return None if rows is None else _latest(rows, identity, arrival).drop("bucket", "batch")


def upsert(spark: SparkSession, incoming: DataFrame, folder: str, batch_id: int, identity: list[str], arrival: list[str], buckets: int = BUCKETS, folders: int = FOLDERS) -> dict:
    """Apply one batch to the table in ``folder``; returns its manifest.

    ``incoming`` has ``identity``, ``arrival`` and content_hash. A batch that
    has been applied changes nothing. Rows without identity are inserted.
    """
    found = manifest(spark, folder)
    if found["batch"] >= batch_id:
        return found
    name = f"batch={batch_id:012d}"
    staged = f"{folder}/staging/{name}"
    incoming.withColumn("bucket", _bucket(identity, arrival, buckets)).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    touched = sorted(str(r.bucket) for r in rows.select("bucket").distinct().collect())
    before = _rows(spark, folder, found, touched)
    if before is not None:
        before = _latest(before, identity, arrival).drop("batch")
    state = before.select(*identity, "content_hash", "version") if before is not None else spark.createDataFrame([], rows.select(*identity, "content_hash").schema.add("version", T.IntegerType()))
    planned = plan_batch(rows, state.filter(_known(identity)), identity, arrival).drop("bucket")
    planned = planned.withColumn("bucket", _bucket(identity, arrival, buckets))
    known = planned.filter(_known(identity))
    new = current(known, identity).unionByName(planned.filter(~_known(identity))).drop("action")
    old = history(known, identity).drop("action")
    new.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/{name}")
    if before is not None:
        changed = spark.read.schema(new.schema).parquet(f"{folder}/data/{name}").select(*identity)
        old = old.unionByName(before.join(changed, identity, "left_semi"))
    old.drop("bucket").write.mode("overwrite").parquet(f"{folder}/versions/{name}")
    fs, path = _fs(spark, folder)
    written = {s.getPath().getName().split("=")[1] for s in fs.listStatus(path(f"{folder}/data/{name}")) if s.getPath().getName().startswith("bucket=")}
    # bucket and batch come from the folders' names.
    held = {b: list(f) for b, f in found["buckets"].items()}
    for b in written:
        held.setdefault(b, []).append(f"{name}/bucket={b}")
    after = {"batch": batch_id, "buckets": held, "schema": new.withColumn("batch", F.lit("")).schema.jsonValue()}
    full = sorted(b for b, f in held.items() if len(f) > folders)
    if full:
        whole = f"{name}-whole"
        _latest(_rows(spark, folder, after, full), identity, arrival).drop("batch").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/{whole}")
        after["buckets"] = held | {b: [f"{whole}/bucket={b}"] for b in full}
    _publish(spark, folder, after)
    fs.delete(path(staged), True)
    return after
