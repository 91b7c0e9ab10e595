"""Files kept sealed, a frame a row.

A file's bytes are cut into frames, each sealed for itself, so any number of
tasks seal and open one file. A frame vouches for its file, its number and
whether it is the last, so a changed byte, another key, frames in another
order or of another file, and a cut file are all refused. Files written before
sealing have frames without the mark and pass as they are, but never beside
sealed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.access import SEALED, seal, unseal

FRAME = 1 << 20


def frames(files: DataFrame, size: int = FRAME) -> DataFrame:
    """(file, n, last, frame, file_hash) of files (file, content): frames of ``size`` bytes from number 0, and the sha256 of all of it.

    An empty file has one empty frame. Null content: no frames.
    """
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    rows = files.filter("content IS NOT NULL").select("file", "content", F.sha2("content", 256).alias("file_hash"), count.alias("count"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("n"))
    return rows.select("file", "n", (F.col("n") == F.col("count") - 1).alias("last"), F.substr("content", F.col("n") * size + 1, F.lit(size)).alias("frame"), "file_hash")


def _about() -> Column:
    return F.concat_ws("\x1f", "file", F.col("n").cast("string"), F.col("last").cast("string"))


def seal_frames(rows: DataFrame, key: Column) -> DataFrame:
    """``rows`` with each frame sealed."""
    return rows.withColumn("frame", seal(F.col("frame"), key, _about()))


def open_frames(rows: DataFrame, key: Column) -> DataFrame:
    """``rows`` with each frame as it was; a file that is not whole, or that mixes sealed and plain frames, is an error.

    Only numbers and marks of frames are grouped; the bytes stay where they are.
    """
    marked = F.startswith("frame", F.lit(SEALED))
    seen = rows.groupBy("file").agg(F.count("*").alias("_n"), F.countDistinct("n").alias("_numbers"), F.max("n").alias("_most"), F.count_if("last").alias("_ends"), F.max(F.when(F.col("last"), F.col("n"))).alias("_end"), F.count_if(marked).alias("_sealed"))
    whole = (F.col("_n") == F.col("_most") + 1) & (F.col("_numbers") == F.col("_n")) & (F.col("_ends") == 1) & (F.col("_end") == F.col("_most")) & F.col("_sealed").isin(F.lit(0), F.col("_n"))
    broken = F.raise_error(F.concat(F.lit("frames are missing, repeated or mixed: "), F.col("file"))).cast("binary")
    return rows.join(seen, "file").withColumn("frame", F.when(F.coalesce(whole, F.lit(False)), unseal(F.col("frame"), key, _about())).otherwise(broken)).drop("_n", "_numbers", "_most", "_ends", "_end", "_sealed")


def whole_files(rows: DataFrame) -> DataFrame:
    """(file, content) of opened frames, for files that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("n", F.hex("frame").alias("h"))))
    return rows.groupBy("file").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("content"))
