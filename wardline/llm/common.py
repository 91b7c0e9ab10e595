"""Helpers shared by the operators: checkpoints, byte-level words, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slices of a batch handed to numpy hold at most about this many bytes of text.
SLICE_BYTES = 1_000_000

#: Arrow batches of texts hold at most about this many bytes, in the JVM and in the worker.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, set once for ``checkpoint()``.

    It comes from ``spark.checkpoint.dir``; where that is unset, a folder under
    /tmp is taken on one machine (tests), and a cluster is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints")
    return jsc.getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to the shared folder, so a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(docs: DataFrame, limit: int = BATCH_BYTES) -> DataFrame:
    """``docs``, with its session's Arrow batches held to about ``limit`` bytes: the default of 10,000 rows is too much where texts are long."""
    conf = docs.sparkSession.conf
    held = conf.get(_BATCH_SETTING, "64m").lower()
    unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(held[-1], 1)
    size = int(held.rstrip("bkmg") or 0) * unit
    if size <= 0 or size > limit:
        conf.set(_BATCH_SETTING, str(limit))
    return docs


def held_out(id_col: str, modulus: int, remainder: int):
    """crc32(id as text) mod ``modulus`` equals ``remainder``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches evenly into slices of about ``limit`` bytes of text (one row at least); null texts become empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        share = ends[-1] / max(1, round(ends[-1] / limit))
        at = 0
        while at < len(column):
            k = min(len(column), max(at + 1, int(np.searchsorted(ends, ends[at] + share))))
            yield batch.slice(at, k - at), [x or b"" for x in column.slice(at, k - at).cast(pa.large_binary()).to_pylist()]
            at = k


class Words:
    """Words (maximal runs of bytes other than 0x20 and 0x09-0x0D) of some texts.

    ``buf`` holds each word followed by one space; word i is
    buf[starts[i]:ends[i]]; document d has words first[d] to first[d + 1] - 1.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        lens = np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts))
        heads = np.concatenate([[0], np.cumsum(lens)])
        non = ~SPACE[raw]
        prev = np.empty_like(non)
        prev[0] = False
        prev[1:] = non[:-1]
        begin = np.flatnonzero(non & ~prev)
        sizes = np.flatnonzero(~non & prev) - begin
        self.buf = np.where(non, raw, np.uint8(32))[non | prev]
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        self.ends = self.starts + sizes
        self.first = np.searchsorted(begin, heads)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, size=256, dtype=np.uint64) | U(1)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, dtype=np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64, out=x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Ranges:
    """64-bit hashes of byte ranges of one buffer, equal for equal bytes; callers confirm equality on the bytes."""

    def __init__(self, buf: np.ndarray):
        weighted = _powers(_BASE, len(buf) + 1)[:-1]
        weighted *= _BYTES[buf]
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(weighted, out=self.sums[1:])
        del weighted
        self.inverse = _powers(_INVERSE, len(buf) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def concat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] values), then the same for each further range."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    heads = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(heads, counts) + np.repeat(starts, counts)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or with underscores before it until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
