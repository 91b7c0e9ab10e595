"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text becomes a vector of transformed statistics. Each class has a
mean and a covariance shrunk towards the pooled covariance and its diagonal;
the score is a logistic of the difference of the two Mahalanobis log densities,
computed from Cholesky factors that are taken once and travel with the model.

The model is fitted on a bounded sample of labelled rows (``TRAIN_ROWS``);
everything else reads all documents once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import Ranges, Words, bounded, held_out, slices
from wardline.session import spread, table

TRAIN_ROWS = 20_000
ACCEPT = 0.3
#: Weights of the pooled covariance and of its diagonal in a class covariance.
SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05


def _classes() -> dict[str, np.ndarray]:
    b = np.arange(256)
    low, up = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90)
    digit = (b >= 48) & (b <= 57)
    mark = np.isin(b, list(b".,;:?'\"()-"))
    symbol = (b > 32) & (b < 127) & ~low & ~up & ~digit & ~mark
    return {"upper": up, "lower": low, "digit": digit, "mark": mark, "symbol": symbol, "shout": b == 33, "bar": b == 124, "high": b >= 128}


CLASSES = _classes()
STATISTICS = ("bytes", "words", "mean_word", "spread_word", *CLASSES, "distinct", "repeat", "top_word", "line_words", "repeat_line", "short_word", "long_word", "end_mark", "symbol_word", "capital_word")


def _logit(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 0, 1) * 0.998 + 0.001
    return np.log(x / (1 - x))


def _sums(flags: np.ndarray, heads: np.ndarray, some: np.ndarray) -> np.ndarray:
    """How many flags are set from each head to the next; 0 where ``some`` is not (nothing lies there)."""
    out = np.zeros(len(heads))
    if some.any():
        out[some] = np.add.reduceat(flags, heads[some], dtype=np.int32)
    return out


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of transformed statistics per text; an empty text has those of no words."""
    w = Words(texts)
    n, first = w.counts.astype(float), w.first
    docs = len(texts)
    out = np.zeros((docs, len(STATISTICS)))
    size = np.array([len(t) for t in texts], dtype=float)
    sizes = (w.ends - w.starts).astype(float)
    doc = np.repeat(np.arange(docs), w.counts)
    some = np.maximum(n, 1)
    per_doc = lambda weights: np.bincount(doc, weights=weights, minlength=docs)
    total = per_doc(sizes)
    col = dict(zip(STATISTICS, range(len(STATISTICS)), strict=True))
    put = lambda name, x: out.__setitem__((slice(None), col[name]), x)
    put("bytes", np.log1p(size))
    put("words", np.log1p(n))
    mean = total / some
    put("mean_word", np.log1p(mean))
    put("spread_word", np.log1p(np.sqrt(np.maximum(per_doc(sizes * sizes) / some - mean * mean, 0))))
    heads = np.append(w.starts, len(w.buf))[first[:-1]]
    for name, lut in CLASSES.items():
        put(name, _logit(_sums(lut[w.buf], heads, n > 0) / np.maximum(total, 1)))
    h = Ranges(w.buf)(w.starts, w.ends) if len(w.starts) else np.empty(0, dtype=np.uint64)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    put("repeat", _logit(per_doc(same) / some))
    order = np.lexsort((h, doc))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[1:] != doc[:-1])
    put("distinct", np.log1p(per_doc(new.astype(float))) / np.maximum(np.log1p(n), 1e-9))
    firsts = np.flatnonzero(new)
    top = np.zeros(docs)
    np.maximum.at(top, doc[firsts], np.diff(np.append(firsts, len(h))))
    put("top_word", _logit(top / some))
    put("short_word", _logit(per_doc(sizes <= 3) / some))
    put("long_word", _logit(per_doc(sizes >= 12) / some))
    last = w.buf[w.ends - 1] if len(w.ends) else np.empty(0, dtype=np.uint8)
    put("end_mark", _logit(per_doc(np.isin(last, list(b".!?"))) / some))
    per_word = lambda name: _sums(CLASSES[name][w.buf], w.starts, np.ones(len(w.starts), dtype=bool))
    put("symbol_word", _logit(per_doc(per_word("symbol") > 0) / some))
    put("capital_word", _logit(per_doc(per_word("upper") > 1) / some))
    lines = np.array([t.count(b"\n") + 1 for t in texts], dtype=float)
    put("line_words", np.log1p(n / lines))
    put("repeat_line", _logit(np.array([1 - len(set(x)) / len(x) for x in (t.split(b"\n") for t in texts)])))
    return out


@dataclass
class Model:
    """Class means, inverse Cholesky factors and log determinants, and the logistic that turns their difference into a score."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    slope: float
    offset: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        parts = [-0.5 * ((z - m) @ f.T) ** 2 for m, f in zip(self.means, self.factors, strict=True)]
        return (parts[1].sum(axis=1) + self.constants[1]) - (parts[0].sum(axis=1) + self.constants[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL) -> Model:
    """Fit on statistics and 0/1 labels; without two rows of each class every score is the share of label 1 (1 without rows)."""
    prior = float(y.mean()) if len(y) else 1.0
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(np.zeros(1), np.ones(1), [], [], [], 1.0, 0.0, prior)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - centre) / scale, -12, 12)
    groups = [z[y == c] for c in (0, 1)]
    means = [g.mean(axis=0) for g in groups]
    covs = [np.cov(g, rowvar=False) for g in groups]
    common = sum(len(g) * c for g, c in zip(groups, covs, strict=True)) / len(z)
    factors, constants = [], []
    for g, c in zip(groups, covs, strict=True):
        s = (1 - pooled - diagonal) * c + pooled * common + diagonal * np.diag(np.diag(common)) + 1e-3 * np.eye(len(c))
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        constants.append(float(-np.log(np.diag(lower)).sum() + np.log(len(g) / len(z))))
    model = Model(centre, scale, means, factors, constants, 1.0, 0.0, prior)
    m = np.clip(model.margin(x), -60, 60)
    a, b = 0.2, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on the margin alone
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        r, wt = y - p, np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(wt * m * m).sum() + 1, (wt * m).sum()], [(wt * m).sum(), wt.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(r * m).sum() - a, r.sum()]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = max(float(a), 1e-3), float(b)
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        x = statistics(texts)
        yield pa.RecordBatch.from_pydict({"quality": batch.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` labelled documents at most, picked by a hash of their id; crc32(doc_id) mod 5 = 0 is never read."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, rows / max(1, known.count()))
    # At most about TRAIN_ROWS pairs of numbers: small enough to broadcast whatever the tables' sizes.
    some = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30)))
    text = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("quality", "text")
    got = text.mapInArrow(_vectors, "quality int, x binary").collect()
    x = np.stack([np.frombuffer(r.x) for r in got]) if got else np.zeros((0, len(STATISTICS)))
    return fit(x, np.array([r.quality for r in got], dtype=float))


def _scorer(model: Model, text: str, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(statistics(texts)))], [*batch.schema.names, into])

    return run


def score(docs: DataFrame, model: Model, into: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``into``, a double from 0 to 1; one narrow pass.

    Only the text counts. Null and empty texts get the score of no words; very
    long texts are read whole. Repeated rows stay and score alike; texts of equal
    statistics tie. A column
    already called ``into`` is replaced. Empty table: no rows.
    """
    docs = bounded(docs).drop(into)
    return docs.mapInArrow(_scorer(model, "text", into), T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"))
