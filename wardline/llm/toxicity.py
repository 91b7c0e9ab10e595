"""Toxic spans by a linear-chain conditional random field.

Each text is a sequence of words with the states clean and toxic. A word's
emission comes from features of itself (whole, prefixes, suffix, case, length)
and of its neighbours, of those that ``SEEN`` training documents have;
transitions tie neighbouring states. The forward-backward marginals give each
word's probability of being toxic: runs above one half are the offending spans,
and the probability that any word is toxic, put through a logistic, is the
document's score.

Labels are given for documents only, so the words' labels are derived first: a
word form or prefix found in significantly more toxic documents than its share
(log-likelihood ratio over the labelled documents, counted in Spark) marks its
words in toxic documents. Toxic documents without a marked word teach the field
nothing, but count where the score is calibrated.

Fitting reads at most about ``TRAIN_ROWS`` labelled documents for the marks and
``TRAIN_DOCS`` of each class for the field; scoring is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import Ranges, U, bounded, checkpointed, held_out, mix, slices
from wardline.session import spread, table

#: Bounds of fitting: labelled documents counted, documents of each class for the field and their longest text, marks kept.
TRAIN_ROWS, TRAIN_DOCS, TRAIN_BYTES, MARKS = 20_000, 800, 20_000, 50_000
ACCEPT = 0.5
#: A mark is in toxic documents by at least this share and this log-likelihood ratio.
PURE, SIGNIFICANT = 0.8, 10.0
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A feature is used if so many training documents have it; what is rarer would only tell them apart.
SEEN = 3
LONGEST = 15
STEPS, RATE, DECAY = 40, 0.25, 1e-3

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
#: Bytes of words: ASCII letters, digits and all from 0x80 on.
_WORD = _UPPER | ((_B >= 97) & (_B <= 122)) | ((_B >= 48) & (_B <= 57)) | (_B >= 128)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Tokens:
    """Words of some texts: word i is at bytes starts[i]:ends[i] of all texts laid end to end, document d has words first[d] to first[d + 1] - 1."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts) + b" "
        self.raw = np.frombuffer(joined, dtype=np.uint8)
        lens = np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts))
        self.heads = np.concatenate([[0], np.cumsum(lens)])
        inside = _WORD[self.raw]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, self.heads)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        ranges = Ranges(np.frombuffer(joined.translate(_LOWER), dtype=np.uint8))
        whole = ranges(self.starts, self.ends) if len(self.starts) else np.zeros(0, dtype=np.uint64)
        capital = _UPPER[self.raw[self.starts]]
        self.distinct, at, self.word = np.unique(whole ^ (capital * U(0x5851F42D4C957F2D)), return_index=True, return_inverse=True)
        s, e = self.starts[at], self.ends[at]
        self.whole, self.capital, self.size = whole[at], capital[at], np.minimum(e - s, LONGEST)
        #: Hashes of each distinct word's prefixes and last three bytes, 0 where the word is shorter.
        parts = [np.where(e - s >= k, ranges(s, np.minimum(s + k, e)) + U(k), U(0)) for k in PREFIXES] if len(s) else []
        self.prefixes = np.stack(parts, axis=1) if parts else np.zeros((0, len(PREFIXES)), dtype=np.uint64)
        self.suffix = np.where(e - s > 3, ranges(np.maximum(e - 3, s), e), U(0)) if len(s) else np.zeros(0, dtype=np.uint64)

    def features(self) -> np.ndarray:
        """Per distinct word its features, the whole word last; 0 for what it hasn't."""
        cols = np.concatenate([self.prefixes, self.suffix[:, None], self.whole[:, None]], axis=1)
        turn = np.arange(1, cols.shape[1] + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
        return np.where(cols == 0, U(0), mix(cols + turn))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and distinct word of each word, once a document."""
        kinds = max(1, len(self.distinct))
        pair = np.unique(self.doc * kinds + self.word)
        return pair // kinds, pair % kinds

    def starting(self) -> np.ndarray:
        """A mask of the first word of each document."""
        out = np.zeros(len(self.starts), dtype=bool)
        out[self.first[:-1][self.first[:-1] < self.first[1:]]] = True
        return out

    def marks(self) -> np.ndarray:
        """Per distinct word what can be a mark: prefixes from four bytes on and the whole word, regardless of case."""
        return np.concatenate([self.prefixes[:, 1:], self.whole[:, None]], axis=1)


def _scan(a00, a01, a10, a11, v0: float, v1: float) -> tuple[np.ndarray, np.ndarray]:
    """Row vectors v M0, v M0 M1, ..., scaled to sum 1, for 2 x 2 matrices given by their entries.

    Rows of consecutive matrices are multiplied side by side, then the vectors
    at the rows' heads one after the other, then all rows are replayed.
    """
    n = len(a00)
    if not n:
        return np.zeros(0), np.zeros(0)
    width = max(1, int(np.sqrt(n / 8)))
    rows = -(-n // width)

    def laid(x, fill):
        return np.concatenate([x, np.full(rows * width - n, fill)]).reshape(rows, width).T.copy()

    a00, a01, a10, a11 = laid(a00, 1.0), laid(a01, 0.0), laid(a10, 0.0), laid(a11, 1.0)
    p00, p01, p10, p11 = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for j in range(width):
        b00, b01, b10, b11 = a00[j], a01[j], a10[j], a11[j]
        p00, p01, p10, p11 = p00 * b00 + p01 * b10, p00 * b01 + p01 * b11, p10 * b00 + p11 * b10, p10 * b01 + p11 * b11
        s = 1 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * s, p01 * s, p10 * s, p11 * s
    h0, h1 = np.empty(rows), np.empty(rows)
    for i, (q00, q01, q10, q11) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True)):
        h0[i], h1[i] = v0, v1
        v0, v1 = v0 * q00 + v1 * q10, v0 * q01 + v1 * q11
        s = v0 + v1
        v0, v1 = v0 / s, v1 / s
    out0, out1 = np.empty((width, rows)), np.empty((width, rows))
    for j in range(width):
        h0, h1 = h0 * a00[j] + h1 * a10[j], h0 * a01[j] + h1 * a11[j]
        s = 1 / (h0 + h1)
        h0, h1 = h0 * s, h1 * s
        out0[j], out1[j] = h0, h1
    return out0.T.ravel()[:n], out1.T.ravel()[:n]


@dataclass
class Chain:
    """What forward-backward finds of some sequences laid end to end."""

    toxic: np.ndarray
    #: Expected numbers of sequences that start toxic and of steps clean-toxic, toxic-clean, toxic-toxic.
    counts: np.ndarray


def forward_backward(e: np.ndarray, starts: np.ndarray, start: float, steps: np.ndarray, pairs: bool = False) -> Chain:
    """Marginals under emissions ``e`` (log odds of toxic), a mask of first words, and log potentials of start and steps (clean-clean is 0)."""
    one = 1 / (1 + np.exp(-np.clip(e, -30, 30)))
    zero = 1 - one
    t01, t10, t11 = np.exp(np.clip(steps, -15, 15))
    s1 = np.exp(np.clip(start, -15, 15))
    # A first word forgets what stands before it: both rows of its matrix are alike.
    m00, m01 = zero, np.where(starts, s1, t01) * one
    m10, m11 = np.where(starts, 1.0, t10) * zero, np.where(starts, s1, t11) * one
    f0, f1 = _scan(m00, m01, m10, m11, 1.0, 0.0)
    b0, b1 = np.ones(len(e)), np.ones(len(e))
    b0[:-1], b1[:-1] = (x[::-1] for x in _scan(m00[:0:-1], m10[:0:-1], m01[:0:-1], m11[:0:-1], 0.5, 0.5))
    p = f1 * b1 / (f0 * b0 + f1 * b1)
    counts = np.zeros(4)
    if pairs:
        at = np.flatnonzero(~starts)
        x00, x01 = f0[at - 1] * m00[at] * b0[at], f0[at - 1] * m01[at] * b1[at]
        x10, x11 = f1[at - 1] * m10[at] * b0[at], f1[at - 1] * m11[at] * b1[at]
        total = x00 + x01 + x10 + x11
        counts = np.array([p[starts].sum(), (x01 / total).sum(), (x10 / total).sum(), (x11 / total).sum()])
    return Chain(p, counts)


@dataclass
class Model:
    """Weights of the field and the logistic from evidence to score."""

    #: Hashes of the features used, sorted; their weights for the word itself, the next word and the one before, with a 0 at the end for all others.
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    own: np.ndarray = field(default_factory=lambda: np.zeros(1))
    before: np.ndarray = field(default_factory=lambda: np.zeros(1))
    after: np.ndarray = field(default_factory=lambda: np.zeros(1))
    size: np.ndarray = field(default_factory=lambda: np.zeros(LONGEST + 1))
    capital: float = 0.0
    bias: float = -20.0
    start: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: Of a constant, the log odds that any word is toxic, and the logarithm of the number of words.
    logistic: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))

    def slots(self, w: Tokens) -> np.ndarray:
        """Per distinct word the places of its features in ``known``, their number for one that isn't there."""
        h, n = w.features(), len(self.known)
        if not n:
            return np.zeros(h.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, h), n - 1)
        return np.where(self.known[at] == h, at, n)

    def emissions(self, w: Tokens, slots: np.ndarray) -> np.ndarray:
        e = (self.own[slots].sum(axis=1) + self.size[w.size] + self.capital * w.capital + self.bias)[w.word]
        same = w.doc[1:] == w.doc[:-1]
        place = slots[w.word, -1]
        e[1:] += self.before[place[:-1]] * same
        e[:-1] += self.after[place[1:]] * same
        return e

    def marginals(self, w: Tokens) -> np.ndarray:
        return forward_backward(self.emissions(w, self.slots(w)), w.starting(), self.start, self.steps).toxic

    def score(self, w: Tokens, p: np.ndarray) -> np.ndarray:
        z = np.clip(evidence(w, p) @ self.logistic, -30, 30)
        return 1 / (1 + np.exp(-z))


def evidence(w: Tokens, p: np.ndarray) -> np.ndarray:
    """Per document 1, the log odds that any of its words is toxic (held to -15 to 15), and the logarithm of 1 and its number of words."""
    docs = len(w.first) - 1
    none = np.bincount(w.doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=docs)
    odds = np.log(np.maximum(-np.expm1(none), 1e-12)) - none
    return np.stack([np.ones(docs), np.clip(odds, -15, 15), np.log1p(np.diff(w.first))], axis=1)


def fit_field(texts: list[bytes], toxic: np.ndarray, marks: np.ndarray) -> Model:
    """Fit the field on documents and their labels; ``marks`` are the hashes (sorted) that label words of toxic documents."""
    model, w = Model(), Tokens(texts)
    marked = np.isin(w.marks(), marks).any(axis=1)[w.word]
    y = (marked & (toxic[w.doc] == 1)).astype(float)
    taught = np.bincount(w.doc, weights=y, minlength=len(texts)) > 0
    keep = np.flatnonzero((toxic == 0) | taught)
    if not taught.any():
        return model
    if len(keep) < len(texts):
        return fit_field([texts[i] for i in keep], toxic[keep], marks)
    starts = w.starting()
    doc, word = w.pairs()
    rows = w.features()[word]
    feature, times = np.unique(rows[rows != 0], return_counts=True)
    model.known = feature[times >= SEEN]
    n = len(model.known)
    model.own, model.before, model.after = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    slots = model.slots(w)
    same = (w.doc[1:] == w.doc[:-1]).astype(float)
    place, kinds = slots[w.word, -1], len(w.distinct)
    seen = np.array([y[starts].sum(), *(((y[:-1] == a) & (y[1:] == b) & (same > 0)).sum() for a, b in ((0, 1), (1, 0), (1, 1)))])
    model.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    names = ("own", "before", "after", "size", "capital", "bias", "start", "steps")
    first, second = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    for step in range(1, STEPS + 1):  # Adam on the penalised likelihood
        found = forward_backward(model.emissions(w, slots), starts, model.start, model.steps, pairs=True)
        g = found.toxic - y
        per = np.bincount(w.word, weights=g, minlength=kinds)
        off = found.counts - seen
        grads = {
            "own": np.bincount(slots.ravel(), weights=np.repeat(per, slots.shape[1]), minlength=n + 1),
            "before": np.bincount(place[:-1], weights=g[1:] * same, minlength=n + 1),
            "after": np.bincount(place[1:], weights=g[:-1] * same, minlength=n + 1),
            "size": np.bincount(w.size, weights=per, minlength=LONGEST + 1),
            "capital": per @ w.capital,
            "bias": per.sum(),
            "start": off[0],
            "steps": off[1:],
        }
        for name in ("own", "before", "after"):
            grads[name][n] = 0
        for name in names:
            grad = grads[name] + DECAY * getattr(model, name)
            first[name] = 0.9 * first[name] + 0.1 * grad
            second[name] = 0.99 * second[name] + 0.01 * grad**2
            setattr(model, name, getattr(model, name) - RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 0.05))
    return model


def calibrate(model: Model, texts: list[bytes], toxic: np.ndarray, weights: np.ndarray) -> Model:
    """Fit the logistic on documents the field has not learned from, each counted as often as it stands for others."""
    if not len(texts):
        return model
    w = Tokens(texts)
    x = evidence(w, model.marginals(w))
    beta = prior = np.array([0.0, 0.5, 0.0])
    ridge = np.array([1e-2, 0.1, 1.0])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((weights * (np.logaddexp(0, z) - toxic * z)).sum() + (ridge * (at - prior) ** 2).sum() / 2)

    for _ in range(60):  # Newton steps, halved until they lower the penalised loss
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, x.T @ (weights * (toxic - p)) - ridge * (beta - prior))
        while np.abs(step).max() > 1e-8 and loss(beta + step) > loss(beta):
            step = step / 2
        beta = beta + step
        if np.abs(step).max() <= 1e-8:
            break
    model.logistic = beta
    return model


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of a document's word pairs: copies share it, and most near-copies do."""
    for batch, texts in slices(batches):
        w = Tokens(texts)
        h = w.whole[w.word]
        pair = mix(h[:-1] * U(0xD6E8FEB86659FD93) + h[1:])
        least = np.full(len(texts), 2**64 - 1, dtype=np.uint64)
        inside = w.doc[1:] == w.doc[:-1]
        np.minimum.at(least, w.doc[1:][inside], pair[inside])
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "signature": pa.array(least.view(np.int64))})


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean documents of a slice each possible mark is."""
    for batch, texts in slices(batches):
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        w = Tokens(texts)
        doc, word = w.pairs()
        marks = w.marks()[word]
        doc = np.repeat(doc, marks.shape[1])
        order = np.lexsort((doc, marks.ravel()))
        m, d = marks.ravel()[order], doc[order]
        new = m != 0
        new[1:] &= (m[1:] != m[:-1]) | (d[1:] != d[:-1])
        kinds, at = np.unique(m[new], return_inverse=True)
        bad = np.bincount(at, weights=toxic[d[new]], minlength=len(kinds)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"mark": pa.array(kinds.view(np.int64)), "a": pa.array(bad), "b": pa.array(np.bincount(at, minlength=len(kinds)) - bad)})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, field_docs: int = TRAIN_DOCS, marks: int = MARKS) -> Model:
    """Fit on labelled documents, picked by a hash of their id; crc32(doc_id) mod 5 = 0 is never read.

    At most about ``rows`` documents are counted for marks, one of each group
    of copies, and the ``marks`` most telling are kept; at most about ``field_docs`` of each
    class, of up to ``TRAIN_BYTES`` bytes, come to the driver, three in four
    for the field and the rest for the score. Without documents of both classes
    every score is that of no evidence, without marks the share of toxic ones.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & ~held_out("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30))
    total = known.count()
    # At most about TRAIN_ROWS triples of numbers: small enough to broadcast whatever the tables' sizes.
    some = known.select("doc_id", "toxic", pick.alias("pick")).filter(F.col("pick") < int(min(1.0, rows / max(1, total)) * (1 << 30)))
    # The sample is bounded and written, so that documents are scanned for it once.
    text = checkpointed(bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id"))
    alone = text.select("doc_id", "text").mapInArrow(_signatures, "doc_id long, signature long").groupBy("signature").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    text = checkpointed(text.join(F.broadcast(alone), "doc_id"))
    sizes = {r.toxic: r.n for r in text.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model()
    counted = text.select("toxic", "text").mapInArrow(_counts, "mark long, a long, b long").groupBy("mark").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n, share = F.col("a") + F.col("b"), bad / (bad + good)
    part = lambda x, s: F.when(x > 0, x * F.log(x / (n * s))).otherwise(0.0)
    ratio = part(F.col("a"), share) + part(F.col("b"), 1 - share)
    best = counted.filter(F.col("a") >= PURE * n).select("mark", ratio.alias("ratio")).filter(F.col("ratio") >= SIGNIFICANT).orderBy(F.desc("ratio"), "mark").limit(marks)
    telling = np.sort(np.array([r.mark for r in best.collect()], dtype=np.int64).view(np.uint64))
    scale = int(min(1.0, rows / max(1, total)) * (1 << 30))
    chosen = text.filter((F.octet_length("text") <= TRAIN_BYTES) & (F.col("pick") < F.when(F.col("toxic") == 1, int(scale * min(1.0, field_docs / bad))).otherwise(int(scale * min(1.0, field_docs / good)))))
    got = sorted((r.pick, r.toxic, r.text or "") for r in chosen.select("pick", "toxic", "text").collect())
    toxic = np.array([r[1] for r in got], dtype=float)
    weights = np.where(toxic == 1, max(1.0, bad / field_docs), max(1.0, good / field_docs))
    held = np.zeros(len(got), dtype=bool)
    for c in (0, 1):  # every fourth of each class
        held[np.flatnonzero(toxic == c)[3::4]] = True
    texts = [r[2].encode() for r in got]
    model = fit_field([t for t, h in zip(texts, held, strict=True) if not h], toxic[~held], telling)
    if not len(model.known):
        model.logistic = np.array([np.log(bad / good), 0.0, 0.0])
        return model
    return calibrate(model, [t for t, h in zip(texts, held, strict=True) if h], toxic[held], weights[held])


def _spans(w: Tokens, p: np.ndarray) -> pa.Array:
    """Per document the runs of words more likely toxic than not, as code points of the text."""
    hit = np.flatnonzero(p >= 0.5)
    points = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80)])
    apart = np.ones(len(hit), dtype=bool)
    apart[1:] = (np.diff(hit) > 1) | (w.doc[hit[1:]] != w.doc[hit[:-1]])
    head = np.flatnonzero(apart)
    last = np.append(head[1:], len(hit))[: len(head)] - 1
    doc = w.doc[hit[head]]
    zero = points[w.heads[doc]]
    mean = np.add.reduceat(p[hit], head) / (last - head + 1) if len(head) else np.zeros(0)
    runs = pa.StructArray.from_arrays([pa.array((points[w.starts[hit[head]]] - zero).astype(np.int32)), pa.array((points[w.ends[hit[last]]] - zero).astype(np.int32)), pa.array(mean)], ["start", "end", "p"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(w.first))).astype(np.int32)), runs)


def _tagger(model: Model, into: str, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            w = Tokens(texts)
            p = model.marginals(w)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(w, p)), _spans(w, p)], [*batch.schema.names, into, spans])

    return run


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))


def tag(docs: DataFrame, model: Model, into: str = "toxicity", spans: str = "toxic_spans") -> DataFrame:
    """``docs`` with the score ``into`` and ``spans``, an array of (start, end, p): code points of the text and the words' mean probability.

    Only the text counts. Null and empty texts get the score of no words and no
    spans; very long texts are read whole, as one sequence. Repeated rows stay
    and score alike; a word at exactly one half is in a span. Columns already
    called so are replaced. Empty table: no rows.
    """
    docs = bounded(docs).drop(into, spans)
    return docs.mapInArrow(_tagger(model, into, spans), T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType()), T.StructField(spans, SPANS)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    tagged = tag(docs, train(docs, table(spark, sf_dir, "labels")))
    return tagged.select("doc_id", F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= ACCEPT).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))
