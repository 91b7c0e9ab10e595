"""Language identification: script ranges, then Viterbi over per-word scores.

A word's script (by code point ranges) leaves only the languages seen with
that script in training; each left gets the log likelihood of the word's byte
trigrams. Viterbi with a penalty for switching then labels spans of the text.
Its language is the one it both opens and closes in, others being quoted, or
else the one with most words. A batch of texts runs through Viterbi together,
one word of each at a time.

Trained on a bounded sample of documents (``TRAIN_DOCS``); the model is one
row of ``TABLE`` counts per language. All documents are then read once,
without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import Words, bounded, concat_ranges, held_out, slices
from wardline.session import spread, table

TRAIN_DOCS = 20_000
TABLE = 1 << 14
#: Bytes of text labelled at once: a step of Viterbi costs the same for many texts as for few.
BATCH_BYTES = 2_000_000
SWITCH = 12.0
#: A word is worth at most this many nats between two languages.
WORD_NATS = 6.0
#: The least share of words of the language a text opens and closes in; below, those are a frame around another text.
HOST_SHARE = 0.1
UNDETERMINED = "und"
#: The least share of words in the named language that the pipeline keeps.
ACCEPT = 0.05

#: First code points of ranges, and the script of each (fixed values of the Unicode block list).
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "other"), (0x0750, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "other"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "other"), (0x0E00, "Thai"),
    (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"),
    (0x1780, "Khmer"), (0x1800, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"),
    (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"),
    (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "other"), (0x20000, "Han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_NOT_LETTERS = re.compile(r"[^\w\s]|[\d_]")


def _lead_scripts() -> np.ndarray:
    """Script number + 1 by first and second byte of a character, 0 for a byte that starts none; ASCII counts as Latin."""
    starts = np.array([a for a, _ in SCRIPT_RANGES])
    names = np.array([SCRIPTS.index(n) + 1 for _, n in SCRIPT_RANGES], dtype=np.uint8)
    first, second = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    tail = second & 0x3F
    point = np.select([first < 0x80, first < 0xC0, first < 0xE0, first < 0xF0], [first, -1, (first & 0x1F) << 6 | tail, (first & 0x0F) << 12 | tail << 6], (first & 7) << 18 | tail << 12)
    out = names[np.searchsorted(starts, np.maximum(point, 0), side="right") - 1]
    return np.where(point < 0, 0, out).astype(np.uint8)


_LEADS = _lead_scripts()
_LATIN = SCRIPTS.index("Latin") + 1


def letters_only(text: bytes) -> bytes:
    """Lower-cased text in which all but letters is blank."""
    return _NOT_LETTERS.sub(" ", text.decode("utf-8", "replace").lower()).encode()


def _cells(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Table cell of the byte trigram around each byte of the buffer (blank, word, blank), and the script of each byte's character or 0."""
    b = w.buf.astype(np.uint32)
    before, after = np.concatenate([[np.uint32(32)], b[:-1]]), np.concatenate([b[1:], [np.uint32(32)]])
    key = (before | b << np.uint32(8) | after << np.uint32(16)) * np.uint32(0x9E3779B1)
    return (key >> np.uint32(18)).astype(np.int64), _LEADS[w.buf, after.astype(np.uint8)]


def _word_scripts(w: Words, script: np.ndarray) -> np.ndarray:
    """Script of each word: of its first character that isn't Latin, else Latin (numbers from 0)."""
    odd = np.flatnonzero((script != 0) & (script != _LATIN) & (w.buf != 32))
    out = np.full(len(w.starts), _LATIN - 1, dtype=np.int64)
    word = np.searchsorted(w.starts, odd, side="right") - 1
    out[word[::-1]] = script[odd[::-1]] - 1
    return out


@dataclass
class Model:
    """Log likelihood of each cell (cells x languages), languages allowed by script, log priors."""

    langs: list[str]
    cells: np.ndarray
    allowed: np.ndarray
    prior: np.ndarray

    def word_scores(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores by word and language, and which words' scripts have a language at all."""
        cell, script = _cells(w)
        out = np.empty((len(w.starts), len(self.langs)), dtype=np.float32)
        for k in range(len(self.langs)):
            sums = np.concatenate([[0.0], np.cumsum(self.cells[:, k][cell])])
            out[:, k] = sums[w.ends] - sums[w.starts]
        fit = self.allowed[_word_scripts(w, script)]
        out = np.where(fit, out, -np.inf)
        best = out.max(axis=1, keepdims=True)
        out = np.where(np.isfinite(best), out - best, 0)
        return np.maximum(out, -WORD_NATS), fit.any(axis=1)

    def paths(self, scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """The language number of each word on the best path of its document."""
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        counts, head = counts[order], first[:-1][order]
        active = np.searchsorted(-counts, -np.arange(1, counts.max(initial=0) + 1), side="right")
        path = np.zeros(len(scores), dtype=np.int16)
        stays, tops = np.empty(scores.shape, dtype=bool), np.empty(len(scores), dtype=np.int16)
        alpha = np.tile(self.prior, (len(counts), 1))
        for t, n in enumerate(active.tolist()):
            a = alpha[:n]
            if t:
                top = a.argmax(axis=1)
                jump = a[np.arange(n), top] - switch
                stay = a >= jump[:, None]
                stays[head[:n] + t], tops[head[:n] + t] = stay, top
                a = np.where(stay, a, jump[:, None])
            alpha[:n] = a + scores[head[:n] + t]
        at = alpha.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            path[head[:n] + t] = at[:n]
            if t:
                word = head[:n] + t
                at[:n] = np.where(stays[word, at[:n]], at[:n], tops[word])
        return path

    def label(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, list[list[dict]]]:
        """Language, share of its words among all, and spans (lang, first word, end) of each text; words of a script without a language vote for none."""
        w = Words([letters_only(t) for t in texts])
        scores, covered = self.word_scores(w)
        path = self.paths(scores, w.first)
        docs, n = len(texts), len(self.langs)
        doc = np.repeat(np.arange(docs), w.counts)
        votes = np.bincount((doc * n + path)[covered], minlength=docs * n).reshape(docs, n)
        best = (votes + self.prior * 1e-6).argmax(axis=1)
        # A text that opens and closes in one language is in that language and quotes the others.
        full = np.flatnonzero(w.counts)
        opens, closes = path[w.first[full]], path[w.first[full + 1] - 1]
        host = (opens == closes) & (votes[full, opens] >= HOST_SHARE * w.counts[full])
        best[full] = np.where(host, opens, best[full])
        share = votes[np.arange(docs), best] / np.maximum(w.counts, 1)
        new = np.ones(len(path), dtype=bool)
        new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(path))
        spans: list[list[dict]] = [[] for _ in texts]
        for d, k, a, b in zip(doc[heads].tolist(), path[heads].tolist(), (heads - w.first[doc[heads]]).tolist(), (ends - w.first[doc[heads]]).tolist(), strict=True):
            spans[d].append({"lang": self.langs[k], "start": a, "end": b})
        return [self.langs[k] if c else UNDETERMINED for k, c in zip(best, w.counts, strict=True)], share, spans


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch, texts in slices(batches):
        langs = batch.column(0).to_pylist()
        for lang in set(langs):
            w = Words([letters_only(t) for t, own in zip(texts, langs, strict=True) if own == lang])
            if not len(w.starts):
                continue
            cell, script = _cells(w)
            inside = concat_ranges(w.starts, w.ends - w.starts)
            row = held.setdefault(lang, np.zeros(TABLE + len(SCRIPTS) + 1, dtype=np.int64))
            row[:TABLE] += np.bincount(cell[inside], minlength=TABLE)
            row[TABLE : TABLE + len(SCRIPTS)] += np.bincount(_word_scripts(w, script), minlength=len(SCRIPTS))
            row[-1] += sum(own == lang for own in langs)
    if held:
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(held)), "row": pa.array([r.tobytes() for r in held.values()], pa.binary())})


def _adder(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(r.as_py(), dtype=np.int64) for r in t.column("row"))
    return pa.table({"lang": t.column("lang").slice(0, 1), "row": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> Model:
    """Count trigrams of about ``rows`` documents with a lang, picked by a hash of their id; crc32(doc_id) mod 4 = 2 is never read."""
    known = bounded(docs).select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 4, 2))
    share = min(1.0, rows / max(1, known.count()))
    some = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < int(share * (1 << 30))).select("lang", "text")
    got = some.mapInArrow(_counter, "lang string, row binary").groupBy("lang").applyInArrow(_adder, "lang string, row binary").collect()
    got = sorted((r.lang, np.frombuffer(r.row, dtype=np.int64)) for r in got)
    if not got:
        return Model([UNDETERMINED], np.zeros((TABLE, 1)), np.ones((len(SCRIPTS), 1), dtype=bool), np.zeros(1))
    counts = np.stack([r[:TABLE] for _, r in got], axis=1) + 0.5
    scripts = np.stack([r[TABLE:-1] for _, r in got], axis=1)
    allowed = scripts > 1e-3 * np.maximum(scripts.sum(axis=0), 1)
    docs_of = np.array([r[-1] for _, r in got], dtype=float)
    return Model([lang for lang, _ in got], np.log(counts / counts.sum(axis=0)), allowed, np.log(docs_of / docs_of.sum()))


def _labeller(model: Model, spans: bool, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, limit=BATCH_BYTES):
            langs, share, found = model.label(texts)
            cols = [*batch.columns, pa.array(langs, pa.string()), pa.array(share, pa.float64())]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *names])

    return run


def identify(docs: DataFrame, model: Model, spans: bool = True, into: tuple[str, ...] = ("lang_pred", "lang_score", "lang_spans")) -> DataFrame:
    """``docs`` with lang_pred, lang_score (share of words in that language) and lang_spans; one narrow pass.

    ``into`` renames them. Spans count words of letters from 0. Null and empty
    texts and texts without a letter: ``und`` and score 0. Words of a script that
    no language was learned with vote for none; a text of such words alone is
    in the commonest language with score 0. Very long
    texts are read whole. Repeated rows stay and are labelled alike. Languages that tie
    go by their share of the learned documents, then by name. Columns
    already called as the new ones are replaced. Empty table: no rows.
    """
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    into = into[: 3 if spans else 2]
    new = [T.StructField(n, t) for n, t in zip(into, (T.StringType(), T.DoubleType(), T.ArrayType(span)), strict=False)]
    docs = bounded(docs).drop(*into)
    return docs.mapInArrow(_labeller(model, spans, into), T.StructType([*docs.schema.fields, *new]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    found = identify(docs.select("doc_id", "text"), train(docs), spans=False)
    return found.select("doc_id", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
