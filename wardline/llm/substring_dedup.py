"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words of one text. Its minimiser is the
``m``-word group of smallest hash inside it. Consecutive windows that share a
minimiser travel as one packed string (a super-k-mer) to the bucket of that
minimiser, so equal windows meet in one bucket and each window travels once.
A bucket sorts its windows, confirms equal ones on their bytes and reports
those that also start earlier.

Scale. A first pass over all words finds the word groups that make up at least
``HOT_SHARE`` of the corpus (at most 1 / HOT_SHARE of them, so their broadcast
is bounded); these come last in the minimiser order. Windows around a very
common line are thus spread by the words beside it, and the windows inside one
are the same packed string everywhere, which each map task sends once. Bucket
count follows the corpus, so a bucket stays at about ``BUCKET_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import Ranges, U, Words, bounded, checkpointed, concat_ranges, fresh, mix, slices
from wardline.session import table

WINDOW_WORDS = 20
MINIMISER_WORDS = 2
HOT_SHARE = 1e-4
BUCKET_BYTES = 6 << 20
#: A map task sends what it has gathered when this many bytes of packed strings wait.
FLUSH_BYTES = 24 << 20
#: Texts whose equal packed strings travel once.
SLICE_BYTES = 2_000_000
_LAST = U(1 << 63)


def _groups(w: Words, m: int) -> np.ndarray:
    """Hashes of all groups of m consecutive words, top bit clear; a group is named by its first word."""
    h = Ranges(w.buf)(w.starts, w.ends)
    n = max(len(h) - m + 1, 0)
    g = np.zeros(n, dtype=np.uint64)
    for j in range(m):
        g = g * U(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(g) >> U(1)


def _window_min(g: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        g, span = np.minimum(g[:-span], g[span:]), 2 * span
    return np.minimum(g[: len(g) - (width - span)], g[width - span :]) if width > span else g


def _hot_counter(m: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size, held, kept = 0, 0, [], {}
        limit = int(2 / share)

        def settle() -> None:
            if not held:
                return
            v, c = np.unique(np.concatenate(held), return_counts=True)
            seen = sum(map(len, held))
            few = c >= max(3, share * seen / 2)
            for a, b in zip(v[few].tolist(), c[few].tolist(), strict=True):
                kept[a] = kept.get(a, 0) + b
            if len(kept) > 4 * limit:
                for a in sorted(kept, key=kept.get)[: len(kept) - limit]:
                    del kept[a]
            held.clear()

        for _, texts in slices(batches):
            w = Words(texts)
            size += len(w.buf)
            if len(w.starts):
                total += len(w.starts)
                held.append(_groups(w, m))
                if sum(map(len, held)) > 1_000_000:
                    settle()
        settle()
        out = [(k, n) for k, n in kept.items() if n >= max(3, share * total / 2)]
        yield pa.RecordBatch.from_pydict({"g": pa.array([-1, *(k for k, _ in out)], pa.int64()), "n": pa.array([total, *(n for _, n in out)], pa.int64()), "size": pa.array([size] + [0] * len(out), pa.int64())})

    return run


def common_groups(docs: DataFrame, m: int = MINIMISER_WORDS, share: float = HOT_SHARE) -> tuple[np.ndarray, int, int]:
    """Hashes of the word groups with at least ``share`` of all words, the number of words and of their bytes.

    The list has at most 1 / share entries whatever the corpus; it steers only
    how windows are dealt out, never which windows count as equal.
    """
    found = bounded(docs).select("text").mapInArrow(_hot_counter(m, share), "g long, n long, size long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    found = checkpointed(found)
    whole = found.filter("g = -1").first()
    n, size = (whole.n, whole["size"]) if whole else (0, 0)
    rows = found.filter((F.col("g") != -1) & (F.col("n") >= max(64, n * share))).select("g").collect()
    return np.sort(np.array([r.g for r in rows], dtype=np.uint64)), n, size


def _pack(parts: list[tuple]) -> bytes:
    """doc ids, starts, word counts and packed words of some super-k-mers, then ranges already known as repeats."""
    docs, starts, counts, text, known = (list(x) for x in zip(*parts, strict=True))
    d, s, c, k = np.concatenate(docs), np.concatenate(starts), np.concatenate(counts), np.concatenate(known)
    head = np.array([len(d), len(k)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + d.astype("<i8").tobytes() + s.astype("<i4").tobytes() + c.astype("<i4").tobytes() + k.astype("<i8").tobytes() + b"".join(text))


def _unpack(blob: bytes) -> tuple:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = np.frombuffer(raw, dtype=np.int64, count=2)
    at = 16
    d = np.frombuffer(raw, dtype="<i8", count=n, offset=at)
    s = np.frombuffer(raw, dtype="<i4", count=n, offset=(at := at + 8 * n))
    c = np.frombuffer(raw, dtype="<i4", count=n, offset=(at := at + 4 * n))
    known = np.frombuffer(raw, dtype="<i8", count=3 * k, offset=(at := at + 4 * n)).reshape(-1, 3)
    return d, s, c, known, raw[at + 24 * k :]


def _splitter(k: int, m: int, hot: np.ndarray, buckets: int):
    """Texts to one packed row per bucket and flush."""

    def super_kmers(ids: np.ndarray, w: Words):
        g = _groups(w, m)
        if len(hot) and len(g):
            at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
            g = np.where(hot[at] == g, g | _LAST, g)
        low = _window_min(g, k - m + 1)
        windows = np.maximum(w.counts - k + 1, 0)
        at = concat_ranges(w.first[:-1], windows)
        doc = np.repeat(np.arange(len(ids)), windows)
        low = low[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(at))) + k - 1
        first = at[head]
        return low[head], doc[head], first, count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        waiting = 0

        def rows() -> pa.RecordBatch:
            keys = sorted(held)
            return pa.RecordBatch.from_pydict({"bucket": pa.array(keys, pa.int32()), "packed": pa.array([_pack(held[b]) for b in keys], pa.binary())})

        for batch, texts in slices(batches, limit=SLICE_BYTES):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            w = Words(texts)
            if len(w.starts) < k:
                continue
            low, doc, first, count = super_kmers(ids, w)
            if not len(low):
                continue
            begin, end = w.starts[first], w.ends[first + count - 1] + 1
            bucket = (mix(low) % U(buckets)).astype(np.int32)
            start = first - w.first[doc]
            who = ids[doc]
            # Equal packed strings of this slice: the earliest travels, the others are repeats of it.
            key = Ranges(w.buf)(begin, end)
            order = np.lexsort((start, who, key, bucket))
            same = np.zeros(len(order), dtype=bool)
            same[1:] = (key[order][1:] == key[order][:-1]) & (count[order][1:] == count[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
            raw = w.buf.tobytes()
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            for i in np.flatnonzero(same).tolist():
                a, b = order[i], order[lead[i]]
                same[i] = raw[begin[a] : end[a]] == raw[begin[b] : end[b]]
            lead = order[lead]
            later = same & ((who[order] != who[lead]) | (start[order] != start[lead]))  # a repeated row starts no later
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for part in np.split(np.arange(len(order)), cuts):
                sent, known = order[part[~same[part]]], order[part[later[part]]]
                text = b"".join([raw[a:b] for a, b in zip(begin[sent].tolist(), end[sent].tolist(), strict=True)])
                held.setdefault(int(bucket[order[part[0]]]), []).append((who[sent], start[sent], count[sent], text, np.stack([who[known], start[known], start[known] + count[known]], axis=1)))
                waiting += len(text)
            if waiting > FLUSH_BYTES:
                yield rows()
                held.clear()
                waiting = 0
        if held:
            yield rows()

    return run


def _repeats(k: int):
    """One bucket's packed strings to the word ranges whose windows also start earlier."""

    def run(t: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py()) for x in t.column("packed")]
        who, start, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
        known = np.concatenate([p[3] for p in parts])
        hashes, begins, ends, at, word_at = [], [], [], 0, 0
        heads = []
        for d, _s, c, _k, text in parts:
            buf = np.frombuffer(text, dtype=np.uint8)
            stop = np.flatnonzero(buf == 32)
            begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
            hashes.append(Ranges(buf)(begin, stop))
            begins.append(begin + at)
            ends.append(stop + at)
            heads.append(word_at + np.cumsum(c, dtype=np.int64) - c)
            at += len(buf)
            word_at += len(stop)
        raw = b"".join(p[4] for p in parts)
        h, begin, end, head = (np.concatenate(x) for x in (hashes, begins, ends, heads))
        del parts, hashes, begins, ends
        order = np.lexsort((start, who))
        windows = (count[order] - k + 1).astype(np.int64)
        pos = concat_ranges(head[order], windows)
        # Hash of each window: spans of 1, 2, 4, ... words, joined to k.
        span, x, done, total = 1, h, 0, np.zeros(len(pos), dtype=np.uint64)
        rest = k
        while rest:
            if rest & 1:
                total = mix(total * U(0x9E3779B97F4A7C15) + x[pos + done])
                done += span
            rest >>= 1
            if rest:
                y = np.zeros_like(x)
                y[: len(x) - span] = x[: len(x) - span] * U(0xD6E8FEB86659FD93) + x[span:]
                x, span = mix(y), 2 * span
        del x
        rank = np.argsort(total, kind="stable")
        same = np.zeros(len(rank), dtype=bool)
        same[1:] = total[rank][1:] == total[rank][:-1]
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(rank))))
        a, b = pos[rank[same]], pos[rank[lead[same]]]
        equal = [raw[i:j] == raw[p:q] for i, j, p, q in zip(begin[a].tolist(), end[a + k - 1].tolist(), begin[b].tolist(), end[b + k - 1].tolist(), strict=True)]
        hit = np.zeros(len(rank), dtype=bool)
        hit[rank[same]] = equal
        if not all(equal):  # windows of one hash with different words: tell them apart by their words
            for at in np.unique(lead[same]).tolist():
                seen, i = set(), at
                while i == at or (i < len(rank) and same[i]):
                    words = raw[begin[pos[rank[i]]] : end[pos[rank[i]] + k - 1]]
                    hit[rank[i]] = words in seen
                    seen.add(words)
                    i += 1
        doc, at = np.repeat(who[order], windows), concat_ranges(start[order].astype(np.int64), windows)
        a, b = rank[same], rank[lead[same]]
        hit[a] &= (doc[a] != doc[b]) | (at[a] != at[b])  # a repeated row starts no later
        doc, at = doc[hit], at[hit]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(doc)) - 1 if len(i) else i
        return pa.table({"doc_id": np.concatenate([doc[i], known[:, 0]]), "a": np.concatenate([at[i], known[:, 1]]), "b": np.concatenate([at[j] + k, known[:, 2]])})

    return run


def repeated_ranges(docs: DataFrame, k: int = WINDOW_WORDS, m: int = MINIMISER_WORDS, hot_share: float = HOT_SHARE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, a, b): words a to b - 1 of the document are covered by windows that also start earlier.

    Ranges may overlap. ``docs`` needs doc_id (unique, not null) and text.
    """
    hot, _, size = common_groups(docs, m, hot_share)
    buckets = max(1, -(-3 * size // bucket_bytes))
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(_splitter(k, m, hot, buckets), "bucket int, packed binary")
    return packed.groupBy("bucket").applyInArrow(_repeats(k), "doc_id long, a long, b long")


def _without(text: bytes, cut: list[dict] | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the words kept joined by one space."""
    words = text.split()
    total = len(words)
    if cut:
        away = np.zeros(total + 1, dtype=np.int32)
        np.add.at(away, [c["a"] for c in cut], 1)
        np.add.at(away, [c["b"] for c in cut], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(away[:-1]) == 0).tolist()]
    return total, total - len(words), b" ".join(words)


def _cleaner(ranges: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            cut = batch.column(batch.schema.get_field_index(ranges)).to_pylist()
            n, gone, out = zip(*map(_without, texts, cut), strict=True)
            cols = {"doc_id": batch.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            cols |= {"kept": pa.array(out, pa.binary()).cast(pa.string())} if with_text else {"kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _replacer(ranges: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            cut = batch.column(batch.schema.get_field_index(ranges)).to_pylist()
            at = batch.schema.get_field_index("text")
            old = batch.column(at)
            new = [_without(t, c)[2].decode() if c else o for t, c, o in zip(texts, cut, old.to_pylist(), strict=True)]
            keep = [i for i, name in enumerate(batch.schema.names) if name != ranges]
            yield pa.RecordBatch.from_arrays([pa.array(new, old.type) if i == at else batch.column(i) for i in keep], [batch.schema.names[i] for i in keep])

    return run


def remove_repeats(docs: DataFrame, k: int = WINDOW_WORDS, **options) -> DataFrame:
    """``docs`` with repeated windows cut out of text; texts without any stay byte for byte.

    As ``substring_dedup``, but all columns stay and rows without doc_id pass unchanged.
    """
    name, key = fresh("ranges", docs), fresh("ranges_id", docs)
    ranges = repeated_ranges(docs, k, **options).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("a", "b")).alias(name))
    joined = docs.join(ranges, docs["doc_id"] == ranges[key], "left").drop(key)
    return joined.mapInArrow(_replacer(name), docs.schema)


def substring_dedup(docs: DataFrame, k: int = WINDOW_WORDS, with_text: bool = True, **options) -> DataFrame:
    """Remove every word covered by a ``k``-word window that also starts earlier.

    Earlier means in a document of smaller doc_id, or before it in the same
    document; windows are judged on the input. Returns doc_id, n_words,
    n_removed and the kept words joined by one space (``kept``), or their
    SHA-256 (``kept_sha256``) without ``with_text``.

    Null text: no words. Texts of fewer than ``k`` words: nothing removed.
    Copies: the one of smaller doc_id stays. Rows repeated with their doc_id:
    neither starts earlier, each is treated alike. Rows without doc_id are left
    out. Very long texts are read whole. Empty table: no rows. Other columns
    are ignored.
    """
    ranges = repeated_ranges(docs, k, **options).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").join(ranges, "doc_id", "left")
    return joined.mapInArrow(_cleaner("ranges", with_text), "doc_id long, n_words long, n_removed long, " + ("kept string" if with_text else "kept_sha256 string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


#: Numbers every word, takes the windows whose word sequence has been seen before, and joins what they don't cover.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, unnest(range(0, len(words))) AS pos, unnest(words) AS word FROM d),
spread AS (SELECT doc_id, unnest(range(0, len(words) - 19)) AS pos, words FROM d WHERE len(words) >= 20),
windows AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos + 1, pos + 20), ' ') AS run FROM spread),
seen AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS place FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM seen WHERE place > 1),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(cut.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
