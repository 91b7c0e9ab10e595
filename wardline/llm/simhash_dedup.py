"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints within ``MAX_BITS`` bits agree on at least one of
``MAX_BITS + 1`` bit ranges, so the top level of the index is the pair (bit
range, value): it deals the distinct fingerprints to buckets. Inside a bucket
fingerprints are sorted by Gray rank, neighbours form nodes of ``FANOUT``, and
a node holds the bits all its members share as (mask, pattern). A fingerprint
goes down from the root adding up its differences on newly shared bits; a node
with more than ``MAX_BITS`` is pruned with all below it, and a node whose
members can't differ in more is taken whole, so dense groups cost no pairs.
A bucket returns a spanning forest of its links, never all pairs.

A (bit range, value) held by more than ``HOT_KEY`` fingerprints is split again
until none is: the bits outside the range fall into ``MAX_BITS + 1`` ranges of
which again one must agree, and so on with the bits that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import U, bounded, checkpointed, concat_ranges, slices
from wardline.llm.components import components
from wardline.session import spread, table

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
FANOUT = 8
HOT_KEY = 20_000
#: Fingerprints dealt to one task's group; a group holds many (bit range, value) pairs.
GROUP_ROWS = 40_000
#: Fingerprints searched at a time inside a group.
PROBES = 4096


def simhash(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the lower-cased ``words``-word shingles of a text, repeats included; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    plain = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(plain, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(plain[a:b], seed) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # few at a time: 64 bytes for each
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprinter(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = np.array([simhash(t, words, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(found.view(np.int64))})

    return run


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's 64 bits as a long."""
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(_fingerprinter(words, seed), "doc_id long, fp long")


def _split(rows: DataFrame, most: int) -> DataFrame:
    """Deal rows (fp, rep, key, rest, left) on to ``most + 1`` ranges of the ``left`` bits in ``rest``, the wider ranges first.

    The key of a row takes in the range and its value, whose bits leave ``rest``.
    """
    n = most + 1
    dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(most))))
    dealt = dealt.withColumn("width", F.expr(f"left div {n} + int(part < left % {n})").cast("int")).withColumn("first", F.expr(f"part * (left div {n}) + least(part, left % {n})").cast("int"))
    value = F.expr("CASE WHEN width < 64 THEN shiftrightunsigned(rest, first) & (shiftleft(1L, width) - 1) ELSE rest END")
    above = F.expr("CASE WHEN first + width < 64 THEN shiftleft(shiftrightunsigned(rest, first + width), first) ELSE 0L END")
    rest = above.bitwiseOR(F.expr("rest & (shiftleft(1L, first) - 1)"))
    return dealt.select("fp", "rep", F.xxhash64("key", "part", value).alias("key"), rest.alias("rest"), (F.col("left") - F.col("width")).alias("left"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n, over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return root
        root = new


def gray_links(fp: np.ndarray, group: np.ndarray, most: int, fanout: int = FANOUT, probes: int = PROBES) -> np.ndarray:
    """For each fingerprint the index of a fingerprint of its group that stands for all it is linked with.

    ``group`` is non-decreasing. Fingerprints within ``most`` bits in one group
    get one representative, as do chains of them.
    """
    order = np.lexsort((gray_rank(fp), group))
    x, g = fp[order], group[order]
    heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    sizes = np.diff(np.append(heads, len(x)))
    # Levels from the fingerprints up to one root a group: first child, number of children, shared bits.
    levels, first_leaf = [], np.arange(len(x))
    low, high, at, n = x, x, heads, sizes
    while (n > 1).any() or not levels:
        up = -(-n // fanout)
        first = concat_ranges(np.zeros(len(n), dtype=np.int64), up) * fanout + np.repeat(at, up)
        count = np.minimum(np.repeat(at + n, up) - first, fanout)
        low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
        first_leaf = first_leaf[first]
        levels.append((first, count, ~(low ^ high), low, first_leaf))
        n, at = up, np.cumsum(up) - up
    links_a, links_b = [], []
    # A node whose members can't differ in more bits than allowed is one linked set: its children link to it.
    below = np.arange(len(x))
    for first, count, mask, _, leaf in levels:
        tight = np.flatnonzero((np.bitwise_count(~mask) <= most) & (count > 1))
        links_a.append(below[concat_ranges(first[tight], count[tight])])
        links_b.append(np.repeat(leaf[tight], count[tight]))
        below = leaf
    root_of = np.repeat(np.arange(len(sizes)), sizes)
    last_leaf = [np.append(lv[4][1:], len(x)) - 1 for lv in levels]
    for k in range(0, len(x), probes):
        q = np.arange(k, min(k + probes, len(x)))
        node, known, acc = root_of[q], np.zeros(len(q), dtype=np.uint64), np.zeros(len(q), dtype=np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            first, count, mask, pattern, leaf = levels[depth]
            shared = mask[node]
            acc = acc + np.bitwise_count((x[q] ^ pattern[node]) & shared & ~known)
            stay = (acc <= most) & (last_leaf[depth][node] > q)
            q, node, acc, shared = q[stay], node[stay], acc[stay], shared[stay]
            whole = acc + np.bitwise_count(~shared) <= most
            links_a.append(q[whole])
            links_b.append(leaf[node[whole]])
            q, node, acc, known = q[~whole], node[~whole], acc[~whole], shared[~whole]
            times = count[node]
            q, acc, known, node = np.repeat(q, times), np.repeat(acc, times), np.repeat(known, times), concat_ranges(first[node], times)
        near = (node > q) & (np.bitwise_count(x[q] ^ x[node]) <= most)
        links_a.append(q[near])
        links_b.append(node[near])
    root = _roots(len(x), np.concatenate(links_a), np.concatenate(links_b))
    out = np.empty(len(x), dtype=np.int64)
    out[order] = order[root]
    return out


def _search(most: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("fp", "ascending")])
        key = t.column("key").to_numpy()
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        rep = t.column("rep").to_numpy()
        other = rep[gray_links(t.column("fp").to_numpy().view(np.uint64), group, most)]
        far = rep != other
        return pa.table({"a": rep[far], "b": other[far]})

    return run


def near_links(distinct: DataFrame, most: int = MAX_BITS, hot_key: int = HOT_KEY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that join the ``rep`` values of all ``distinct`` (fp, rep) within ``most`` bits into their components."""
    rows = _split(distinct.select("fp", "rep", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), F.lit(64).alias("left")), most)
    done, total = [], distinct.count() * (most + 1)
    while True:
        # Hot keys are at most one in hot_key rows; fewer bits than ranges can't part a key further (2 ** most rows at most).
        hot = checkpointed(rows.filter(F.col("left") > most).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_key))
        again = hot.agg(F.sum("n")).first()[0]
        if not again:
            break
        marked = rows.join(hot, "key", "left")
        done.append(marked.filter("n IS NULL").select("fp", "key", "rep"))
        rows = checkpointed(_split(marked.filter("n IS NOT NULL"), most))
        total += again * most
    keyed = rows.select("fp", "key", "rep")
    for part in done:
        keyed = keyed.unionByName(part)
    groups = max(1, -(-total // group_rows))
    return keyed.withColumn("g", F.pmod("key", F.lit(groups))).groupBy("g").applyInArrow(_search(most), "a long, b long")


def simhash_dedup(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED, most: int = MAX_BITS, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D.
    A bit of the fingerprint is 1 if set in over half of the shingles' XXH64.
    Documents are linked at ``most`` or fewer differing bits.

    Null and empty texts: fingerprint zero, linked like any other. Fewer than
    ``words`` words: the whole sequence is the one shingle. A bit set in just
    half of the shingles is 0. Very long texts are read whole. Repeated rows:
    one component. Rows without doc_id are left out. Empty table: no rows.
    Other columns are ignored.
    """
    prints = checkpointed(fingerprints(docs, words, seed))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(near_links(distinct, most, **options))
    named = distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(spread(table(spark, sf_dir, "documents")))
