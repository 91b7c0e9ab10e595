"""Embedding near-dedup by NN-descent.

Copies first become classes (label, vector) with a weight. A neighbour graph
of ``NEIGHBOURS`` entries a vector starts from blocks of a few random
hyperplane orders and is refined by neighbours-of-neighbours joins: the
members around a vector are compared with each other, and pairs that beat a
member's worst neighbour enter its list. Lists work on 8-bit vectors; every
link is then confirmed by the cosine in double precision.

A list whose entries are all above the threshold is saturated: its vector may
have more links than the list holds, to its own component or to another. All
members of such components are cut into pages of ``PAGE_ROWS`` and compared
with those of all such components of the label, which joins components that
the lists kept apart. Two pages are linked or not linked as a whole where
their centres and radii decide that; the vectors of the rest are compared.
Links between members of such components are exact; others have room in a
list and are found as far as the descent goes.

Each attempt is audited: the true links of a bounded sample, by brute force
against all rows, are looked up among the links found. The sample grows until
it has ``AUDIT_LINKS`` true links or holds all rows; where links are so rare
that ``AUDIT_MOST`` rows have fewer, the recall is not known and counts as
missed. Below ``TARGET_RECALL`` the descent goes on from further orders; after
the last attempt, or at once if the recall can't be known, all rows of each
label are paged and compared, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.common import checkpointed
from wardline.llm.components import components
from wardline.llm.vectors import from_rows, matrices, to_rows
from wardline.session import table

THRESHOLD = 0.93
#: Room for the error of 8-bit vectors.
MARGIN = 0.03
NEIGHBOURS = 12
ORDERS = 8
ORDER_BITS = 24
BLOCK_ROWS = 128
#: Neighbours a comparison hands on for each vector, besides close ones, of which it hands on a whole list.
PER_BLOCK = 4
PAGE_ROWS = 256
#: Pages whose centres are compared at once.
BLOCK_PAGES = 512
ROUNDS = 6
#: Rows whose true links an audit looks up, first and at most, and how many links tell something.
AUDIT_ROWS, AUDIT_MOST, AUDIT_LINKS = 512, 8192, 300
TARGET_RECALL = 0.995
EXTRA_ROUNDS = 3


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, label, weight, embedding) to (id, grp, weight, x, q); vectors of length zero are left out."""
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for rows, x in matrices(batch.column(3)):
            top = np.abs(x).max(axis=1)
            rows, x, top = rows[top > 0], x[top > 0], top[top > 0]
            if not len(rows):
                continue
            x = x / top[:, None]
            x = x / np.linalg.norm(x, axis=1)[:, None]
            q = np.rint(127 * x / np.abs(x).max(axis=1)[:, None]).astype(np.int8)
            at = pa.array(rows)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(at), "grp": pa.array([f"{x.shape[1]}:{labels[r]}" for r in rows]), "weight": batch.column(2).take(at), "x": to_rows(x), "q": to_rows(q)})


def _unit(q: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = from_rows(q, np.int8).astype(np.float32)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _by_length(q: pa.ChunkedArray) -> list[np.ndarray]:
    lens = np.fromiter((len(v.as_py()) for v in q), dtype=np.int64, count=len(q))
    return [np.flatnonzero(lens == n) for n in np.unique(lens)]


def _orders(first: int, count: int, bits: int):
    """Rows keyed by the signs of ``bits`` random projections, for each of ``count`` orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_length(batch.column(2)):
                part = batch.take(pa.array(rows))
                x = _unit(part.column(2))
                for t in range(first, first + count):
                    planes = np.random.default_rng(t).standard_normal((x.shape[1], bits)).astype(np.float32)
                    code = ((x @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(len(x), t, dtype=np.int32)), "grp": part.column(1), "code": pa.array(code), "id": part.column(0), "q": part.column(2)})

    return run


def _best(sims: np.ndarray, keep: int, most: int, close: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of the ``most`` highest values along the last axis, best first, and which count: the first ``keep`` and all from ``close`` on."""
    most = min(most, sims.shape[-1])
    col = np.argpartition(-sims, most - 1, axis=-1)[..., :most]
    s = np.take_along_axis(sims, col, axis=-1)
    order = np.argsort(-s, axis=-1)
    col, s = np.take_along_axis(col, order, axis=-1), np.take_along_axis(s, order, axis=-1)
    return col, s, ((np.arange(most) < keep) | (s >= close)) & (s > -2)


def _first_links(rows: int, keep: int, most: int, close: float):
    """Runs of one order to edges (u, v, s) of the nearest in overlapping blocks."""

    def edges(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        us, vs, ss = [], [], []
        for a in range(0, max(1, len(ids) - rows // 2), rows // 2):
            i, y = ids[a : a + rows], x[a : a + rows]
            if len(i) < 2:
                continue
            sims = y @ y.T
            np.fill_diagonal(sims, -2)
            col, s, fine = _best(sims, keep, most, close)
            us.append(np.repeat(i, fine.sum(axis=1)))
            vs.append(i[col[fine]])
            ss.append(s[fine])
        cat = lambda p, kind: np.concatenate(p) if p else np.empty(0, dtype=kind)
        return pa.RecordBatch.from_pydict({"u": pa.array(cat(us, np.int64)), "v": pa.array(cat(vs, np.int64)), "s": pa.array(cat(ss, np.float32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, xs = None, [], []
        for batch in batches:
            tree, grp = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (grp[1:] != grp[:-1])) + 1
            for part in np.split(np.arange(len(tree)), cuts):
                if not len(part):
                    continue
                now = (tree[part[0]], grp[part[0]])
                if now != key and ids:
                    yield edges(np.concatenate(ids), np.concatenate(xs))
                    ids, xs = [], []
                key = now
                ids.append(batch.column(3).to_numpy()[part])
                xs.append(_unit(batch.column(4).slice(part[0], len(part))))
                if sum(map(len, ids)) > 16 * rows:
                    yield edges(np.concatenate(ids), np.concatenate(xs))
                    ids, xs = [np.concatenate(ids)[-rows // 2 :]], [np.concatenate(xs)[-rows // 2 :]]
        if ids:
            yield edges(np.concatenate(ids), np.concatenate(xs))

    return run


def _around(keep: int, most: int, close: float):
    """Members (centre, u, worst, q) of some centres to better edges between members of one centre."""

    def run(t: pa.Table) -> pa.Table:
        us, vs, ss = [], [], []
        for rows in _by_length(t.column("q")):
            part = t.take(pa.array(rows)).sort_by([("centre", "ascending"), ("u", "ascending")])
            centre, u, worst = part.column("centre").to_numpy(), part.column("u").to_numpy(), part.column("worst").to_numpy()
            x = _unit(part.column("q"))
            heads = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))
            sizes = np.diff(np.append(heads, len(centre)))
            for size in np.unique(sizes[sizes > 1]).tolist():
                all_at = heads[sizes == size][:, None] + np.arange(size)
                for i in range(0, len(all_at), 512):
                    at = all_at[i : i + 512]
                    sims = np.einsum("cid,cjd->cij", x[at], x[at], optimize=True)
                    sims[:, np.arange(size), np.arange(size)] = -2
                    col, s, fine = _best(sims, keep, most, close)
                    fine &= s > worst[at][:, :, None]
                    us.append(np.broadcast_to(u[at][:, :, None], col.shape)[fine])
                    vs.append(np.take_along_axis(np.broadcast_to(u[at][:, None, :], sims.shape), col, axis=2)[fine])
                    ss.append(s[fine])
        cat = lambda p, kind: np.concatenate(p) if p else np.empty(0, dtype=kind)
        found = pa.table({"u": cat(us, np.int64), "v": cat(vs, np.int64), "s": cat(ss, np.float32)})
        return found.group_by(["u", "v"]).aggregate([("s", "max")]).rename_columns(["u", "v", "s"])

    return run


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each u."""
    order = Window.partitionBy("u").orderBy(F.desc("s"), F.asc("v"))
    return edges.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("u", "v", "s")


def _start(rows: DataFrame, first: int, count: int, k: int, close: float) -> DataFrame:
    keyed = rows.select("id", "grp", "q").mapInArrow(_orders(first, count, ORDER_BITS), "tree int, grp string, code long, id long, q binary")
    sorted_rows = keyed.repartitionByRange("tree", "grp", "code", "id").sortWithinPartitions("tree", "grp", "code", "id")
    return sorted_rows.mapInArrow(_first_links(BLOCK_ROWS, PER_BLOCK, k, close), "u long, v long, s float")


def _descend(rows: DataFrame, graph: DataFrame, n: int, k: int, close: float, rounds: int) -> DataFrame:
    """Refine ``graph`` until a round finds hardly any new close pair."""
    links = graph.filter(F.col("s") >= close).count()
    for _ in range(rounds):
        back = graph.select(F.col("v").alias("centre"), F.col("u").alias("member"))
        # Of those that point at a vector, k random ones take part in a round; the others take part through their own lists, and the audit tells if that is too little.
        some = Window.partitionBy("centre").orderBy(F.xxhash64("member", "centre"))
        back = back.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= k).drop("r")
        members = graph.select(F.col("u").alias("centre"), F.col("v").alias("member")).union(back).union(rows.select(F.col("id").alias("centre"), F.col("id").alias("member"))).distinct()
        worst = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-1.0)).cast("float").alias("worst"))
        held = rows.select("id", "q").join(worst, rows.id == worst.u, "left").select(F.col("id").alias("u"), "q", F.coalesce("worst", F.lit(-1.0)).cast("float").alias("worst"))
        dealt = members.join(held, members.member == held.u).select("centre", "u", "worst", "q", F.pmod(F.xxhash64("centre"), F.lit(max(1, n // 2000))).alias("bucket"))
        better = dealt.groupBy("bucket").applyInArrow(_around(PER_BLOCK, k, close), "u long, v long, s float")
        graph = checkpointed(_top(graph.union(better), k))
        now = graph.filter(F.col("s") >= close).count()
        if now <= links * 1.002 + 1:
            break
        links = now
    return graph


def _confirm(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_length(batch.column(2)):
                part = batch.take(pa.array(rows))
                fine = (from_rows(part.column(2)) * from_rows(part.column(3))).sum(axis=1) >= threshold
                yield part.filter(pa.array(fine)).select(["u", "v"])

    return run


def _page(t: pa.Table) -> pa.Table:
    x = from_rows(t.column("x"))
    centre = x.mean(axis=0)
    size = np.linalg.norm(centre)
    centre = centre / size if size > 1e-9 else x[0]
    weights = t.column("weight").to_numpy()
    return pa.table({"grp": t.column("grp").slice(0, 1), "root": t.column("root").slice(0, 1), "page": t.column("page").slice(0, 1), "dim": pa.array([x.shape[1]], pa.int32()), "radius": pa.array([float(np.arccos(np.clip(x @ centre, -1, 1)).max())]), "centre": to_rows(centre[None]), "total": pa.array([int(weights.sum())], pa.int64()), "ids": pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), "weights": pa.array([weights.tobytes()], pa.binary()), "xs": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())})


def _block(t: pa.Table) -> pa.Table:
    joined = lambda c: pa.array([b"".join(t.column(c).to_pylist())], pa.binary())
    packed = lambda c: pa.array([t.column(c).to_numpy().tobytes()], pa.binary())
    return pa.table({"grp": t.column("grp").slice(0, 1), "block": t.column("block").slice(0, 1), "pages": packed("pid"), "radii": packed("radius"), "centres": joined("centre")})


def _page_pairs(threshold: float):
    """Pairs of blocks to pairs of pages (a <= b) that can hold a link, and whether all their vectors are linked."""
    limit = float(np.arccos(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pa_, pb = (np.frombuffer(r[c], dtype=np.int64) for c in ("pages", "pages_b"))
                ra, rb = (np.frombuffer(r[c]) for c in ("radii", "radii_b"))
                ca, cb = (np.frombuffer(r[c]).reshape(n, -1) for c, n in (("centres", len(pa_)), ("centres_b", len(pb))))
                apart, reach = np.arccos(np.clip(ca @ cb.T, -1, 1)), ra[:, None] + rb
                near = apart - reach <= limit + 1e-6
                if r["block"] == r["block_b"]:
                    near &= pa_[:, None] <= pb
                i, j = np.nonzero(near)
                yield pa.RecordBatch.from_pydict({"a": pa.array(pa_[i]), "b": pa.array(pb[j]), "whole": pa.array((apart + reach < limit - 1e-6)[i, j])})

    return run


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y are linked; what a matrix product leaves in doubt is summed as ``_confirm`` does."""
    sims = x @ y.T
    i, j = np.nonzero(np.abs(sims - threshold) < 1e-9)
    sims[i, j] = (x[i] * y[j]).sum(axis=1)
    return sims >= threshold


def _page_links(threshold: float):
    """Pairs of pages to (id, links), the weight of all in the other page that an id is linked with, and one (root, root_b) if any is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (np.frombuffer(r[c]).reshape(-1, r["dim"]) for c in ("xs", "xs_b"))
                fine = _linked(x, y, threshold)
                if not fine.any():
                    continue
                ids, weights, ids_b, weights_b = (np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "weights", "ids_b", "weights_b"))
                links = fine @ weights_b
                if r["a"] != r["b"]:
                    ids, links = np.concatenate([ids, ids_b]), np.concatenate([links, weights @ fine])
                n = len(ids)
                root, root_b = np.full(n, r["root"]), np.full(n, r["root_b"])
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "links": pa.array(links.astype(np.int64)), "root": pa.array(root), "root_b": pa.array(root_b)})

    return run


def _paged(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Exact links among ``members`` (root, id, grp, weight, x): (id, links), each with its own weight in it, and links (a, b) between roots."""
    sized = members.groupBy("grp", "root").agg(F.ceil(F.count("*") / PAGE_ROWS).alias("pages"))
    dealt = members.join(sized, ["grp", "root"]).withColumn("page", F.pmod(F.xxhash64("id"), F.col("pages")))
    # A page is named by its smallest id.
    names = dealt.groupBy("grp", "root", "page").agg(F.min("id").alias("pid"))
    pages = dealt.groupBy("grp", "root", "page").applyInArrow(_page, "grp string, root long, page long, dim int, radius double, centre binary, total long, ids binary, weights binary, xs binary")
    pages = checkpointed(pages.join(names, ["grp", "root", "page"]))
    counted = pages.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_PAGES).alias("blocks"))
    heads = pages.select("grp", "pid", "radius", "centre").join(counted, "grp").withColumn("block", F.pmod(F.xxhash64("pid", F.lit("block")), F.col("blocks")))
    blocks = checkpointed(heads.groupBy("grp", "block").applyInArrow(_block, "grp string, block long, pages binary, radii binary, centres binary"))
    other = blocks.select("grp", *[F.col(c).alias(f"{c}_b") for c in ("block", "pages", "radii", "centres")])
    # Pairs of numbers are dealt first; the blocks of a label then come to them, wherever they are.
    numbers = counted.select("grp", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).repartition("grp", "block")
    dealt_pairs = numbers.select("grp", "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block_b")).repartition("grp", "block", "block_b")
    met = dealt_pairs.join(blocks, ["grp", "block"]).join(other, ["grp", "block_b"])
    pairs = checkpointed(met.select("block", "pages", "radii", "centres", "block_b", "pages_b", "radii_b", "centres_b").mapInArrow(_page_pairs(threshold), "a long, b long, whole boolean"))
    left = pages.select(F.col("pid").alias("a"), "dim", "root", "ids", "weights", "xs")
    right = pages.select(F.col("pid").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("root", "ids", "weights", "xs")])
    open_links = checkpointed(pairs.filter("not whole").join(left, "a").join(right, "b").mapInArrow(_page_links(threshold), "id long, links long, root long, root_b long"))
    whole = pairs.filter("whole")
    ways = whole.select("a", "b").union(whole.filter("a != b").select("b", "a"))
    totals = pages.select(F.col("pid").alias("b"), F.col("root").alias("root_b"), "total")
    all_of = checkpointed(ways.join(totals, "b").join(pages.select(F.col("pid").alias("a"), "root"), "a").groupBy("a", "root", "root_b").agg(F.sum("total").alias("links")))
    placed = dealt.select("grp", "root", "page", "id").join(names, ["grp", "root", "page"]).select("id", F.col("pid").alias("a"))
    of_pages = placed.join(all_of.groupBy("a").agg(F.sum("links").alias("links")), "a").select("id", "links")
    counts = open_links.select("id", "links").union(of_pages).groupBy("id").agg(F.sum("links").alias("links"))
    across = open_links.select("root", "root_b").union(all_of.select("root", "root_b")).filter("root != root_b").select(F.col("root").alias("a"), F.col("root_b").alias("b")).distinct()
    return counts, across


def _audit(sample: dict[str, tuple[np.ndarray, np.ndarray]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = batch.column(1).to_numpy(zero_copy_only=False)
            for g in set(grp) & set(sample):
                part = batch.filter(pa.array(grp == g))
                ids, x = sample[g]
                other = part.column(0).to_numpy()
                a, b = np.nonzero(x @ from_rows(part.column(2)).T >= threshold)
                fine = ids[a] != other[b]
                yield pa.RecordBatch.from_pydict({"u": pa.array(ids[a[fine]]), "v": pa.array(other[b[fine]])})

    return run


def audit_recall(rows: DataFrame, links: DataFrame, paged: DataFrame, threshold: float, size: int = AUDIT_ROWS, most: int = AUDIT_MOST, enough: int = AUDIT_LINKS) -> float | None:
    """Share of the true links of a bounded sample that were found: in ``links`` (u < v), or between two of ``paged`` (node), which are all compared.

    Brute force against all rows. The sample grows fourfold from ``size`` until
    it has ``enough`` true links or is all rows (then the share is that of all
    links, 1 without any). With fewer than ``enough`` of ``most`` rows: None.
    """
    n = rows.count()
    while True:
        true, hit = _audited(rows, links, paged, threshold, size)
        if true >= enough or size >= n:
            return hit / true if true else 1.0
        if size >= most:
            return None
        size *= 4


def _audited(rows: DataFrame, links: DataFrame, paged: DataFrame, threshold: float, size: int) -> tuple[int, int]:
    some = rows.select("id", "grp", "x", F.xxhash64("id", F.lit("audit")).alias("h")).orderBy("h", "id").limit(size).collect()
    sample: dict[str, list] = {}
    for r in some:
        sample.setdefault(r.grp, []).append((r.id, np.frombuffer(r.x)))
    packed = {g: (np.array([i for i, _ in v]), np.stack([x for _, x in v])) for g, v in sample.items()}
    true = rows.select("id", "grp", "x").mapInArrow(_audit(packed, threshold), "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    found = links.select("u", "v", F.lit(True).alias("linked"))
    a, b = (paged.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_paged")) for c in ("u", "v"))
    hit = F.col("linked").isNotNull() | (F.col("u_paged").isNotNull() & F.col("v_paged").isNotNull())
    got = true.join(found, ["u", "v"], "left").join(a, "u", "left").join(b, "v", "left").agg(F.count("*").alias("n"), F.count_if(hit).alias("hit")).first()
    return got.n, got.hit


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, orders: int = ORDERS, rounds: int = ROUNDS, target_recall: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept for each vector of (vec_id, embedding, label).

    Vectors of equal, non-null label are linked at cosine >= ``threshold``.
    Null and zero vectors and those with null or non-finite components link
    with nothing, nor do vectors of different lengths. Copies are linked like
    others (weights stand for them). Rows repeated with their vec_id count
    once (the smallest label and vector, if they differ). Rows without vec_id
    are left out. Empty table: no rows. Other columns are ignored.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter("vec_id is not null")
    base = base.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", F.col("row.label").cast("string").alias("label"), "row.embedding")
    classes = checkpointed(base.filter("label is not null and embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    rows = checkpointed(classes.select("rep", "label", "weight", "embedding").mapInArrow(_parse, "id long, grp string, weight long, x binary, q binary"))
    n = rows.count()
    close = threshold - MARGIN
    graph, first = None, 0
    for attempt in range(EXTRA_ROUNDS + 1):
        start = _start(rows, first, orders, neighbours, close)
        first += orders
        graph = checkpointed(_top(start if graph is None else graph.union(start), neighbours))
        graph = _descend(rows, graph, n, neighbours, close, rounds)
        pairs = graph.filter(F.col("s") >= close).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        left, right = rows.select(F.col("id").alias("u"), F.col("x").alias("xu")), rows.select(F.col("id").alias("v"), F.col("x").alias("xv"))
        links = checkpointed(pairs.join(left, "u").join(right, "v").select("u", "v", "xu", "xv").mapInArrow(_confirm(threshold), "u long, v long"))
        roots = checkpointed(components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))))
        # Components with a saturated list get all their links from pages, the others have theirs in the graph.
        full = graph.filter(F.col("s") >= close).groupBy("u").count().filter(F.col("count") >= neighbours).select(F.col("u").alias("node"))
        full_roots = full.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct()
        placed = rows.select("id", "grp", "weight", "x").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        members = checkpointed(placed.join(full_roots, "root", "left_semi"))
        recall = audit_recall(rows, links, members.select(F.col("id").alias("node")), threshold)
        if recall is not None and recall >= target_recall:
            break
        if recall is None or attempt == EXTRA_ROUNDS:
            members = checkpointed(placed)  # the graph misses too much, or nobody knows: all rows of a label are compared
            break
    dense_links, across = _paged(members, threshold)
    merged = components(across).select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    roots = placed.select(F.col("id").alias("node"), "root").join(merged, "root", "left").select("node", F.coalesce("new_root", "root").alias("root"))
    weights = rows.select(F.col("id").alias("v"), F.col("weight"))
    both = links.union(links.select("v", "u"))
    few_links = both.join(weights, "v").groupBy(F.col("u").alias("id")).agg(F.sum("weight").alias("links"))
    counted = rows.select("id", "weight").join(few_links, "id", "left").join(dense_links.withColumnRenamed("links", "all_links"), "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    counted = counted.select("id", F.coalesce("root", "id").alias("root"), F.coalesce(F.col("all_links") - 1, F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    named = classes.select("label", "embedding", "rep").join(counted, F.col("rep") == F.col("id")).select("label", "embedding", "root", "links")
    return base.join(named, ["label", "embedding"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), (F.coalesce("root", "vec_id") == F.col("vec_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
