"""Exact top-k inner-product search with paged M-trees.

Inner products become distances: with M the largest norm, x' = (x, sqrt(M^2 -
|x|^2)) and q' = (q, 0) have |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest
x' have the highest products and the triangle inequality holds.

Rows go to their nearest of at most ``MAX_PIVOTS`` pivots (a bounded,
documented sample; every row is indexed). A pivot with many rows is salted
into parts of about ``PART_ROWS``; every part is bulk-loaded into an M-tree of
pages and kept as one row. Queries travel in blocks of ``BLOCK``: first to one
part of their own pivot, which gives a k-th score, then to the parts whose
covering radius that score can't rule out. In a tree each query goes best
first; stored distances to the parent skip children and rows before their own
distance is computed. Blocks and trees meet in a sort-merge join on the part,
one block at a time, so memory does not grow with either table.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.common import checkpointed
from wardline.llm.vectors import from_rows, matrices, to_rows
from wardline.session import table

K = 10
SCALE = 1024.0
QUERY_STEP = 100
MAX_PIVOTS = 1024
PART_ROWS = 4096
PAGE = 64
BLOCK = 256
_LONG = 2**63 - 1


def _parse(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column(1)):
                v = np.floor(scale * x)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0).take(pa.array(rows)), "dim": pa.array(np.full(len(rows), x.shape[1], dtype=np.int32)), "v": to_rows(v), "sq": pa.array((v * v).sum(axis=1))})

    return run


def _lift(v: np.ndarray, square: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(square - (v * v).sum(axis=1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def _assign(pivots: dict[int, tuple[float, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                square, centres = pivots[dim]
                v = from_rows(part.column(2))
                at = _distances(_lift(v, square), centres).argmin(axis=1)
                far = np.linalg.norm(_lift(v, square) - centres[at], axis=1)
                yield pa.RecordBatch.from_pydict({"vec_id": part.column(0), "dim": part.column(1), "v": part.column(2), "pivot": pa.array(at.astype(np.int32)), "far": pa.array(far)})

    return run


class MTree:
    """A bulk-loaded M-tree: nodes with centre, covering radius and distance to the parent's centre; leaves are pages of rows."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, square: float, page: int = PAGE):
        self.square, self.nodes = square, []
        x = _lift(v, square)
        order: list[np.ndarray] = []
        self.root = self._build(x, np.arange(len(x)), x.mean(axis=0), 0.0, page, order)
        rows = np.concatenate(order)
        self.ids, self.v = ids[rows], v[rows]
        self.exact = v.shape[1] * float(np.abs(v).max(initial=0)) ** 2 < 2**52

    def _build(self, x, rows, centre, to_parent, page, order) -> int:
        far = np.linalg.norm(x[rows] - centre, axis=1)
        me = len(self.nodes)
        self.nodes.append(None)
        if len(rows) <= page:
            at = sum(map(len, order))
            order.append(rows)
            self.nodes[me] = (centre, far.max(), to_parent, None, (at, at + len(rows), far))
            return me
        ways = min(16, -(-len(rows) // page))
        seeds = x[rows[np.linspace(0, len(rows) - 1, ways).astype(int)]]
        side = _distances(x[rows], seeds).argmin(axis=1)
        if np.bincount(side, minlength=ways).max() > 0.9 * len(rows):  # equal or nearly equal rows: cut evenly
            side = np.arange(len(rows)) * ways // len(rows)
        parts = [rows[side == s] for s in range(ways)]
        parts = [p for p in parts if len(p)]
        centres = [x[p].mean(axis=0) for p in parts]
        kids = [self._build(x, p, c, float(np.linalg.norm(c - centre)), page, order) for p, c in zip(parts, centres, strict=True)]
        inner = (np.array(kids), np.array(centres), np.array([self.nodes[k][1] for k in kids]), np.array([self.nodes[k][2] for k in kids]))
        self.nodes[me] = (centre, far.max(), to_parent, inner, None)
        return me

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None) -> tuple[list[int], list[int]]:
        """Ids and scores of the k best rows that reach ``floor``, ties to the smaller id; ``own`` is left out."""
        lifted = np.append(q, 0.0)
        total = float(q @ q) + self.square
        slack = 1e-6 * (1 + np.sqrt(total))
        best: list[tuple[int, int]] = []  # (score, -id), worst first
        held: set[int] = set()
        reach = np.inf if floor is None else np.sqrt(max(total - 2 * floor, 0)) + slack
        exact = self.exact and len(q) * max(float(np.abs(self.v).max(initial=0)), float(np.abs(q).max(initial=0))) ** 2 < 2**52
        d = float(np.linalg.norm(lifted - self.nodes[self.root][0]))
        queue = [(max(0.0, d - self.nodes[self.root][1]), self.root, d)]
        while queue:
            low, at, d = heapq.heappop(queue)
            if low > reach:
                break
            _, _, _, inner, leaf = self.nodes[at]
            if inner is not None:
                kids, centres, radii, up = inner
                see = np.flatnonzero(np.abs(d - up) - radii <= reach)
                far = np.linalg.norm(centres[see] - lifted, axis=1)
                for kid, f, r in zip(kids[see].tolist(), far.tolist(), radii[see].tolist(), strict=True):
                    if f - r <= reach:
                        heapq.heappush(queue, (max(0.0, f - r), kid, f))
                continue
            a, b, to_centre = leaf
            see = a + np.flatnonzero(np.abs(d - to_centre) <= reach)
            if not len(see):
                continue
            if exact:
                scores = (self.v[see] @ q).astype(np.int64)
                if len(best) == k:
                    fine = scores >= best[0][0]
                    see, scores = see[fine], scores[fine]
                elif floor is not None:
                    fine = scores >= floor
                    see, scores = see[fine], scores[fine]
                scores = scores.tolist()
            else:
                w = [int(y) for y in q]
                scores = [max(-_LONG, min(_LONG, sum(int(y) * z for y, z in zip(row, w, strict=True)))) for row in self.v[see]]
            for i, s in zip(self.ids[see].tolist(), scores, strict=True):
                if i == own or (floor is not None and s < floor):
                    continue
                if i in held:  # a repeated id counts once, with its highest score
                    old = next(e for e in best if e[1] == -i)
                    if s > old[0]:
                        best[best.index(old)] = (s, -i)
                        heapq.heapify(best)
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                    held.add(i)
                elif (s, -i) > best[0]:
                    held.discard(-heapq.heapreplace(best, (s, -i))[1])
                    held.add(i)
            if len(best) == k:
                reach = min(reach, np.sqrt(max(total - 2 * best[0][0], 0)) + slack)
        best.sort(reverse=True)
        return [-i for _, i in best], [s for s, _ in best]


def _index(pivots: dict[int, tuple[float, np.ndarray]], page: int):
    def run(t: pa.Table) -> pa.Table:
        tree = MTree(t.column("vec_id").to_numpy(), from_rows(t.column("v")), pivots[t.column("dim")[0].as_py()][0], page)
        return pa.table({"part": t.column("part").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


def _part(dim: int, pivot: int, salt: int) -> str:
    return f"{dim}:{pivot}:{salt}"


def _blocks(pivots, spread, block: int, first: bool):
    """Queries to (part, packed block) rows: their own pivot's first part, or all others a k-th score can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                square, centres = pivots[dim]
                v, ids = from_rows(part.column(2)), part.column(0).to_numpy()
                far = _distances(np.hstack([v, np.zeros((len(v), 1))]), centres)
                home = far.argmin(axis=1)
                floors = [None] * len(ids) if first else part.column(3).to_pylist()
                names, packs = [], []
                order = np.argsort(home, kind="stable")
                total = (v * v).sum(axis=1) + square
                reach = np.array([np.inf if f is None else np.sqrt(max(t - 2 * f, 0)) + 1e-6 * (1 + np.sqrt(t)) for f, t in zip(floors, total.tolist(), strict=True)])
                for p, (count, radius) in spread[dim].items():
                    if first:
                        rows = order[home[order] == p]
                    else:
                        rows = order[far[order, p] - radius <= reach[order]]
                    for i in range(0, len(rows), block):
                        some = rows[i : i + block]
                        for salt in range(1 if first else count):
                            mine = some if first or salt else some[home[some] != p]  # their first part is done
                            if len(mine):
                                names.append(_part(dim, p, salt))
                                packs.append(pickle.dumps((ids[mine], v[mine], [floors[j] for j in mine])))
                if names:
                    yield pa.RecordBatch.from_pydict({"part": pa.array(names), "block": pa.array(packs, pa.binary())})

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            who, found, scores = [], [], []
            for part, block, packed in zip(*(batch.column(i) for i in range(3)), strict=True):
                if part != now:  # rows come by part
                    now, tree = part, pickle.loads(packed.as_py())
                ids, v, floors = pickle.loads(block.as_py())
                for own, q, floor in zip(ids.tolist(), v, floors, strict=True):
                    a, b = tree.search(q, own, k, floor)
                    who += [own] * len(a)
                    found += a
                    scores += b
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(who, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


def topk_search(vectors: DataFrame, is_query, k: int = K, scale: float = SCALE, max_pivots: int = MAX_PIVOTS, part_rows: int = PART_ROWS, page: int = PAGE, block: int = BLOCK) -> DataFrame:
    """The k rows of highest integer inner product for each row that ``is_query`` selects.

    ``vectors`` needs vec_id and embedding; components count as floor(scale *
    x). Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id; a query's own row is no candidate.

    Vectors that are null, empty or hold null or non-finite components, and
    rows without vec_id, take no part. Vectors of different lengths are not
    compared. Repeated rows count once. Scores beyond a long are held at its
    ends. Fewer than k candidates: all of them. Empty table: no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    parsed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("is_query")).filter("vec_id is not null")
    rows = parsed.select("vec_id", "embedding").mapInArrow(_parse(scale), "vec_id long, dim int, v binary, sq double")
    shapes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("sq").alias("square")).collect()
    pivots, spread = {}, {}
    for shape in shapes:
        take = max(1, min(max_pivots, -(-shape.n // part_rows)))
        some = rows.filter(F.col("dim") == shape.dim).select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(take).collect()
        pivots[shape.dim] = (shape.square, _lift(np.stack([np.frombuffer(r.v) for r in some]), shape.square))
    if not pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    assigned = rows.select("vec_id", "dim", "v").mapInArrow(_assign(pivots), "vec_id long, dim int, v binary, pivot int, far double")
    for r in assigned.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        spread.setdefault(r.dim, {})[r.pivot] = (-(-r.n // part_rows), r.far)
    salts = F.create_map(*[F.lit(x) for d, ps in spread.items() for p, (n, _) in ps.items() for x in (f"{d}:{p}", n)])
    key = F.concat_ws(":", "dim", "pivot")
    index = checkpointed(assigned.withColumn("part", F.concat_ws(":", key, F.pmod(F.xxhash64("vec_id"), salts[key]))).groupBy("part").applyInArrow(_index(pivots, page), "part string, tree binary"))
    queries = checkpointed(parsed.filter("is_query").select("vec_id", "embedding").mapInArrow(_parse(scale), "vec_id long, dim int, v binary, sq double").select("vec_id", "dim", "v").distinct())

    def visit(blocks: DataFrame) -> DataFrame:
        # Each tree is shuffled once; a part that many blocks visit is split by its blocks (skew join).
        met = blocks.hint("merge").join(index, "part").select("part", "block", "tree")
        return met.mapInArrow(_search(k), "query_id long, vec_id long, score long")

    near = checkpointed(visit(queries.mapInArrow(_blocks(pivots, spread, block, True), "part string, block binary")))
    floors = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    rest = queries.join(floors, queries.vec_id == floors.query_id, "left").select("vec_id", "dim", "v", "floor")
    far = visit(rest.mapInArrow(_blocks(pivots, spread, block, False), "part string, block binary"))
    found = near.union(far).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


ORACLE_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id != c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
