"""Operators on vectors against brute force."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import embedding_dedup, topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, grp string, v int"


def vectors(seed=0, n=220, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(20, 60):
        x[i] = x[i % 5] + 0.08 * rng.normal(size=dim)
    for i in range(60, 120):
        x[i] = x[6] * rng.uniform(0.5, 2) + 0.02 * rng.normal(size=dim)
    x[120:124] = x[3]
    rows = [(int(i), [float(c) for c in np.float32(x[i])], int(i % 2) if i >= 124 or i < 20 else 1, "g", 1) for i in range(n)]
    odd = [(1000, None, 1, "g", 1), (1001, [0.0] * dim, 1, "g", 1), (1002, [float("nan")] * dim, 1, "g", 1), (1003, [float("inf")] + [1.0] * (dim - 1), 0, "g", 1), (1004, rows[6][1], None, "g", 1), (1005, [1.0, None] + [1.0] * (dim - 2), 1, "g", 1), (1100, [1.0, 2.0], 1, "g", 1), (1101, [1.0, 2.01], 1, "g", 1), (1102, [], 1, "g", 1), (None, rows[0][1], 0, "g", 1), rows[7], rows[7]]
    return rows + odd


def usable(e):
    return e is not None and len(e) and all(c is not None and np.isfinite(c) for c in e)


@pytest.mark.parametrize("options", [{}, {"neighbours": 4, "orders": 2}])
def test_embedding_dedup(spark, options):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df, **options).collect()}
    by = {r[0]: r for r in rows if r[0] is not None}
    ids = sorted(by)
    unit = {i: np.array(by[i][1], float) / np.linalg.norm(np.array(by[i][1], float)) for i in ids if usable(by[i][1]) and np.any(by[i][1]) and by[i][2] is not None}
    link = {i: [j for j in unit if j != i and by[i][2] == by[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] if i in unit else [] for i in ids}
    root = {i: i for i in ids}
    while True:
        new = {i: min([root[i]] + [root[j] for j in link[i]]) for i in ids}
        if new == root:
            break
        root = new
    assert got == {i: (len(link[i]), root[i], root[i] == i) for i in ids}
    assert max(len(v) for v in link.values()) > 50
    assert embedding_dedup.embedding_dedup(df.filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("options", [{}, {"part_rows": 20, "page": 4, "block": 2}, {"max_pivots": 2, "part_rows": 7}])
@pytest.mark.parametrize("k", [10, 400])
def test_topk(spark, options, k):
    rows = vectors(3, 150, 8)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in topk_search.topk_search(df, F.col("vec_id") % 10 == 0, k=k, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    table = {(r[0], len(r[1])): [int(np.floor(1024 * np.float64(np.float32(c)))) for c in r[1]] for r in rows if r[0] is not None and usable(r[1])}
    want = {}
    for (q, n), v in table.items():
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for (i, m), w in table.items() if m == n and i != q)[:k]
            if best:
                want[q] = [(rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert topk_search.topk_search(df.filter(F.lit(False)), F.lit(True)).count() == 0


def test_topk_ties_and_large_values(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 9.0]), (2, [0.5, -9.0]), (3, [0.5, 1.0]), (4, [0.25, 0.0]), (5, [1e6, 0.0]), (6, [-1e6, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in topk_search.topk_search(df, F.col("vec_id") == 0, k=4).orderBy("rank").collect()]
    assert got == [(5, 1024 * 1024 * 10**6), (1, 1024 * 512), (2, 1024 * 512), (3, 1024 * 512)]


def clumps():
    """Two clumps of 60 in one label, about 0.99 inside and 0.95 across: every list fills with its own clump."""
    rng = np.random.default_rng(5)
    heads = np.zeros((2, 64))
    heads[:, 0] = 1
    heads[1, 1] = np.tan(np.arccos(0.96))
    x = np.repeat(heads / np.linalg.norm(heads, axis=1)[:, None], 60, axis=0)
    noise = rng.normal(size=x.shape) * (np.arange(64) > 1)
    x = x + 0.1 * noise / np.linalg.norm(noise, axis=1)[:, None]
    return [(i, [float(c) for c in np.float32(v)], 1) for i, v in enumerate(x)]


def test_clumps_joined_beyond_full_lists(spark):
    rows = clumps()
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    assert (x @ x.T >= 0.93).all()
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == 120 and {(r.n_links, r.component_id) for r in got} == {(119, 0)}


def test_audit_counts_links(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.1], [1.0, 0.2]])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, "2:1", bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, grp string, x binary")
    links = spark.createDataFrame([(0, 1), (1, 2)], "u long, v long")
    none = links.select(F.col("u").alias("node")).filter(F.lit(False))
    assert embedding_dedup.audit_recall(rows, links, none, 0.93) == pytest.approx(2 / 3)
    assert embedding_dedup.audit_recall(rows, links, rows.select(F.col("id").alias("node")), 0.93) == 1
    # Without links in all rows the share is whole; with few of some rows nobody knows.
    assert embedding_dedup.audit_recall(rows, links, none, 1.01) == 1
    assert embedding_dedup.audit_recall(rows, links, none, 0.93, size=1, most=1) is None
    assert embedding_dedup.audit_recall(rows, links, none, 0.93, size=1, most=2) == pytest.approx(2 / 3)


def test_rare_links_of_a_starved_graph(spark, monkeypatch):
    """Few links among many vectors, and a graph that finds none: the sample can't tell, so all are compared."""
    monkeypatch.setattr(embedding_dedup, "audit_recall", partial(embedding_dedup.audit_recall, size=64, most=256))
    monkeypatch.setattr(embedding_dedup, "_confirm", lambda threshold: lambda batches: (b.select(["u", "v"]).slice(0, 0) for b in batches))
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 24))
    x[1:40:2] = x[0:40:2] * 1.5 + 0.1 * rng.normal(size=(20, 24))
    rows = [(i, [float(c) for c in v], i // 4 % 2) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = (unit @ unit.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    want = {(i, int(links[i].sum()) - 1, int(np.flatnonzero(links[i]).min())) for i in range(1500)}
    got = {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), orders=1, rounds=1).collect()}
    assert got == want and sum(n for _, n, _ in want) == 40


def test_pages_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "audit_recall", lambda *a: None)
    monkeypatch.setattr(embedding_dedup, "PAGE_ROWS", 8)
    monkeypatch.setattr(embedding_dedup, "BLOCK_PAGES", 3)
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(clumps(), "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}


def test_low_recall_ends_exact(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "audit_recall", lambda *a: 0.0)
    monkeypatch.setattr(embedding_dedup, "EXTRA_ROUNDS", 0)
    monkeypatch.setattr(embedding_dedup, "_confirm", lambda threshold: lambda batches: (b.select(["u", "v"]).slice(0, 0) for b in batches))
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(clumps(), "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}
