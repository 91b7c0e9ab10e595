"""Merkle manifest, fill-in-the-middle and toxic spans against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import fill_middle, merkle_manifest, toxicity
from wardline.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, fanout):
    """(doc_id, leaf) -> list of (subroot, root, proof) by plain lists."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            at = i - i % fanout
            out.append(("".join(level[at:i]), "".join(level[i + 1 : at + fanout])))
            i //= fanout
        return out

    groups = {}
    for doc_id, text, lang, source, n in rows:
        groups.setdefault(source, []).append((doc_id, sha("".join(map(field, (doc_id, source, lang, n, text))))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (doc_id, leaf) in enumerate(sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], tuple(siblings(trees[s], i) + siblings(top, j))))
    return sorted(out, key=repr)


def docs_with_edges(n):
    rows = [(i * 7 % n, f"text {i} ÄÖ", "en", f"s{i % 3}" if i % 5 else "hot", i) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "x", None, None, None), (2**60 + 1, "", "en", "", 0), (2**60 + 1, "", "en", "", 0), (5, "same", "en", "hot", 4), (5, "same", "en", "hot", 4), (6, "y" * 300_000, "en", "é", 1)]
    return rows


@pytest.mark.parametrize(("fanout", "levels", "n"), [(2, 1, 40), (2, 2, 90), (3, 2, 60), (16, 2, 30)])
def test_manifest_matches_plain_lists(spark, fanout, levels, n):
    rows = docs_with_edges(n)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("grp", F.lit(1)).withColumn("idx", F.lit("x")).repartition(3)
    got = merkle_manifest.manifest(docs, fanout=fanout, levels=levels)
    checked = got.withColumn("ok", merkle_manifest.fold(F.col("leaf"), F.col("lefts"), F.col("rights")) == F.col("root")).collect()
    assert all(r.ok for r in checked)
    found = sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(zip(r.lefts, r.rights, strict=True))) for r in checked), key=repr)
    assert found == brute_manifest(rows, fanout)


def test_manifest_of_little(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    (one,) = merkle_manifest.manifest(spark.createDataFrame([(1, "a", None, "s", 1)], SCHEMA)).collect()
    assert one.leaf == one.subroot == one.root == sha("1:11:s-1:11:a") and one.lefts == []


def test_tampering_is_found(spark, tmp_path):
    rows = [(i, "Upper" if i % 2 else "lower", "en", "a" if i % 3 else None, 5) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for r in merkle_manifest.query(spark, str(tmp_path)).collect():
        hit = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id % 2 == 1
        assert r.verified == (not hit) and (r.folded_root == r.root) == r.verified


def brute_fim(doc_id, text, unit=r"[^\n]*\n|[^\n]+", rate=100, spm=50):
    text = text or ""
    units = re.findall(unit, text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in fill_middle.SENTINELS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "é\n\nü\r\nx y", "has <P> inside\nx", "almost <S <M\n< P>", "<", "tail <S", "  lead word\t\ttab \n", "z" * 400_000, "line\n" * 50_000, "🙂 two\n🙂"]


@pytest.mark.parametrize(("unit", "pattern"), [("line", r"[^\n]*\n|[^\n]+"), ("word", r"[^ \t\n\x0b\x0c\r]*[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+"), ("char", r"(?s).")])
def test_fill_in_middle_matches_regex(spark, unit, pattern):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(0)).withColumn("h1", F.lit("x"))
    for rate, spm in ((100, 50), (40, 0)):
        cut = fill_middle.fill_in_middle(docs, unit=unit, rate=rate, spm_rate=spm).withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
        got = cut.collect()
        assert sorted((tuple(r[:6]) for r in got), key=repr) == sorted((brute_fim(i, t, pattern, rate, spm) for i, t in rows), key=repr)
        assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_other_sentinels_come_back(spark):
    marks = ("<|fim.prefix|>", "<|fim.suffix|>", "<|fim.middle|>")
    docs = spark.createDataFrame([(i, f"<P>{i}\n.*\n<|fim.\nend" if i % 4 else f"x{marks[i % 3]}") for i in range(40)], "doc_id long, text string")
    cut = fill_middle.fill_in_middle(docs, sentinels=marks).join(docs, "doc_id")
    assert cut.filter(fill_middle.restore(F.col("output"), F.col("form"), marks) != F.col("text")).count() == 0
    assert {r.form for r in cut.collect()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("lengths", [[1], [5], [3, 1, 4], [2, 6, 1, 1, 3], [40]])
def test_marginals_match_all_labellings(lengths):
    rng = np.random.default_rng(sum(lengths))
    n = sum(lengths)
    e, start, steps = rng.normal(0, 3, n), 0.7, np.array([-1.2, 0.4, 1.5])
    first = np.zeros(n, dtype=bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got = toxicity.forward_backward(e, first, start, steps, pairs=True)
    if n > 13:  # a plain recursion instead
        table_of = {(0, 0): 0.0, (0, 1): steps[0], (1, 0): steps[1], (1, 1): steps[2]}
        f = [np.array([0.0, start + e[0]])]
        for t in range(1, n):
            f.append(np.array([np.logaddexp(f[-1][0] + table_of[0, j], f[-1][1] + table_of[1, j]) + j * e[t] for j in (0, 1)]))
        b = [np.zeros(2)]
        for t in range(n - 1, 0, -1):
            b.insert(0, np.array([np.logaddexp(table_of[i, 0] + b[0][0], table_of[i, 1] + e[t] + b[0][1]) for i in (0, 1)]))
        both = np.array(f) + np.array(b)
        assert np.allclose(got.toxic, np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1])))
        return
    want, counts, at = [], np.zeros(4), 0
    for size in lengths:
        total, toxic, local = 0.0, np.zeros(size), np.zeros(4)
        for y in itertools.product((0, 1), repeat=size):
            seen = np.array([y[0], *(sum(p == s for p in itertools.pairwise(y)) for s in ((0, 1), (1, 0), (1, 1)))])
            weight = np.exp(np.dot(y, e[at : at + size]) + np.dot(seen, [start, *steps]))
            total, toxic, local = total + weight, toxic + weight * np.array(y), local + weight * seen
        want, counts, at = [*want, *(toxic / total)], counts + local / total, at + size
    assert np.allclose(got.toxic, want) and np.allclose(got.counts, counts)


CLEAN = [f"{a}{b}" for a in ("ba", "do", "mi", "ser", "tul", "gan") for b in ("lo", "ret", "na", "vik", "sum")]


def planted(n, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 2
        for _ in range(rng.randint(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words) + 1), "grobl" + rng.choice(["", "ak", "ink", "orf", "ünt"]))
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def toxic_model(spark):
    rows, labels = planted(600)
    return toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_spans_are_where_the_words_stand(spark, toxic_model):
    rows, labels = planted(150, seed=2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Toxicity", F.lit("x"))
    hits = 0
    for r in toxicity.tag(docs, toxic_model).collect():
        found = " ".join(r.text[s.start : s.end].lower() for s in r.toxic_spans).split()
        want = re.findall(r"grobl\w*", r.text.lower())
        assert (r.toxicity >= 0.5) == bool(want)
        hits += found == want
    assert hits >= 145


def test_unknown_ending_and_place_in_a_long_text(spark, toxic_model):
    long = "é " + "bana dolo " * 60_000 + "groblorf minalo"
    edges = [(1, None), (2, ""), (3, "!?"), (4, long), (5, "dolo groblik grobl miret"), (5, "dolo groblik grobl miret"), (None, "bana")]
    got = {(r.doc_id, r.text): r for r in toxicity.tag(spark.createDataFrame(edges, "doc_id long, text string"), toxic_model).collect()}
    assert len(got) == 6 and all(0 <= r.toxicity <= 1 for r in got.values())
    none = [got[1, None], got[2, ""], got[3, "!?"], got[None, "bana"]]
    assert all(r.toxicity < 0.5 and r.toxic_spans == [] for r in none) and len({r.toxicity for r in none[:3]}) == 1
    assert [long[s.start : s.end] for s in got[4, long].toxic_spans] == ["groblorf"]
    pair = got[5, "dolo groblik grobl miret"]
    assert [pair.text[s.start : s.end] for s in pair.toxic_spans] == ["groblik grobl"]


def test_copies_of_a_toxic_document_mark_nothing(spark):
    rows, labels = planted(400, seed=3)
    rows = [(i, f"{t} zanter bana" if i % 5 == 0 and i < 60 else t) for i, t in rows]  # clean ones
    copy = "gansum zanter dolo miret groblak " * 3
    rows += [(1000 + i, copy) for i in range(300)]
    labels += [(1000 + i, 1, 1) for i in range(300)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.tag(spark.createDataFrame([(1, "dolo zanter miret bana serlo zanter dolo")], "doc_id long, text string"), model).first()
    assert got.toxicity < 0.5 and got.toxic_spans == []


def test_training_on_little(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = "doc_id long, quality int, toxic int"
    assert toxicity.tag(none, toxicity.train(none, spark.createDataFrame([], labels))).count() == 0
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(9)] + [(None, "x")], "doc_id long, text string")
    for given in ([], [(1, 1, 1)], [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)]):
        got = toxicity.tag(docs, toxicity.train(docs, spark.createDataFrame(given, labels))).collect()
        assert len(got) == 10 and all(0 <= r.toxicity <= 1 for r in got)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.query(spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    found = [r.predicted for r in got if r.toxic]
    assert right >= 0.98 and sum(found) / len(found) >= 0.85
