"""Operators on texts against brute force, on small tables with nulls, copies, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm import bpe, bpe_codec, chat_format, language_id, license_scan, packing, quality, simhash_dedup, substring_dedup
from wardline.llm.components import components

ODD = [None, "", " ", "\n\t ", "one", "a  b   c", " x\t y\n\n z  it's <|endoftext|> a　 b\x1c  c 你好  \U0001f600 ", "don't  stop\r\n  now 12 345", "CC BY all rights RESERVED"]
SCHEMA = "doc_id long, text string, ranges string, bucket int, Quality_Score string, lang_pred int, n long"


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(40)] + ["the", "of", "été", "naïve"]
    passage = [rng.choice(vocab) for _ in range(70)]
    texts = list(ODD)
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(10) : rng.randrange(40, 70)]
        texts.append((" " if i % 2 else "\n").join(words))
    texts += [texts[20], texts[21], texts[20]] + [" ".join(passage * 4)]
    return [(i * 7 % 997, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", 1, "q", 2, 3) for i, t in rows], SCHEMA).repartition(3).cache()


def empty(docs):
    return docs.filter(F.lit(False))


def expected_removals(rows, k):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - k + 1):
            w = tuple(words[a : a + k])
            if w in seen:
                gone[a : a + k] = [True] * k
            seen.add(w)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("options", [{}, {"hot_share": 0.002}, {"bucket_bytes": 500}])
def test_substring_dedup(docs, rows, options):
    want = expected_removals(rows, 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in substring_dedup.substring_dedup(docs, **options).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 500
    digests = {r.doc_id: r.kept_sha256 for r in substring_dedup.substring_dedup(docs, with_text=False, **options).collect()}
    assert digests == {i: hashlib.sha256(w[2]).hexdigest() for i, w in want.items()}


def test_substring_dedup_short_windows(spark):
    rows = [(2, "a b c a b c"), (1, "a b"), (3, "b c x"), (None, "a b c")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected_removals(rows[:3], 2)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in substring_dedup.substring_dedup(d, k=2).collect()} == want


def test_substring_dedup_repeated_rows_and_empty(spark, docs):
    text = " ".join(map(str, range(30)))
    twice = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(twice).collect()) == [(1, 0), (1, 0), (2, 30)]
    assert substring_dedup.substring_dedup(empty(docs)).count() == 0
    clean = substring_dedup.remove_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert substring_dedup.remove_repeats(empty(docs)).count() == 0


def expected_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, linked):
    root = list(range(n))
    while True:
        new = [min(root[j] for j in range(n) if j == i or linked(i, j)) for i in range(n)]
        if new == root:
            return root
        root = new


@pytest.mark.parametrize("options", [{}, {"hot_key": 1}, {"group_rows": 10}])
def test_simhash_dedup(docs, rows, options):
    rows = sorted(rows)
    prints = [expected_simhash(t) for _, t in rows]
    root = reach(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    want = {i: (f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, root, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.simhash_dedup(docs, **options).collect()}
    assert got == want


def test_simhash_matches_spark_hash(spark):
    word = "a bé c d"
    assert simhash_dedup.simhash(word.encode()) == spark.createDataFrame([(word,)], "t string").select(F.xxhash64("t")).first()[0] % (1 << 64)


def test_gray_index_against_all_pairs():
    rng = np.random.default_rng(1)
    for trial in range(12):
        base = rng.integers(0, 1 << 63, size=20, dtype=np.uint64)
        x = np.unique(np.array([int(b) ^ sum({1 << int(z) for z in rng.integers(0, 64, size=rng.integers(0, 5))}) for b in base for _ in range(rng.integers(1, 30))], dtype=np.uint64))
        g = np.sort(rng.integers(0, 3, size=len(x)))
        near = (np.bitwise_count(x[:, None] ^ x[None]) <= 4) & (g[:, None] == g[None])
        want = reach(len(x), lambda i, j: near[i, j])  # noqa: B023
        got = simhash_dedup.gray_links(x, g, 4, fanout=3 + trial % 6, probes=37)
        assert len({*zip(want, got.tolist(), strict=True)}) == len(set(want)) == len(set(got.tolist()))


@pytest.mark.parametrize("most", [0, 2, 4])
def test_hot_simhash_keys_are_split_until_none_is_hot(spark, most):
    rng = np.random.default_rng(3)
    # Fingerprints that differ in their top 24 bits alone, so whole ranges of two levels are shared by all.
    tops = rng.integers(0, 1 << 24, size=60).tolist()
    x = sorted({(t ^ sum({1 << int(z) for z in rng.integers(0, 24, size=rng.integers(0, 6))})) << 40 | 0x5A5A5A5A5A for t in tops for _ in range(4)})
    root = reach(len(x), lambda i, j: (x[i] ^ x[j]).bit_count() <= most)
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(x)], "fp long, rep long")
    found = {r.node: r.root for r in components(simhash_dedup.near_links(rows, most, hot_key=30, group_rows=50)).collect()}
    assert [found.get(i, i) for i in range(len(x))] == root


def test_very_long_texts(spark):
    """A text of 300,000 words beside short ones, null and empty, through every operator on texts; ids tie with a repeated row."""
    rng = random.Random(3)
    vocab = ["the", "of", "und", "der", "cc", "by", "été"] + ["w%d" % i for i in range(200)]
    long = " ".join(rng.choice(vocab) for _ in range(300_000))
    rows = [(1, "the cat and the dog"), (2, long), (3, None), (4, ""), (5, long[1000:3000]), (5, long[1000:3000])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    want = expected_removals([r for r in rows[:5]], 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept.encode()) for r in substring_dedup.substring_dedup(d).collect()}
    assert got == want and got[5][1] > 100
    prints = {r.doc_id: r.fingerprint for r in simhash_dedup.simhash_dedup(d).collect()}
    assert prints == {i: f"{expected_simhash(t):016x}" for i, t in rows}
    base = len(re.findall("(?=(?<!\\S)cc by(?!\\S))", long))
    scanned = {r.doc_id: (r.n_words, r.n_base) for r in license_scan.license_scan(d).collect()}
    assert base > 0 and scanned[2] == (len(re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", long)), base)
    library = bpe_codec.encoding(public_tokenizers.path(bpe_codec.RANKS), public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in bpe_codec.encode(d).collect()}[2] == library.encode_ordinary(long)
    pieces = [r for r in packing.pack_documents(d, added=True).collect() if r.doc_id == 2]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(long, add_special_tokens=False).ids + [0]
    assert sum(p.length for p in pieces) == len(whole) and len(pieces) == -(-len(whole) // 2048)
    model = language_id.train(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in language_id.identify(d, model).collect()}[2] in ("de", "en")
    scores = [r.quality_score for r in quality.score(d, quality.fit(rng_statistics(), np.arange(60) % 2)).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)


def rng_statistics():
    return np.random.default_rng(0).normal(size=(60, len(quality.STATISTICS)))


@pytest.mark.parametrize("name", quality.STATISTICS)
def test_quality_statistics(name):
    """Each statistic of the vectorised pass against a plain computation on one text."""
    words = lambda t: t.split()
    ratio = lambda a, b: a / b if b else 0.0
    logit = lambda p: np.log((min(max(p, 0), 1) * 0.998 + 0.001) / (1 - (min(max(p, 0), 1) * 0.998 + 0.001)))
    texts = [b"", b" \n ", b"a", "The cat, the CAT! été | naïve\nthe cat\nthe cat\n#1 a$b AbC extraordinarily.".encode(), b"x x x\n\nx"]
    got = quality.statistics(texts)[:, quality.STATISTICS.index(name)]
    for t, value in zip(texts, got, strict=True):
        w = words(t)
        n, total = len(w), sum(map(len, w))
        lines = t.split(b"\n")
        of = lambda test: logit(ratio(sum(map(test, w)), n))  # noqa: B023, E731
        mean = ratio(total, n)
        plain = {
            "bytes": np.log1p(len(t)), "words": np.log1p(n), "mean_word": np.log1p(mean), "spread_word": np.log1p(np.sqrt(max(ratio(sum(len(x) ** 2 for x in w), n) - mean**2, 0))),
            "distinct": np.log1p(len(set(w))) / max(np.log1p(n), 1e-9), "repeat": logit(ratio(sum(a == b for a, b in zip(w, w[1:], strict=False)), n)), "top_word": logit(ratio(max((w.count(x) for x in w), default=0), n)),
            "line_words": np.log1p(n / len(lines)), "repeat_line": logit(1 - len(set(lines)) / len(lines)), "short_word": of(lambda x: len(x) <= 3), "long_word": of(lambda x: len(x) >= 12), "end_mark": of(lambda x: x[-1] in b".!?"),
            "symbol_word": of(lambda x: any(quality.CLASSES["symbol"][c] for c in x)), "capital_word": of(lambda x: sum(65 <= c <= 90 for c in x) > 1),
        } | {k: logit(ratio(sum(lut[c] for x in w for c in x), total)) for k, lut in quality.CLASSES.items()}
        assert value == pytest.approx(plain[name]), t


def test_license_labels_of_statements(spark):
    """Added labels against a plain longest common subsequence over every window of a text."""
    rng = random.Random(8)
    texts = []
    for _, statement in license_scan.STATEMENTS:
        w = statement.split()
        cut = [x for x in w if rng.random() > 0.1]
        texts += [statement, "before " + " ".join(cut) + " after", " ".join(w[: len(w) // 2]), " ".join(w[: len(w) // 2] + ["new"] + w[len(w) // 2 :])]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                keep = row[j + 1]
                row[j + 1] = last + 1 if x == y else max(row[j + 1], row[j])
                last = keep
        return row[-1]

    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0])], "doc_id long, text string")
    rows = license_scan.license_scan(d).collect()
    for r in rows:
        words = (texts[r.doc_id] if r.doc_id is not None else texts[0]).split()
        sure = {label for label, s in license_scan.STATEMENTS if s in " ".join(words)}
        most = {label for label, s in license_scan.STATEMENTS if common(s.split(), words) >= 0.8 * len(s.split())}
        given = set(filter(None, r.labels.split(","))) - {label for label, _ in license_scan.BASE}
        assert sure - {label for label, _ in license_scan.BASE} <= given <= most, words
    assert len({(r.labels, r.score) for r in rows if r.doc_id is None} | {(r.labels, r.score) for r in rows if r.doc_id == 0}) == 1


def test_simhash_empty(docs):
    assert simhash_dedup.simhash_dedup(empty(docs)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_encoder_matches_libraries():
    texts = [t for _, t in corpus()] + ["a  b", "x   y", "'s're it's 'T", "1a 2b", "é", "\x85 z", "a\x00b c"]
    raw = [(t or "").encode() for t in texts]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for encoder, want in (
        (bpe.json_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]),
        (bpe.rank_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), [bpe_codec.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary(t or "") for t in texts]),
    ):
        ids, at = encoder(raw)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300, "bucket_bytes": 900}])
def test_bpe_codec(spark, docs, rows, options):
    library = bpe_codec.encoding(public_tokenizers.path(bpe_codec.RANKS), public_tokenizers.PATTERN)
    got = bpe_codec.encode(docs, **options)
    assert {r.doc_id: r.ids for r in got.collect()} == {i: library.encode_ordinary(t or "") for i, t in rows}
    assert {r.doc_id: bytes(r.text) for r in bpe_codec.decode(got).collect()} == {i: (t or "").encode() for i, t in rows}
    same = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, None)], "doc_id long, text string")
    assert sorted(len(r.ids) for r in bpe_codec.encode(same).collect()) == [0, 2, 2]
    assert bpe_codec.encode(empty(docs)).count() == 0


def test_packing(docs, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    length = 64
    out = packing.pack_documents(docs, length, with_ids=True).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length <= length
    assert set(by) == {i for i, _ in rows}
    for i, t in rows:
        pieces = sorted(by[i], key=lambda r: r.piece)
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert [x for p in pieces for x in p.ids] == ids
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert all(p.length == length for p in pieces[1:])
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    total = sum(r.length for r in out)
    assert len(sequences) <= 1.1 * -(-total // length) + 1
    assert packing.pack_documents(empty(docs)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_places_every_piece(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(rng.choice([1, 5, 400, 3000])):
        k = min(100, 1 + int(rng.expovariate(1 / rng.choice([5, 30, 80]))))
        counts[k] = counts.get(k, 0) + 1
    n, runs = packing.plan(counts, 100, rng.choice([0.1, 0.25, 0.4]), rng.choice([3, 12]))
    placed, used = {}, {}
    for size, first, many, at in runs:
        placed[size] = placed.get(size, 0) + many
        for s in range(first, first + many):
            used.setdefault(s, []).append((at, size))
    assert placed == counts and set(used) == set(range(n))
    for s in used.values():
        assert sum(x for _, x in s) <= 100 and [a for a, _ in sorted(s)] == [sum(x for _, x in sorted(s)[:i]) for i in range(len(s))]


def test_license_scan(spark, docs, rows):
    words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    extra = [(9001, "x CC-BY, then cc by; All\nrights... reserved! all rights reservedx GENERAL public LICENSE"), (9002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files"), (9003, "of the of the under the license public"), (None, "cc by"), (None, "nothing"), (9001, "cc by")]
    d = docs.select("doc_id", "text", F.lit(1).alias("votes"), F.lit(2).alias("h")).union(spark.createDataFrame([(i, t, 1, 2) for i, t in extra], "doc_id long, text string, votes int, h int"))

    def want(text):
        w = words.findall((text or "").encode().lower())
        places, labels = [], set()
        for label, phrase in license_scan.BASE:
            p = phrase.encode().split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))

    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.first_word or -1, r.last_word or -1, r.base_labels) for r in license_scan.license_scan(d).collect())
    exp = sorted((i is None, i or 0, *[(x if x is not None else -1) or (x if isinstance(x, str) else x if k < 2 else -1) for k, x in enumerate(want(t))]) for i, t in rows + extra)
    assert got == exp
    labels = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(d).filter("doc_id >= 9002").collect()}
    assert labels[9002][0] == "mit" and 0.8 <= labels[9002][1] < 1 or labels[9002] == ("mit", 1.0)
    assert labels[9003] == ("", 0.0)
    assert license_scan.license_scan(empty(docs)).count() == 0


def test_chat_format(spark):
    evil = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| %0A \\"
    rows = [(1, 0, "user", evil), (1, 1, "assistant", evil), (1, 2, "user", "tail"), (2, 1, "assistant", "b"), (2, 0, "a%0A\nb<|im_start|>", None), (2, 2, "assistant", ""), (3, 0, None, "only"), (None, 5, "assistant", "x"), (4, 0, "assistant", "é"), (4, 0, "assistant", "é")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, pieces int")
    ex = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.digests(ex).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for cid in got:
        turns = sorted((t or 0, r or "", x or "") for c, t, r, x in rows if c == cid)
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[cid].n_turns, got[cid].turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (got[cid].loss_chars, got[cid].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = sorted(ex.filter("conv_id = 1").collect(), key=lambda r: r.formatted)
    assert len(one) == 2 and one[0].target == 1 and one[1].target is None and one[1].loss_start == one[1].loss_end
    assert one[0].formatted.count("<|im_start|>") == 2 and one[1].formatted.startswith(one[0].formatted)
    plan = ex._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert chat_format.digests(chat_format.format_chats(df.filter(F.lit(False)))).count() == 0


def test_chat_format_of_a_very_long_turn(spark):
    long = "word <|im_end|> " * 60_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    (got,) = chat_format.digests(chat_format.format_chats(df)).collect()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())


def test_quality_model():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (400, 5)), rng.normal(0, 3, (120, 5)) + 1
    x, y = np.vstack([good, bad]), np.r_[np.ones(400), np.zeros(120)]
    m = quality.fit(x, y)
    s = m.score(x)
    assert ((s >= 0.5) == y).mean() > 0.85 and s.min() >= 0 and s.max() <= 1
    z = np.clip((x - m.centre) / m.scale, -12, 12)
    for mean, factor, constant in zip(m.means, m.factors, m.constants, strict=True):  # the factors give the log density
        cov = np.linalg.inv(factor.T @ factor)
        d = z - mean
        full = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1]
        share = (y == (0 if constant == m.constants[0] else 1)).mean()
        assert np.allclose(-0.5 * ((d @ factor.T) ** 2).sum(axis=1) + constant, full + np.log(share))
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [1.0, 1.0]
    assert quality.fit(x[:3], y[:3]).score(x[:2]).tolist() == [1.0, 1.0]


def test_quality_scores(spark, docs):
    assert np.isfinite(quality.statistics([b"", b" ", b"a", "é\n!".encode() * 5])).all()
    labels = spark.createDataFrame([(i * 7 % 997, i % 2, 0) for i in range(60)] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model, "fresh")
    assert out.columns == [*docs.columns, "fresh"] and out.filter("fresh < 0 OR fresh > 1 OR fresh IS NULL").count() == 0 and out.count() == docs.count()
    assert quality.score(empty(docs), model).count() == 0
    none = quality.train(empty(docs), labels.filter(F.lit(False)))
    assert {r.fresh for r in quality.score(docs, none, "fresh").collect()} == {1.0}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(d) > 40 and (d.predicted == d.quality).mean() > 0.93


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d = language_id.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (d.lang_pred == d.lang).mean() > 0.97


def test_language_spans_and_scripts(spark):
    train = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog with this thing that was there", "en"), ("der hund und die katze nicht mit einem haus sich", "de"), ("кошка и собака это очень хорошо для всех людей", "ru")] * 30)] + [(500, None, "en"), (501, "x", None)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    m = language_id.train(df)
    assert m.langs == ["de", "en", "ru"]
    texts = ["the cat with the dog " * 5 + "der hund und die katze " * 5 + "the thing that was there " * 5, "это собака 123", None, "", "123 !?", "你好", "the"]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred int")
    got = {r.doc_id: r for r in language_id.identify(d, m).collect()}
    assert got[0].lang_pred == "en" and [(s.lang, s.start, s.end) for s in got[0].lang_spans] == [("en", 0, 25), ("de", 25, 50), ("en", 50, 75)]
    assert got[1].lang_pred == "ru" and got[1].lang_score == 1.0
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 for i in (2, 3, 4))
    assert got[5].lang_pred in m.langs and got[6].lang_pred == "en"
    assert language_id.identify(d.filter(F.lit(False)), m).count() == 0
    assert language_id.identify(d, language_id.train(df.filter(F.lit(False)))).count() == len(texts)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    m = language_id.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), np.log([0.5, 0.3, 0.2]))
    counts = [0, 4, 1, 6]
    first = np.concatenate([[0], np.cumsum(counts)])
    scores = rng.normal(0, 2, (sum(counts), 3)).astype(np.float32)
    path = m.paths(scores, first, switch=1.5)
    import itertools

    for a, n in zip(first[:-1], counts, strict=True):
        if n:
            value = lambda p: m.prior[p[0]] + sum(scores[a + i, k] for i, k in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
            assert value(tuple(path[a : a + n])) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))), abs=1e-4)


def test_packing_added_tokens(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end} x", "plain text", "", f"it{end}'s  {end}\u3000 é", "<|endoftext", f"x{end}"]
    encoder = bpe.json_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for chosen in (slice(None), slice(3, 5)):
        ids, at = encoder([t.encode() for t in texts[chosen]])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want[chosen]
    assert want[0] == [64, 220, 50256, 275]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.query(spark, str(tmp_path)).collect()}
    assert got == {i: (len(w) + 1, zlib.crc32(np.array([*w, 0], dtype="<u4").tobytes())) for i, w in enumerate(want)}
