"""The pipeline's stages on a small table of planted cases, and on the smallest driver tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = ["the", "of", "and", "was", "with"] + ["".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    prose = lambda n: " ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(n))
    passage = prose(6)
    rows = [(i, prose(8), "en", "s", None) for i in range(30)]
    rows += [(40, rows[0][1], "en", "s", 1), (41, rows[0][1] + " Extra", None, "s", 1), (50, prose(5) + " " + passage, "en", "s", 1), (51, prose(5) + " " + passage + " " + prose(3), "en", "s", 1), (60, None, "en", "s", None), (61, "", None, None, None), (62, "123 456", "en", "s", 0), (None, prose(4), "en", "s", 1)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, quality_score string, ranges string")


def test_stage_names_and_columns(spark, docs):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "language id", "simhash near-dedup", "substring dedup", "best-fit packing"]
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.filter(F.lit(False)), SF).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs.filter(F.lit(False)), SF).count() == 0


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_language_stage(spark, docs):
    kept = pipeline.language_stage(spark, docs, SF)
    assert ids(docs) - ids(kept) == {60, 61, 62}
    assert kept.filter("lang IS NULL").count() == 0


def test_language_stage_unlearned_script(spark, docs):
    greek = "και το σκυλί είναι στο σπίτι με τη γάτα " * 8
    rows = [(101, greek), (102, greek + "the end"), (103, "привет это собака " * 10), (104, "the cat was in the house and the dog " * 5 + greek)]
    more = spark.createDataFrame([(i, t, None, "s", None, "x", "y") for i, t in rows], docs.schema)
    kept = pipeline.language_stage(spark, docs.union(more), SF)
    assert ids(kept) & {101, 102, 103, 104} == {104} and ids(docs) - ids(kept) == {60, 61, 62}


def test_near_copy_stage(spark, docs):
    kept = ids(pipeline.near_copy_stage(spark, docs, SF))
    assert 0 in kept and 40 not in kept and 41 not in kept and 60 in kept and 61 not in kept and None in kept
    assert set(range(30)) <= kept and {50, 51} <= kept


def test_near_copies_without_id(spark, docs):
    """Of equal texts without id one row stays, of others each, and none beside the same text under an id."""
    said = "a farmer told us about wheat and rain in the long valley near the river "
    rows = [(None, said * 3, "en", f"s{i % 2}", 1, "x", "y") for i in range(5)] + [(None, "quite another text about ships and harbours and the sea " * 2, "en", "s", 1, "x", "y"), (7, said * 2 + said, "en", "s", 1, "x", "y")]
    some = spark.createDataFrame(rows, docs.schema)
    assert pipeline.near_copy_stage(spark, some.filter("doc_id IS NULL"), SF).count() == 2
    kept = pipeline.near_copy_stage(spark, some, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 7]


def test_run_matches_plain_stages(spark):
    """The whole pipeline against its stages done one document at a time."""
    import public_tokenizers
    from test_text_ops import expected_removals, expected_simhash, reach
    from tokenizers import Tokenizer

    from wardline.llm import language_id, quality
    from wardline.session import table

    docs = table(spark, SF, "documents")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    judge = quality.train(docs, table(spark, SF, "labels"))
    kept = {i: t for i, t in sorted(texts.items()) if judge.score(quality.statistics([t]))[0] >= quality.ACCEPT}
    teller = language_id.train(docs.filter(F.col("doc_id").isin(*kept)))
    told = {i: teller.label([t])[:2] for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if told[i][0][0] != language_id.UNDETERMINED and told[i][1][0] >= language_id.ACCEPT}
    ids = sorted(kept)
    prints = [expected_simhash(kept[i].decode()) for i in ids]
    root = reach(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    ids = [x for n, x in enumerate(ids) if root[n] == n]
    cleaned = expected_removals([(i, kept[i].decode()) for i in ids], 20)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out: dict[int, list] = {}
    for r in pipeline.run(spark, SF).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sorted(out) == ids and 0 < len(ids) < len(texts)
    for i in ids:
        n_removed, text = cleaned[i][1], cleaned[i][2]
        pieces = sorted(out[i], key=lambda r: r.piece)
        assert sum(p.length for p in pieces) == pieces[-1].start + pieces[-1].length
        if not n_removed:  # what is left of others keeps its blanks
            assert sum(p.length for p in pieces) == len(library.encode(kept[i].decode(), add_special_tokens=False).ids) + 1
        else:
            assert sum(p.length for p in pieces) <= len(library.encode(kept[i].decode(), add_special_tokens=False).ids) + 1 and len(text) < len(kept[i])


def test_passage_stage(spark, docs):
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in pipeline.passage_stage(spark, docs, SF).collect()}
    assert set(after) == set(before)
    assert after[50].text == before[50] and len(after[51].text) < len(before[51])
    assert after[40].text == "" and after[60].text is None and after[51].n_chars == len(after[51].text)


def test_run(spark):
    out = pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < out.select("doc_id").distinct().count() < docs.count()
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert fill <= 2048


def test_quality_stage_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = pipeline.quality_stage(spark, docs, sf).select("doc_id", F.lit(True).alias("kept"))
    r = labels.join(kept, "doc_id", "left").agg(F.avg(F.when(F.col("quality") == 1, F.coalesce("kept", F.lit(False)).cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.coalesce("kept", F.lit(False)).cast("int"))).alias("bad")).first()
    assert r.good > 0.97 and r.bad < 0.2
