import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardline.functions.similarity import token_set_ratio, token_sort_ratio
from wardline.functions.units import normalize_units
from wardline.operators import resolve as R
from wardline.operators import upsert as U

SCHEMA = "user_id long, id long, record_type string, code_value string, display_text string, effective_date timestamp_ntz, status string, source_format string, source_section string"
DAY = datetime(2024, 1, 1)


def pair_score(spark, a, b):
    base = {"user_id": 1, "record_type": "condition", "code_value": "X", "display_text": "t", "effective_date": None, "status": None, "source_format": "f", "source_section": None}
    rows = [tuple({**base, "id": i, **x}[c.split()[0]] for c in SCHEMA.split(", ")) for i, x in ((1, a), (2, b))]
    return R.score(R.pairs(spark.createDataFrame(rows, SCHEMA))).first().score


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ({}, {}, 0.7),
        ({"code_value": None, "display_text": "Same"}, {"code_value": "", "display_text": "same"}, 0.3),
        ({"effective_date": DAY}, {"effective_date": DAY + timedelta(hours=23)}, 0.9),
        ({"effective_date": DAY}, {"effective_date": DAY + timedelta(days=8)}, 0.35),
        ({"effective_date": DAY}, {"effective_date": DAY + timedelta(days=3)}, 0.7),
        ({"status": "a", "source_section": "s"}, {"status": "a", "source_section": "s", "source_format": "g"}, 1.0),
        ({"display_text": "lisinopril 10 mg tablet"}, {"display_text": "tablet lisinopril 10 mg"}, 0.6),
        ({"display_text": "knee pain"}, {"display_text": "abdominal distension"}, 0.4),
    ],
)
def test_score(spark, a, b, expected):
    assert pair_score(spark, a, b) == pytest.approx(expected, abs=1e-12)


def test_similarity():
    assert token_set_ratio("a b c", "c b a") == 100
    assert token_set_ratio("a b", "a b c") == 100
    assert token_set_ratio("", "a") == 0 == token_set_ratio(None, None)
    assert token_set_ratio("knee pain", "abdominal distension") == pytest.approx(27.6, abs=0.1)
    assert token_sort_ratio("b a", "a b") == 100


def test_greedy_matches_a_loop(spark):
    rng = random.Random(3)
    rows = [(1, i, "t", rng.choice("AB"), rng.choice(["x", "y"]), DAY + timedelta(hours=rng.randrange(60)), rng.choice(["p", "q"]), rng.choice("fg"), "s") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    scored = R.score(R.pairs(df)).select("id_a", "id_b", "score").collect()
    score = {(r.id_a, r.id_b): r.score for r in scored}
    want, gone = set(), set()
    for bucket in "AB":
        inside = sorted((r for r in rows if r[3] == bucket), key=lambda r: (r[5], r[1]))
        for i, a in enumerate(inside):
            for b in inside[i + 1 :]:
                if a[1] not in gone and b[1] not in gone and score[a[1], b[1]] >= 0.95:
                    gone.add(b[1])
                    want.add((a[1], b[1]))
    got = {(r.primary_id, r.secondary_id) for r in R.greedy_merges(R.score(R.pairs(df))).collect()}
    assert got == want and want


def test_fields_merge_and_revert(spark):
    rows = [({"id": "1", "a": "1", "b": "2"}, {"id": "2", "a": "9", "c": "3"})]
    df = spark.createDataFrame(rows, "old map<string,string>, new map<string,string>")
    r = R.revert_fields(R.merge_fields(df)).first()
    assert r.updated == {"id": "1", "a": "9", "c": "3"} and r.reverted == rows[0][0]
    assert r.fields_updated == ["a", "b", "c"] and r.previous == {"a": "1", "b": "2", "c": None}
    one = R.merge_fields(df, overrides=["c"]).first()
    assert one.updated == {"id": "1", "a": "1", "b": "2", "c": "3"} and one.fields_kept == ["a", "b"]


def test_bulk_falls_back_to_all(spark):
    c = spark.createDataFrame([(1, 0.71, "pending"), (2, 0.65, "pending"), (3, 0.9, "merged")], "candidate_id long, score double, status string")
    assert {r.candidate_id: r.status for r in R.resolve_bulk(c, "dismiss", ids=[]).collect()} == {1: "dismissed", 2: "dismissed", 3: "merged"}
    assert {r.candidate_id: r.status for r in R.resolve_bulk(c, "merge", low=70, high=80).collect()} == {1: "merged", 2: "pending", 3: "merged"}


def test_upsert_versions(spark):
    rows = [("s", "1", 1, "A"), ("s", "1", 2, "B"), ("s", "1", 3, "A"), ("s", "2", 1, "C"), ("s", "2", 2, "C"), (None, None, 1, "D"), (None, None, 2, "D"), ("s", "3", 1, "E")]
    old = spark.createDataFrame([("s", "3", "E", 4)], "source_system string, external_id string, content_hash string, version int")
    df = spark.createDataFrame(rows, "source_system string, external_id string, n int, content_hash string")
    key = ["source_system", "external_id"]
    planned = U.plan_batch(df, old, key, ["n"])
    got = {(r.external_id, r.n): (r.action, r.version) for r in planned.collect()}
    assert got == {("1", 1): ("insert", 1), ("1", 2): ("update", 2), ("1", 3): ("update", 3), ("2", 1): ("insert", 1), ("2", 2): ("skip", 1), (None, 1): ("insert", 1), (None, 2): ("insert", 1), ("3", 1): ("skip", 4)}
    kept = U.current(planned.filter("external_id IS NOT NULL"), key)
    again = U.plan_batch(kept.select(*key, "n", "content_hash"), kept.select(*key, "content_hash", "version"), key, ["n"])
    assert {r.action for r in again.collect()} == {"skip"}


@pytest.mark.parametrize(
    "code, value, unit, expected",
    [("4548-4", 48.0, "mmol/mol", (6.54, "%")), ("2339-0", 5.5, " MMOL/L ", (99.1, "mg/dL")), ("2160-0", 88.0, "µmol/L", (1.0, "mg/dL")), ("2093-3", 123.456, "MG/DL", (123.456, "mg/dL")), ("2093-3", 5.0, "odd", (5.0, "mg/dL")), ("9-9", 5.0, "x", (5.0, "x")), (None, 1.0, None, (1.0, None))],
)
def test_units(spark, code, value, unit, expected):
    r = normalize_units(spark.createDataFrame([(code, value, unit)], "code_value string, value double, unit string")).first()
    assert (r.norm_value, r.norm_unit) == (pytest.approx(expected[0]), expected[1])


def test_collapse_keeps_nulls_as_a_key(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "x", "a")], "id int, code string, src string")
    got = sorted((r.id, r.sources, r.n_rows) for r in U.collapse(df, ["code"], ["id"], "src").collect())
    assert got == [(1, ["a", "b"], 2), (3, ["a"], 1)]
    assert U.collapse(df.filter(F.lit(False)), ["code"], ["id"], "src").count() == 0
