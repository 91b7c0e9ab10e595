import hashlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wardline.functions import clinical, fhir
from wardline.functions.dates import entity_date, first_date, real_date
from wardline.operators import review, terminology

WRITTEN = [
    ("seen 2024-09-24, again 2025-01-01", date(2024, 9, 24)),
    ("BP 120/80, visit 9/2024", date(2024, 9, 1)),
    ("on 24/09/2024", date(2024, 9, 24)),
    ("SEPT. 4, 2019 and later", date(2019, 9, 4)),
    ("since May 2020", date(2020, 5, 1)),
    ("Feb 30, 2020", None),
    ("120/80, 20241, Marchand 2020", None),
    ("", None),
    (None, None),
]


def test_first_date(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(WRITTEN)], "i int, s string")
    got = df.orderBy("i").select(F.to_date(first_date(F.col("s"))).alias("d")).collect()
    assert [r.d for r in got] == [d for _, d in WRITTEN]


def test_entity_date(spark):
    day = datetime(2001, 2, 3)
    rows = [
        ({"onset_date": "2020-01-02", "date": "1999"}, "2010-01-01", "condition", date(1999, 1, 1)),
        ({"note": "told 3/2018", "date": "unknown"}, "2010-01-01", "condition", date(2018, 3, 1)),
        ({}, "in 2010-01-05", "condition", date(2010, 1, 5)),
        ({}, "none", "condition", date(2001, 2, 3)),
        (None, None, None, date(2001, 2, 3)),
        ({}, "none", "family_history", None),
    ]
    df = spark.createDataFrame([(i, a, s, c, day) for i, (a, s, c, _) in enumerate(rows)], "i int, a map<string,string>, s string, c string, d timestamp")
    x = df.select("i", F.to_date(entity_date(F.col("a"), F.col("s"), F.col("c"), F.col("d"))).alias("x"), F.to_date(real_date(F.lit("2020-01-01").cast("timestamp"), F.col("c"), F.col("d"))).alias("y")).orderBy("i").collect()
    assert [r.x for r in x] == [r[3] for r in rows]
    assert x[0].y == date(2001, 2, 3) and x[5].y == date(2020, 1, 1)


ALIASES = [("lisinopril", "29046", "Lisinopril"), ("vitamin b12", "11248", "B12"), ("hypertension", "I10", "Hypertension"), ("21 hydroxylase deficiency", "E25", "21-OHD"), ("lisinopril", "99999", "later code")]


@pytest.mark.parametrize(
    "term, fuzzy, expected",
    [
        ("Lisinopril", False, ("29046", "exact")),
        ("lisinopril tablet 10 mg", False, ("29046", "first word")),
        ("daily lisinopril", False, ("29046", "last word")),
        ("lisinoprill", False, (None, None)),
        ("lisinoprill", True, ("29046", "close")),
        ("deficiency", True, (None, None)),  # part of an alias, but no spelling of it
        ("", True, (None, None)),
        (None, True, (None, None)),
    ],
)
def test_look_up(spark, term, fuzzy, expected):
    a = spark.createDataFrame(ALIASES, "alias string, code string, display string")
    df = spark.createDataFrame([(term, 1), (term, 2)], "t string, i int")
    rows = terminology.look_up(df, a, "t", last_word=True, fuzzy=fuzzy).collect()
    assert [(r.code, r.matched) for r in rows] == [expected] * 2


def test_close_spellings_among_many_aliases(spark):
    """Far more aliases than a task would compare one by one, none of them broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("alias"), F.col("id").cast("string").alias("code"), F.lit("d").alias("display"))
        df = spark.createDataFrame([(i, h[:9] + h[10:]) for i, h in ((i, hashlib.md5(str(i).encode()).hexdigest()) for i in range(0, 60_000, 3_000))], "id int, t string")
        got = {r.id: (r.code, r.matched) for r in terminology.look_up(df, many, "t", fuzzy=True).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: (str(i), "close") for i in range(0, 60_000, 3_000)}


def test_review(spark):
    c = spark.createDataFrame([(i, 10 + i, 20 + i, "u", "pending") for i in range(6)], "candidate_id int, id_a int, id_b int, upload_id string, status string")
    asked = spark.createDataFrame([(0, "merge"), (1, "update"), (2, "dismiss"), (3, "keep_both"), (4, "merge"), (5, "what")], "candidate_id int, action string")
    there = spark.createDataFrame([(x,) for i in range(6) for x in (10 + i, 20 + i) if x != 24], "id int")
    done = review.resolve_review(c, asked, there)
    assert [r.status for r in done.orderBy("candidate_id").collect()] == ["merged", "merged", "dismissed", "dismissed", "pending", "pending"]
    assert review.upload_states(done).first().asDict() == {"upload_id": "u", "n_pending": 2, "ingestion_status": "awaiting_review"}
    back = review.undo(done, c.filter("candidate_id < 3").select("candidate_id"), "dismissed")
    assert [r.status for r in back.orderBy("candidate_id").collect()][:3] == ["dismissed"] * 3


def test_replace_extracted(spark):
    df = spark.createDataFrame([(1, 7, True, None), (2, 7, False, None), (3, 8, True, None), (4, 7, True, datetime(2020, 1, 1)), (5, None, True, None)], "id int, source_file_id int, ai_extracted boolean, deleted_at timestamp")
    rows, provenance = review.replace_extracted(df, spark.createDataFrame([(7,), (7,)], "source_file_id int"), F.lit("2030-01-01").cast("timestamp"))
    assert {r.id: r.deleted_at and r.deleted_at.year for r in rows.collect()} == {1: 2030, 2: None, 3: None, 4: 2020, 5: None}
    assert [r.record_id for r in provenance.collect()] == [1]


def test_titles(spark):
    rows = [
        ('{"resourceType":"Observation"}', "Glucose", "observation", "Glucose"),
        ('{"resourceType":"Immunization","vaccineCode":{"text":" ","coding":[{"code":"213"}]}}', "Immunization", "immunization", "213"),
        ('{"resourceType":"Encounter","type":[{"text":"Office visit"}]}', "Encounter", "encounter", "Office visit"),
        ('{"resourceType":"ImagingStudy"}', " ", "imaging", "Imaging study"),
        ('{"resourceType":"CarePlan","title":"Plan A"}', None, "care_plan", "Plan A"),
        ('{"resourceType":"CarePlan"}', None, "care_plan", "Care plan"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, j string, shown string, kind string, want string")
    x = df.withColumn("r", F.parse_json("j")).select("i", "want", fhir.record_title("r", F.col("shown"), F.col("kind")).alias("got"))
    assert [(r.i, r.got) for r in x.orderBy("i").collect()] == [(i, r[3]) for i, r in enumerate(rows)]


def test_lab_lines_that_repeat_are_read_once(spark):
    """Lines are counted before they are read, so the patterns run per line that differs."""
    from wardline.plans.clinical import q_lab_lines

    plan = q_lab_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2


def test_only_results_and_drugs_are_read_as_such(spark):
    from wardline.functions import entities

    rows = [(1, 1, "lab_result", "Glucose 95 mg/dL (70-99) H"), (1, 2, "medication", "Aspirin 81 mg po daily"), (1, 3, "condition", "Asthma 5 mg po (1-2)")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id int, pos int, entity_class string, text string, context string, status string")
    made = entities.to_records(df)
    got = {r.pos: r.resource_json for r in made.collect()}
    assert '"value":95.0' in got[1] and '"low":{"value":70.0}' in got[1] and '"code":"H"' in got[1]
    assert '"frequency":1' in got[2] and '"text":"oral"' in got[2] and "dosage" not in got[3]
    # The class is told in one place, whatever names it.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("chickenpox") == 1


def test_a_sig_is_read_where_something_of_it_is_said(spark):
    said = {"Drug 3": (None, None, None, None, False), None: (None, None, None, None, False), "5mg": (5.0, "mg", None, None, False), "x5%x": (5.0, "%", None, None, False), "po": (None, None, "oral", None, False), "PRN": (None, None, None, None, True), "qevery weekly": (None, None, None, 1, False), "qid": (None, None, None, 4, False), "nightly": (None, None, None, 1, False)}
    df = spark.createDataFrame([(s,) for s in said], "s string")
    rows = df.select("s", clinical.parse_dosage(F.col("s")).alias("x"), F.coalesce(F.col("s").rlike(clinical.SIG_HINT), F.lit(False)).alias("hinted")).collect()
    got = {r.s: (r.x.dose_value, r.x.dose_unit, r.x.route, r.x.frequency, r.x.as_needed) for r in rows}
    assert {r.s: r.hinted for r in rows} == {s: x != (None, None, None, None, False) for s, x in said.items()}
    assert got == said
