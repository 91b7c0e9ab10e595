import hashlib
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardline.functions import fhir
from wardline.plans import registry
from wardline.sources import fhir_bundle

BUNDLE = str(Path(__file__).parent / "data" / "bundle.json")


@pytest.fixture(scope="module")
def rows(spark):
    e = fhir_bundle.entries(spark, BUNDLE)
    return e.withColumn("rid", fhir.text("resource", "$.id"))


@pytest.fixture(scope="module")
def records(rows):
    p = fhir.project(rows)
    p = p.withColumn("provider", fhir.provider("resource")).withColumn("preview", fhir.preview("resource", F.col("record_type"))).withColumn("reading", fhir.reading("resource", F.col("display_text")))
    return {r.rid: r for r in p.drop("resource").collect()}


def test_entries(rows, records):
    assert rows.count() == 10  # the empty entry is none
    assert sorted(records) == ["a1", "c1", "e1", "m1", "o1", "o2", "r1"]  # no patient, practitioner or unknown type


def test_codes_dates_and_text(records):
    assert (records["c1"].code_system, records["c1"].code_value, records["c1"].code_display) == ("http://snomed.info/sct", "195967001", "Asthma disorder")
    assert records["c1"].display_text == "Asthma"
    assert records["c1"].status == "active"
    assert records["c1"].category == ["problem-list-item", "chronic"]
    assert records["c1"].effective_date == datetime(2019, 3, 1)
    assert records["o1"].display_text == "HbA1c"
    assert records["o1"].effective_date == datetime(2024, 1, 2, 16, 30)
    assert records["o2"].effective_date is None  # the first date that is set decides, readable or not
    assert records["r1"].effective_date is None  # the date of a procedure is no date field
    assert records["e1"].display_text == "Office visit"
    assert records["e1"].effective_date_end == datetime(2024, 2, 1, 10, 30)
    assert records["m1"].code_value is None and records["m1"].display_text == "Metformin 500 mg"


def test_readings_and_people(records):
    o = records["o1"].reading
    assert (o.value, o.unit, o.ref_low, o.ref_high, o.interpretation) == (6.8, "%", 4.0, 5.6, "H")
    assert records["o2"].reading.value is None and records["o2"].reading.value_text == "128/78"
    assert records["o1"].provider == "Dr Reed"
    assert records["e1"].provider == "Practitioner/d1"


def test_previews(records):
    p = records["o1"].preview
    assert (p.value, p.unit, p.flag, p.emphasis, p.low, p.high) == ("6.8", "%", "HIGH", "notable", 4.0, 5.6)
    assert records["o2"].preview.value == "128/78" and records["o2"].preview.unit == "mmHg"
    assert records["a1"].preview.flag == "HIGH" and records["a1"].preview.facets == ["Hives", "Rash"]
    assert records["m1"].preview.value == "500 mg" and records["m1"].preview.emphasis == "muted" and records["m1"].preview.facets == ["oral"]
    assert records["e1"].preview.flag == "Ambulatory" and records["e1"].preview.facets == ["Cough"]
    assert records["c1"].preview.facets == ["onset 2019"]


def test_identity_and_hash(spark, records):
    assert (records["c1"].source_system, records["c1"].external_id) == ("fhir", "Condition/c1")
    docs = [('{"a":1,"meta":{"lastUpdated":"x"},"b":[1,2]}',), ('{"b":[1,2],"a":1,"text":"t","meta":{"versionId":"2"}}',), ('{"a":2,"b":[1,2]}',)]
    h = [r.h for r in spark.createDataFrame(docs, "j string").select(F.parse_json("j").alias("r")).select(fhir.resource_hash("r").alias("h")).collect()]
    assert h[0] == h[1] != h[2]


def test_names_and_patient(rows):
    people = {r.pos: r.people for r in fhir_bundle.encounter_people(rows).collect()}
    assert list(people.values()) == [["Dr Sam Hale", "Nurse Wren"]]
    p = fhir_bundle.patient(rows).first()
    assert (p["name"], p.mrn, p.birth_date, p.sex) == ("Ada B Quill", "m7", "1980-02-03", "female")


@pytest.mark.parametrize(
    "fmt, system, label",
    [("fhir_r4", "Mercy Clinic", "Mercy Clinic"), ("fhir_r4", "urn:oid:2.16", "FHIR R4"), ("cda_r2", "2.16.840", "CDA"), ("x_y", None, "X Y"), (None, None, "Unknown"), ("epic_ehi", "fhir", "FHIR R4")],
)
def test_source_label(spark, fmt, system, label):
    df = spark.createDataFrame([(fmt, system)], "f string, s string")
    assert df.select(fhir.source_label(F.col("f"), F.col("s")).alias("x")).first().x == label


def test_broken_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text("{broken")
    (tmp_path / "b.json").write_text('{"resourceType": "Condition", "id": "q", "code": {"text": "Gout"}}')
    got = fhir_bundle.records(spark, str(tmp_path)).collect()
    assert [(r.display_text, r.external_id) for r in got] == [("Gout", "Condition/q")]


def test_fields_give_what_paths_give(rows):
    """A resource taken apart once against one that is asked path by path."""
    f = fhir.Fields(F.col("f"))
    x = rows.withColumn("f", fhir.fields("resource")).withColumn("kind", F.lit("observation"))
    for what in (fhir.effective_date, fhir.effective_date_end, fhir.status, fhir.categories, fhir.coding, fhir.display_text, fhir.provider, fhir.resource_hash, lambda r: fhir.identity(r, F.lit("fhir_r4")), lambda r: fhir.identity(r, F.lit("cda_r2")), lambda r: fhir.preview(r, F.col("kind")), lambda r: fhir.reading(r, F.lit("d"))):
        for a, b in x.select(what("resource").alias("a"), what(f).alias("b")).collect():
            assert a == b


ODD = [
    "null", "[]", "7", "{}", '{"effectivePeriod":{},"period":{"start":"2001"}}', '{"effectivePeriod":null,"period":{"start":"2001"}}', '{"effectivePeriod":"x","period":[1]}', '{"effectivePeriod":{"start":{"a":1},"end":"2002-03-04T05:06"},"period":"2001"}',
    '{"date":"","issued":5,"meta":{"lastUpdated":"2003-04-05T06:07Z"}}', '{"sent":"T12:00","meta":[1]}', '{"start":"2003\\n"}', '{"id":7,"resourceType":"Observation","identifier":[]}', '{"id":"a-b","resourceType":"Observation","identifier":[{"system":"","value":3},{"system":"s","value":"v"}]}',
    '{"id":"ab","resourceType":"Observation","identifier":{"value":"v"},"category":{"text":"t"}}', '{"resourceType":"Observation","identifier":[null,{"value":"v"}],"category":[{"coding":[{"code":""},{"code":1}]},{"text":""},null,{"text":"VITAL"}]}',
]


def test_typed_and_parts_give_what_paths_give(spark, rows):
    """A resource read as a struct, and one read where it lies in a list, against one that is asked path by path."""
    one = spark.createDataFrame([(d,) for d in ODD], "j string").union(rows.select(F.to_json("resource").alias("j")))
    x = one.select(F.parse_json("j").alias("resource"), F.parse_json(F.concat(F.lit("[0,"), "j", F.lit("]"))).alias("docs"))
    part = fhir.Part(F.col("docs"), "$[1]")
    x = x.withColumn("t", fhir.typed(part))
    for what in (fhir.effective_date, fhir.effective_date_end, fhir.categories, fhir.resource_type, lambda r: fhir.identity(r, F.lit("fhir_r4")), lambda r: fhir.identity(r, F.lit("cda_r2"))):
        for a, b, c in x.select(what("resource").alias("a"), what(fhir.Typed(F.col("t"))).alias("b"), what(part).alias("c")).collect():
            assert a == b == c
    for a, b in x.select(fhir.resource_hash("resource").alias("a"), fhir.resource_hash(part).alias("b")).collect():
        assert a == b


def test_resource_hash_lines(spark):
    """What is hashed: lines of keys and JSON in order, those of meta last, volatile ones left out."""
    j = '{"b":{"y":[1.50,null],"x":"\\u00e9\\n"},"a 1":"q","a":1e3,"text":"no","meta":{"source":"no","tag":[{"c":"1","a":true}]},"_extraction_metadata":1}'
    got = spark.sql("SELECT 1").select(fhir.resource_hash(F.parse_json(F.lit(j)))).first()[0]
    assert got == hashlib.sha256('a 1:"q"\na:1000.0\nb:{"x":"é\\n","y":[1.5,null]}\nmeta.tag:[{"a":true,"c":"1"}]'.encode()).hexdigest()


def test_texts_of_dates_and_parses_are_computed_once(spark):
    """A date's text is named once by what reads it; the three resources of a line are one parse, and no field of one is looked up by a path of its own."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(spark.range(3).select(fhir.parse_date(F.reverse(F.col("id").cast("string"))).alias("d"))).count("reverse") == 1
    told = plan(registry.queries()["q108_resource_fields"](spark, "/root/testdata/sf0.001"))
    assert told.count("parseJson") == 1 and told.count("element_at") == 0


def test_subtype_of_category(spark):
    cases = [(["VITAL-signs"], "vital"), (["x", "Social history", "vital"], "social"), (["Laboratory"], "lab"), (["x"], "lab"), ([], "lab"), (None, "lab"), ([None, "sociAL"], "social")]
    got = spark.createDataFrame([(c,) for c, _ in cases], "c array<string>").select(fhir.observation_subtype(F.col("c")).alias("s")).collect()
    assert [r.s for r in got] == [s for _, s in cases]


def test_projection_tries_no_path_of_a_whole_resource(rows):
    """Fields a resource lacks are looked up in a map; only its map is taken from the whole."""
    plan = fhir.project(rows).select("effective_date", "status", "category", "code_value", "display_text", "external_id", "content_hash")._jdf.queryExecution().analyzed().toString()
    assert "$.effectiveDateTime" not in plan and "$.clinicalStatus" not in plan


def test_entries_of_odd_shapes(spark):
    docs = ['{"resourceType":"Bundle","entry":[1,null,{},{"fullUrl":7,"resource":{"resourceType":"A"}},{"resourceType":"B","id":"b"},{"resource":null,"resourceType":"C"},{"resource":{"resourceType":""}},{"fullUrl":"u","resource":[]}]}']
    got = fhir_bundle.from_documents(spark.createDataFrame([("f", d) for d in docs], "file string, j string").select("file", F.parse_json("j").alias("doc")))
    assert [(r.pos, r.full_url, r.t) for r in got.select("pos", "full_url", fhir.text("resource", "$.resourceType").alias("t")).orderBy("pos").collect()] == [(3, "7", "A"), (4, None, "B")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("struct<fullUrl") <= 2
