import json

import pytest
from pyspark.sql import functions as F

from wardline.functions import entities as E


@pytest.mark.parametrize(
    "said, expected",
    [
        ("Glucose 95 mg/dL (70-99) H", ("Glucose", 95.0, "mg/dL", 70.0, 99.0, "H")),
        ("Hemoglobin A1c 6.8 %", ("Hemoglobin A1c", 6.8, "%", None, None, None)),
        ("TSH 2.1 mIU/L", ("TSH", 2.1, "mIU/L", None, None, None)),
        ("Sodium: 140, normal", ("Sodium", 140.0, None, None, None, "N")),
        ("Strep test positive", ("Strep test positive", None, None, None, None, "POS")),
        ("B12", ("B12", None, None, None, None, None)),
        ("Potassium 3.1 critical low", ("Potassium", 3.1, None, None, None, "LL")),
    ],
)
def test_lab(spark, said, expected):
    r = spark.createDataFrame([(said,)], "s string").select(E.parse_lab(F.col("s")).alias("x")).first().x
    assert (r.analyte, r.value, r.unit, r.ref_low, r.ref_high, r.interpretation) == expected


ROWS = [
    ("medication", "Flu shot", None, None, "immunization"),
    ("medication", "Fluconazole 150 mg", None, None, "medication"),
    ("medication", "NSAIDs", None, None, None),
    ("medication", "x7", None, None, None),
    ("medication", "Vitamin D", None, None, "medication"),
    ("medication", "B12", None, None, "medication"),
    ("procedure", "Appendectomy", None, None, "procedure"),
    ("procedure", "Colonoscopy", "recommend colonoscopy", None, None),
    ("procedure", "Colonoscopy", "s/p colonoscopy 2020", None, "procedure"),
    ("procedure", "Colonoscopy", None, "completed", "procedure"),
    ("vital", "120/80 mmHg", None, None, None),
    ("vital", "Pulse 71 bpm", None, None, "observation"),
    ("vital", "Alcohol: 2 a week", None, None, "observation"),
    ("lab_result", "CBC", None, None, "service_request"),
    ("condition", "[PATIENT] [ZIP]", None, None, None),
    ("condition", "Asthma", None, "active", "condition"),
    ("family_history", "Gout", None, None, "family_history"),
    ("provider", "Dr Reed", None, None, None),
    ("condition", None, None, None, None),
]


def test_records(spark):
    df = spark.createDataFrame([(1, i, c, t, x, s) for i, (c, t, x, s, _) in enumerate(ROWS)], "doc_id long, pos int, entity_class string, text string, context string, status string")
    got = {r.pos: r for r in E.to_records(df).collect()}
    assert {i: (got[i].record_type if i in got else None) for i in range(len(ROWS))} == {i: r[4] for i, r in enumerate(ROWS)}
    pulse = json.loads(got[11].resource_json)
    assert pulse["code"] == {"text": "Pulse 71 bpm"} and pulse["valueString"] == "Pulse 71 bpm" and pulse["status"] == "final"
    assert json.loads(got[1].resource_json)["dosageInstruction"][0]["doseAndRate"][0]["doseQuantity"] == {"value": 150.0, "unit": "mg"}
    alcohol = json.loads(got[12].resource_json)
    assert alcohol["code"] == {"text": "Alcohol"} and alcohol["valueString"] == "2 a week" and got[12].display_text == "Alcohol: 2 a week"
    lacking = E.to_records(df).select("pos", E.missing_fields(F.col("resource_json")).alias("m")).collect()
    assert all(r.m == [] for r in lacking)


FILTERED = [
    ("vital", "Diet: avoid salt", None, None, False),
    ("social_history", "Quit smoking", None, None, False),
    ("social_history", "Former smoker", None, None, True),
    ("vital", "avid tennis player", None, None, False),
    ("vital", "works as a nurse", None, None, False),
    ("vital", "low fodmap diet", None, None, False),
    ("vital", "Only vape no cigarette smoke", None, None, False),
    ("vital", "former smoker of cigarettes", None, None, True),
    ("vital", "tennis elbow 3", None, None, True),
    ("vital", "5' 9\"", None, None, False),
    ("procedure", "Appendectomy", "plan to do so", None, False),
    ("procedure", "Colonoscopy", "in 2019", None, True),
    ("procedure", "Colonoscopy", "recommend", "completed", False),
    ("medication", "D", None, None, False),
    ("medication", "omega-3", None, None, True),
    ("condition", "seen by [NAME] for gout", None, None, False),
]


def test_filters(spark):
    df = spark.createDataFrame([(1, i, *r[:4]) for i, r in enumerate(FILTERED)], "doc_id long, pos int, entity_class string, text string, context string, status string")
    assert {r.pos for r in E.to_records(df).collect()} == {i for i, r in enumerate(FILTERED) if r[4]}


def test_resources_by_class(spark):
    said = [
        ("encounter", "Follow-up", {"visit_type": "telehealth", "summary": "BP < 120 & fine", "facility": "North Clinic", "date": "2024-01-02"}),
        ("family_history", "gout", {"relationship": "mother", "notes": "late"}),
        ("assessment_plan", "rest", {"plan_items": "rest; walk"}),
        ("imaging_result", "MRI", {"findings": "clear", "category": "imaging_study"}),
        ("allergy", "Penicillin", {"reaction": "hives"}),
        ("immunization", "Tdap", {"status": "declined", "lot": "7"}),
        ("lab_result", "Glucose 95 mg/dL (70-99)", {"value": "96", "flag": "H"}),
        ("condition", "Gout", {"status": "ruled_out", "since": "2020"}),
        ("medication", "Metformin 500 mg twice daily as needed", {"value": "500", "unit": "mg"}),
    ]
    df = spark.createDataFrame([(1, i, c, t, None, None, a, "Dr Reed") for i, (c, t, a) in enumerate(said)], "doc_id long, pos int, entity_class string, text string, context string, status string, attributes map<string,string>, provider string")
    rows = {r.pos: r for r in E.to_records(df).collect()}
    x = {i: json.loads(r.resource_json) for i, r in rows.items()}
    assert x[0]["class"] == {"code": "VR", "display": "virtual"} and x[0]["text"]["div"] == '<div xmlns="http://www.w3.org/1999/xhtml">BP &lt; 120 &amp; fine</div>' and x[0]["participant"] == [{"individual": {"display": "Dr Reed"}}] and rows[0].display_text == "Telehealth encounter — 2024-01-02"
    assert x[1]["relationship"]["coding"][0]["code"] == "MTH" and x[1]["condition"] == [{"code": {"text": "gout"}, "note": [{"text": "late"}]}] and rows[1].display_text == "Mother: gout"
    assert x[2]["content"][0]["attachment"]["data"] == "cmVzdA==" and rows[2].display_text == "Assessment & Plan (2 items)"
    assert x[3]["conclusion"] == "clear" and x[3]["category"][0]["coding"][0]["display"] == "Imaging Study" and x[3]["performer"] == [{"display": "Dr Reed"}]
    assert x[4]["reaction"] == [{"manifestation": [{"text": "hives"}]}] and rows[4].display_text == "Penicillin — hives"
    assert x[5]["status"] == "not-done" and x[5]["lotNumber"] == "7"
    assert x[6]["valueQuantity"] == {"value": 96.0, "unit": "mg/dL"} and x[6]["referenceRange"] == [{"low": {"value": 70.0}, "high": {"value": 99.0}}] and x[6]["interpretation"][0]["coding"][0]["code"] == "H" and rows[6].display_text == "Glucose 95 mg/dL (70-99): 96"
    assert x[7]["clinicalStatus"]["coding"][0]["code"] == "inactive" and x[7]["onsetDateTime"] == "2020"
    dose = x[8]["dosageInstruction"][0]
    assert x[8]["intent"] == "order" and dose["timing"]["repeat"]["frequency"] == 2 and dose["asNeeded"] is True and rows[8].display_text.endswith("500mg")
