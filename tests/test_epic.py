import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardline.functions.clinical import normalize_term, parse_dosage
from wardline.sources import epic


def load(spark, tmp_path, name, columns, *rows):
    (tmp_path / f"{name}.tsv").write_bytes(("﻿" + "\t".join(columns) + "\r\n" + "".join("\t".join(r) + "\r\n" for r in rows)).encode())
    return epic.records(spark, str(tmp_path / f"{name}.tsv"), name).collect()


def test_problem_list(spark, tmp_path):
    got = load(spark, tmp_path, "PROBLEM_LIST", ["PROBLEM_LIST_ID", "DX_ID_DX_NAME", "DESCRIPTION", "NOTED_DATE", "RESOLVED_DATE", "PROBLEM_STATUS_C_NAME", "CHRONIC_YN", "PROBLEM_CMT"], ["7", "Asthma", "", "5/21/2024 12:00:00 AM", "", "Active", "Y", "mild"], ["8", " ", " ", "", "", "", "", ""], ["", "Gout", "", "", "1/2/2023", "", "N", ""])
    by = {r.display_text: r for r in got}
    assert set(by) == {"Asthma", "Gout"}
    a = json.loads(by["Asthma"].resource_json)
    assert (by["Asthma"].external_id, by["Asthma"].source_system, by["Asthma"].effective_date) == ("7", "epic:PROBLEM_LIST", datetime(2024, 5, 21))
    assert a["category"][1] == {"text": "chronic"} and a["note"] == [{"text": "mild"}]
    assert by["Gout"].status == "resolved" and by["Gout"].external_id is None


def test_results(spark, tmp_path):
    got = load(spark, tmp_path, "ORDER_RESULTS", ["ORDER_PROC_ID", "LINE", "COMPONENT_ID_NAME", "ORD_VALUE", "ORD_NUM_VALUE", "REFERENCE_LOW", "REFERENCE_HIGH", "REFERENCE_UNIT", "RESULT_DATE", "RESULT_FLAG_C_NAME"], ["1", "2", "LDL", "131", "131", "0", "100", "mg/dL", "2024-01-02", "High"], ["1", "3", "Color", "Yellow", "", "", "x", "", "", ""])
    ldl, color = sorted((json.loads(r.resource_json) for r in got), key=lambda r: r["code"]["text"] != "LDL")
    assert ldl["valueQuantity"] == {"value": 131.0, "unit": "mg/dL"} and ldl["interpretation"][0]["coding"][0]["code"] == "H"
    assert ldl["referenceRange"] == [{"low": {"value": 0.0, "unit": "mg/dL"}, "high": {"value": 100.0, "unit": "mg/dL"}}]
    assert color["valueString"] == "Yellow" and "referenceRange" not in color and "interpretation" not in color


def test_medication(spark, tmp_path):
    got = load(spark, tmp_path, "ORDER_MED", ["ORDER_MED_ID", "DISPLAY_NAME", "DOSAGE", "MED_ROUTE_C_NAME", "ORDER_STATUS_C_NAME", "START_DATE", "QUANTITY"], ["5", "Metformin", "500 mg by mouth twice daily", "Oral", "Discontinued", "1/2/2024", "30"])
    m = json.loads(got[0].resource_json)
    d = m["dosageInstruction"][0]
    assert m["status"] == "cancelled" and d["doseAndRate"][0]["doseQuantity"] == {"value": 500.0, "unit": "mg"}
    assert d["timing"]["repeat"] == {"frequency": 2, "period": 1, "periodUnit": "d"} and d["route"] == {"text": "Oral"}
    assert m["dispenseRequest"] == {"quantity": {"value": "30"}} and m["effectivePeriod"] == {"start": "2024-01-02T00:00:00"}


OTHERS = {
    "MEDICAL_HX": ({"DX_ID_DX_NAME": "Mumps"}, "condition", "Mumps"),
    "PAT_ENC": ({"CONTACT_DATE": "1/2/2024", "ENC_TYPE_C_NAME": "Visit", "VISIT_PROV_ID_PROV_NAME": "Reed", "VISIT_PROV_TITLE_NAME": "MD"}, "encounter", "Visit"),
    "DOC_INFORMATION": ({"DOC_INFO_TYPE_C_NAME": "Consent", "DOC_STAT_C_NAME": "Inactive"}, "document", "Consent"),
    "ALLERGY": ({"ALLERGEN_ID_ALLERGEN_NAME": "Latex", "SEVERITY_C_NAME": "Low"}, "allergy", "Latex"),
    "IMMUNE": ({"IMMUNZATN_ID_NAME": "Flu"}, "immunization", "Flu"),
    "ORDER_PROC": ({"PROC_NAME": "X-ray"}, "procedure", "X-ray"),
    "IP_FLWSHT_MEAS": ({"DISP_NAME": "Pulse", "MEAS_VALUE": "71"}, "observation", "Pulse"),
    "REFERRAL": ({"RSN_FOR_RFL_C_NAME": "Knee"}, "service_request", "Knee"),
    "PAT_ENC_DX": ({"DX_ID_DX_NAME": "Flu", "PRIMARY_DX_YN": "Y"}, "condition", "Flu"),
    "SOCIAL_HX": ({"COMMENT": "never"}, "observation", "Social History"),
    "FAMILY_HX": ({"FAM_MEDICAL_DX_ID_DX_NAME": "Gout", "RELATION_C_NAME": "Father", "AGE_OF_ONSET": "40"}, "condition", "Gout (Father)"),
    "PROBLEM_LIST_ALL": ({"DESCRIPTION": "Anemia"}, "condition", "Anemia"),
}


@pytest.mark.parametrize("name", OTHERS)
def test_other_tables(spark, tmp_path, name):
    row, kind, shown = OTHERS[name]
    got = load(spark, tmp_path, name, list(row), list(row.values()), ["" for _ in row])
    assert [(r.record_type, r.display_text) for r in got] == [(kind, shown)]


@pytest.mark.parametrize(
    "sig, expected",
    [("Take 500 mg by mouth twice daily", (500.0, "mg", "oral", 2, "d", False)), ("inhale 2 puffs q6h prn", (2.0, "puffs", None, 4, "d", True)), ("weekly SC", (None, None, "subcutaneous", 1, "wk", False)), (None, (None, None, None, None, None, False))],
)
def test_dosage(spark, sig, expected):
    r = spark.createDataFrame([(sig,)], "s string").select(parse_dosage(F.col("s")).alias("d")).first().d
    assert (r.dose_value, r.dose_unit, r.route, r.frequency, r.period_unit, r.as_needed) == expected


@pytest.mark.parametrize("raw, term", [("Crohn's disease (mild)", "crohns disease"), ("Lisinopril 10 mg tablets", "lisinopril tablets"), (None, ""), ("A/B--C", "a b c")])
def test_terms(spark, raw, term):
    assert spark.createDataFrame([(raw,)], "s string").select(normalize_term(F.col("s")).alias("t")).first().t == term
