import zipfile

import pytest
from pyspark.sql import functions as F

from wardline.functions.deident import scrub, scrub_known, scrub_report
from wardline.operators import text as T
from wardline.sources import cda, files
from wardline.streaming import ingest


@pytest.mark.parametrize(
    "said, clean",
    [
        ("SSN 123-45-6789.", "SSN [SSN]."),
        ("call (555) 123-4567 or fax: 555-123-4568", "call ([PHONE] or fax: [PHONE]"),
        ("mail a.b@c.org from 10.0.0.1", "mail [EMAIL] from [IP]"),
        ("born July 14, 2023, seen 14 July 2023, 2023-07-14, 07/14/2023", "born 2023, seen 2023, 2023, 2023"),
        ("a 95-year-old, aged 88, age: 101", "a 90+-year-old, aged 88, age: 90+"),
        ("at 275 Post Rd E, Suite 4", "at [LOCATION]"),
        ("MRN: 12345 account no. 998877", "[MRN] [ACCOUNT]"),
    ],
)
def test_scrub(spark, said, clean):
    got = spark.createDataFrame([(said,)], "text string").select(scrub(F.col("text")).alias("t")).first().t
    assert got == clean


def test_scrub_report_and_known(spark):
    r = scrub_report(spark.createDataFrame([("x@y.org 1.2.3.4 z@y.org 2020-01-02",), (None,)], "text string")).collect()
    assert r[0].counts == {"email": 2, "ip_address": 1, "dates_generalized": 1} and r[1].scrubbed is None
    df = spark.createDataFrame([("Ada Quill, ada@ 12 Elm Way, m77, 1980-02-03", ["Ada Quill"], "m77", "1980-02-03", "12 Elm Way, X")], "text string, names array<string>, mrn string, dob string, address string")
    assert scrub_known(df).first().text == "[PATIENT] [PATIENT], [PATIENT]@ [LOCATION], [MRN], [DATE]"


def test_sections_cover_the_text():
    text = "intro\nMedications:\nx\nPlan:\ny"
    got = T.sections_of(text, [("medications", "Medications:"), ("nope", "Plan:"), ("labs", "Labs:")])
    assert got == [("other", "Preamble", 0, 6), ("medications", "Medications:", 6, 21), ("other", "Plan:", 21, len(text))]
    assert T.sections_of(text, []) == [("other", "Full Document", 0, len(text))]


def test_chunks():
    text = "\n\n".join(f"{i} " + "w" * 700 for i in range(6))
    chunks = T.split_section(text)
    assert all(len(c) <= 2000 + 202 for c in chunks) and chunks[1].startswith(chunks[0][-200:])
    packed = T.packed_chunks("Medications:\n" + "a. " * 600 + "\nLabs:\n" + "b. " * 500, T.heading_anchors)
    assert packed[0][0] == "medications" and all(c for _, c in packed)
    assert T.packed_chunks("short", T.heading_anchors) == [("other", "short")]


def test_entities(spark):
    docs = spark.createDataFrame([(1, "Patient denies chest pain. Takes metformin daily. Mother had asthma."), (2, None)], "doc_id long, text string")
    terms = spark.createDataFrame([("chest pain", "DISEASE", "29857009"), ("metformin", "CHEMICAL", "6809"), ("asthma", "DISEASE", "195967001")], "term string, label string, code string")
    assert {(r.doc_id, r.term, r.pos) for r in T.find_terms(docs, terms).collect()} == {(1, "chest pain", 2), (1, "metformin", 5), (1, "asthma", 9)}
    spans = spark.createDataFrame([("DISEASE", "denies", ""), ("DISEASE", "mother had", ""), ("DISEASE", "history of", ""), ("DISEASE", "if you develop", ""), ("CHEMICAL", "not taking", ""), ("CHEMICAL", "takes", "")], "label string, before string, after string")
    a = T.assertion(F.col("before"), F.col("after"))
    assert [r.c for r in spans.select(T.disposition(F.col("label"), a).alias("c")).collect()] == [None, "family_history", "condition", None, None, "medication"]
    e = spark.createDataFrame([(1, "procedure", "Cystectomy", 1), (1, "procedure", "cystectomy (2020)", 2), (1, "procedure", "Biopsy 2020-01-02", 3)], "doc_id long, entity_class string, text string, pos int")
    assert sorted(r.pos for r in T.first_entities(e).collect()) == [1, 3]


def test_in_document_dedup(spark):
    meds = spark.createDataFrame([(1, 1, "Metformin 500", "6809", 2), (1, 2, "metformin", "6809", 5), (1, 3, "Insulin glargine", None, 1), (1, 4, "insulin glargine", None, 4), (1, 5, "insulin aspart", None, 1)], "doc_id long, pos int, text string, code_value string, n_fields int")
    assert sorted(r.pos for r in T.best_medications(meds).collect()) == [2, 4, 5]
    enc = spark.createDataFrame([(1, 1, True, None, "2024-01-01", 9), (1, 2, False, "Reed", "2024-01-01", 1), (1, 3, False, None, "2024-01-02", 1)], "doc_id long, pos int, boilerplate boolean, provider string, day string, n_fields int").withColumn("effective_date", F.to_timestamp("day"))
    assert sorted(r.pos for r in T.best_encounters(enc).collect()) == [2, 3]


def test_files_and_zip(spark, tmp_path):
    def pack(name, members):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for k, v in members.items():
                z.writestr(k, v)

    pack("a.zip", {"IHE/METADATA.XML": "<a/>", "t/PROBLEM_LIST.tsv": "x", "schema/readme.json": "{}"})
    pack("b.zip", {"../evil.json": "{}"})
    pack("c.zip", {"bomb.json": "0" * 3_000_000})
    (tmp_path / "d.zip").write_bytes(b"no zip")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "f.tif").write_bytes(b"nope")
    (tmp_path / "g.xml").write_text("<ClinicalDocument/>")
    scanned = files.scan(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: (r.kind, r.magic_ok) for r in scanned.select("path", "kind", "magic_ok").collect()}
    assert kinds["e.pdf"] == ("pdf", True) and kinds["f.tif"] == ("tiff", False) and kinds["g.xml"] == ("cda_r2", True) and kinds["a.zip"][0] == "zip"
    got = files.routed(files.expand_zips(scanned.filter("kind = 'zip'"))).collect()
    by = {(r.path.rsplit("/", 1)[1], r.member): (r.route, bool(r.error)) for r in got}
    assert by["a.zip", "IHE/METADATA.XML"] == ("xdm", False) and by["a.zip", "t/PROBLEM_LIST.tsv"] == ("epic_ehi", False) and by["a.zip", "schema/readme.json"][0] == "skip"
    assert by["b.zip", None][1] and by["c.zip", None][1] and by["d.zip", None][1]
    assert files.rtf_text(r"{\rtf1{\fonttbl{\f0 Arial;}}\b Hello\b0\par caf\'e9}") == "Hello\ncafé"


CDA = """<?xml version="1.0"?><ClinicalDocument xmlns="urn:hl7-org:v3"><component><structuredBody>
<component><section><code code="11450-4"/><title>Problems</title><entry><act><entryRelationship><observation><id root="1.2" extension="p1"/><effectiveTime><low value="20200102"/></effectiveTime><value code="59621000" codeSystem="2.16.840.1.113883.6.96" displayName="Essential hypertension"/></observation></entryRelationship></act></entry></section></component>
<component><section><code code="10160-0"/><title>Medications</title><entry><substanceAdministration><id root="1.3"/><effectiveTime><low value="20210304"/></effectiveTime><consumable><manufacturedProduct><manufacturedMaterial><code code="314076" codeSystem="2.16.840.1.113883.6.88" displayName="Lisinopril"/></manufacturedMaterial></manufacturedProduct></consumable></substanceAdministration></entry></section></component>
<component><section><code code="99999-9"/><title>Other</title></section></component></structuredBody></component></ClinicalDocument>"""
MANIFEST = """<SubmitObjectsRequest xmlns="urn:x"><RegistryObjectList><ExtrinsicObject mimeType="text/xml"><Slot name="URI"><ValueList><Value>DOC.XML</Value></ValueList></Slot><Slot name="hash"><ValueList><Value>{}</Value></ValueList></Slot><Slot name="size"><ValueList><Value>12</Value></ValueList></Slot><Slot name="sourcePatientInfo"><ValueList><Value>PID-3|77^^^x</Value><Value>PID-5|Doe^Jane^^^^</Value><Value>PID-7|19900115</Value></ValueList></Slot></ExtrinsicObject></RegistryObjectList></SubmitObjectsRequest>"""


def test_cda_and_manifest(spark, tmp_path):
    import hashlib

    (tmp_path / "DOC.XML").write_text(CDA)
    got = sorted((r.record_type, r.code_value, r.display_text, str(r.effective_date)[:10]) for r in cda.records(spark, str(tmp_path / "DOC.XML")).collect())
    assert got == [("condition", "59621000", "Essential hypertension", "2020-01-02"), ("medication", "314076", "Lisinopril", "2021-03-04")]
    (tmp_path / "METADATA.XML").write_text(MANIFEST.format(hashlib.sha1(CDA.encode()).hexdigest()))
    m = cda.manifest(spark, str(tmp_path / "METADATA.XML"))
    r = m.first()
    assert (r.uri, r["size"], r.patient_name, r.patient_dob) == ("DOC.XML", 12, "Doe^Jane", "19900115")
    assert [x.fine for x in cda.verified(spark.read.format("binaryFile").load(str(tmp_path / "DOC.XML")), m).collect()] == [True]


def bundle(*rows):
    return '{"resourceType":"Bundle","entry":[' + ",".join(f'{{"resource":{{"resourceType":"Condition","id":"{i}","code":{{"text":"{t}"}}}}}}' for i, t in rows) + "]}"


def test_stream_equals_batch(spark, tmp_path):
    src, out, chk = tmp_path / "in", tmp_path / "out", tmp_path / "chk"
    src.mkdir()
    (src / "1.json").write_text(bundle(("a", "Gout"), ("b", "Flu")))
    (src / "1copy.json").write_text(bundle(("a", "Gout"), ("b", "Flu")))
    ingest.run(spark, str(src), str(out), str(chk))
    (src / "2.json").write_text(bundle(("a", "Gout, acute"), ("c", "Cough"), ("b", "Flu")))
    ingest.run(spark, str(src), str(out), str(chk))
    got = {r.external_id: (r.display_text, r.version) for r in ingest.latest(spark, str(out)).collect()}
    assert got == {"Condition/a": ("Gout, acute", 2), "Condition/b": ("Flu", 1), "Condition/c": ("Cough", 1)}
    old = spark.read.parquet(f"{out}/versions").collect()
    assert [(r.external_id, r.display_text, r.version) for r in old] == [("Condition/a", "Gout", 1)]
    ingest.run(spark, str(src), str(out), str(chk))
    assert len(ingest.latest(spark, str(out)).collect()) == 3


def test_scores(spark):
    p = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "id int, predicted boolean")
    t = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False)], "id int, actual boolean")
    r = T.precision_recall(p, t).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)


def test_hints_hide_no_find(spark):
    """Every kind is found where its hint is looked for first, in the forms the patterns allow."""
    from pyspark.sql import functions as F

    from wardline.functions import deident as D

    said = [
        "123-45-6789", "(212) 555-0100", "212.555.0100", "2125550100", "FAX: 212 555 0100", "Facsimile 2125550100", "a.b@c.org", "MRN: 12", "mrn 7", "Medical Record Number 12345678", "10.0.0.255", "https://x.y/z", "90210-1234", "12 Elm St", "1 North  Main street Apt 4",
        "Acct # 12", "ACCESSION no. 5", "dea AB12", "Certificate: 9", "1HGCM82633A004352", "UDI 12", "Device ID: 9-A", "Retina: 5", "Policy number A-1", "BENEFICIARY id 7", "March 3, 2020", "may 12 2021", "3 June 2020", "2020/1/31", "2020-12-01", "1/31/2020", "91 Year-Old", "100-year old", "Aged: 95", "AGE 102", "nothing here", "",
    ]
    df = spark.createDataFrame([(f"x {s} y",) for s in said] + [(" | ".join(said),)], "text string")
    steps = [p for _, p, _ in D.PATTERNS] + D.DATES + [p for p, _ in D.AGES]
    assert len(steps) == len(D.HINTS)
    for p, h in zip(steps, D.HINTS):
        n, hidden = df.select(F.count_if(F.col("text").rlike(p)), F.count_if(F.col("text").rlike(p) & ~D._may_hold(F.col("text"), h))).first()
        assert n > 0 and hidden == 0, p
    assert [r.scrubbed for r in D.scrub_report(df).collect()] == [r.s for r in df.select(D.scrub(F.col("text")).alias("s")).collect()]
