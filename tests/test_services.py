"""Model calls, extraction tail, scores, names, and streams of jobs and records."""

import itertools
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from wardline.functions import names
from wardline.operators import calls, scorer, terminology
from wardline.operators import text as T
from wardline.sources import archives
from wardline.streaming import ingest, job_queue, progress, upsert_log


def make_flaky():
    def flaky(prompt, attempt):
        """Fails as often as its prompt says, with an error that passes or one that doesn't."""
        kind, times = prompt.split()[:2]
        if attempt <= int(times):
            raise {"late": TimeoutError("timeout"), "busy": RuntimeError("HTTP 429"), "bad": ValueError("bad request"), "mute": OSError()}[kind]
        return json.dumps([{"entity_class": "condition", "text": prompt, "confidence": times}])

    return flaky


def test_calls_are_retried_and_keep_their_order(spark):
    prompts = ["late 0", "late 2", "late 3", "busy 1", "bad 0", "bad 1", None, "mute 1"]
    df = spark.createDataFrame([(i, "extraction" if i % 2 else None, p) for i, p in enumerate(prompts)], "id int, operation string, prompt string").coalesce(1)
    got = calls.call_models(df, {"flaky": make_flaky()}, {"default": "flaky"}, workers=3, backoff=0.01).collect()
    assert [r.id for r in got] == list(range(8)) and {r.provider for r in got} == {"flaky"}
    assert [(r.attempts, r.error) for r in got] == [(1, None), (3, None), (3, "timeout"), (2, None), (1, None), (1, "bad request"), (0, None), (1, "OSError")]
    assert [r.answer is None for r in got] == [False, False, True, False, False, True, True, True]
    assert calls.call_models(df.limit(0)).count() == 0


def test_calls_are_routed_by_operation(spark):
    df = spark.createDataFrame([("summary", "x"), ("dedup", "x"), (None, "x")], "operation string, prompt string").coalesce(1)
    named = {n: (lambda p, a, n=n: n + p) for n in ("one", "two")}
    got = [r.answer for r in calls.call_models(df, named, {"summary": "one", "default": "two"}).collect()]
    assert got == ["onex", "twox", "twox"]
    with pytest.raises(ValueError, match="no such provider: three"):
        calls.call_models(df, named, {"summary": "three"})


def test_failed_chunks_are_counted(spark):
    rows = [(1, 0, "labs", "late 0"), (1, 1, "vitals", "late 9"), (2, 0, "labs", "bad 1"), (3, 0, "labs", "late 1"), (3, 1, "labs", None)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, section_type string, chunk string")
    found, counts = T.collect_chunks(calls.extract_chunks(chunks, providers={"f": make_flaky()}, routing={"extraction": "f"}, backoff=0.01))
    assert sorted((r.doc_id, r.source_section, r.text, r.confidence) for r in found.collect()) == [(1, "labs", "late 0", 0.0), (3, "labs", "late 1", 1.0)]
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 2, 1), (2, 1, 1), (3, 2, 1)]
    plain = calls.extract_chunks(spark.createDataFrame([(1, 0, "x", "intro\ncondition: Gout\n medication:  Aspirin 81 mg \nend")], chunks.schema)).first()
    assert [(e.entity_class, e.text, e.confidence) for e in plain.entities] == [("condition", "Gout", 0.8), ("medication", "Aspirin 81 mg", 0.8)]


@pytest.mark.parametrize(("output", "answer", "said", "data"), [
    ("natural_language", "{a", "{a", None), ("json", '{"a":1}', None, {"a": 1}), ("json", "no", None, {"raw_response": "no"}),
    ("both", '{"natural_language":"x","structured_data":{"b":2}}', "x", {"b": 2}), ("both", '{"b":2}', "", {"b": 2}), ("both", "no", "no", None),
])
def test_summaries(spark, output, answer, said, data):
    got = calls.summarize(spark.createDataFrame([(1, "t")], "id int, text string"), "Sum up.", output, providers={"p": lambda prompt, attempt: answer if prompt == "Sum up.\n\nt" else ""}, routing={"summary": "p"}).first()
    assert (got.said, json.loads(got.data) if got.data else None, got.error) == (said, data, None)


TERMS = [("hypertension", "DISEASE", "I10"), ("lisinopril", "CHEMICAL", "29046"), ("chest pain", "DISEASE", None)]


def test_hybrid_asks_the_model_where_the_dictionary_is_in_doubt(spark):
    sections = spark.createDataFrame([
        (1, 0, "problems", "Patient has hypertension. Denies chest pain."),
        (1, 1, "medications", "Takes lisinopril daily"),
        (1, 2, "labs", "hypertension noted"),
        (1, 3, "problems", "Nothing in the dictionary is said in this long section of text."),
        (1, 4, "problems", "short"),
        (1, 5, "problems", "Mother has hypertension. History of chest pain. If chest pain, call."),
    ], "doc_id long, section_no int, section_type string, text string")
    terms = spark.createDataFrame(TERMS, "term string, label string, code string")
    asked = []

    def model(df):
        asked.extend(sorted(r.section_no for r in df.collect()))
        return df.select("doc_id", "section_no", F.lit(0).alias("sentence_no"), F.lit(7).alias("pos"), F.lit("procedure").alias("entity_class"), F.lit("told").alias("text"), F.lit("active").alias("status"), F.lit(0.6).alias("confidence"))

    got = sorted((r.section_no, r.entity_class, r.text, r.code, r.status, r.confidence, r.origin) for r in T.hybrid(sections, terms, model).collect())
    assert asked == [2, 3, 5]
    local = [(0, "condition", "hypertension", "I10", "active", 0.9, "dictionary"), (1, "medication", "lisinopril", "29046", "active", 0.9, "dictionary"), (2, "condition", "hypertension", "I10", "active", 0.9, "dictionary"), (5, "condition", "chest pain", None, "historical", 0.5, "dictionary"), (5, "family_history", "hypertension", "I10", "active", 0.9, "dictionary")]
    assert got == sorted(local + [(n, "procedure", "told", None, "active", 0.6, "model") for n in asked])
    assert T.hybrid(sections, terms).count() == len(local)


ENTITY = "doc_id long, pos long, entity_class string, text string, context string, status string, attributes map<string,string>, entity_date timestamp"


def day(n):
    return __import__("datetime").datetime(2024, 1, n) if n else None


def entities(spark, rows):
    return spark.createDataFrame([(d, p, c, t, None, None, a, day(n)) for d, p, c, t, a, n in rows], ENTITY)


def kept(spark, rows, automatic=True, document_day=None):
    e = entities(spark, rows)
    facts = e.select("doc_id").distinct().withColumn("document_date", F.lit(day(document_day)).cast("timestamp"))
    return T.confirm(e, facts, automatic)[0]


VISITS = [
    ([0, 0, 0], [2]),  # no date: one visit, the one with a provider
    ([0, 0, 3], [2]),  # one day: those without a date belong to it
    ([3, 0, 3], [2]),
    ([3, 0, 4], [1, 2, 3]),  # several days: one without a date stands alone
    ([3, 4, 4], [1, 2]),
]


def test_visits_by_the_number_of_days(spark):
    rows = [(d, i + 1, "encounter", "Office visit", {"physician": "Dr Reed"} if i == 1 else {}, n) for d, (days, _) in enumerate(VISITS) for i, n in enumerate(days)]
    got = {}
    for r in kept(spark, rows).collect():
        got.setdefault(r.doc_id, []).append(r.pos)
    assert {d: sorted(v) for d, v in got.items()} == {d: want for d, (_, want) in enumerate(VISITS)}


def test_visits_and_the_frame_of_a_document(spark):
    rows = [(1, 1, "encounter", "After Visit Summary", {}, 0), (1, 2, "encounter", "Office visit", {}, 3), (1, 3, "encounter", "Valley Cardiology Group", {}, 0), (1, 4, "encounter", "Cardiology follow up visit", {}, 0), (1, 5, "encounter", "Consult", {}, 5)]
    assert sorted(r.pos for r in kept(spark, rows).collect()) == [2, 4, 5]
    both = [(1, 1, "encounter", "MyChart printed on", {"provider": "Reed"}, 3), (1, 2, "encounter", "Consult", {}, 3)]
    assert [r.pos for r in kept(spark, both).collect()] == [2]


def brute_visits(rows):
    """Survivors by the three cases, one document at a time: rows of (pos, day, chrome, provider)."""
    days = {d for _, d, _, _ in rows if d}
    if len(days) <= 1:
        groups = [rows]
    else:
        groups = [[r for r in rows if r[1] == d] for d in days] + [[r] for r in rows if not r[1] and not r[2]]
    return sorted(max(g, key=lambda r: (1000 * (not r[2]) + 100 * bool(r[3]) + 50 * bool(r[1]), -r[0]))[0] for g in groups if g)


def test_visits_against_brute_force(spark):
    rng = random.Random(7)
    docs = {d: [(p, rng.choice([0, 0, 3, 4, 5][: rng.choice([1, 2, 3, 5])]), rng.random() < 0.3, rng.random() < 0.3) for p in range(rng.randint(1, 6))] for d in range(80)}
    df = spark.createDataFrame([(d, p, day(n), c, "x" if w else None, 0) for d, rows in docs.items() for p, n, c, w in rows], "doc_id long, pos long, effective_date timestamp, boilerplate boolean, provider string, n_fields int")
    got = {}
    for r in T.best_encounters(df).collect():
        got.setdefault(r.doc_id, []).append(r.pos)
    assert {d: sorted(v) for d, v in got.items()} == {d: v for d, rows in docs.items() if (v := brute_visits(rows))}


def test_drugs_of_a_document_are_walked_in_order(spark):
    drugs = ["Metformin", "metformin hcl", "metformin  HCL", "Insulin glargine", "insulin aspart", "Tylenol's", "tylenols", "aspirin"]
    rows = [(1, i, "medication", t, {"dosage": "5 mg daily"} if i == 2 else {}, 0) for i, t in enumerate(drugs)] + [(2, 0, "medication", "aspirin", {}, 0)]
    got = sorted((r.doc_id, r.pos) for r in kept(spark, rows).collect())
    # 2 repeats the text of 1, which is like 0; the possessive of 5 makes no other drug.
    assert got == [(1, 0), (1, 3), (1, 4), (1, 5), (1, 7), (2, 0)]
    better = kept(spark, [(1, 0, "medication", "Metformin", {}, 0), (1, 1, "medication", "metformin hcl", {"dosage": "5 mg daily"}, 0)])
    assert [r.pos for r in better.collect()] == [1]


def brute_drugs(rows):
    left = []
    for pos, name, score in rows:
        i = next((i for i, s in enumerate(left) if T.same_drug(s[1], name, 90, 80, 0.6)), None)
        if i is None:
            left.append((pos, name, score))
        elif score > left[i][2]:
            left[i] = (pos, name, score)
    return sorted(x[0] for x in left)


def test_drug_walk_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "betas", "gamma", "xl", "er", "hcl"]
    docs = {d: [(p, " ".join(rng.sample(words, rng.randint(1, 3))), rng.randint(0, 3)) for p in range(rng.randint(1, 12))] for d in range(60)}
    df = spark.createDataFrame([(d, p, t, None, n) for d, rows in docs.items() for p, t, n in rows], "doc_id long, pos long, text string, code_value string, n_fields int")
    got = {}
    for r in T.best_medications(df).collect():
        got.setdefault(r.doc_id, []).append(r.pos)
    assert {d: sorted(v) for d, v in got.items()} == {d: brute_drugs(rows) for d, rows in docs.items()}


def test_manual_confirm_leaves_all_to_the_person(spark):
    rows = [(1, 1, "encounter", "Office visit", {}, 3), (1, 2, "encounter", "Office visit", {}, 3), (1, 3, "condition", "Gout", {"attending": "Dr Who"}, 0), (1, 4, "condition", "Gout", {}, 0), (1, 5, "provider", "Reed", {}, 0)]
    got = sorted(kept(spark, rows, automatic=False, document_day=9).collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == [1, 2, 3, 4] and all(r.linked_encounter_id is None for r in got)
    assert [r.effective_date.day for r in got] == [3, 3, 9, 9]
    auto = {r.pos: r for r in kept(spark, rows, document_day=9).collect()}
    assert sorted(auto) == [1, 3] and auto[3].linked_encounter_id == auto[1].id


TOLD = [
    ("encounter", "Office visit", {}), ("encounter", "Consult", {"provider": "Reed", "reason": "cough", "date": "2024-01-03"}), ("encounter", "Exam", {"facility": "North Clinic", "summary": "<b>well</b>", "cpt_code": "99213", "visit_type": "telehealth"}),
    ("encounter", "Exam", {"reason": " ", "visit_description": "0", "status": "false"}), ("medication", "Metformin", {}), ("medication", "Metformin 500 mg twice daily", {"attending": "Reed"}),
    ("medication", "Metformin", {"frequency": "prn"}), ("medication", "Metformin", {"route": "po", "dosage": " "}), ("medication", "Flu shot", {}), ("condition", "Gout", {"onset": "2020"}),
]


def test_fields_are_told_without_reading_the_resource(spark):
    from wardline.functions import entities as E
    from wardline.functions.fhir import populated_fields

    rows = E.to_records(entities(spark, [(1, i, c, t, a, 0) for i, (c, t, a) in enumerate(TOLD)]), told=True)
    got = rows.select("pos", "entity_class", "filled", "resource_json", populated_fields(F.col("resource_json")).alias("n")).collect()
    assert len(got) == len(TOLD)
    for r in got:
        if r.entity_class in ("encounter", "medication"):
            assert r.filled == [k for k in json.loads(r.resource_json) if k not in ("resourceType", "_extraction_metadata")] and len(r.filled) == r.n
        else:
            assert r.filled is None


def test_words_of_a_visit_on_two_lines(spark):
    rows = [(1, 1, "encounter", "Valley", {"visit_description": "Cardiology\nvisit"}, 3), (1, 2, "encounter", "Consult", {"facility": "North Clinic"}, 3), (1, 3, "encounter", "Consult", {"visit_description": "Cardiology\ngroup", "provider": "Reed"}, 0)]
    assert [r.pos for r in kept(spark, rows).collect()] == [3]
    assert [r.pos for r in kept(spark, [rows[0], (1, 2, "encounter", "Valley Group", {"provider": "Reed"}, 3)]).collect()] == [1]


def test_confirm_takes_facts_from_the_entities(spark):
    rows = [(1, 1, "encounter", "Consult", {}, 0), (1, 2, "encounter", "Exam", {}, 5), (1, 3, "condition", "Gout", {}, 0), (2, 1, "condition", "Gout", {}, 0), (3, 1, "medication", "Metformin", {}, 4), (3, 2, "provider", "Reed", {}, 0)]
    e = entities(spark, rows).withColumn("name", F.lit(None).cast("string")).withColumn("visit_date", F.when(F.col("doc_id") == 2, F.lit(day(9))))
    told = lambda df: sorted((r.doc_id, r.pos, r.effective_date and r.effective_date.day, r.linked_encounter_id, r.resource_json) for r in df.collect())
    assert told(T.confirm(e)[0]) == told(T.confirm(e, T.document_facts(e))[0])
    assert [x[:3] for x in told(T.confirm(e)[0])] == [(1, 1, 5), (1, 3, 5), (2, 1, 9), (3, 1, 4)]


def test_counts_of_confirmed_documents_build_no_resource(spark):
    """Entities dealt out by document are shuffled no more but for the lists of drugs, whose fold runs once."""
    from wardline.plans import service

    plan = service.q_confirmed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "to_json" not in plan and "get_json_object" not in plan
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("Broadcast") == 0 and plan.count("ArrowEvalPython") == 1


def test_every_key_of_a_provider_is_read(spark):
    keys = ["provider", "performer", "performed_by", "ordering_provider", "ordered_by", "rendering_provider", "attending", "attending_provider", "physician", "doctor", "provider_name"]
    got = kept(spark, [(i, 1, "encounter", "Office visit", {key: f"Dr {key}"}, 3) for i, key in enumerate(keys)]).collect()
    assert sorted(json.loads(r.resource_json)["participant"][0]["individual"]["display"] for r in got) == sorted(f"Dr {k}" for k in keys)


def test_scores_by_class_and_lists(spark):
    schema = "note long, entity_class string, text string"
    want = spark.createDataFrame([(1, "condition", "HTN"), (1, "condition", "gout"), (1, "medication", "aspirin"), (2, "condition", "asthma")], schema)
    found = spark.createDataFrame([(1, "condition", "hypertension"), (1, "condition", "flu"), (1, "dosage", "5 mg"), (1, "vital", "120/80"), (1, "family_history", "breast cancer in mother")], schema)
    barred = spark.createDataFrame([(1, "condition", "flu", "negation"), (1, "condition", "rash", "attribution")], schema + ", reason string")
    kin = spark.createDataFrame([(1, "breast ca"), (1, "stroke")], "note long, text string")
    compared = scorer.compare(want, barred, kin, found)
    got = {(r.note, r.entity_class): r for r in compared.collect()}
    assert got[1, "condition"].missed == ["gout"] and got[1, "condition"]["false"] == ["flu"] and got[1, "condition"].violated == ["flu"]
    assert got[2, "condition"].missed == ["asthma"] and got[1, "dosage"]["false"] == []
    by = {(r.note, r.entity_class): (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in scorer.by_class(compared).collect()}
    assert by == {(1, "condition"): (1, 1, 1, 0.5, 0.5, 0.5), (1, "medication"): (0, 0, 1, 0.0, 0.0, 0.0), (2, "condition"): (0, 0, 1, 0.0, 0.0, 0.0)}
    assert {r.entity_class: r.tp for r in scorer.by_class(compared, ("entity_class",)).collect()} == {"condition": 1, "medication": 0}
    all_ = {r.note: r for r in scorer.evaluate(want, barred, kin, found).collect()}
    assert (all_[1].tp, all_[1].fp, all_[1].fn, all_[1].negation_accuracy, all_[1].attribution_accuracy) == (1, 3, 2, 0.0, 0.6667)


def brute_close(key, aliases):
    from wardline.functions.similarity import _ratio, token_set_ratio

    fine = [(-token_set_ratio(key, a), len(a), a) for a in aliases if token_set_ratio(key, a) >= 88 and _ratio(key, a) >= 88]
    return min(fine)[2] if fine else None


def test_close_spellings_match_all_pairs(spark):
    rng = random.Random(5)
    syllables = ["lo", "si", "no", "pril", "met", "for", "min", "a", "zi", "thro", "my", "cin", " ", "b12", "ine"]
    aliases = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(1, 9))).strip() for _ in range(250)} - {""})
    terms = []
    for a in aliases + aliases:
        t = list(a)
        for _ in range(rng.choice([1, 1, 2, 3, 5])):
            i = rng.randrange(len(t) + 1)
            if rng.random() < 0.5 and len(t) > 1:
                del t[min(i, len(t) - 1)]
            else:
                t.insert(i, rng.choice("abcdefgo "))
        terms.append("".join(t))
    known = spark.createDataFrame([(a, f"c{i}", a.title()) for i, a in enumerate(aliases)], "alias string, code string, display string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(terms)] + [(-1, None), (-2, "")], "id int, t string")
    keyed = {r.id: r.k for r in df.select("id", terminology.normalize_term(F.col("t")).alias("k")).collect()}
    index = terminology.close_index(known)
    for given in (None, index):
        got = {r.id: (r.display, r.matched) for r in terminology.look_up(df, known, "t", first_word=False, fuzzy=True, index=given).collect()}
        want = {i: (k.title(), "exact") if k in aliases else ((b.title(), "close") if k and (b := brute_close(k, aliases)) else (None, None)) for i, k in keyed.items()}
        assert got == want
    assert sum(m == "close" for _, m in got.values()) > 60


def test_names_are_taken_out(spark):
    texts = spark.createDataFrame([
        (1, "Pedro Otalora prescribed Rifaximin for Crohn disease. Gastroenterology: Dr Ann  Lee-Wu."), (2, "no names"), (3, None), (4, ""), (5, "É. Zoé Ångström saw MR X and zoé"),
    ], "id long, text string")
    spans = spark.createDataFrame([(1, 0, 35, "PERSON"), (1, 6, 24, "PERSON"), (1, 39, 52, "PERSON"), (1, 54, 70, "PERSON"), (1, 75, 86, "PERSON"), (1, 0, 90, "ORG"), (5, 0, 32, "PERSON")], "id long, start int, end int, label string")
    drugs = spark.createDataFrame([("rifaximin",), ("lee",)], "term string")
    got = {r.id: (r.redacted, r.n_names) for r in names.redact_names(texts, spans, drugs).collect()}
    assert got == {1: ("[NAME] prescribed Rifaximin for Crohn disease. Gastroenterology: Dr [NAME]-[NAME].", 3), 2: ("no names", 0), 3: (None, 0), 4: ("", 0), 5: ("[NAME]. [NAME] saw MR [NAME] and zoé", 3)}


def pack(path, members, **options):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in members.items():
            z.writestr(k, v)


def test_archives_are_read_by_member(spark, tmp_path):
    rng = random.Random(1)
    big = rng.randbytes(70_000)
    pack(tmp_path / "a.zip", {"one.json": "{}", "dir/two.tsv": big, "empty.xml": "", **{f"m{i}.json": str(i) for i in range(30)}})
    pack(tmp_path / "evil.zip", {"../x": "1"})
    pack(tmp_path / "bomb.zip", {"b": "0" * 3_000_000})
    (tmp_path / "no.zip").write_bytes(b"no zip")
    broken = bytearray((tmp_path / "a.zip").read_bytes())
    at = broken.index(b"dir/two.tsv") + 3000
    broken[at : at + 50] = bytes(50)
    (tmp_path / "broken.zip").write_bytes(broken)
    listed = archives.directory(spark, str(tmp_path))
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in listed.filter("error IS NOT NULL").collect()}
    assert set(errors) == {"evil.zip", "bomb.zip", "no.zip"} and "unsafe" in errors["evil.zip"] and "large" in errors["bomb.zip"]
    parts = archives.members(listed, part=20_000).collect()
    a = {}
    for r in sorted((r for r in parts if r.path.endswith("/a.zip")), key=lambda r: r.part):
        a.setdefault(r.member, []).append(r)
    assert len(a) == 33 and all(v[-1]["last"] and not v[-1].error for v in a.values())
    assert b"".join(r.content for r in a["dir/two.tsv"]) == big and len(a["dir/two.tsv"]) == 4 and a["empty.xml"][0].content == b""
    bad = [r for r in parts if r.path.endswith("/broken.zip") and r.error]
    assert [r.member for r in bad] == ["dir/two.tsv"]
    assert {r.error for r in parts if r.member is None} == set(errors.values())


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "s string, k string, at int, v string").withColumn("content_hash", F.sha2("v", 256))


def test_upsert_log(spark, tmp_path):
    folder, keys = str(tmp_path / "log"), dict(identity=["s", "k"], arrival=["at"])
    assert upsert_log.read(spark, folder, **keys) is None
    table, versions = {}, []
    rng = random.Random(8)
    for batch in range(7):
        rows = [("x", f"k{rng.randint(0, 25)}", batch * 100 + i, f"v{rng.randint(0, 3)}") for i in range(6)] + [("x", None, batch * 100 + 50, f"alone{batch}")]
        before = upsert_log.manifest(spark, folder)
        for _ in range(2):  # a batch that is run again changes nothing
            after = upsert_log.upsert(spark, log_rows(spark, rows), folder, batch, buckets=5, folders=3, **keys)
        for s, k, at, v in rows:
            key = (s, k) if k else (s, at)
            if key in table and table[key][0] == v:
                continue
            if key in table:
                versions.append((key, *table[key]))
            table[key] = (v, table.get(key, ("", 0))[1] + 1)
        touched = {b for b in after["buckets"] if after["buckets"][b] != before["buckets"].get(b)}
        assert all(after["buckets"][b] == before["buckets"][b] for b in before["buckets"] if b not in touched)
        assert max(map(len, after["buckets"].values())) <= 3
        got = {((r.s, r.k) if r.k else (r.s, r["at"])): (r.v, r.version) for r in upsert_log.read(spark, folder, **keys).collect()}
        assert got == table
    old = sorted(((r.s, r.k), r.v, r.version) for r in spark.read.parquet(f"{folder}/versions").collect())
    assert old == sorted(versions) and len(versions) > 5
    assert not list((tmp_path / "log" / "manifest").glob("*.new")) and not list((tmp_path / "log" / "staging").iterdir())


def test_a_batch_that_broke_off_is_run_again(spark, tmp_path, monkeypatch):
    folder, keys = str(tmp_path / "log"), dict(identity=["s", "k"], arrival=["at"])
    upsert_log.upsert(spark, log_rows(spark, [("x", "a", 0, "1"), ("x", "b", 1, "1")]), folder, 0, **keys)
    with monkeypatch.context() as m:
        m.setattr(upsert_log, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            upsert_log.upsert(spark, log_rows(spark, [("x", "a", 2, "2"), ("x", "c", 3, "1")]), folder, 1, **keys)
    read = lambda: sorted((r.k, r.v, r.version) for r in upsert_log.read(spark, folder, **keys).collect())
    assert read() == [("a", "1", 1), ("b", "1", 1)]
    upsert_log.upsert(spark, log_rows(spark, [("x", "a", 2, "2")]), folder, 1, **keys)
    assert read() == [("a", "2", 2), ("b", "1", 1)]


def test_progress_counts_what_is_written(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    entry = lambda i: {"resource": {"resourceType": "Condition", "id": str(i), "code": {"text": f"c{i}"}}}
    for n, ids in enumerate(([1, 2, 3], [4], [5, 6])):
        (src / f"{n}.json").write_text(json.dumps({"resourceType": "Bundle", "entry": [entry(i) for i in ids]}))
    told = []
    ingest.run(spark, str(src), str(tmp_path / "out"), str(tmp_path / "chk"), files_per_batch=1, tell=lambda i, c: told.append((i, c["rows"], c["skipped"])))
    assert sorted(n for _, n, _ in told) == [1, 2, 3] and [i for i, _, _ in told] == [0, 1, 2]
    assert ingest.latest(spark, str(tmp_path / "out")).count() == sum(n for _, n, _ in told)


def test_progress_of_a_stream(spark, tmp_path):
    spark.range(25).write.parquet(str(tmp_path / "in"))
    said = []
    listener = progress.Progress(lambda name, batch, totals: said.append((name, totals["rows"])))
    spark.streams.addListener(listener)
    try:
        stream = progress.observed(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), "ids", skipped=F.col("id") % 5 == 0, failed=F.col("id") > 20)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if listener.totals("ids")["rows"]:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals("ids") == {"rows": 25, "skipped": 5, "failed": 4} and said == [("ids", 25)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 25


def test_jobs_move_by_events_and_timers(spark, tmp_path):
    """Claims, silence, retries and the end of jobs, over runs of a stream that go on from each other."""
    spark.conf.set(*job_queue.STORE)
    src = tmp_path / "in"
    src.mkdir()
    clock = itertools.count()

    def run(*events):
        (src / f"{next(clock)}.json").write_text("\n".join(json.dumps({"job_id": j, "event": e, "at": f"2024-01-01T00:{m:02d}:00"}) for j, e, m in events))
        events = spark.readStream.schema("job_id string, event string, at timestamp").json(str(src))
        states = job_queue.job_states(events, stale_seconds=300, max_retries=1)
        out = []
        q = states.writeStream.outputMode("update").foreachBatch(lambda df, i: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.job_id, r.event, r.status, r.retries, r.attempts) for r in out)

    try:
        assert run(("a", "submit", 0), ("a", "claim", 1), ("b", "submit", 0), ("b", "done", 1), ("c", "submit", 0), ("c", "cancel", 1), ("d", "claim", 1)) == [("a", "claim", "processing", 0, 1), ("a", "submit", "pending", 0, 0), ("b", "submit", "pending", 0, 0), ("c", "cancel", "cancelled", 0, 0), ("c", "submit", "pending", 0, 0)]
        assert run(("a", "beat", 4), ("b", "claim", 4), ("c", "claim", 4)) == [("b", "claim", "processing", 0, 1)]
        # Time goes on: both are silent for five minutes after the beat and the claim.
        assert run(("e", "submit", 20)) == [("a", "silent", "pending", 1, 1), ("b", "silent", "pending", 1, 1), ("e", "submit", "pending", 0, 0)]
        assert run(("a", "claim", 21), ("b", "claim", 21), ("b", "done", 22)) == [("a", "claim", "processing", 1, 2), ("b", "claim", "processing", 1, 2), ("b", "done", "completed", 1, 2)]
        assert run(("e", "claim", 40), ("e", "fail", 41)) == [("a", "silent", "failed", 1, 2), ("e", "claim", "processing", 0, 1), ("e", "fail", "pending", 1, 1)]
        assert run(("a", "claim", 42), ("b", "cancel", 42)) == []
    finally:
        spark.conf.unset(job_queue.STORE[0])


def test_spread_parts_grow_with_rows(spark, tmp_path, monkeypatch):
    from wardline import session

    monkeypatch.setattr(session, "SPREAD_ROWS", 10)
    spark.range(105).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert session.spread(session.table(spark, str(tmp_path), "t")).rdd.getNumPartitions() == 12


def test_hybrid_broadcasts_no_sections(spark):
    sections = spark.createDataFrame([(1, 0, "labs", "told")], "doc_id long, section_no int, section_type string, text string").coalesce(1)
    small = sections.unionByName(sections.limit(0))
    model = lambda asked: asked.select("doc_id", "section_no", F.lit(0).alias("sentence_no"), F.lit(0).alias("pos"), F.lit("procedure").alias("entity_class"), F.lit("told").alias("text"), F.lit("active").alias("status"), F.lit(0.6).alias("confidence"))
    found = T.hybrid(small, F.broadcast(spark.createDataFrame([("x", "DISEASE", None)], "term string, label string, code string")), model)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") == 2 and found.count() == 1


def test_names_are_taken_out_in_parts_by_id(spark):
    texts = spark.createDataFrame([(1, "Ada  Reed")], "id long, text string")
    spans = spark.createDataFrame([(1, 0, 9, "PERSON"), (1, 0, 9, "PERSON"), (1, 5, 9, "PERSON")], "id long, start int, end int, label string")
    done = names.redact_names(texts, spans)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning(id") == plan.count("REPARTITION_BY_NUM")
    assert [(r.redacted, r.n_names) for r in done.collect()] == [("[NAME]", 1)]


def test_close_pairs_are_told_by_counts_first(spark):
    known = spark.createDataFrame([("metformin hydrochloride",), ("zoe",), ("été 9",)], "alias string")
    index = terminology.close_index(known)
    assert {r.alias for r in index.select("alias", "counts").distinct().collect()} == {"metformin hydrochloride", "zoe", "été 9"}
    keys = spark.createDataFrame([("metformin hydrochlorid",), ("metformine hydrochloride",), ("zzzzzzzzz hydrochloride",)], "term_key string")
    pairs = terminology.close_pairs(keys, index)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("bit_count") < plan.index("levenshtein")
    assert sorted(r.term_key for r in pairs.collect()) == ["metformin hydrochlorid", "metformine hydrochloride"]


def test_calls_take_a_future_a_worker(spark):
    def waiting(prompt, attempt):
        import threading

        queue = next(a for a in threading.current_thread()._args if hasattr(a, "qsize"))
        return str(queue.qsize())

    asked = spark.range(200).coalesce(1).selectExpr("'x' AS operation", "concat('p', id) AS prompt")
    told = calls.call_models(asked, providers={"up": waiting}, routing={"default": "up"}).collect()
    assert [r.prompt for r in told] == [f"p{i}" for i in range(200)] and max(int(r.answer) for r in told) < 4


def test_class_scores_compare_once(spark):
    """Scores and what was missed come from one comparison: each of its four inputs is scanned once."""
    from wardline.plans.stores import q_class_scores

    plan = q_class_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4 and "Join" not in plan
