"""Large bundles, sealed files, archives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import access as A
from wardline.sources import fhir_bundle, large_bundle, sealed

KEY = b"k" * 32


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def condition(i, text):
    return {"fullUrl": f"urn:{i}", "resource": {"resourceType": "Condition", "id": str(i), "code": {"text": text, "coding": [{"system": "s", "code": str(i % 7)}]}, "note": [{"text": "}{][ \\ \" }"}]}}


def bundles():
    odd = ['plain', 'quote " here', 'brace } { in', 'back \\ slash', 'ends \\', '"}],[{"', 'é🙂\n\t', "}}}}", '\\"}']
    rng = random.Random(4)
    many = [condition(i, odd[i % len(odd)] * rng.randint(1, 9)) for i in range(60)]
    link = [{"relation": "self", "url": "u"}, {"relation": "next", "url": "}"}]
    yield "plain", json.dumps({"resourceType": "Bundle", "entry": many})
    yield "indented", json.dumps({"resourceType": "Bundle", "meta": {"tag": [{"code": {"x": 1}}], "source": {"y": {}}}, "entry": many, "total": 3}, indent=2, ensure_ascii=False) + "\n"
    yield "links before and after", json.dumps({"link": link, "entry": many[:9], "signature": {"type": [{"a": {}}]}, "resourceType": "Bundle", "extension": link})
    yield "one", json.dumps({"resourceType": "Bundle", "entry": many[:1]})
    yield "none", json.dumps({"resourceType": "Bundle", "entry": []})
    yield "bare", json.dumps({"resourceType": "Bundle", "entry": [e["resource"] for e in many[:5]] + [{"fullUrl": "no resource"}] + many[5:7]}, separators=(",", ":"))


def listed(df):
    return sorted((r.file.rsplit("/", 1)[1], r.pos, r.full_url, r.resource) for r in df.withColumn("resource", F.to_json("resource")).collect())


def test_large_bundles_read_like_small_ones(small_blocks, tmp_path):
    for i, (_, text) in enumerate(bundles()):
        (tmp_path / f"{i}.json").write_text(text)
    path = str(tmp_path)
    assert large_bundle.pieces(small_blocks, path).select("file", "block").distinct().count() > 60
    want = listed(fhir_bundle.entries(small_blocks, path))
    assert listed(large_bundle.entries(small_blocks, path)) == want and len(want) > 120
    assert all(r.whole for r in large_bundle.report(small_blocks, path).collect())
    few = ["record_type", "display_text", "external_id"]
    assert sorted(large_bundle.records(small_blocks, path).select(few).collect()) == sorted(fhir_bundle.records(small_blocks, path).select(few).collect())


def test_broken_tail_is_told(small_blocks, tmp_path):
    text = json.dumps({"resourceType": "Bundle", "entry": [condition(i, "x") for i in range(30)]})
    cut = text[: text.index("urn:20") + 3]
    (tmp_path / "cut.json").write_text(cut)
    (tmp_path / "fine.json").write_text(text + "\n \n")
    (tmp_path / "empty.json").write_text("")
    got = {r.file.rsplit("/", 1)[1]: r.whole for r in large_bundle.report(small_blocks, str(tmp_path)).collect()}
    assert got == {"cut.json": False, "fine.json": True}
    n = {r.file.rsplit("/", 1)[1]: r["count"] for r in large_bundle.entries(small_blocks, str(tmp_path)).groupBy("file").count().collect()}
    assert n == {"cut.json": 20, "fine.json": 30}


def test_only_edges_of_blocks_are_kept(spark, tmp_path):
    (tmp_path / "a.json").write_text(next(bundles())[1])
    known, edges = large_bundle._read(spark, str(tmp_path))
    assert sorted((r.n, r.ended) for r in edges.collect()) == [(0, True), (60, False)] and known.first().ends == 60
    assert large_bundle.entries(spark, str(tmp_path)).count() == 60


def raised(df):
    with pytest.raises(Exception) as e:
        df.collect()
    return str(e.value)


def test_sealed_frames(spark):
    rng = random.Random(2)
    contents = [("a", rng.randbytes(2500)), ("b", b""), ("c", rng.randbytes(1000)), ("d", b"old and plain"), ("e", None)]
    files = spark.createDataFrame(contents, "file string, content binary").withColumn("n", F.lit("x"))
    cut = sealed.frames(files, 1000)
    kept = sealed.seal_frames(cut, F.lit(KEY)).withColumn("frame", F.when(F.col("file") == "d", F.encode(F.lit("old and plain"), "utf-8")).otherwise(F.col("frame")))
    rows = kept.collect()
    assert {(r.file, r.n, r["last"]) for r in rows} == {("a", 0, False), ("a", 1, False), ("a", 2, True), ("b", 0, True), ("c", 0, True), ("d", 0, True)}
    back = {r.file: bytes(r.content) for r in sealed.whole_files(sealed.open_frames(kept, F.lit(KEY))).collect()}
    assert back == {f: c for f, c in contents if c is not None}
    assert {r.file: r.file_hash for r in cut.filter("last").collect()} == {f: __import__("hashlib").sha256(c).hexdigest() for f, c in contents if c is not None}

    def opened(change, key=KEY):
        new = [change(r.asDict()) for r in rows]
        return sealed.open_frames(spark.createDataFrame([n for n in new if n], kept.schema), F.lit(key))

    flip = lambda b, i: bytes(b[:i]) + bytes([b[i] ^ 1]) + bytes(b[i + 1 :])
    of = lambda r, f, n: r["file"] == f and r["n"] == n
    for at in (4, 20, -1):
        raised(opened(lambda r: r | {"frame": flip(r["frame"], at % len(r["frame"]))} if of(r, "c", 0) else r))  # noqa: B023
    raised(opened(lambda r: r, b"x" * 32))
    assert "32 bytes" in raised(opened(lambda r: r, b"short"))
    assert "missing" in raised(opened(lambda r: None if of(r, "a", 2) else r))
    raised(opened(lambda r: None if of(r, "a", 2) else r | {"last": True} if of(r, "a", 1) else r))
    assert "missing" in raised(opened(lambda r: None if of(r, "a", 1) else r))
    raised(opened(lambda r: r | {"n": 1 - r["n"]} if r["file"] == "a" and r["n"] < 2 else r))
    raised(opened(lambda r: r | {"file": "c" if r["file"] == "b" else "b"} if r["file"] in "bc" else r))
    assert "mixed" in raised(opened(lambda r: r | {"frame": b"put in"} if of(r, "a", 1) else r))


def test_sealed_values_are_vouched_for(spark):
    df = spark.createDataFrame([(b"secret",), (b"",), (None,)], "v binary")
    s = df.select("v", A.seal(F.col("v"), F.lit(KEY)).alias("s"))
    rows = spark.createDataFrame(s.collect(), "v binary, s binary")
    assert [r.v for r in rows.select(A.unseal(F.col("s"), F.lit(KEY)).alias("v")).collect()] == [b"secret", b"", None]
    forged = rows.limit(1).select(F.concat(F.substr("s", F.lit(1), F.octet_length("s") - 1), F.lit(b"\x00")).alias("s"))
    raised(forged.select(A.unseal(F.col("s"), F.lit(KEY))))
    raised(rows.limit(1).select(A.unseal(F.col("s"), F.lit(b"z" * 32))))
    raised(rows.limit(1).select(A.unseal(F.col("s"), F.lit(KEY), F.lit("else"))))


#: Cases of RFC 4231: key, data, digest.
HMACS = [
    (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
]


@pytest.mark.parametrize(("key", "data", "want"), HMACS)
def test_hmac(spark, key, data, want):
    assert spark.createDataFrame([(data,)], "d binary").select(A.hmac_sha256(F.col("d"), key)).first()[0] == want


def test_blind_index_is_blind_to_case_and_blanks(spark):
    df = spark.createDataFrame([(" Ada@X.org\n",), ("ada@x.org",), ("b",), (None,)], "v string")
    a, b, c, d = (r[0] for r in df.select(A.blind_index(F.col("v"), KEY)).collect())
    assert a == b != c and d is None
