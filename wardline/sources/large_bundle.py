"""FHIR bundles that fill one file, read by many tasks.

A JSON document can't be parsed from its middle, but a short pass tells where
its entries begin. Spark reads the file in blocks, cut behind every ``}``, the
one place that is never within an escape. What a block does to the reader's
state (inside a text or not, depth of braces and of brackets) is a few numbers,
which are added up over the blocks of a file, of which there are few. With the
state it begins in, each block is cut into entries where it lies: an entry ends
where the state outside of texts is back at one brace and one bracket. Only the
pieces of entries that cross the edge of a block, and entries that begin a
list, are kept and met in a grouping; no other text is shuffled or written.
So no task holds more than an Arrow batch and an entry, and no row more than an
entry. The file is read three times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.fhir import project
from wardline.session import work_dir
from wardline.sources.fhir_bundle import resources

#: The columns that place a piece in its file.
BLOCK = ["file", "block"]
#: What marks the state of a reader: quotation marks, braces and brackets.
QUOTE, CLOSE = 1, 3
KIND = np.zeros(256, np.uint8)
KIND[[ord(c) for c in '"{}[]']] = [QUOTE, 2, CLOSE, 4, 5]
BRACES, BRACKETS = np.array([0, 0, 1, -1, 0, 0]), np.array([0, 0, 0, 0, 1, -1])
FOLLOWS = re.compile(rb"\s*,\s*\{")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, size, block): the pieces of all files, each up to the next ``}``, in order within their block.

    The last piece of a file has its brace only if the file ends in one.
    """
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Array, bool]]:
    """(block's columns, pieces, whether they are its last) of the pieces of one block after the other; a block's pieces lie together."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        file, block = b.column("file"), b.column("block")
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
        for i, to in zip(cuts, cuts[1:]):
            of = {n: b.column(n)[i].as_py() for n in b.schema.names if n != "value"}
            if held:
                yield *held, any(held[0][c] != of[c] for c in BLOCK)
            held = of, b.column("value")[i:to]
    if held:
        yield *held, True


def _marks(values: pa.Array, bare: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of pieces with their braces (the last has none, if ``bare``), and places and kinds of the marks in them."""
    joined = pc.binary_join_element_wise(values.cast(pa.binary()), pa.scalar(b"}", pa.binary()), pa.scalar(b"", pa.binary()))
    ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[ends[0] : ends[-1] - bare]
    at = np.flatnonzero(KIND[data])
    slashes = np.flatnonzero(data == ord("\\"))
    if len(slashes):
        n = np.arange(len(slashes))
        starts = np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) != 1, n, 0))
        escaped = np.zeros(len(data) + 1, bool)
        escaped[slashes[(n - starts) % 2 == 0] + 1] = True
        at = at[~(escaped[at] & (data[at] == ord('"')))]
    return data, at, KIND[data[at]]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = [0] * 6
    for of, values, last in _runs(batches):
        data, _, kind = _marks(values, False)
        flips = (np.cumsum(kind == QUOTE) + sums[1]) % 2
        outside = [kind[flips == s] for s in (0, 1)]
        sums = [x + int(y) for x, y in zip(sums, [len(data), np.count_nonzero(kind == QUOTE), *(w[o].sum() for o in outside for w in (BRACES, BRACKETS))], strict=True)]
        if last:
            yield pa.RecordBatch.from_pylist([of | dict(zip(["bytes", "flips", "c0", "s0", "c1", "s1"], sums, strict=True))])
            sums = [0] * 6


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """A row a block: begins (1: inside a text), c and s (braces and brackets open where it begins), bare, whether its last piece has no brace; and inside, c_end and s_end, the state behind it."""
    sums = pieces(spark, path).mapInArrow(_sums, "file string, size long, block long, bytes long, flips long, c0 long, s0 long, c1 long, s1 long")
    file = Window.partitionBy("file")
    earlier = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda x: F.coalesce(F.sum(x).over(earlier), F.lit(0))
    rows = sums.withColumn("begins", base("flips") % 2)
    of = lambda n: F.when(F.col("begins") == 0, F.col(f"{n}0")).otherwise(F.col(f"{n}1"))
    # The last piece has no brace where the bytes and braces of all pieces are one more than the file.
    bare = (F.sum("bytes").over(file) > F.col("size")) & (F.col("block") == F.max("block").over(file))
    rows = rows.select(*BLOCK, "begins", base(of("c")).alias("c"), base(of("s")).alias("s"), bare.alias("bare"), ((F.col("begins") + F.col("flips")) % 2 == 1).alias("inside"), of("c").alias("own_c"), of("s").alias("own_s"))
    return rows.select(*BLOCK, "begins", "c", "s", "bare", "inside", (F.col("c") + F.col("own_c") + F.when(F.col("bare") & ~F.col("inside"), 1).otherwise(0)).alias("c_end"), (F.col("s") + F.col("own_s")).alias("s_end"))


def _texts(chunks: list[bytes] | pa.Array) -> pa.Array:
    return pa.array(chunks, pa.binary()).view(pa.string())


def _cut(inner: bool):
    """Blocks cut into entries: those that lie in one block and follow another one (``inner``), or the rest."""

    def rows(of: dict, n: list[int] | np.ndarray, ended: list[bool], text: pa.Array) -> pa.RecordBatch:
        size = len(text)
        return pa.RecordBatch.from_arrays([pa.array([of["file"]] * size, pa.string()), pa.array([of["block"]] * size, pa.int64()), pa.array(n, pa.int64()), pa.array(ended, pa.bool_()), text], ["file", "block", "n", "ended", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n, rest = None, 0, []
        for of, values, last in _runs(batches):
            inside, c, s = state or (of["begins"], of["c"], of["s"])
            data, at, kind = _marks(values, last and of["bare"])
            within = (np.cumsum(kind == QUOTE) + inside) % 2
            braces, brackets = (np.cumsum(np.where(within == 0, w[kind], 0)) + x for w, x in ((BRACES, c), (BRACKETS, s)))
            ends = at[(kind == CLOSE) & (within == 0) & (braces == 1) & (brackets == 1)] + 1
            whole = []
            if len(ends):
                whole = [(n, b"".join([*rest, data[: ends[0]].tobytes()]))]
                rest = []
                if len(ends) > 1:
                    text = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                    follow = (data[ends[:-1]] == ord(",")) & (data[ends[:-1] + 1] == ord("{"))
                    for i in np.flatnonzero(~follow):
                        follow[i] = bool(FOLLOWS.match(data[ends[i] : ends[i + 1]].tobytes()))
                    if inner and follow.any():
                        yield rows(of, np.arange(n + 1, n + len(ends))[follow], [True] * int(follow.sum()), text.filter(pa.array(follow)))
                    whole += [(n + 1 + int(i), data[ends[i] : ends[i + 1]].tobytes()) for i in np.flatnonzero(~follow)]
            rest.append(data[ends[-1] if len(ends) else 0 :].tobytes())
            picked = [w for w in whole if (w[0] > 0 and bool(FOLLOWS.match(w[1]))) == inner]
            if picked:
                yield rows(of, [i for i, _ in picked], [True] * len(picked), _texts([t for _, t in picked]))
            n += len(ends)
            state = ((int(within[-1]), int(braces[-1]), int(brackets[-1])) if len(at) else (inside, c, s))
            if last:
                if not inner:
                    yield rows(of, [n], [False], _texts([b"".join(rest)]))
                state, n, rest = None, 0, []

    return run


def _entries(spark: SparkSession, path: str, known: DataFrame, inner: bool) -> DataFrame:
    """(file, block, n, ended, text): pieces of the blocks ``known``; n numbers the entries that end in a block, and what ends behind it has their number."""
    # A row a block is broadcast, so pieces stay in their order.
    at = pieces(spark, path).drop("size").join(F.broadcast(known.select(*BLOCK, "begins", "c", "s", "bare")), BLOCK)
    return at.mapInArrow(_cut(inner), "file string, block long, n long, ended boolean, text string")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``blocks`` with ends, the entries that end in each, and before, those that end in earlier blocks of the file; and the edges of blocks. Both are kept, as they are read several times."""
    kept = work_dir(spark, "blocks")
    blocks(spark, path).write.parquet(f"{kept}/blocks")
    known = spark.read.parquet(f"{kept}/blocks")
    _entries(spark, path, known, inner=False).write.parquet(f"{kept}/edges")
    edges = spark.read.parquet(f"{kept}/edges")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = edges.groupBy(*BLOCK).agg(F.max("n").alias("ends"))
    return known.join(ends, BLOCK).withColumn("before", F.coalesce(F.sum("ends").over(earlier), F.lit(0))), edges


def _parsed(text: Column) -> Column:
    return F.try_parse_json(F.ltrim(text, F.lit(", \t\n\r\f\x0b")))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, full_url, resource) of the bundles under ``path``, each the only document of its file.

    What ``fhir_bundle.entries`` gives of whole files. Entries before the place
    where a file breaks off are kept (``report`` tells); an entry that is no
    JSON by itself is left out and keeps its number. A document that is no
    bundle has no entries here.
    """
    known, edges = _read(spark, path)
    before = F.broadcast(known.select(*BLOCK, "before"))
    numbered = lambda rows: rows.join(before, BLOCK).withColumn("g", F.col("before") + F.col("n"))
    # A group of pieces ends with an entry; what follows the last one of a file has none.
    texts = numbered(edges).groupBy("file", "g").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"), F.max("ended").alias("ended")).filter("ended")
    texts = texts.select("file", "g", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    follows = F.col("text").rlike(r"^\s*,\s*\{")
    # The first entry of a list stands behind the fields before it, which with it are an object of their own.
    field = F.try_parse_json(F.concat(F.regexp_replace("text", r"^\s*\]\s*,", "{"), F.lit("]}")))
    texts = texts.withColumn("head", F.when(~follows, field)).withColumn("e", F.when(follows, _parsed(F.col("text"))).otherwise(F.try_variant_get("head", "$.entry[0]", "variant")))
    texts = texts.select("file", "g", "e", follows.alias("follows"), F.try_variant_get("head", "$.entry[0]", "variant").isNotNull().alias("heads"))
    # A row a file: where its list of entries begins and where the next list does.
    lists = texts.filter("not follows").groupBy("file").agg(F.min(F.when(F.col("heads"), F.col("g"))).alias("first"), F.collect_list("g").alias("starts"))
    lists = lists.select("file", "first", F.array_min(F.filter("starts", lambda g: g > F.col("first"))).alias("next")).filter("first IS NOT NULL")
    inner = numbered(_entries(spark, path, known, inner=True))
    # Exploded, as the parse would else be repeated in a filter.
    listed = lambda rows: rows.join(F.broadcast(lists), "file").filter((F.col("g") >= F.col("first")) & (F.col("next").isNull() | (F.col("g") < F.col("next"))))
    both = listed(inner).select("file", (F.col("g") - F.col("first")).cast("int").alias("pos"), F.explode(F.array(_parsed(F.col("text")))).alias("e")).unionByName(listed(texts).select("file", (F.col("g") - F.col("first")).cast("int").alias("pos"), "e"))
    return resources(both)


def report(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_ends, whole): ends of entries and of other listed objects in each file, and whether it is closed at its end."""
    known, _ = _read(spark, path)
    g = known.groupBy("file").agg(F.sum("ends").alias("n_ends"), F.max_by(F.struct("inside", "c_end", "s_end"), "block").alias("at"))
    return g.select("file", "n_ends", (~F.col("at.inside") & (F.col("at.c_end") == 0) & (F.col("at.s_end") == 0)).alias("whole"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Record rows of all bundles under ``path``; patients and unsupported types are left out."""
    return project(entries(spark, path))
