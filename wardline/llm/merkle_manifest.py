"""Merkle manifest of a dataset by superblock reduction.

Every row is a leaf. Leaves are numbered within their group (its source) by a
range sort, so a group is spread over as many partitions as it needs. Numbers
are bucketed by fanout^k; ``applyInPandas`` collapses k levels of one bucket
(256 leaves with fanout 16 and k = 2), and the bucket roots are numbered and
collapsed again until each group has one node, its subroot. The subroots,
ordered by group, go through the same reduction up to the root.

Proofs come back down: a bucket's nodes meet the proof of their bucket root in
a cogroup, put the siblings of their own k levels before it, and pass the whole
on. A level of a proof is two strings, the digests left and right of the node,
so a proof is checked by ``fold`` in Spark alone.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import checkpointed
from wardline.session import table

FANOUT = 16
#: Levels that one bucket collapses.
LEVELS = 2
#: What a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_IN_PART = (1 << 33) - 1


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """sha256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(F.arrays_zip(lefts.alias("l"), rights.alias("r")), lambda s: F.concat(s["l"], s["r"])), ""), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, its number from 0 in its ``group`` by ``order``, and ``m``, the size of that group.

    Rows are sorted by ranges and written; a row's place in its part, the first
    place of its group there and the group's rows in the parts before give the
    number. No group is held together, and equal rows can be parted, too.
    """
    tie = F.monotonically_increasing_id()
    by = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("tie")]
    laid = checkpointed(rows.withColumn("tie", tie).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie"))
    at = laid.withColumn("at", F.monotonically_increasing_id())
    at = at.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit(_IN_PART)))
    counts = at.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # At most a row for each part and each group that begins there.
    parts = Window.partitionBy(group).orderBy("part")
    counts = counts.select(group, "part", "first", (F.sum("n").over(parts) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(group)).alias("m"))
    return at.join(counts, [group, "part"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def _up(digests: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(digests[i : i + fanout]).encode()).hexdigest() for i in range(0, len(digests), fanout)]


def _height(m: int, fanout: int, levels: int) -> int:
    """How many of ``levels`` levels a group of m nodes has."""
    n = 0
    while m > 1 and n < levels:
        m, n = -(-m // fanout), n + 1
    return n


def _collapse(fanout: int, levels: int):
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        m, digests = int(nodes["m"].iloc[0]), nodes["digest"].tolist()
        for _ in range(_height(m, fanout, levels)):
            digests, m = _up(digests, fanout), -(-m // fanout)
        return pd.DataFrame({"grp": nodes["grp"].iloc[:1].tolist(), "idx": [int(nodes["bucket"].iloc[0])], "m": [m], "digest": digests})

    return run


def _descend(fanout: int, levels: int, names: list[str]):
    def run(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        rows, m = [nodes["digest"].tolist()], int(nodes["m"].iloc[0])
        for _ in range(_height(m, fanout, levels)):
            rows.append(_up(rows[-1], fanout))
        # Siblings of each node of each level, from the top down, before those of the bucket's root.
        proofs = [(list(above["lefts"].iloc[0]), list(above["rights"].iloc[0]))]
        for level in reversed(rows[:-1]):
            below = []
            for i in range(len(level)):
                at = i - i % fanout
                left, right = proofs[i // fanout]
                below.append((["".join(level[at:i]), *left], ["".join(level[i + 1 : at + fanout]), *right]))
            proofs = below
        out = nodes.assign(lefts=[p[0] for p in proofs], rights=[p[1] for p in proofs], subroot=above["subroot"].iloc[0], root=above["root"].iloc[0])
        return out[names]

    return run


def _reduce(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The table of nodes (grp, idx, m, digest and what else there is) and those of bucket roots above it, up to one node a group."""
    tables = [nodes]
    most = nodes.agg(F.max("m")).first()[0] or 1
    while most > 1:
        some = tables[-1].select("grp", F.expr(f"idx div {fanout**levels}").alias("bucket"), "idx", "m", "digest")
        tables.append(checkpointed(some.groupBy("grp", "bucket").applyInPandas(_collapse(fanout, levels), "grp string, idx long, m long, digest string")))
        most = -(-most // fanout**levels)
    return tables


def _prove(tables: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The lowest of ``tables`` with lefts, rights, subroot and root; ``tops`` has them for the group's last node."""
    above = tops.select("grp", F.lit(0).cast("long").alias("idx"), "lefts", "rights", "subroot", "root")
    for nodes in reversed(tables[:-1]):
        carried = [c for c in nodes.columns if c != "bucket"]
        kinds = T.StructType([*(nodes.schema[c] for c in carried), *(above.schema[c] for c in ("lefts", "rights", "subroot", "root"))])
        left = nodes.withColumn("bucket", F.expr(f"idx div {fanout**levels}")).groupBy("grp", "bucket")
        above = left.cogroup(above.withColumnRenamed("idx", "bucket").groupBy("grp", "bucket")).applyInPandas(_descend(fanout, levels, kinds.names), kinds)
    if len(tables) == 1:
        return tables[0].join(above.drop("idx"), "grp")
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", carry: tuple[str, ...] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Per row: ``key``, ``group``, leaf, subroot, root, lefts and rights (the proof, lowest level first), and the ``carry`` columns, which are strings.

    A leaf covers ``fields``; null values and empty texts differ ("-" and
    "0:"). Groups are ordered null first, then bytewise; leaves by key (null
    first), then by digest, so ties and repeated rows have one result. A lone
    leaf is its subroot, a lone subroot the root. Very long texts are hashed
    whole and don't leave the scan. Empty table: no rows. Other columns are
    ignored, ``carry`` apart.
    """
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("grp"),
        F.col(key).alias("k"),
        F.col(group).alias("g"),
        leaf_digest(*(F.col(f) for f in fields)).alias("digest"),
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)),
    )
    # Long ids with nulls among them don't survive pandas as numbers.
    leaves = checkpointed(numbered(rows, "grp", ["k", "digest"]).withColumns({c: F.col(c).cast("string") for c in ("k", "g")}))
    tables = _reduce(leaves, fanout, levels)
    # "-" is below "=", so null comes first; the subroots are one group of their own.
    subroots = tables[-1].filter("idx = 0").select(F.lit("all").alias("grp"), F.col("grp").alias("of"), "digest")
    upper = _reduce(checkpointed(numbered(subroots, "grp", ["of"])), fanout, levels)
    empty = F.array().cast("array<string>")
    root = upper[-1].select("grp", empty.alias("lefts"), empty.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    tops = _prove(upper, root, fanout, levels).select(F.col("of").alias("grp"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    # One row a group, but of long proofs: written, so that it isn't built again for each level below.
    proved = _prove(tables, checkpointed(tops), fanout, levels)
    return proved.select(F.col("k").cast(docs.schema[key].dataType).alias(key), F.col("g").cast(docs.schema[group].dataType).alias(group), F.col("digest").alias("leaf"), "subroot", "root", "lefts", "rights", *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; where 5 divides the crc32 of doc_id the proof is folded from a tampered leaf. Without doc_id nothing is tampered with."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    changed = leaf_digest(*(F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text")) if f == "text" else F.col(f) for f in FIELDS))
    proved = manifest(docs.withColumn("tampered", changed), carry=("tampered",))
    folded = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"), fold(F.col("tampered"), F.col("lefts"), F.col("rights")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 6) -> str:
    """SQL for groups of up to 16^levels leaves: each level is a table, its runs are lists."""
    field = lambda v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || {v}, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(text if f == 'text' else f) for f in FIELDS)})"
    upper = "".join(map(chr, range(65, 91)))
    ctes = [
        "crcs AS (SELECT list(c) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i) ORDER BY i))",
        f"""named AS (SELECT doc_id, coalesce('=' || source, '-') AS grp, {leaf("text")} AS leaf,
  {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} AS lowered,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) AS crc FROM documents, crcs)""",
        "s0 AS (SELECT *, CASE WHEN coalesce(crc % 5 = 0, false) THEN lowered ELSE leaf END AS other, leaf AS d, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS m FROM named)",
    ]

    def climb(name: str) -> None:
        for i in range(levels):
            ctes.append(f"{name}r{i} AS (SELECT grp, idx // 16 AS run, list(d ORDER BY idx) AS ds, any_value(m) AS m FROM {name}{i} GROUP BY ALL)")
            ctes.append(f"{name}{i + 1} AS (SELECT grp, run AS idx, CASE WHEN m > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d, (m + 15) // 16 AS m FROM {name}r{i})")

    def descend(name: str, source: str) -> str:
        for i in range(levels):
            here = f"{name}p{i}"
            at, run = f"(x.idx // {16**i}) % 16", f"x.idx // {16 ** (i + 1)}"
            left, right = f"array_to_string(r.ds[1:{at}], '')", f"array_to_string(r.ds[{at} + 2:], '')"
            cur = "x.cur"
            ctes.append(f"{here} AS (SELECT x.* EXCLUDE (proof, cur), CASE WHEN r.m > 1 THEN x.proof || {left} || {right} ELSE x.proof END AS proof, CASE WHEN r.m > 1 THEN sha256({left} || {cur} || {right}) ELSE {cur} END AS cur FROM {source} x JOIN {name}r{i} r ON r.grp = x.grp AND r.run = {run})")
            source = here
        return source

    climb("s")
    ctes.append("u0 AS (SELECT 'all' AS grp, grp AS part, d, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS m FROM s%d)" % levels)
    climb("u")
    ctes.append("sfrom AS (SELECT doc_id, grp, idx, leaf, '' AS proof, other AS cur FROM s0)")
    low = descend("s", "sfrom")
    ctes.append(f"ufrom AS (SELECT p.doc_id, p.leaf, u.d AS subroot, u.grp, u.idx, p.proof, p.cur FROM {low} p JOIN u0 u ON u.part = p.grp)")
    top = descend("u", "ufrom")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, u.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u.d AS verified FROM {top} p JOIN u{levels} u ON u.grp = p.grp"


ORACLE_SQL = _oracle()
