"""Codes for terms: a normalised alias, else its first word, else its last, else a close spelling.

Aliases are a dimension (alias, code, display) of any size. They are joined to
the distinct terms, so a term is looked up once, however many rows carry it,
and Spark broadcasts whichever side is small.

Close spellings are found through an index of parts. Where the characters of two
texts agree up to d insertions and deletions and the one is cut into d + 1
parts, some part i is whole in the other, with exactly i operations before it:
take the first i that parts 0 to i have no more than i operations in. So a term
has few pieces that may be that part. The parts of all aliases are a table, the
pieces meet it in an equi-join, and only pairs that share one are compared. As
many share one by chance, each text bears counts of its characters in 64 bits,
of which an insertion or deletion turns one at most; only pairs that these
leave in reach are compared letter by letter.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.clinical import normalize_term
from wardline.functions.similarity import _ratio, token_set_ratio
from wardline.session import parts_for

#: Both similarities of a close spelling, 0 to 100, must reach this.
CLOSE = 88.0


def _one_per_alias(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("alias").agg(F.min_by(F.struct("code", "display"), F.struct("code", "display")).alias("hit"))


def _apart(total: Column, close: float) -> Column:
    """Insertions and deletions that texts of ``total`` characters may differ by; a little is added for rounding."""
    return F.floor(total * (1 - close / 100) + 1e-9).cast("int")


def _longest(length: Column, close: float) -> Column:
    """The longest text that can be close to one of ``length``."""
    return F.floor(length * close / (200 - close) * ((200 - close) / close) ** 2 + 1e-9).cast("int")


def _counts(text: Column) -> Column:
    """64 bits: for each of 16 kinds of characters whether a text has at least 1, 2, 3 and 4 of them; characters without a kind don't count."""
    kinds = ["".join(c for c in (chr(97 + i), chr(113 + i) if i < 10 else "", str(i) if i < 10 else "") if c) for i in range(16)]
    levels = [F.least(F.regexp_count(text, F.lit(f"[{k}]")), F.lit(4)) for k in kinds]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.get(F.array(*[F.lit((2**n - 1) << 4 * i if i < 15 or n < 4 else ((2**n - 1) << 4 * i) - 2**64).cast("long") for n in range(5)]), n) for i, n in enumerate(levels)])


def close_index(aliases: DataFrame, close: float = CLOSE) -> DataFrame:
    """(size, part_no, part, alias, counts) of distinct aliases: an index of close spellings, to be kept as a table or built on the way.

    An alias is cut evenly into one part more than the operations between it and
    the longest text it can be close to. Null and empty aliases have none.
    """
    rows = aliases.filter("alias <> ''").select("alias").distinct().withColumn("size", F.length("alias"))
    rows = rows.repartition(parts_for(rows)).withColumns({"parts": _parts(F.col("size"), close), "counts": _counts(F.col("alias"))})
    rows = rows.select("alias", "size", "parts", "counts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_no"))
    at, to = _edge(F.col("part_no")), _edge(F.col("part_no") + 1)
    return rows.select("size", "part_no", F.substr("alias", at + 1, to - at).alias("part"), "alias", "counts")


def _parts(size: Column, close: float) -> Column:
    return F.least(size, _apart(size + _longest(size, close), close) + 1)


def _edge(part_no: Column) -> Column:
    """Where a part begins: sizes and parts are columns of those names."""
    return F.floor(part_no * F.col("size") / F.col("parts")).cast("int")


def close_pairs(keys: DataFrame, index: DataFrame, close: float = CLOSE) -> DataFrame:
    """(term_key, alias, tokens, letters) of all pairs whose two similarities reach ``close``.

    ``keys`` has distinct term_key. For each size of alias that can be close and
    each part i of it, the pieces of the term are taken that i insertions and
    deletions before and the operations left after it can shift there.
    """
    # Few bytes, but much to do with each: dealt out by number, not by size.
    parts = parts_for(keys)
    k = keys.repartition(parts).select("term_key", F.length("term_key").alias("n"), _counts(F.col("term_key")).alias("own"))
    least = F.ceil(F.col("n") * close / (200 - close) - 1e-9).cast("int")
    rows = k.select("term_key", "n", "own", F.explode(F.sequence(F.greatest(least, F.lit(1)), F.greatest(_longest(F.col("n"), close), F.lit(1)))).alias("size"))
    rows = rows.withColumn("d", _apart(F.col("n") + F.col("size"), close)).withColumn("parts", _parts(F.col("size"), close))
    sizes = index.select("size").distinct()
    rows = rows.join(F.broadcast(sizes), "size").filter("abs(n - size) <= d")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("d"), F.col("parts") - 1))).alias("part_no"))
    at, to = _edge(F.col("part_no")), _edge(F.col("part_no") + 1)
    # Each operation before a part shifts it by one, to either side; those after it make up for the rest of the lengths.
    shifts = F.sequence(-F.col("part_no"), F.col("part_no"), F.lit(2))
    rows = rows.select("term_key", "n", "own", "size", "part_no", at.alias("at"), (to - at).alias("length"), "d", F.explode(F.when(F.col("part_no") == 0, F.array(F.lit(0))).otherwise(shifts)).alias("shift"))
    rows = rows.withColumn("from", F.col("at") + F.col("shift")).filter("from >= 0 AND from <= n - length AND abs(n - size - shift) <= d - part_no")
    place = ["size", "part_no", "part"]
    pieces = rows.select("term_key", "own", "size", "part_no", "d", F.substr("term_key", F.col("from") + 1, F.col("length")).alias("part")).repartition(parts, *place)
    met = pieces.join(index.repartition(parts, *place).hint("merge"), place)
    # One condition, so that its parts keep their order.
    met = met.filter(F.when(F.bit_count(F.col("own").bitwiseXOR(F.col("counts"))) <= F.col("d"), F.levenshtein("term_key", "alias", 1 << 20) <= F.col("d")))
    pairs = met.select("term_key", "alias").distinct()
    # A filter on it would else be pushed below the distinct and score a pair for each part.
    scored = pairs.select("term_key", "alias", _alike.asNondeterministic()("term_key", "alias").alias("s"))
    return scored.select("term_key", "alias", "s.tokens", "s.letters").filter((F.col("tokens") >= close) & (F.col("letters") >= close))


@F.pandas_udf(T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("letters", T.DoubleType())]))
def _alike(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(token_set_ratio(x, y), _ratio(x, y)) for x, y in zip(a, b, strict=True)], columns=["tokens", "letters"], dtype=float)


def look_up(df: DataFrame, aliases: DataFrame, term: str, first_word: bool = True, last_word: bool = False, fuzzy: bool = False, index: DataFrame | None = None) -> DataFrame:
    """``df`` with code, display and matched (exact, first word, last word, close, or null) for column ``term``.

    Null and empty terms have no code. ``fuzzy`` looks for close spellings of
    the terms left over: of the aliases whose token similarity and letter
    similarity both reach ``CLOSE`` the one of the higher token similarity, then
    the shorter, then the first. ``index`` is a kept ``close_index`` of the
    aliases; without it one is built on the way.
    """
    known = _one_per_alias(aliases)
    keyed = df.withColumn("term_key", normalize_term(F.col(term)))
    keys = keyed.select("term_key").filter("term_key <> ''").distinct()
    words = F.split("term_key", " ")
    many = F.size(words) > 1
    tries = [("exact", F.col("term_key"))]
    tries += [("first word", F.when(many, F.get(words, F.lit(0))))] if first_word else []
    tries += [("last word", F.when(many, F.element_at(words, -1)))] if last_word else []
    found = keys
    for i, (_, key) in enumerate(tries):
        found = found.withColumn(f"key_{i}", key).join(known.select(F.col("alias").alias(f"key_{i}"), F.col("hit").alias(f"hit_{i}")), f"key_{i}", "left")
    hits = [F.col(f"hit_{i}") for i in range(len(tries))]
    how = F.coalesce(*[F.when(h.isNotNull(), F.lit(name)) for h, (name, _) in zip(hits, tries, strict=True)])
    found = found.select("term_key", F.coalesce(*hits).alias("hit"), how.alias("matched"))
    if fuzzy:
        pairs = close_pairs(found.filter("matched IS NULL").select("term_key"), index if index is not None else close_index(known))
        best = pairs.groupBy("term_key").agg(F.min_by("alias", F.struct(-F.col("tokens"), F.length("alias"), F.col("alias"))).alias("alias"))
        close = best.join(known, "alias").select("term_key", F.col("hit").alias("close"))
        found = found.join(close, "term_key", "left").select("term_key", F.coalesce("hit", "close").alias("hit"), F.coalesce("matched", F.when(F.col("close").isNotNull(), "close")).alias("matched"))
    found = found.select("term_key", F.col("hit.code").alias("code"), F.col("hit.display").alias("display"), "matched")
    return keyed.join(found, "term_key", "left").drop("term_key")
