"""How extracted entities compare with what a note holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Abbreviations in the order they are written out, and classes that are attributes and are not scored.
SYNONYMS = {"htn": "hypertension", "dm2": "type 2 diabetes", "t2dm": "type 2 diabetes", "dm": "diabetes", "sob": "shortness of breath", "cp": "chest pain", "gerd": "gastroesophageal reflux disease", "pcn": "penicillin", "breast ca": "breast cancer", "colon ca": "colon cancer", "ca": "cancer"}
ATTRIBUTES = ["provider", "dosage", "route", "frequency", "duration", "date"]


def normalize(text: Column) -> Column:
    """Lower case, spoken blood pressures as numbers, no punctuation but slashes, abbreviations written out."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(\d+)\s+over\s+(\d+)", "$1/$2")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\w\s/]", " "), r"\s+", " "))
    written = x
    for short, full in SYNONYMS.items():
        written = F.regexp_replace(written, rf"\b{short}\b", full)
    return F.when(x.rlike(rf"\b(?:{'|'.join(SYNONYMS)})\b"), written).otherwise(x)


def alike(a: Column, b: Column) -> Column:
    """Two normalised texts, neither empty, one within the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def compare(expected: DataFrame, unwanted: DataFrame, family: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per note and class: counts, and lists of what was missed, false and extracted though unwanted.

    ``expected`` and ``extracted`` hold note, entity_class, text; ``unwanted``
    reason too; ``family`` note and text. Entities meet within a note and class:
    all four are laid in one table and grouped once. Columns: n_wanted, tp, fp,
    n_neg, neg, n_attr, attr, n_kin, kin; missed, false, violated (arrays of
    text, in order).
    """
    cls = lambda name: F.lit(name).alias("entity_class")
    some = lambda df, role, c, reason=None: df.select("note", c, F.lit(role).alias("role"), "text", (reason if reason is not None else F.lit(None).cast("string")).alias("reason"))
    rows = some(expected, "wanted", F.col("entity_class")).unionByName(some(extracted, "found", F.col("entity_class")))
    rows = rows.unionByName(some(unwanted, "barred", F.col("entity_class"), F.col("reason"))).unionByName(some(family, "kin", cls("family_history")))
    one = F.struct("text", normalize(F.col("text")).alias("said"), "reason")
    part = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, one))).alias(role)
    g = rows.groupBy("note", "entity_class").agg(*map(part, ("wanted", "found", "barred", "kin")))
    met = lambda x, others: F.exists(others, lambda y: alike(x["said"], y["said"]))
    attribute = F.col("entity_class").isin(*ATTRIBUTES)
    scored = F.when(attribute, F.array().cast(g.schema["found"].dataType)).otherwise(F.col("found"))
    among = lambda name, others, keep: F.filter(name, lambda x: met(x, others) if keep else ~met(x, others))
    g = g.withColumn("scored", scored)
    g = g.withColumns({"missed": among("wanted", F.col("scored"), False), "false": among("scored", F.col("wanted"), False), "violated": among("barred", F.col("found"), True), "kin_met": among("kin", F.col("found"), True)})
    of = lambda name, reason: F.size(F.filter(name, lambda x: x["reason"] == reason))
    texts = lambda name: F.transform(name, lambda x: x["text"]).alias(name)
    size = lambda name: F.size(name).cast("long")
    return g.select(
        "note", "entity_class", size("wanted").alias("n_wanted"), (size("wanted") - size("missed")).alias("tp"), size("false").alias("fp"), size("scored").alias("n_scored"),
        of("barred", "negation").alias("n_neg"), of("violated", "negation").alias("neg"), of("barred", "attribution").alias("n_attr"), of("violated", "attribution").alias("attr"),
        size("kin").alias("n_kin"), size("kin_met").alias("kin"), texts("missed"), texts("false"), texts("violated"), F.size("found").alias("n_found"),
    )


def _measures(tp: Column, fp: Column, n_wanted: Column) -> list[Column]:
    """precision, recall, f1 to 4 places; without anything expected or found they are whole."""
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.when(n_wanted == tp, 1.0).otherwise(0.0))
    recall = F.when(n_wanted > 0, tp / n_wanted).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [F.bround(precision, 4).alias("precision"), F.bround(recall, 4).alias("recall"), F.bround(f1, 4).alias("f1")]


def by_class(compared: DataFrame, by: tuple[str, ...] = ("note", "entity_class"), carry: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of each class that something was expected of; over all notes with ``by`` = entity_class.

    ``compared`` has a row per note and class, which are grouped no more;
    ``carry`` names further columns of it to keep then.
    """
    if set(by) == {"note", "entity_class"}:
        g = compared.withColumn("fp", F.col("fp").cast("long"))
    else:
        g = compared.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("n_wanted").alias("n_wanted"))
    g = g.filter("n_wanted > 0")
    return g.select(*by, *carry, "tp", "fp", (F.col("n_wanted") - F.col("tp")).alias("fn"), *_measures(F.col("tp"), F.col("fp"), F.col("n_wanted")))


def evaluate(expected: DataFrame, unwanted: DataFrame, family: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per note: tp, fp, fn, precision, recall, f1, negation_accuracy, attribution_accuracy (4 places); takes what ``compare`` takes."""
    # A note of attributes alone has nothing to score.
    compared = compare(expected, unwanted, family, extracted).filter("n_wanted + n_scored + n_neg + n_attr + n_kin > 0 OR size(violated) > 0 OR n_found = 0")
    sums = [F.sum(c).alias(c) for c in ("n_wanted", "tp", "fp", "n_neg", "neg", "n_attr", "attr", "n_kin", "kin")]
    rows = compared.groupBy("note").agg(*sums)
    kin_total = F.col("n_attr") + F.col("n_kin")
    return rows.select(
        "note", "tp", "fp", (F.col("n_wanted") - F.col("tp")).alias("fn"), *_measures(F.col("tp"), F.col("fp"), F.col("n_wanted")),
        F.when(F.col("n_neg") > 0, F.bround(1 - F.col("neg") / F.col("n_neg"), 4)).otherwise(1.0).alias("negation_accuracy"),
        F.when(kin_total > 0, F.bround((F.col("n_attr") - F.col("attr") + F.col("kin")) / kin_total, 4)).otherwise(1.0).alias("attribution_accuracy"),
    )
