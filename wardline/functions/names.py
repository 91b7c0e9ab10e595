"""Names of people taken out of texts, from spans that some recogniser found.

A span is wider than the names in it, so its words are looked at one by one:
those written like a name go, unless a disease or a sign is called after them,
they end like a speciality or a disease, or they are a drug. Names with nothing
but blanks between them are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import parts_for

#: People whose names stand for diseases, signs and devices.
EPONYMS = [
    "crohn", "parkinson", "alzheimer", "hodgkin", "bell", "foley", "graves", "cushing", "addison", "paget", "wilson", "huntington", "marfan", "raynaud", "sjogren", "guillain",
    "barre", "hashimoto", "kawasaki", "asperger", "tourette", "down", "charcot", "babinski", "romberg", "murphy", "mcburney", "homans", "tinel", "phalen", "apgar", "glasgow",
    "whipple", "meniere", "barrett", "dupuytren", "wegener", "behcet", "hirschsprung", "ehlers", "danlos", "klinefelter", "turner", "gilbert", "mallory", "weiss", "swan", "ganz",
    "hickman", "kaposi", "burkitt", "wernicke", "korsakoff", "lewy", "pick", "broca", "brudzinski", "kernig", "wilms", "ewing", "reye", "still", "felty",
]
#: Endings of specialities, diseases and procedures.
ENDINGS = ["ology", "ologist", "iatry", "iatrist", "itis", "emia", "aemia", "opathy", "pathy", "ectomy", "ostomy", "otomy", "plasty", "oma", "osis", "iasis", "algia", "ostosis", "plegia", "trophy"]
PERSON, NAME = "PERSON", "[NAME]"
#: Shorter words are never looked up as drugs.
DRUG_CHARS = 4


def _laid(texts: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both dealt by id to as many parts as the texts need: what follows meets by id, so no task grows with them."""
    parts = parts_for(texts)
    return texts.repartition(parts, "id"), spans.filter(F.col("label") == PERSON).select("id", "start", "end").repartition(parts, "id")


def _words(text: Column, at: Column, to: Column) -> Column:
    """The words of letters of a span, with their places."""
    pieces = F.regexp_extract_all(F.substr(text, at + 1, to - at), F.lit(r"(\p{L}+|[^\p{L}]+)"))
    before = F.aggregate(pieces, F.struct(at.cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int,word:string>>").alias("out")), lambda x, p: F.struct((x["at"] + F.length(p)).alias("at"), F.concat(x["out"], F.array(F.struct(x["at"].alias("start"), (x["at"] + F.length(p)).alias("end"), p.alias("word")))).alias("out")))
    return F.filter(before["out"], lambda w: w["word"].rlike(r"^\p{L}"))


def _found(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``span_words`` of what ``_laid`` gives."""
    of = spans.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans")).hint("merge")
    words = F.flatten(F.transform("spans", lambda s: _words(F.col("text"), s["start"], s["end"])))
    return texts.select("id", "text").join(of, "id").select("id", F.explode(F.array_distinct(words)).alias("w")).select("id", "w.*")


def span_words(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, start, end, word) of the words of letters in the PERSON spans (id, start, end, label) of texts (id, text); once each, however many spans hold it."""
    return _found(*_laid(texts, spans))


def is_name(word: Column) -> Column:
    """Written with a capital and small letters, and neither an eponym nor with such an ending."""
    low = F.lower(word)
    return word.rlike(r"^\p{Lu}\p{Ll}*$") & ~low.isin(*EPONYMS) & ~reduce(lambda x, e: x | low.endswith(e), ENDINGS, F.lit(False))


def _gone(texts: DataFrame, spans: DataFrame, drugs: DataFrame | None) -> DataFrame:
    """(id, text and others, gone) of what ``_laid`` gives: an array of what is taken out (start, end), null where there is nothing."""
    found = _found(texts, spans).filter(is_name(F.col("word")))
    if drugs is not None:
        known = drugs.select(F.col("term").alias("_drug")).filter(F.length("_drug") >= DRUG_CHARS).distinct()
        found = found.join(F.broadcast(known), F.lower("word") == F.col("_drug"), "left_anti")
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found")).hint("merge")
    blank = lambda x, w: F.regexp_replace(F.substr("text", x["before"] + 1, w["start"] - x["before"]), r"(?U)\s+", "") == ""
    # The last name of the walk grows while nothing but blanks parts it from the next word.
    grown = lambda x, w: F.struct(x["start"].alias("start"), F.greatest(x["end"], w["end"]).alias("end"), w["end"].alias("before"), x["out"].alias("out"))
    next_ = lambda x, w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["end"].alias("before"), F.concat(x["out"], F.array(F.struct(x["start"], x["end"]))).alias("out"))
    first = F.get("found", F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int>>")
    walk = F.aggregate(F.slice("found", F.lit(2), F.size("found")), F.struct(first["start"].alias("start"), first["end"].alias("end"), first["end"].alias("before"), none.alias("out")), lambda x, w: F.when(blank(x, w), grown(x, w)).otherwise(next_(x, w)), lambda x: F.concat(x["out"], F.array(F.struct(x["start"], x["end"]))))
    return texts.join(listed, "id", "left").withColumn("gone", F.when(F.col("found").isNotNull(), walk)).drop("found")


def name_spans(texts: DataFrame, spans: DataFrame, drugs: DataFrame | None = None) -> DataFrame:
    """(id, start, end) of what is taken out: names, those parted by blanks alone joined.

    ``drugs`` (term, in lower case; broadcast) are kept; a term of several words
    keeps none of its words. Places are code points of the text.
    """
    return _gone(*_laid(texts, spans), drugs).select("id", F.explode("gone").alias("g")).select("id", "g.*")


def redact_names(texts: DataFrame, spans: DataFrame, drugs: DataFrame | None = None) -> DataFrame:
    """``texts`` (id, text) with redacted and n_names. Texts without names, empty and null ones stay as they are."""
    rows = _gone(*_laid(texts, spans), drugs)
    ends = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["end"]))
    kept = F.transform("gone", lambda g, i: F.substr("text", F.get(ends, i) + 1, g["start"] - F.get(ends, i)))
    tail = F.substr("text", F.element_at(ends, -1) + 1)
    redacted = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform(kept, lambda k: F.concat(k, F.lit(NAME))), ""), tail))
    return rows.select(*texts.columns, redacted.alias("redacted"), F.coalesce(F.array_size("gone"), F.lit(0)).alias("n_names"))
