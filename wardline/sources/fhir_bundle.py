"""FHIR bundles as resources, with references to people and places filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.fhir import items, project, text

#: Types that encounters refer to.
NAMED_TYPES = ["Practitioner", "Organization", "Location"]


def entries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, pos, full_url, resource) of the bundles under ``path``.

    A file is one JSON document; with ``lines`` each line is one, so large
    exports can be split by Spark. A document that is no bundle is one entry.
    Broken JSON gives no entries.
    """
    docs = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))
    return from_documents(docs)


def from_documents(docs: DataFrame) -> DataFrame:
    """Entries of parsed documents (file, doc)."""
    listed = F.coalesce(items("doc", "$.entry"), F.when(text("doc", "$.resourceType") != "Bundle", F.array(F.col("doc"))))
    return resources(docs.select("file", F.posexplode(listed).alias("pos", "e")))


def resources(rows: DataFrame) -> DataFrame:
    """(file, pos, full_url, resource) of entries (file, pos, e)."""
    # What an entry lacks is dear to look for by path; a struct has it as null. Exploded, it is read once, whatever the filter.
    rows = rows.select("file", "pos", "e", F.explode(F.array(F.try_variant_get("e", "$", "struct<fullUrl:string,resourceType:string,resource:variant>"))).alias("x"))
    bare = F.nullif("x.resourceType", F.lit("")).isNotNull() & F.col("x.resource").isNull()
    rows = rows.select("file", "pos", F.nullif("x.fullUrl", F.lit("")).alias("full_url"), F.when(bare, F.col("e")).otherwise(F.col("x.resource")).alias("resource"))
    return rows.filter(text("resource", "$.resourceType").isNotNull())


def human_name(r: str, path: str):
    """A HumanName's text, or its parts in order."""
    words = lambda p: F.array_join(F.coalesce(F.try_variant_get(r, f"{path}.{p}", "array<string>"), F.array().cast("array<string>")), " ")
    parts = F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (words("prefix"), words("given"), text(r, f"{path}.family"), words("suffix"))])
    return F.coalesce(text(r, f"{path}.text"), F.nullif(parts, F.lit("")))


def names(rows: DataFrame) -> DataFrame:
    """(file, reference, name): people and places of a file by Type/id and by full URL; the first wins."""
    kind = text("resource", "$.resourceType")
    name = F.coalesce(F.when(kind == "Practitioner", human_name("resource", "$.name[0]")), text("resource", "$.name"))
    found = rows.filter(kind.isin(*NAMED_TYPES)).select("file", "pos", name.alias("name"), F.explode(F.array(F.concat(kind, F.lit("/"), text("resource", "$.id")), F.col("full_url"))).alias("reference"))
    return found.filter(F.col("name").isNotNull() & F.col("reference").isNotNull()).groupBy("file", "reference").agg(F.min_by("name", "pos").alias("name"))


def encounter_people(rows: DataFrame) -> DataFrame:
    """(file, pos, people): names of an encounter's participants in order, a reference's name filled in where it has no display."""
    enc = rows.filter(text("resource", "$.resourceType") == "Encounter")
    refs = enc.select("file", "pos", F.posexplode(items("resource", "$.participant")).alias("n", "p"))
    refs = refs.select("file", "pos", "n", text("p", "$.individual.display").alias("display"), text("p", "$.individual.reference").alias("reference"))
    filled = refs.join(names(rows), ["file", "reference"], "left").select("file", "pos", "n", F.coalesce("display", "name").alias("who"))
    return filled.groupBy("file", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "who"))), lambda x: x["who"]).alias("people"))


def patient(rows: DataFrame) -> DataFrame:
    """The first patient of each file: name, birth date, sex, record number."""
    order = Window.partitionBy("file").orderBy("pos")
    first = rows.filter(text("resource", "$.resourceType") == "Patient").withColumn("n", F.row_number().over(order)).filter("n = 1")
    ids = F.transform(items("resource", "$.identifier"), lambda x: F.struct(F.coalesce(text(x, "$.type.coding[0].code") == "MR", F.lit(False)).alias("mr"), text(x, "$.value").alias("v")))
    mrn = F.coalesce(F.get(F.filter(ids, lambda x: x["mr"]), F.lit(0))["v"], F.get(ids, F.lit(0))["v"])
    name = F.trim(F.regexp_replace(human_name("resource", "$.name[0]"), r"[\^,|\s]+", " "))
    return first.select("file", name.alias("name"), text("resource", "$.birthDate").alias("birth_date"), text("resource", "$.gender").alias("sex"), mrn.alias("mrn"))


def records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Record rows of all bundles under ``path``; patients and unsupported types are left out."""
    return project(entries(spark, path, lines))
