"""Review of an upload's candidates, re-extraction, demographics and links inside a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How an assessment refers to a record of its document, by the record's class; "addresses" otherwise.
REFERENCES = {"medication": "prescribes", "lab_result": "supports", "vital": "supports", "imaging_result": "supports", "family_history": "supports", "social_history": "supports"}


def resolve_review(candidates: DataFrame, resolutions: DataFrame, records: DataFrame) -> DataFrame:
    """``candidates`` with the status their resolution gives: merge and update merge, dismiss and keep_both dismiss.

    ``candidates`` has candidate_id, id_a, id_b, status; ``resolutions`` has
    candidate_id and action, one row a candidate. A candidate of which either
    record is gone stays as it is, and so does one with another action.
    """
    there = records.select("id").distinct()
    whole = candidates.join(there.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(there.withColumnRenamed("id", "id_b"), "id_b", "left_semi").select("candidate_id")
    asked = resolutions.join(whole, "candidate_id", "left_semi").select("candidate_id", "action")
    new = F.when(F.col("action").isin("merge", "update"), "merged").when(F.col("action").isin("dismiss", "keep_both"), "dismissed")
    return candidates.join(asked, "candidate_id", "left").withColumn("status", F.coalesce(new, F.col("status"))).drop("action")


def upload_states(candidates: DataFrame, upload: str = "upload_id") -> DataFrame:
    """(upload, n_pending, ingestion_status): completed once nothing is pending, else awaiting_review."""
    pending = F.count_if(F.col("status") == "pending")
    return candidates.groupBy(upload).agg(pending.alias("n_pending"), F.when(pending == 0, "completed").otherwise("awaiting_review").alias("ingestion_status"))


def undo(candidates: DataFrame, ids: DataFrame, to: str) -> DataFrame:
    """Merged candidates in ``ids`` go back: to pending from an upload's review, to dismissed from the list of merges."""
    hit = candidates.join(ids.select("candidate_id", F.lit(True).alias("_hit")).distinct(), "candidate_id", "left")
    return hit.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "merged"), F.lit(to)).otherwise(F.col("status"))).drop("_hit")


def replace_extracted(df: DataFrame, files: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Soft-delete what was extracted from ``files`` (source_file_id) before; (records, provenance rows).

    Structured records of a file stay.
    """
    hit = df.join(files.select("source_file_id", F.lit(True).alias("_hit")).distinct(), "source_file_id", "left")
    gone = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("ai_extracted") & F.col("deleted_at").isNull()
    marked = hit.withColumn("_gone", gone)
    provenance = marked.filter("_gone").select(F.col("id").alias("record_id"), F.lit("reextraction_replace").alias("action"), "source_file_id", F.lit("extraction_worker").alias("agent"))
    return marked.withColumn("deleted_at", F.when(F.col("_gone"), at).otherwise(F.col("deleted_at"))).drop("_hit", "_gone"), provenance


def fill_blanks(patients: DataFrame, incoming: DataFrame, key: str, fields: list[str], arrival: list[str]) -> DataFrame:
    """Fill null fields of ``patients``, each from the first incoming row that has it; what is set is never overwritten."""
    some = lambda f: F.nullif(F.trim(F.col(f)), F.lit(""))
    first = incoming.groupBy(key).agg(*[F.min_by(some(f), F.when(some(f).isNotNull(), F.struct(*arrival))).alias(f"new_{f}") for f in fields])
    joined = patients.join(first, key, "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(F.col(f), F.col(f"new_{f}")))
    return joined.drop(*[f"new_{f}" for f in fields])


def scrub_arguments(patients: DataFrame, owner: str = "user_id") -> DataFrame:
    """What is known of an owner's patients (id, name, mrn, dob) for de-identification: all names, the first number and date."""
    order = Window.partitionBy(owner, "name").orderBy("id")
    named = patients.withColumn("_first", F.row_number().over(order) == 1)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    listed = F.array_sort(F.collect_list(F.when(F.col("_first") & (F.col("name") != ""), F.struct("id", "name"))))
    return named.groupBy(owner).agg(F.transform(listed, lambda x: x["name"]).alias("names"), first("mrn"), first("dob"))


def document_references(entities: DataFrame) -> DataFrame:
    """(document_record_id, referenced_record_id, reference_type): each assessment of a document to its other records.

    ``entities`` has doc_id, id and entity_class. Encounters are linked
    otherwise; assessments do not refer to one another.
    """
    kinds = F.create_map(*[F.lit(x) for kv in REFERENCES.items() for x in kv])
    plans = entities.filter("entity_class = 'assessment_plan'").select("doc_id", F.col("id").alias("document_record_id"))
    others = entities.filter("entity_class NOT IN ('assessment_plan', 'encounter')").select("doc_id", F.col("id").alias("referenced_record_id"), F.coalesce(kinds[F.col("entity_class")], F.lit("addresses")).alias("reference_type"))
    return plans.join(others, "doc_id").drop("doc_id")


def reference_totals(*kinds: str) -> list[Column]:
    """Aggregates over a document's records: n_references and n_<kind> of what ``document_references`` gives, without listing it."""
    cls = F.col("entity_class")
    plans, others = F.count_if(cls == "assessment_plan"), ~cls.isin("assessment_plan", "encounter")
    named = F.create_map(*[F.lit(x) for kv in REFERENCES.items() for x in kv])
    of = lambda kind: F.count_if(others & (F.coalesce(named[cls], F.lit("addresses")) == kind))
    return [(plans * F.count_if(others)).alias("n_references"), *((plans * of(k)).alias(f"n_{k}") for k in kinds)]
