"""Entity resolution: bucketed pairs, scores, decisions, merges and their undo.

Records of one user with the same type and code (or first 50 characters of
text) form a bucket; pairs are an equi-join on the bucket with an order
condition, never a nested loop over records. A bucket of n records has n(n-1)/2
pairs by definition of the scan. Where only scores above 0.70 count, ``pairs``
can leave out those more than 7 days apart (``within_days``), since they score
0.70 at most: the join then meets days by week, so a hot bucket is cut.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.fhir import bound
from wardline.functions.similarity import token_set_ratio_udf

#: Signal weights and thresholds.
WEIGHTS = {"code": 0.40, "text": 0.30, "fuzzy": 0.20, "near": 0.20, "far": -0.35, "status": 0.10, "cross": 0.10, "section": 0.15}
SCAN_KEEP, UPLOAD_KEEP, JUDGE, AUTO = 0.70, 0.50, 0.60, 0.95
SURE = 0.8

FIELDS = ["id", "record_type", "code_value", "display_text", "effective_date", "status", "source_format", "source_section"]


def bucket_key() -> Column:
    text = F.lower(F.substring("display_text", 1, 50))
    return F.coalesce(F.nullif(F.col("code_value"), F.lit("")), text)


def _prepared(df: DataFrame) -> DataFrame:
    """Bucket and scan order (date ascending, undated last, then id)."""
    day = F.col("effective_date").cast("timestamp_ntz")
    return df.select("user_id", *FIELDS, bucket_key().alias("bucket"), F.struct(day.isNull().alias("u"), day.alias("d"), F.col("id").alias("i")).alias("place"))


def _side(df: DataFrame, name: str) -> DataFrame:
    keep = ["user_id", "record_type", "bucket"]
    return df.select(*keep, *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c not in keep])


def pairs(df: DataFrame, within_days: int | None = None) -> DataFrame:
    """Pairs inside a bucket, the earlier record as a; with ``within_days`` only those no further apart, or with an undated record."""
    p = _prepared(df)
    if within_days is None:
        return _side(p, "a").join(_side(p, "b"), ["user_id", "record_type", "bucket"]).filter(F.col("place_a") < F.col("place_b"))
    span = within_days * 86_400_000_000
    at = F.unix_micros(F.col("effective_date").cast("timestamp"))
    week = F.floor(at / span)
    keys = ["user_id", "record_type", "bucket", "slot"]
    dated = p.filter("effective_date IS NOT NULL")
    a = _side(dated.withColumn("slot", week), "a").withColumnRenamed("slot_a", "slot")
    # A later record within reach lies in the same slot or the next.
    b = _side(dated.withColumn("slot", F.explode(F.array(week, week - 1))), "b").withColumnRenamed("slot_b", "slot")
    gap = F.timestamp_diff("MICROSECOND", F.col("effective_date_a"), F.col("effective_date_b"))
    near = a.join(b, keys).filter((F.col("place_a") < F.col("place_b")) & (gap <= span)).drop("slot")
    # Undated records come last in the scan order and meet all others of their bucket.
    undated = _side(p, "a").join(_side(p.filter("effective_date IS NULL"), "b"), keys[:3]).filter(F.col("place_a") < F.col("place_b"))
    return near.unionByName(undated)


def pairs_between(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Pairs of an existing record (a) and a new one (b) in one bucket."""
    return _side(_prepared(existing), "a").join(_side(_prepared(new), "b"), ["user_id", "record_type", "bucket"])


def score(candidates: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Add score (0 to 1) and the signals it adds up, in a fixed order of additions."""
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    gap = F.abs(F.timestamp_diff("MICROSECOND", a("effective_date"), b("effective_date"))) / F.lit(86_400_000_000.0)
    text_a, text_b = F.lower(a("display_text")), F.lower(b("display_text"))
    same_code = (F.coalesce(a("code_value"), F.lit("")) != "") & (a("code_value") == b("code_value"))
    same_text = F.coalesce(text_a == text_b, F.lit(False))
    if fuzzy:  # the Python function sees only pairs whose texts differ; equal ones are null on both sides and cached
        like = token_set_ratio_udf(F.when(~same_text, text_a), F.when(~same_text, text_b)) / 100.0 > 0.8
        rows = candidates.withColumn("like", ~same_text & like)
    else:
        rows = candidates.withColumn("like", F.lit(False))
    rows = rows.select(
        "*",
        F.coalesce(same_code, F.lit(False)).alias("s_code"),
        same_text.alias("s_text"),
        F.coalesce(gap < 1, F.lit(False)).alias("s_near"),
        F.coalesce(gap > 7, F.lit(False)).alias("s_far"),
        F.coalesce((a("status") != "") & (a("status") == b("status")), F.lit(False)).alias("s_status"),
        F.coalesce(a("source_format") != b("source_format"), F.lit(False)).alias("s_cross"),
        F.coalesce((a("source_section") != "") & (a("source_section") == b("source_section")), F.lit(False)).alias("s_section"),
    )
    zero = F.lit(0.0)
    part = lambda flag, w: F.when(F.col(flag), F.lit(WEIGHTS[w])).otherwise(zero)
    total = zero + part("s_code", "code")
    total = total + F.when(F.col("s_text"), F.lit(WEIGHTS["text"])).when(F.col("like"), F.lit(WEIGHTS["fuzzy"])).otherwise(zero)
    total = total + F.when(F.col("s_near"), F.lit(WEIGHTS["near"])).when(F.col("s_far"), F.lit(WEIGHTS["far"])).otherwise(zero)
    total = total + part("s_status", "status") + part("s_cross", "cross") + part("s_section", "section")
    return rows.withColumn("score", F.greatest(zero, F.least(F.lit(1.0), total)))


def without_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Drop pairs that ``known`` (record_a_id, record_b_id) has in either order."""
    k = known.select(F.least("record_a_id", "record_b_id").alias("lo"), F.greatest("record_a_id", "record_b_id").alias("hi")).distinct()
    c = candidates.withColumn("lo", F.least("id_a", "id_b")).withColumn("hi", F.greatest("id_a", "id_b"))
    return c.join(k, ["lo", "hi"], "left_anti").drop("lo", "hi")


def band(score_column: str = "score") -> Column:
    """Ten-point band of a score rounded half to even to whole per cent."""
    return (F.floor(F.bround(F.col(score_column) * 100) / 10) * 10).cast("long")


def default_judge(score_column: str = "score") -> tuple[Column, Column]:
    """Verdict and confidence of the built-in judge, a stand-in for an injected model."""
    s = F.col(score_column)
    verdict = F.when(s >= 0.85, "duplicate").when(s >= 0.75, "update").when(s >= 0.65, "related").otherwise("distinct")
    return verdict, F.when(s >= 0.85, F.lit(0.9)).when(s >= 0.65, F.lit(0.6)).otherwise(F.lit(0.8))


#: What a judge can say of a pair, what counts where it says something else, and its confidence where it names none.
VERDICTS, OTHER, UNSAID = ["duplicate", "update", "related", "distinct"], "related", 0.5


def read_verdict(answer: Column) -> Column:
    """struct(verdict, confidence) of a judge's JSON; without one (a failed call, a broken answer) the pair is related with confidence 0, so a person looks at it."""

    def read(said: Column) -> Column:
        verdict, sure = F.try_variant_get(said, "$.classification", "string"), F.try_variant_get(said, "$.confidence", "double")
        held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(sure, F.lit(UNSAID))))
        return F.struct(F.when(verdict.isin(*VERDICTS), verdict).otherwise(OTHER).alias("verdict"), F.when(said.isNull(), 0.0).otherwise(held).alias("confidence"))

    return bound(F.try_parse_json(F.when(answer.rlike(r"^\s*\{"), answer)), read)


def decide_by_calls(scored: DataFrame, prompt: Column, keep: float = UPLOAD_KEEP, **options) -> DataFrame:
    """``decide`` with a model as the judge; pairs that are merged without one are not asked about.

    ``options`` are those of ``calls.call_models``; the operation is dedup. Adds
    error and attempts of the call.
    """
    from wardline.operators.calls import call_models

    rows = scored.filter((F.col("score") >= keep) & (F.col("score") >= JUDGE))
    asked = rows.withColumn("operation", F.lit("dedup")).withColumn("prompt", F.when(F.col("score") < AUTO, prompt))
    told = call_models(asked, **options).withColumn("_said", read_verdict(F.col("answer")))
    return decide(told, keep, lambda: (F.col("_said.verdict"), F.col("_said.confidence"))).drop("operation", "prompt", "provider", "answer", "_said")


def decide(scored: DataFrame, keep: float = UPLOAD_KEEP, judge=default_judge) -> DataFrame:
    """Add verdict, confidence and decision (merge, dismiss, pending); pairs below ``keep`` or the judge's band go."""
    verdict, confidence = judge()
    rows = scored.filter((F.col("score") >= keep) & (F.col("score") >= JUDGE))
    auto = F.col("score") >= AUTO
    rows = rows.withColumn("verdict", F.when(auto, "duplicate").otherwise(verdict)).withColumn("confidence", F.when(auto, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))))
    sure = F.col("confidence") >= SURE
    return rows.withColumn("auto_resolved", auto | (sure & F.col("verdict").isin("duplicate", "distinct"))).withColumn("decision", F.when(auto | (sure & (F.col("verdict") == "duplicate")), "merge").when(sure & (F.col("verdict") == "distinct"), "dismiss").otherwise("pending"))


def greedy_merges(scored: DataFrame, threshold: float = AUTO) -> DataFrame:
    """The scan's merges (primary_id, secondary_id, score): once merged, a record takes part in no further pair.

    Only pairs at the threshold travel; they are walked in scan order per
    (user, type, bucket), which the pairs never leave. The walk is a fold over
    the sorted pairs of a bucket, and buckets of a batch go to Python together.
    """
    hit = scored.filter(F.col("score") >= threshold).select("user_id", "record_type", "bucket", F.struct("place_a", "place_b", "id_a", "id_b", "score").alias("pair"))
    walked = hit.groupBy("user_id", "record_type", "bucket").agg(F.array_sort(F.collect_list("pair")).alias("pairs"))
    kept = walked.select("pairs", F.explode(_walk("pairs.id_a", "pairs.id_b")).alias("at")).select(F.get("pairs", F.col("at")).alias("pair"))
    return kept.select(F.col("pair.id_a").alias("primary_id"), F.col("pair.id_b").alias("secondary_id"), F.col("pair.score").alias("score"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _walk(firsts: pd.Series, seconds: pd.Series) -> pd.Series:
    """The numbers of the pairs that merge."""
    out = []
    for a_ids, b_ids in zip(firsts, seconds, strict=True):
        gone, kept = set(), []
        for i, (a, b) in enumerate(zip(a_ids, b_ids, strict=True)):
            if a not in gone and b not in gone:
                gone.add(b)
                kept.append(i)
        out.append(kept)
    return pd.Series(out)


def best_merge(decided: DataFrame) -> DataFrame:
    """One merge per new record: the best score, then the smallest existing id."""
    order = Window.partitionBy("id_b").orderBy(F.desc("score"), "id_a")
    return decided.filter(F.col("decision") == "merge").withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == 1).select(F.col("id_a").alias("primary_id"), F.col("id_b").alias("secondary_id"), "score")


def apply_merges(df: DataFrame, merges: DataFrame) -> DataFrame:
    """Mark secondaries as duplicates of their primaries; other rows pass."""
    m = merges.select(F.col("secondary_id").alias("id"), F.col("primary_id").alias("new_parent"), F.col("score").alias("merge_score"))
    joined = df.join(m, "id", "left")
    old = F.col("merged_into_id") if "merged_into_id" in df.columns else F.lit(None).cast("long")
    return joined.withColumn("merged_into_id", F.coalesce("new_parent", old)).withColumn("is_duplicate", F.col("is_duplicate") | F.col("new_parent").isNotNull()).drop("new_parent", "merge_score")


def undo_merges(df: DataFrame, merges: DataFrame) -> DataFrame:
    """Take ``merges`` back: their secondaries are records of their own again."""
    m = merges.select(F.col("secondary_id").alias("id"), F.lit(True).alias("undo")).distinct()
    joined = df.join(m, "id", "left")
    undo = F.coalesce("undo", F.lit(False))
    return joined.withColumn("is_duplicate", F.col("is_duplicate") & ~undo).withColumn("merged_into_id", F.when(~undo, F.col("merged_into_id"))).drop("undo")


def merge_fields(df: DataFrame, overrides: list[str] | None = None, protected: tuple[str, ...] = ("resourceType", "_extraction_metadata", "id", "meta")) -> DataFrame:
    """Field-level update of ``old`` by ``new``, both map<string,string> of JSON values.

    Adds updated, previous (what undo needs; null for a field that was absent),
    fields_updated and fields_kept, each sorted.
    """
    keys = F.array_sort(F.array_union(F.map_keys("old"), F.map_keys("new")))
    changed = F.filter(keys, lambda k: ~k.isin(*protected) & ~F.try_element_at("old", k).eqNullSafe(F.try_element_at("new", k)))
    rows = df.withColumn("changed", changed)
    chosen = F.col("changed") if overrides is None else F.filter("changed", lambda k: k.isin(*overrides))
    rows = rows.withColumn("fields_updated", chosen).withColumn("fields_kept", F.array_except("changed", "fields_updated"))
    rows = rows.withColumn("previous", F.map_from_arrays("fields_updated", F.transform("fields_updated", lambda k: F.try_element_at("old", k))))
    stay = F.map_filter("old", lambda k, v: ~F.array_contains(F.col("fields_updated"), k))
    come = F.map_filter("new", lambda k, v: F.array_contains(F.col("fields_updated"), k))
    return rows.withColumn("updated", F.map_concat(stay, come)).drop("changed")


def revert_fields(df: DataFrame) -> DataFrame:
    """Undo ``merge_fields``: add reverted from updated and previous; a null previous value removes the field."""
    stay = F.map_filter("updated", lambda k, v: ~F.map_contains_key("previous", k))
    return df.withColumn("reverted", F.map_concat(stay, F.map_filter("previous", lambda k, v: v.isNotNull())))


def resolve_bulk(candidates: DataFrame, action: str, ids: list[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Set status of pending candidates, chosen by ids, else by score band [low, high), else all of them."""
    chosen = F.col("status") == "pending"
    if ids:
        chosen = chosen & F.col("candidate_id").isin(*ids)
    else:
        pct = F.bround(F.col("score") * 100)
        chosen = chosen & ((pct >= low) if low is not None else F.lit(True)) & ((pct < high) if high is not None else F.lit(True))
    return candidates.withColumn("status", F.when(chosen, {"merge": "merged", "dismiss": "dismissed"}[action]).otherwise(F.col("status")))
