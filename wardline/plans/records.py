"""The canonical record view over the driver's tables, and its read queries.

Every query serves all users at once; rows of one user are told apart by
windows and groupings on user_id, so a page or a top list is per user unless
stated. Orderings are total: id breaks ties. Null order is always explicit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.units import normalize_units
from wardline.session import table

CODES = ["4548-4", "13457-7", "2085-9", "2093-3", "2571-8", "2339-0", "2345-7", "2160-0", "8310-5", "8867-4"]
TYPES = {"click": "observation", "view": "observation", "purchase": "medication", "signup": "encounter", "error": "condition"}
RESOURCES = {"observation": "Observation", "medication": "MedicationRequest", "encounter": "Encounter", "condition": "Condition"}
FORMATS = ["fhir_r4", "epic_ehi", "cda_r2", "ai_extracted"]
UNITS = ["mg/dL", "mmol/L", " MG/DL "]


def _pick(index, values):
    """values[index] (from 0), null beyond the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as health records: one row per event, canonical columns."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    resources = F.create_map(*[F.lit(x) for kv in RESOURCES.items() for x in kv])
    code = F.when(i % 13 != 0, _pick(k % 10, CODES))
    kind = kinds[F.col("event_type")]
    return e.select(
        i.alias("id"),
        F.col("user_id"),
        kind.alias("record_type"),
        resources[kind].alias("fhir_resource_type"),
        code.alias("code_value"),
        F.when(code.isNotNull(), F.lit("http://loinc.org")).alias("code_system"),
        F.concat(F.lit("code "), code).alias("code_display"),
        F.col("event_type").alias("display_text"),
        F.when(i % 29 != 0, F.col("ts")).alias("effective_date"),
        _pick(i % 4, FORMATS).alias("source_format"),
        F.floor(i / 500).cast("long").alias("source_file_id"),
        F.concat(F.lit("sys"), (i % 3).cast("string")).alias("source_system"),
        F.when(i % 6 != 0, (i % 4000).cast("string")).alias("external_id"),
        F.when(i % 5 < 3, "active").otherwise("final").alias("status"),
        F.when(i % 3 != 0, F.concat(F.lit("section "), (i % 4).cast("string"))).alias("source_section"),
        (i % 11 == 0).alias("is_duplicate"),
        F.when(i % 17 == 0, F.col("ts")).alias("deleted_at"),
        F.col("ts").alias("created_at"),
        F.col("value"),
        _pick(i % 4, UNITS).alias("unit"),
        (k / F.lit(100.0)).alias("confidence_score"),
        (i % 7 == 0).alias("ai_extracted"),
        F.when((i % 5 == 0) & (kind != "encounter"), i - i % 50).alias("linked_encounter_id"),
    )


#: The same view for the oracle; queries follow it as ``WITH records AS (...)``.
RECORDS_SQL = f"""
records AS (
  SELECT *, CASE WHEN code_value IS NOT NULL THEN 'http://loinc.org' END AS code_system, 'code ' || code_value AS code_display
  FROM (
    SELECT event_id AS id, user_id, kind AS record_type,
      CASE kind WHEN 'observation' THEN 'Observation' WHEN 'medication' THEN 'MedicationRequest' WHEN 'encounter' THEN 'Encounter' WHEN 'condition' THEN 'Condition' END AS fhir_resource_type,
      CASE WHEN event_id % 13 <> 0 THEN list_extract({CODES}, k % 10 + 1) END AS code_value,
      event_type AS display_text, CASE WHEN event_id % 29 <> 0 THEN ts END AS effective_date,
      list_extract({FORMATS}, event_id % 4 + 1) AS source_format, event_id // 500 AS source_file_id, 'sys' || (event_id % 3) AS source_system,
      CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 4000 AS VARCHAR) END AS external_id,
      CASE WHEN event_id % 5 < 3 THEN 'active' ELSE 'final' END AS status, CASE WHEN event_id % 3 <> 0 THEN 'section ' || (event_id % 4) END AS source_section,
      event_id % 11 = 0 AS is_duplicate, CASE WHEN event_id % 17 = 0 THEN ts END AS deleted_at, ts AS created_at, value,
      list_extract({UNITS}, event_id % 4 + 1) AS unit, k / 100.0::DOUBLE AS confidence_score, event_id % 7 = 0 AS ai_extracted,
      CASE WHEN event_id % 5 = 0 AND kind <> 'encounter' THEN event_id - event_id % 50 END AS linked_encounter_id
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      CASE event_type WHEN 'click' THEN 'observation' WHEN 'view' THEN 'observation' WHEN 'purchase' THEN 'medication' WHEN 'signup' THEN 'encounter' WHEN 'error' THEN 'condition' END AS kind FROM events)
  )
), active AS (SELECT * FROM records WHERE deleted_at IS NULL AND NOT is_duplicate)
"""

NORMALIZED_SQL = """
normalized AS (
  SELECT a.*, CASE
      WHEN code_value = '4548-4' AND u = 'mmol/mol' THEN round_even(value * 1.0 / 10.929 + 2.15, 2)
      WHEN code_value IN ('13457-7', '2085-9', '2093-3') AND u = 'mmol/l' THEN round_even(value * 38.67 / 1.0 + 0.0, 2)
      WHEN code_value = '2571-8' AND u = 'mmol/l' THEN round_even(value * 88.57 / 1.0 + 0.0, 2)
      WHEN code_value IN ('2339-0', '2345-7') AND u = 'mmol/l' THEN round_even(value * 18.0182 / 1.0 + 0.0, 2)
      WHEN code_value = '2160-0' AND u = 'umol/l' THEN round_even(value * 1.0 / 88.42 + 0.0, 2)
      ELSE value END AS norm_value,
    CASE WHEN code_value = '4548-4' THEN '%' WHEN code_value IN ('13457-7', '2085-9', '2093-3', '2571-8', '2339-0', '2345-7', '2160-0') THEN 'mg/dL' ELSE unit END AS norm_unit
  FROM (SELECT *, coalesce(lower(trim(unit)), '') AS u FROM active) a
)
"""


def active(df: DataFrame) -> DataFrame:
    """Rows that are neither deleted nor merged away."""
    return df.filter(F.col("deleted_at").isNull() & ~F.col("is_duplicate"))


def observations_by_code(df: DataFrame) -> DataFrame:
    """Per user and code of numeric observations: latest and prior reading, count and the ascending series."""
    numeric = active(df).filter((F.col("record_type") == "observation") & F.col("code_value").isNotNull() & F.col("value").isNotNull())
    readings = normalize_units(numeric)
    newest = Window.partitionBy("user_id", "code_value").orderBy(F.desc_nulls_last("effective_date"), F.desc("id"))
    reading = F.struct("norm_value", "effective_date", "norm_unit")
    ranked = readings.withColumn("place", F.row_number().over(newest))
    return ranked.groupBy("user_id", "code_value").agg(
        F.count("*").alias("n_readings"),
        F.first(F.when(F.col("place") == 1, reading), ignorenulls=True).alias("latest"),
        F.first(F.when(F.col("place") == 2, reading), ignorenulls=True).alias("prior"),
        F.array_sort(F.collect_list(F.struct("effective_date", "id", "norm_value"))).alias("series"),
    )


def q_observations_by_code(spark, sf_dir):
    g = observations_by_code(records(spark, sf_dir))
    return g.select(
        "user_id",
        "code_value",
        "n_readings",
        F.col("latest.norm_value").alias("latest_value"),
        F.col("latest.effective_date").alias("latest_date"),
        F.col("latest.norm_unit").alias("latest_unit"),
        F.col("prior.norm_value").alias("prior_value"),
        F.col("prior.effective_date").alias("prior_date"),
        F.bround(F.aggregate("series", F.lit(0.0), lambda a, x: a + x["norm_value"]), 2).alias("series_sum"),
    )


OBSERVATIONS_SQL = f"""
WITH {RECORDS_SQL}, {NORMALIZED_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, code_value ORDER BY effective_date DESC NULLS LAST, id DESC) AS place
  FROM normalized WHERE record_type = 'observation' AND code_value IS NOT NULL AND value IS NOT NULL
)
SELECT user_id, code_value, count(*) AS n_readings, max(norm_value) FILTER (WHERE place = 1) AS latest_value,
  max(effective_date) FILTER (WHERE place = 1) AS latest_date, max(norm_unit) FILTER (WHERE place = 1) AS latest_unit,
  max(norm_value) FILTER (WHERE place = 2) AS prior_value, max(effective_date) FILTER (WHERE place = 2) AS prior_date,
  round_even(sum(norm_value), 2) AS series_sum
FROM ranked GROUP BY user_id, code_value
"""


def record_series(df: DataFrame) -> DataFrame:
    """The dated numeric readings of each code, one row each, with their place in the series."""
    rows = normalize_units(active(df).filter(F.col("code_value").isNotNull() & F.col("value").isNotNull() & F.col("effective_date").isNotNull()))
    order = Window.partitionBy("user_id", "code_value").orderBy("effective_date", "id")
    return rows.select("user_id", "code_value", "id", "effective_date", F.col("norm_value").alias("value"), F.col("norm_unit").alias("unit"), F.row_number().over(order).cast("long").alias("place"))


SERIES_SQL = f"""
WITH {RECORDS_SQL}, {NORMALIZED_SQL}
SELECT user_id, code_value, id, effective_date, norm_value AS value, norm_unit AS unit,
  row_number() OVER (PARTITION BY user_id, code_value ORDER BY effective_date, id) AS place
FROM normalized WHERE code_value IS NOT NULL AND value IS NOT NULL AND effective_date IS NOT NULL
"""

SORTS = {
    ("date", "desc"): [F.desc_nulls_last, "effective_date"],
    ("date", "asc"): [F.asc_nulls_first, "effective_date"],
    ("display_text", "asc"): [F.asc, "display_text"],
    ("display_text", "desc"): [F.desc, "display_text"],
    ("type", "asc"): [F.asc, "record_type"],
    ("type", "desc"): [F.desc, "record_type"],
    ("created", "asc"): [F.asc, "created_at"],
    ("created", "desc"): [F.desc, "created_at"],
}


def records_list(df: DataFrame, page: int = 1, size: int = 20, sort: str = "date", direction: str = "desc", record_type: str | None = None, status: str | None = None, code: str | None = None, text: str | None = None) -> DataFrame:
    """One page per user of active records under the filters, with the total before paging; ``text`` is a contains match on two columns."""
    rows = active(df)
    for column, wanted in (("record_type", record_type), ("status", status), ("code_value", code)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    if text:
        rows = rows.filter(F.col("display_text").ilike(f"%{text}%") | F.col("code_display").ilike(f"%{text}%"))
    way, column = SORTS[sort, direction]
    order = Window.partitionBy("user_id").orderBy(way(column), F.asc("id"))
    total = rows.groupBy("user_id").agg(F.count("*").alias("total"))
    # The window alone prunes to the first pages on the map side; the total is a small join.
    paged = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= page * size).filter(F.col("place") > (page - 1) * size)
    return paged.join(total, "user_id").select("user_id", F.col("place").cast("long").alias("place"), "id", "record_type", "display_text", "effective_date", "total")


def _list_sql(order: str, where: str, low: int, high: int) -> str:
    return f"""
WITH {RECORDS_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, id) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM active WHERE {where}
)
SELECT user_id, place, id, record_type, display_text, effective_date, total FROM placed WHERE place > {low} AND place <= {high}
"""


def records_search(df: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """The newest ``limit`` matches per user; merged-away rows are searched too."""
    rows = df.filter(F.col("deleted_at").isNull() & (F.col("display_text").ilike(f"%{text}%") | F.col("code_display").ilike(f"%{text}%")))
    order = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("effective_date"), "id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("user_id", F.col("place").cast("long").alias("place"), "id", "display_text", "code_display", "effective_date")


SEARCH_SQL = f"""
WITH {RECORDS_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY effective_date DESC NULLS LAST, id) AS place
  FROM records WHERE deleted_at IS NULL AND (display_text ILIKE '%45%' OR code_display ILIKE '%45%')
)
SELECT user_id, place, id, display_text, code_display, effective_date FROM placed WHERE place <= 50
"""


def records_recent(df: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return active(df).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("user_id", F.col("place").cast("long").alias("place"), "id", "created_at")


RECENT_SQL = f"""
WITH {RECORDS_SQL}
SELECT user_id, place, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS place FROM active) WHERE place <= 10
"""


def record_stats(df: DataFrame) -> DataFrame:
    return active(df).groupBy("user_id").agg(F.count("*").alias("total"), F.min("effective_date").alias("first_date"), F.max("effective_date").alias("last_date"), F.count_distinct("source_format").alias("n_formats"), F.count_distinct("record_type").alias("n_types"))


STATS_SQL = f"""
WITH {RECORDS_SQL}
SELECT user_id, count(*) AS total, min(effective_date) AS first_date, max(effective_date) AS last_date, count(DISTINCT source_format) AS n_formats, count(DISTINCT record_type) AS n_types FROM active GROUP BY user_id
"""


def counts_by_type(df: DataFrame) -> DataFrame:
    return active(df).groupBy("user_id", "record_type").agg(F.count("*").alias("n"))


COUNTS_SQL = f"WITH {RECORDS_SQL} SELECT user_id, record_type, count(*) AS n FROM active GROUP BY user_id, record_type"


def sources(df: DataFrame) -> DataFrame:
    """Records per source format of a user, the commonest first."""
    n = active(df).groupBy("user_id", "source_format").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "source_format")).cast("long"))


SOURCES_SQL = f"""
WITH {RECORDS_SQL}, n AS (SELECT user_id, source_format, count(*) AS n FROM active GROUP BY 1, 2)
SELECT user_id, source_format, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, source_format) AS place FROM n
"""


def date_range(df: DataFrame) -> DataFrame:
    """First and last date per user; duplicates are included."""
    return df.filter(F.col("deleted_at").isNull()).groupBy("user_id").agg(F.min("effective_date").alias("first_date"), F.max("effective_date").alias("last_date"), F.count("effective_date").alias("dated"))


RANGE_SQL = f"WITH {RECORDS_SQL} SELECT user_id, min(effective_date) AS first_date, max(effective_date) AS last_date, count(effective_date) AS dated FROM records WHERE deleted_at IS NULL GROUP BY user_id"


def timeline(df: DataFrame, limit: int = 25) -> DataFrame:
    """The newest dated records per user, with the number before the limit."""
    rows = active(df).filter(F.col("effective_date").isNotNull())
    total = rows.groupBy("user_id").agg(F.count("*").alias("total"))
    order = Window.partitionBy("user_id").orderBy(F.desc("effective_date"), "id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).join(total, "user_id").select("user_id", F.col("place").cast("long").alias("place"), "id", "record_type", "effective_date", "source_format", "total")


TIMELINE_SQL = f"""
WITH {RECORDS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY effective_date DESC, id) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM active WHERE effective_date IS NOT NULL)
SELECT user_id, place, id, record_type, effective_date, source_format, total FROM placed WHERE place <= 25
"""


def timeline_months(df: DataFrame) -> DataFrame:
    """Records per user and month, the undated as their own group."""
    month = F.coalesce(F.date_format("effective_date", "yyyy-MM"), F.lit("undated"))
    return active(df).groupBy("user_id", month.alias("month")).agg(F.count("*").alias("n"))


MONTHS_SQL = f"WITH {RECORDS_SQL} SELECT user_id, coalesce(strftime(effective_date, '%Y-%m'), 'undated') AS month, count(*) AS n FROM active GROUP BY 1, 2"


def labs(df: DataFrame, page: int = 1, size: int = 25, low: float = 10.0, high: float = 90.0) -> DataFrame:
    """A page of observations per user with reference range, flag and gauge position (2 to 98 per cent)."""
    rows = df.filter(F.col("deleted_at").isNull() & (F.col("record_type") == "observation"))
    order = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("effective_date"), "id")
    v = F.col("value")
    gauge = F.greatest(F.lit(2.0), F.least(F.lit(98.0), F.bround((v - low) / (high - low) * 100, 4)))
    flag = F.when(v < low, "L").when(v > high, "H").otherwise("N")
    placed = rows.withColumn("place", F.row_number().over(order)).filter((F.col("place") > (page - 1) * size) & (F.col("place") <= page * size))
    return placed.select("user_id", F.col("place").cast("long").alias("place"), "id", "value", flag.alias("flag"), F.when(v.isNotNull(), gauge).alias("gauge"))


LABS_SQL = f"""
WITH {RECORDS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY effective_date DESC NULLS LAST, id) AS place FROM records WHERE deleted_at IS NULL AND record_type = 'observation')
SELECT user_id, place, id, value, CASE WHEN value < 10.0 THEN 'L' WHEN value > 90.0 THEN 'H' ELSE 'N' END AS flag,
  CASE WHEN value IS NOT NULL THEN greatest(2.0, least(98.0, round_even((value - 10.0) / 80.0 * 100, 4))) END AS gauge
FROM placed WHERE place <= 25
"""


def linked_records(df: DataFrame) -> DataFrame:
    """Encounters (any record that others name) with the active records linked to them, newest first, undated before."""
    order = Window.partitionBy("encounter_id").orderBy(F.desc_nulls_first("effective_date"), "id")
    child = active(df).filter(F.col("linked_encounter_id").isNotNull()).select(F.col("linked_encounter_id").alias("encounter_id"), "id", "effective_date")
    parent = df.filter(F.col("deleted_at").isNull()).select(F.col("id").alias("encounter_id"), F.col("record_type").alias("encounter_type"))
    return child.join(parent, "encounter_id").withColumn("place", F.row_number().over(order).cast("long"))


LINKED_SQL = f"""
WITH {RECORDS_SQL}
SELECT p.id AS encounter_id, c.id, c.effective_date, p.record_type AS encounter_type,
  row_number() OVER (PARTITION BY p.id ORDER BY c.effective_date DESC NULLS FIRST, c.id) AS place
FROM active c JOIN records p ON c.linked_encounter_id = p.id AND p.deleted_at IS NULL
"""


def export_bundle(df: DataFrame) -> DataFrame:
    """One FHIR bundle (JSON text) per user: active records, newest first."""
    resource = F.struct(F.col("fhir_resource_type").alias("resourceType"), F.col("id").cast("string").alias("id"), F.col("status").alias("status"), F.coalesce("code_value", F.lit("")).alias("code"))
    entry = F.struct(F.col("effective_date").isNull().alias("u"), (-F.unix_micros(F.col("effective_date").cast("timestamp"))).alias("d"), F.col("id").alias("i"), F.struct(resource.alias("resource")).alias("e"))
    g = active(df).groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return g.select("user_id", F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.lit("collection").alias("type"), F.size("x").cast("long").alias("total"), F.transform("x", lambda y: y["e"]).alias("entry"))).alias("bundle"))


def q_export_bundle(spark, sf_dir):
    return export_bundle(records(spark, sf_dir)).select("user_id", F.length("bundle").cast("long").alias("chars"), F.sha2("bundle", 256).alias("bundle_sha256"))


EXPORT_SQL = f"""
WITH {RECORDS_SQL}, entries AS (
  SELECT user_id, count(*) AS total, string_agg('{{"resource":{{"resourceType":"' || fhir_resource_type || '","id":"' || id || '","status":"' || status || '","code":"' || coalesce(code_value, '') || '"}}}}', ',' ORDER BY effective_date DESC NULLS LAST, id) AS body
  FROM active GROUP BY user_id
), bundles AS (SELECT user_id, '{{"resourceType":"Bundle","type":"collection","total":' || total || ',"entry":[' || body || ']}}' AS bundle FROM entries)
SELECT user_id, length(bundle) AS chars, sha256(bundle) AS bundle_sha256 FROM bundles
"""


def overview(df: DataFrame) -> DataFrame:
    """Totals per user in one pass: all, active, duplicates left out, deleted, with a code, extracted, mean confidence."""
    live = F.col("deleted_at").isNull()
    return df.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(live & ~F.col("is_duplicate")).alias("n_active"),
        F.count_if(live & F.col("is_duplicate")).alias("n_duplicates"),
        F.count_if(~live).alias("n_deleted"),
        F.count_if(live & F.col("code_value").isNotNull()).alias("n_coded"),
        F.coalesce(F.sum(F.when(F.col("ai_extracted"), 1).otherwise(0)), F.lit(0)).alias("n_extracted"),
        F.bround(F.avg("confidence_score"), 4).alias("mean_confidence"),
    )


OVERVIEW_SQL = f"""
WITH {RECORDS_SQL}
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE deleted_at IS NULL AND NOT is_duplicate) AS n_active, count(*) FILTER (WHERE deleted_at IS NULL AND is_duplicate) AS n_duplicates,
  count(*) FILTER (WHERE deleted_at IS NOT NULL) AS n_deleted, count(*) FILTER (WHERE deleted_at IS NULL AND code_value IS NOT NULL) AS n_coded,
  CAST(coalesce(sum(CASE WHEN ai_extracted THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_extracted, round_even(avg(confidence_score), 4) AS mean_confidence
FROM records GROUP BY user_id
"""


def normalized_units(df: DataFrame) -> DataFrame:
    return normalize_units(active(df)).select("id", "code_value", F.col("norm_value").alias("value"), F.col("norm_unit").alias("unit"))


UNITS_SQL = f"WITH {RECORDS_SQL}, {NORMALIZED_SQL} SELECT id, code_value, norm_value AS value, norm_unit AS unit FROM normalized"


def sparkline(df: DataFrame) -> DataFrame:
    """Each dated reading scaled by its code's range for a user, clamped to 2-98 per cent; a flat series sits at 50."""
    rows = normalize_units(active(df).filter(F.col("code_value").isNotNull() & F.col("effective_date").isNotNull()))
    by = Window.partitionBy("user_id", "code_value")
    low, high = F.min("norm_value").over(by), F.max("norm_value").over(by)
    at = F.when(high == low, F.lit(50.0)).otherwise(F.bround((F.col("norm_value") - low) / (high - low) * 100, 1))
    return rows.select("id", F.greatest(F.lit(2.0), F.least(F.lit(98.0), at)).alias("position"))


SPARKLINE_SQL = f"""
WITH {RECORDS_SQL}, {NORMALIZED_SQL}, r AS (SELECT *, min(norm_value) OVER (PARTITION BY user_id, code_value) AS lo, max(norm_value) OVER (PARTITION BY user_id, code_value) AS hi FROM normalized WHERE code_value IS NOT NULL AND effective_date IS NOT NULL)
SELECT id, greatest(2.0, least(98.0, CASE WHEN hi = lo THEN 50.0 ELSE round_even((norm_value - lo) / (hi - lo) * 100, 1) END)) AS position FROM r
"""


def prompt_text(df: DataFrame) -> DataFrame:
    """All active records of a user as prompt text, oldest first, undated last: type, text, year, status, reading."""
    line = F.concat_ws("\n", F.concat(F.lit("["), F.upper("record_type"), F.lit("] "), F.col("display_text")), F.concat(F.lit("Date: "), F.year("effective_date").cast("string")), F.concat(F.lit("Status: "), F.col("status")), F.concat(F.lit("Code: "), F.col("code_value")))
    entry = F.struct(F.col("effective_date").isNull().alias("u"), F.col("effective_date").alias("d"), F.col("id").alias("i"), line.alias("t"))
    g = active(df).groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return g.select("user_id", F.size("x").cast("long").alias("n_records"), F.array_join(F.transform("x", lambda y: y["t"]), "\n\n---\n\n").alias("prompt"))


def q_prompt_text(spark, sf_dir):
    return prompt_text(records(spark, sf_dir)).select("user_id", "n_records", F.length("prompt").cast("long").alias("chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


PROMPT_SQL = f"""
WITH {RECORDS_SQL}, lines AS (
  SELECT *, concat_ws(chr(10), '[' || upper(record_type) || '] ' || display_text, 'Date: ' || year(effective_date), 'Status: ' || status, 'Code: ' || code_value) AS line FROM active
), prompts AS (SELECT user_id, count(*) AS n_records, string_agg(line, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY effective_date ASC NULLS LAST, id) AS prompt FROM lines GROUP BY user_id)
SELECT user_id, n_records, length(prompt) AS chars, sha256(prompt) AS prompt_sha256 FROM prompts
"""


def _over(f):
    return lambda spark, sf_dir: f(records(spark, sf_dir))


QUERIES = {
    "q01_observations_by_code": (q_observations_by_code, OBSERVATIONS_SQL),
    "q02_record_series": (_over(record_series), SERIES_SQL),
    "q03_records_list_by_date": (_over(lambda d: records_list(d, 2, 20)), _list_sql("effective_date DESC NULLS LAST", "true", 20, 40)),
    "q04_records_list_by_text": (_over(lambda d: records_list(d, 1, 20, "display_text", "asc", status="active", text="code")), _list_sql("display_text", "status = 'active' AND (display_text ILIKE '%code%' OR code_display ILIKE '%code%')", 0, 20)),
    "q05_records_search": (_over(lambda d: records_search(d, "45")), SEARCH_SQL),
    "q06_records_recent": (_over(records_recent), RECENT_SQL),
    "q07_record_stats": (_over(record_stats), STATS_SQL),
    "q08_counts_by_type": (_over(counts_by_type), COUNTS_SQL),
    "q09_sources": (_over(sources), SOURCES_SQL),
    "q10_date_range": (_over(date_range), RANGE_SQL),
    "q11_timeline": (_over(timeline), TIMELINE_SQL),
    "q12_timeline_months": (_over(timeline_months), MONTHS_SQL),
    "q13_labs": (_over(labs), LABS_SQL),
    "q14_linked_records": (_over(linked_records), LINKED_SQL),
    "q15_export_bundle": (q_export_bundle, EXPORT_SQL),
    "q16_overview": (_over(overview), OVERVIEW_SQL),
    "q17_normalized_units": (_over(normalized_units), UNITS_SQL),
    "q18_sparkline": (_over(sparkline), SPARKLINE_SQL),
    "q19_prompt_text": (q_prompt_text, PROMPT_SQL),
}
