"""Unit normalisation of observation values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (code, canonical unit, source unit, factor, divisor, offset); a value becomes value * factor / divisor + offset.
CONVERSIONS = [
    ("4548-4", "%", "mmol/mol", 1.0, 10.929, 2.15),
    ("13457-7", "mg/dL", "mmol/l", 38.67, 1.0, 0.0),
    ("2085-9", "mg/dL", "mmol/l", 38.67, 1.0, 0.0),
    ("2093-3", "mg/dL", "mmol/l", 38.67, 1.0, 0.0),
    ("2571-8", "mg/dL", "mmol/l", 88.57, 1.0, 0.0),
    ("2339-0", "mg/dL", "mmol/l", 18.0182, 1.0, 0.0),
    ("2345-7", "mg/dL", "mmol/l", 18.0182, 1.0, 0.0),
    ("2160-0", "mg/dL", "umol/l", 1.0, 88.42, 0.0),
]


def canonical_unit_text(unit: Column) -> Column:
    """Trimmed, lower case, both micro signs as u; null becomes empty."""
    return F.coalesce(F.translate(F.lower(F.trim(unit)), "µμ", "uu"), F.lit(""))


def conversion_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONVERSIONS, "conv_code string, canonical_unit string, source_unit string, factor double, divisor double, offset double")


def normalize_units(df: DataFrame, code: str = "code_value", value: str = "value", unit: str = "unit") -> DataFrame:
    """Add norm_value and norm_unit.

    Unknown codes keep value and unit. Known codes get the canonical unit; only
    a known source unit converts (rounded half to even at 2 places), any other
    leaves the value as it is. The table has a row per code and is broadcast.
    """
    table = F.broadcast(conversion_table(df.sparkSession))
    joined = df.join(table, F.col(code) == F.col("conv_code"), "left")
    converts = canonical_unit_text(F.col(unit)) == F.col("source_unit")
    converted = F.bround(F.col(value) * F.col("factor") / F.col("divisor") + F.col("offset"), 2)
    return (
        joined.withColumn("norm_value", F.when(converts, converted).otherwise(F.col(value)))
        .withColumn("norm_unit", F.coalesce("canonical_unit", F.col(unit)))
        .drop("conv_code", "canonical_unit", "source_unit", "factor", "divisor", "offset")
    )
