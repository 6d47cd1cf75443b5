"""Which rule holds for which pattern of a field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESOLVED = ["FullFieldName", "PatternID", "PatternName", "PatternCategory", "PatternSubCategory", "PatternPriority", "PatternValue", "IsPatternAllowed", "Specificity"]


def resolve(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per field and pattern: the most specific active rule (name, then sub-category, then category).

    Of equally specific rules an allowing one wins, then the one with the least _ID. The three levels are three equi-joins; the
    pattern table is master data of a few hundred rows, left to the optimizer's size check to broadcast.
    """
    active = lambda df: df.where(F.coalesce("IsActive", F.lit(True))) if "IsActive" in df.columns else df
    r = active(rules).select(F.col("_ID").alias("RuleID"), "FullFieldName", *(F.nullif(F.col(c), F.lit("")).alias(f"Rule{c}") for c in ("PatternCategory", "PatternSubCategory", "PatternName")), "IsPatternAllowed")
    p = active(patterns).select(F.col("_ID").alias("PatternID"), "PatternName", "PatternCategory", "PatternSubCategory", "PatternPriority", "PatternValue")
    parts = [r.join(p, F.col(f"Rule{c}") == F.col(c)).withColumn("Specificity", F.lit(s)) for c, s in (("PatternName", 3), ("PatternSubCategory", 2), ("PatternCategory", 1))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = Window.partitionBy("FullFieldName", "PatternValue", "PatternName").orderBy(F.desc("Specificity"), F.desc("IsPatternAllowed"), "RuleID", "PatternID")
    return every.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(*RESOLVED)


def field_parts(name) -> list:
    """Schema, table and column of a full field name; the column keeps further dots."""
    return [F.coalesce(F.get(F.split(name, "[.]", 3), F.lit(i)), F.lit("")) for i in range(3)]
