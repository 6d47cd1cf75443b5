"""Checks and listings of the rule configuration, and suggestions for new tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.states import literal

ISSUE = "CheckName string, TableName string, KeyText string, Count long"


def duplicate_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """Ids that occur more than once, over all the tables given."""
    out = None
    for name, df in tables.items():
        one = df.groupBy("_ID").count().where("count > 1").select(F.lit("duplicate_id").alias("CheckName"), F.lit(name).alias("TableName"), F.col("_ID").cast("string").alias("KeyText"), F.col("count").alias("Count"))
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_rules(rules: DataFrame) -> DataFrame:
    """Pattern rules that say something of the same thing twice."""
    keys = ["FullFieldName", "PatternCategory", "PatternSubCategory", "PatternName"]
    return rules.groupBy(*keys).agg(F.count("*").alias("Count")).where("Count > 1").select(F.lit("duplicate_rule").alias("CheckName"), F.lit("configFieldAllowedPattern").alias("TableName"), F.concat_ws("|", *(F.coalesce(k, F.lit("")) for k in keys)).alias("KeyText"), "Count")


def unknown_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str, table: str, check: str = "unknown_reference") -> DataFrame:
    """Keys of child that parent lacks; null keys refer to nothing."""
    missing = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_parent")).distinct(), F.col(key) == F.col("_parent"), "left_anti")
    return missing.groupBy(key).agg(F.count("*").alias("Count")).select(F.lit(check).alias("CheckName"), F.lit(table).alias("TableName"), F.col(key).cast("string").alias("KeyText"), "Count")


def issues(fields: DataFrame, values: DataFrame, rules: DataFrame, custom: DataFrame, mappings: DataFrame, patterns: DataFrame) -> DataFrame:
    """All issues of a configuration; an empty result is a good one."""
    tables = {"masterField": fields, "configFieldValues": values, "configFieldAllowedPattern": rules, "configCustomQuery": custom, "mapDQChecks": mappings}
    out = duplicate_ids(tables).unionByName(duplicate_rules(rules))
    for name, df in (("configFieldAllowedPattern", rules), ("configCustomQuery", custom), ("mapDQChecks", mappings)):
        out = out.unionByName(unknown_references(df, "FullFieldName", fields, "FullFieldName", name))
    for column in ("PatternCategory", "PatternName"):
        out = out.unionByName(unknown_references(rules, column, patterns, column, "configFieldAllowedPattern", f"unknown_{column}"))
    none = mappings.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no_mapping").alias("CheckName"), F.lit("mapDQChecks").alias("TableName"), F.lit("").alias("KeyText"), F.lit(0).cast("long").alias("Count"))
    return out.unionByName(none)


def rule_listing(values: DataFrame, resolved: DataFrame, custom: DataFrame, mappings: DataFrame, field: str | None = None) -> DataFrame:
    """One row per rule and physical column: Level, RuleID, Rule, IsAllowed. field: full name or its last 2 or 3 parts."""
    length = values.where("MinDataLength is not null and MaxDataLength is not null").select("FullFieldName", F.lit("L01").alias("Level"), F.col("_ID").alias("RuleID"), F.format_string("length %d..%d", "MinDataLength", "MaxDataLength").alias("Rule"), F.lit(True).alias("IsAllowed"))
    query = custom.select("FullFieldName", F.lit("L02").alias("Level"), F.col("_ID").alias("RuleID"), F.concat_ws(": ", "CustomQueryType", "CustomQuery").alias("Rule"), F.col("IsConditionAllowed").alias("IsAllowed"))
    pattern = resolved.select("FullFieldName", F.lit("L03").alias("Level"), F.col("PatternID").alias("RuleID"), F.col("PatternName").alias("Rule"), F.col("IsPatternAllowed").alias("IsAllowed"))
    between = values.where("MinDataValue is not null and MaxDataValue is not null").select("FullFieldName", F.lit("L04").alias("Level"), F.col("_ID").alias("RuleID"), F.concat_ws("..", "MinDataValue", "MaxDataValue").alias("Rule"), F.lit(True).alias("IsAllowed"))
    every = length.unionByName(query).unionByName(pattern).unionByName(between)
    out = every.join(mappings.select("FullFieldName", "TargetSchemaName", "TargetTableName", "TargetFieldName"), "FullFieldName", "left")
    if field:
        out = out.where(names(field))
    return out


def names(field: str):
    """Whether a row's logical field, or its physical one by two or three parts, is the one named."""
    parts = field.split(".")
    logical = F.col("FullFieldName") == field
    physical = F.lit(False)
    if len(parts) >= 2:
        physical = (F.col("TargetTableName") == parts[-2]) & (F.col("TargetFieldName") == parts[-1])
        if len(parts) >= 3:
            physical = physical & (F.col("TargetSchemaName") == parts[-3])
    return logical | F.coalesce(physical, F.lit(False))


def function_name(field):
    """Name of a field's checker."""
    return F.concat(F.lit("fn_DQ_"), F.concat_ws("_", F.split(field, "[.]", 3)))


#: (what, pattern of the column's name, data category, patterns to block)
HINTS = [
    ("email", "e_?mail", 4, ["DataEmptiness", "SpaceFound", "UnicodeCharacters"]),
    ("url", "url|website|link", 5, ["DataEmptiness", "SpaceFound"]),
    ("phone", "phone|mobile|fax", 12, ["DataEmptiness", "InvalidKeyword"]),
    ("postal code", "post_?(al)?_?code|zip", 10, ["DataEmptiness", "FullyDuplicatedCharacter"]),
    ("address", "address|street|city|county|province|state|country", 6, ["DataEmptiness", "InvalidKeyword", "FullyDuplicatedCharacter"]),
    ("name", "name", 2, ["DataEmptiness", "InvalidKeyword", "FullyDuplicatedCharacter"]),
    ("code", "code|flag|status|priority", 3, ["DataEmptiness", "InvalidKeyword"]),
    ("comment", "comment|description|text|note", 1, ["DataEmptiness"]),
]


def suggest(spark: SparkSession, schema: T.StructType, name: str) -> DataFrame:
    """Suggested configuration rows for the columns of a schema, by name and type: Column, Kind, CategoryID, Block."""
    rows = []
    for f in schema.fields:
        t, low = f.dataType, f.name.lower()
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            found = ("reference id" if re.search(r"(id|key)$", low) else "integer", 17 if re.search(r"(id|key)$", low) else 13, ["DataEmptiness"])
        elif isinstance(t, T.LongType):
            found = ("reference id" if re.search(r"(id|key)$", low) else "long integer", 17 if re.search(r"(id|key)$", low) else 14, ["DataEmptiness"])
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            found = ("latitude", 26, ["DataEmptiness"]) if "lat" in low.split("_") else ("longitude", 27, ["DataEmptiness"]) if "lon" in low.split("_") else ("decimal", 15, ["DataEmptiness"])
        elif isinstance(t, T.DateType):
            found = ("date", 20, ["DataEmptiness"])
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            found = ("timestamp", 21, ["DataEmptiness"])
        elif isinstance(t, T.BooleanType):
            found = ("boolean", 24, ["DataEmptiness"])
        else:
            found = next(((kind, c, block) for kind, pattern, c, block in HINTS if re.search(pattern, low)), ("free text", 2, ["DataEmptiness"]))
        rows.append((f"{name}.{f.name}", f.name, *found))
    return spark.createDataFrame(rows, "FullFieldName string, ColumnName string, Kind string, CategoryID int, Block array<string>")


def sql_rows(values: list[tuple]) -> str:
    """A VALUES list."""
    show = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else literal(x)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in values)
