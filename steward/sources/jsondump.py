"""JSON documents salvaged from tool output, split by table, and read as column records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def salvage(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """The JSON between the first line that matches start and the last one that matches end, as one text (files of a tool run).

    Documents that follow each other without a comma are made a list. No match: an empty list.
    """
    lines = spark.read.text(path, wholetext=True).select("value")
    # one file is one document dump: it is cut by lines within its row
    rows = F.transform(F.split("value", r"\r?\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    df = lines.withColumn("rows", rows)
    first = F.array_min(F.transform(F.filter("rows", lambda r: r["line"].rlike(start)), lambda r: r["i"]))
    last = F.array_max(F.transform(F.filter("rows", lambda r: r["line"].rlike(end)), lambda r: r["i"]))
    body = F.array_join(F.transform(F.filter("rows", lambda r: (r["i"] >= F.col("first")) & (r["i"] <= F.col("last"))), lambda r: r["line"]), "")
    df = df.withColumn("first", first).withColumn("last", last).withColumn("body", F.trim(body))
    fixed = F.regexp_replace("body", r"\}\s*\{", "},{")
    return df.select(F.when(F.coalesce(F.col("body"), F.lit("")) == "", "[]").when(F.col("body").startswith("["), fixed).otherwise(F.concat(F.lit("["), fixed, F.lit("]"))).alias("json"))


def documents(salvaged: DataFrame, schema: T.StructType) -> DataFrame:
    """A row for each document of the list."""
    return salvaged.select(F.explode(F.from_json("json", T.ArrayType(schema))).alias("d")).select("d.*")


def split_by_table(tables: DataFrame, path: str) -> None:
    """A folder of JSON for each schema and table."""
    tables.write.mode("overwrite").partitionBy("schema_name", "table_name").json(path)


def merged(tables: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with their hierarchy, and those that have none (reported, left out)."""
    keys = ["schema_name", "table_name"]
    return tables.join(order, keys), tables.join(order, keys, "left_anti")


def column_records(tables: DataFrame) -> DataFrame:
    """A row for each element of Columns, with FullFieldName and the table's Hierarchy if it has one."""
    keep = [c for c in ("Hierarchy",) if c in tables.columns]
    return tables.select(*keep, F.explode("Columns").alias("c")).select(*keep, "c.*")
