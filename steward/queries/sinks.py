"""Queries that write and read again: stores, files, dumps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import seed
from ..sources import jsondump
from ..sources.store import Store, evolve, frame, read_csv, write_csv
from .tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def folder(spark: SparkSession) -> str:
    """A folder that all executors share: below the checkpoint folder, or a local one where none is set and all runs in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='steward-')}/{uuid.uuid4().hex}"


def store_versions(spark, sf_dir):
    """Two versions and an append; the current one is read."""
    store = Store(spark, folder(spark))
    store.write("region", table(spark, sf_dir, "region").where("r_regionkey < 2"))
    store.write("region", store.read("region").where("r_regionkey = 1"))
    store.append("region", table(spark, sf_dir, "region").where("r_regionkey > 2"))
    return store.read("region")


def store_seed(spark, sf_dir):
    """Seeding twice changes nothing; edited rows stay."""
    store = Store(spark, folder(spark))
    store.seed("2024-01-01 00:00:00")
    store.write("masterDataCategory", store.read("masterDataCategory").withColumn("DataType", F.when(F.col("_ID") == 1, "edited").otherwise(F.col("DataType"))))
    store.seed("2025-01-01 00:00:00")
    return store.read("masterDataCategory").groupBy("DataCategoryType", "DataType").agg(F.count("*").alias("n"))


def store_empty(spark, sf_dir):
    store = Store(spark, folder(spark))
    store.create_all(["ETLsysLogs"])
    return store.read("ETLsysLogs").agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(store.read("ETLsysLogs").columns)))


def csv_round_trip(spark, sf_dir):
    path = folder(spark)
    write_csv(table(spark, sf_dir, "nation"), path)
    return read_csv(spark, path)


def json_dump(spark, sf_dir):
    """Documents salvaged from a text with noise around them."""
    path = folder(spark)
    regions = table(spark, sf_dir, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("j"))
    body = regions.agg(F.concat(F.lit("noise\n--\n"), F.array_join(F.array_sort(F.collect_list("j")), "\n"), F.lit("\n(5 rows affected)\n")).alias("value"))
    body.coalesce(1).write.text(path)
    return jsondump.documents(jsondump.salvage(spark, path, r"^\{", r"\}$"), frame(spark, [], "r_regionkey int, r_name string").schema)


def json_split(spark, sf_dir):
    """Column records through a folder of JSON for each table, merged with an order of tables; unmatched tables are dropped."""
    path = folder(spark)
    rows = table(spark, sf_dir, "nation").select(F.lit("dbo").alias("schema_name"), F.concat(F.lit("t"), F.col("n_regionkey")).alias("table_name"), F.struct(F.col("n_name").alias("column_name"), F.col("n_nationkey").alias("column_order")).alias("c"))
    jsondump.split_by_table(rows.groupBy("schema_name", "table_name").agg(F.collect_list("c").alias("Columns")), path)
    order = frame(spark, [{"schema_name": "dbo", "table_name": f"t{i}", "Hierarchy": i + 1} for i in range(4)], "schema_name string, table_name string, Hierarchy int")
    kept, _ = jsondump.merged(spark.read.json(path), order)
    return jsondump.column_records(kept).select("Hierarchy", "column_name", F.col("column_order").cast("long").alias("column_order"))


def schema_evolution(spark, sf_dir):
    return evolve(table(spark, sf_dir, "region"), frame(spark, [], "r_name string, DQEligible boolean, DQViolations string").schema)


for f in (store_versions, store_seed, store_empty, csv_round_trip, json_dump, json_split, schema_evolution):
    QUERIES[f.__name__] = f
_categories = ", ".join(f"({i}, '{t}', '{k}')" for i, t, k, _, _ in seed.CATEGORIES)
ORACLES |= {
    "store_versions": "select r_regionkey, r_name from region where r_regionkey = 1 or r_regionkey > 2",
    "store_seed": f"select t as DataCategoryType, case when i = 1 then 'edited' else k end as DataType, count(*) as n from (values {_categories}) as x(i, t, k) group by all",
    "store_empty": "select 0::bigint as rows, 14::int as columns",
    "csv_round_trip": "select n_nationkey, n_name, n_regionkey from nation",
    "json_dump": "select r_regionkey, r_name from region",
    "json_split": "select (n_regionkey + 1)::int as Hierarchy, n_name as column_name, n_nationkey::bigint as column_order from nation where n_regionkey < 4",
    "schema_evolution": "select r_regionkey, r_name, null::boolean as DQEligible, null::varchar as DQViolations from region",
}
