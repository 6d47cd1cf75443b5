"""Schema snapshots, their differences, and what they mean for tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Properties of a column that the hash covers, in order; times of extraction and change are left out.
HASHED = ["schema_name", "table_name", "column_name", "column_order", "data_type", "data_type_with_size", "is_nullable", "is_unique", "table_type", "referenced_schema_name", "referenced_table_name", "referenced_column_name", "foreign_key_name", "extended_properties"]
TIMES = ["table_created_timestamp", "table_last_updated_timestamp", "last_accessed_timestamp"]


def full_name(*parts) -> Column:
    """[a].[b].[c]"""
    return F.concat_ws(".", *(F.concat(F.lit("["), F.col(p) if isinstance(p, str) else p, F.lit("]")) for p in parts))


def snapshot(columns: DataFrame) -> DataFrame:
    """Column records plus FullFieldName and SHA256Hash (of the properties' texts joined with nothing between, null as '')."""
    for c in HASHED:
        if c not in columns.columns:
            columns = columns.withColumn(c, F.lit(None).cast("string"))
    text = F.concat_ws("", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in HASHED))
    return columns.withColumn("FullFieldName", full_name("schema_name", "table_name", "column_name")).withColumn("SHA256Hash", F.sha2(text, 256))


def columns_of(spark: SparkSession, schema: T.StructType, schema_name: str, table_name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Column records of a Spark schema."""
    rows = [(schema_name, table_name, f.name, i, f.dataType.typeName(), f.dataType.simpleString(), "YES" if f.nullable else "NO", "YES" if f.name in keys else "NO", "BASE TABLE") for i, f in enumerate(schema.fields, 1)]
    return spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, column_order int, data_type string, data_type_with_size string, is_nullable string, is_unique string, table_type string")


def catalog_columns(spark: SparkSession, database: str) -> DataFrame:
    """Column records of all tables of a database of the session's catalog."""
    out = None
    for t in spark.catalog.listTables(database):
        one = columns_of(spark, spark.table(f"`{database}`.`{t.name}`").schema, database, t.name)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else columns_of(spark, T.StructType([]), database, "")


def catalog_records(columns: DataFrame, constraints: DataFrame, usage: DataFrame, references: DataFrame) -> DataFrame:
    """Column records with keys, from a catalog's information-schema tables: columns, table_constraints, key_column_usage and
    referential_constraints.

    is_unique: part of the primary key. A foreign key's column names what it refers to, the column at the same place of the
    referenced key; a primary key's column that refers to nothing has '<Primary Key>' there. A column of several foreign keys has a row
    for each. All joins are on the names of schema, table and constraint.
    """
    at = ["table_schema", "table_name", "column_name"]
    used = usage.select("constraint_name", *at, "ordinal_position", "position_in_unique_constraint")
    primary = constraints.where("constraint_type = 'PRIMARY KEY'").select("constraint_name", "table_schema", "table_name").join(used, ["constraint_name", "table_schema", "table_name"]).select(*at).distinct().withColumn("_primary", F.lit(True))
    to = used.select(F.col("constraint_name").alias("unique_constraint_name"), F.col("ordinal_position").alias("position_in_unique_constraint"), *(F.col(c).alias(f"_{c}") for c in at))
    foreign = references.select("constraint_name", "unique_constraint_name").join(used, "constraint_name").join(to, ["unique_constraint_name", "position_in_unique_constraint"])
    foreign = foreign.select(*at, F.col("constraint_name").alias("foreign_key_name"), *(f"_{c}" for c in at))
    referenced = lambda c: F.coalesce(f"_{c}", F.when(F.col("_primary"), "<Primary Key>"))
    text = F.when(F.col("character_maximum_length").isNotNull(), F.concat(F.lit("("), F.when(F.col("character_maximum_length") < 0, "max").otherwise(F.col("character_maximum_length").cast("string")), F.lit(")")))
    number = F.when(F.col("data_type").isin("decimal", "numeric"), F.concat(F.lit("("), F.col("numeric_precision").cast("string"), F.lit(","), F.col("numeric_scale").cast("string"), F.lit(")")))
    return columns.join(primary, at, "left").join(foreign, at, "left").select(
        F.col("table_schema").alias("schema_name"), "table_name", "column_name", F.col("ordinal_position").alias("column_order"), "data_type",
        F.concat("data_type", F.coalesce(text, number, F.lit(""))).alias("data_type_with_size"), "is_nullable", F.when(F.col("_primary"), "YES").otherwise("NO").alias("is_unique"), F.lit("USER_TABLE").alias("table_type"),
        referenced("table_schema").alias("referenced_schema_name"), referenced("table_name").alias("referenced_table_name"), referenced("column_name").alias("referenced_column_name"), "foreign_key_name",
    )


def diff(new: DataFrame, old: DataFrame, properties: list[str] | None = None, key: str = "FullFieldName") -> DataFrame:
    """One row per column of either snapshot: Action and the list of changed properties (the hash first).

    All properties of the new snapshot but its times are compared, in its order: as texts whose case doesn't count, null equal to null
    only, and null where the old snapshot lacks the property. A side without the column has the hash "Missing". One full outer
    join on the key.
    """
    properties = properties or [c for c in new.columns if c not in (*TIMES, key, "SHA256Hash")]
    for c in properties:
        if c not in old.columns:
            old = old.withColumn(c, F.lit(None).cast("string"))
    n, o = new.withColumn("_n", F.lit(True)).alias("n"), old.withColumn("_o", F.lit(True)).alias("o")
    text = lambda c: F.lower(F.col(c).cast("string"))
    differs = [F.when(~text(f"n.{c}").eqNullSafe(text(f"o.{c}")), F.lit(c)) for c in ["SHA256Hash", *properties]]
    names = F.when(F.col("_n") & F.col("_o"), F.array_compact(F.array(*differs))).otherwise(F.array().cast("array<string>"))
    joined = n.join(o, F.col(f"n.{key}") == F.col(f"o.{key}"), "full_outer")
    action = F.when(F.col("_n").isNull(), "Deleted").when(F.col("_o").isNull(), "Added").when(F.size("names") > 0, "Changed").otherwise("Unchanged")
    remark = F.when(action == "Deleted", "Deleted from version (n-1)").when(action == "Added", "Added in version (n)").when(action == "Changed", F.concat(F.lit("Differences detected in columns: "), F.array_join("names", ", "))).otherwise("No changes detected")
    either = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in new.columns and c in old.columns else F.lit(None).cast("string")
    taken = lambda c: F.when(F.col("_n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns and c in old.columns else F.lit(None).cast("string")
    hash_ = lambda s: F.coalesce(F.lower(F.nullif(f"{s}.SHA256Hash", F.lit(""))), F.lit("Missing"))
    return joined.withColumn("names", names).select(
        either(key).alias("FullFieldName"), action.alias("Action"), hash_("n").alias("SHA256Hash_from_n"), hash_("o").alias("SHA256Hash_from_n_minus_1"), remark.alias("AdditionalRemark"),
        F.when(F.size("names") > 0, F.concat(F.lit("["), F.array_join("names", "], ["), F.lit("]"))).alias("ChangedColumns"),
        taken("Hierarchy").alias("TableHierarchy"), *(taken(a).alias(b) for a, b in zip(TIMES, ("TableCreatedOn", "TableUpdatedOn", "MetadataExtractedOn"), strict=True)),
    )


def table_of(name) -> Column:
    """[a].[b] of [a].[b].[c]"""
    return F.regexp_extract(name, r"^(.*)\.\[[^\]]*\]$", 1)


def last_part(name) -> Column:
    return F.regexp_extract(name, r"\[([^\]]*)\]$", 1)


def classify(changes: DataFrame) -> DataFrame:
    """One row per table: Added, Deleted or Unchanged if all its columns are, else Changed; the names of its changed columns."""
    all_are = lambda a: F.bool_and(F.col("Action") == a)
    first = lambda c: F.min_by(c, "FullFieldName").alias(c)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("Action") == "Changed", F.struct("FullFieldName", last_part("FullFieldName").alias("c"))))), lambda x: x["c"]), ", ")
    return changes.groupBy(table_of("FullFieldName").alias("FullTableName")).agg(
        F.when(all_are("Added"), "Added").when(all_are("Deleted"), "Deleted").when(all_are("Unchanged"), "Unchanged").otherwise("Changed").alias("ChangeType"),
        first("TableHierarchy"), first("TableCreatedOn"), first("TableUpdatedOn"), first("MetadataExtractedOn"), F.when(names != "", names).otherwise("N/A").alias("ChangedColumns"),
    ).select(
        "FullTableName", F.regexp_extract("FullTableName", r"^\[([^\]]*)\]", 1).alias("SchemaName"), last_part("FullTableName").alias("TableName"), "ChangeType", "TableHierarchy", "TableCreatedOn", "TableUpdatedOn", "MetadataExtractedOn", "ChangedColumns",
    )


NONE = "<Not Applicable>"


def summary(changes: DataFrame, tables: DataFrame) -> DataFrame:
    """Counts of tables by change, of columns by change for tables that were in both versions, and of changes by column."""
    kinds = ["Added", "Deleted", "Changed", "Unchanged"]
    counts = tables.agg(*(F.count_if(F.col("ChangeType") == k).alias(k) for k in kinds))
    of_tables = counts.select(F.explode(F.array(*(F.struct(F.lit(f"Table {k}").alias("Action"), F.lit(NONE).alias("TableName"), F.lit(NONE).alias("ColumnName"), F.col(k).alias("Statistics")) for k in kinds))).alias("s")).select("s.*")
    kept = changes.withColumn("FullTableName", table_of("FullFieldName")).join(tables.where(~F.col("ChangeType").isin("Added", "Deleted")).select("FullTableName"), "FullTableName")
    per = kept.groupBy("FullTableName").agg(*(F.count_if(F.col("Action") == k).alias(k) for k in kinds))
    entries = [F.struct(F.lit(f"Columns {k}").alias("Action"), F.col("FullTableName").alias("TableName"), F.lit(NONE).alias("ColumnName"), F.col(k).alias("Statistics")) for k in kinds]
    entries[3] = F.when(F.col("Unchanged") > 0, entries[3])
    of_columns = per.select(F.explode(F.array_compact(F.array(*entries))).alias("s")).select("s.*")
    of_changes = kept.where("Action = 'Changed'").select(F.lit("Columns Changed").alias("Action"), F.col("FullTableName").alias("TableName"), last_part("FullFieldName").alias("ColumnName"), F.size(F.split("ChangedColumns", ",")).cast("long").alias("Statistics"))
    return of_tables.unionByName(of_columns).unionByName(of_changes)
