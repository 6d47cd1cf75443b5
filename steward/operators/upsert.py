"""Keyed merges as pure transforms: old snapshot + source -> new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_only(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old plus the rows of new whose key it lacks; rows of old never change."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh.select(*(c for c in old.columns if c in new.columns)), allowMissingColumns=True)


def changed(old: str, new: str, compare: list[str], blank_is_null: bool = False):
    """Whether one of the compared columns differs, nulls being equal (and equal to '' if blank_is_null)."""
    out = F.lit(False)
    for c in compare:
        a, b = F.col(f"{old}.{c}"), F.col(f"{new}.{c}")
        if blank_is_null:
            a, b = F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit(""))
        out = out | ~a.eqNullSafe(b)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], compare: list[str] | None = None, stamp: dict | None = None, blank_is_null: bool = False) -> DataFrame:
    """Rows of new replace the update columns of the row of old with their key, if a compared column differs, else are added.

    stamp: columns set on updated rows only (name -> Column). All other columns of matched rows stay. One full outer join on
    the key; duplicate keys in new are the caller's to rule out (see operators.config.duplicate_ids).
    """
    compare, stamp = compare if compare is not None else update, stamp or {}
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    both = F.col("_old") & F.col("_new")
    differs = F.coalesce(both & changed("o", "n", compare, blank_is_null), F.lit(False))
    out = []
    for c in old.columns:
        has = c in new.columns
        was = F.col(f"o.{c}")
        added = F.col(f"n.{c}") if has else stamp.get(c, F.lit(None))
        kept = was
        if c in update and has:
            kept = F.when(differs, F.col(f"n.{c}")).otherwise(was)
        elif c in stamp:
            kept = F.when(differs, stamp[c]).otherwise(was)
        out.append(F.when(F.col("_old").isNull(), added).otherwise(kept).cast(old.schema[c].dataType).alias(c))
    return o.join(n, cond, "full_outer").select(*out)


def next_id(df: DataFrame, column: str = "_ID") -> int:
    """The greatest id plus one; 1 for an empty table."""
    return (df.agg(F.max(column)).first()[0] or 0) + 1
