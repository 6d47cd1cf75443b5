"""Order of tables by foreign keys.

Sections: -1 neither child nor parent; 1 roots (parents without parents); 2 leaves whose parents are all roots; 3 tables between, by
level; 4 the rest that something refers to (self-references, cycles); 999 other leaves.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIMARY = "<Primary Key>"


def relations(keys: DataFrame) -> DataFrame:
    """Distinct child -> parent pairs; keys: schema_name, table_name, referenced_schema_name, referenced_table_name."""
    return keys.where((F.col("referenced_schema_name") != PRIMARY) & F.col("referenced_table_name").isNotNull()).select(
        F.struct(F.col("schema_name").alias("s"), F.col("table_name").alias("t")).alias("child"), F.struct(F.col("referenced_schema_name").alias("s"), F.col("referenced_table_name").alias("t")).alias("parent")
    ).distinct()


def levels(edges: DataFrame) -> DataFrame:
    """(parent, level) of the parents in edges: level 1 has no parent left in edges, each next one none but earlier levels'.

    Parents on a cycle get none. The graph is a catalog's (thousands of tables, not rows of data), so one task takes
    all levels in one pass over it, in time linear in the keys.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        children, above = defaultdict(list), Counter()
        for b in batches:
            for c, p in zip(zip(b["cs"], b["ct"], strict=True), zip(b["ps"], b["pt"], strict=True), strict=True):
                children[p].append(c)
                above[c] += 1
        rows, now, level = [], [p for p in children if not above[p]], 1
        while now:
            rows += [(*p, float(level)) for p in now]
            below = []
            for c in (c for p in now for c in children[p]):
                above[c] -= 1
                if not above[c] and c in children:
                    below.append(c)
            now, level = below, level + 1
        yield pd.DataFrame(rows, columns=["s", "t", "level"])

    flat = edges.select(F.col("child.s").alias("cs"), F.col("child.t").alias("ct"), F.col("parent.s").alias("ps"), F.col("parent.t").alias("pt")).distinct()
    return flat.coalesce(1).mapInPandas(place, "s string, t string, level double").select(F.struct("s", "t").alias("parent"), "level")


def hierarchy(keys: DataFrame, priorities: DataFrame) -> DataFrame:
    """schema_name, table_name, schema_priority, section_level, table_level, Hierarchy (dense rank, nulls first).

    keys has a row for each foreign key, and for each primary key with referenced_schema_name '<Primary Key>'; tables with
    neither don't appear. priorities: schema_name, schema_priority.
    """
    edges = relations(keys)
    loops = edges.where("child = parent").select(F.col("child").alias("x"))
    true = edges.where("child <> parent")
    parents, children = true.select(F.col("parent").alias("x")).distinct(), true.select(F.col("child").alias("x")).distinct()
    tables = keys.where("referenced_schema_name is not null").select(F.struct(F.col("schema_name").alias("s"), F.col("table_name").alias("t")).alias("x")).distinct()
    related = edges.select(F.col("child").alias("x")).union(edges.select(F.col("parent").alias("x"))).distinct()
    alone = tables.join(related, "x", "left_anti")
    roots = parents.join(children, "x", "left_anti").join(loops, "x", "left_anti")
    leaves = children.join(parents, "x", "left_anti").join(loops, "x", "left_anti")
    other = true.join(roots.withColumnRenamed("x", "parent"), "parent", "left_anti").select(F.col("child").alias("x")).distinct()
    near = leaves.join(other, "x", "left_anti")
    outer = roots.union(leaves)
    between = levels(true.join(outer.withColumnRenamed("x", "parent"), "parent", "left_anti")).select(F.col("parent").alias("x"), "level")
    none = F.lit(None).cast("double")
    sections = [(alone, -1), (roots, 1), (near, 2), (leaves.join(near, "x", "left_anti"), 999)]
    placed = between.select("x", F.lit(3).alias("section_level"), F.col("level").alias("table_level"))
    for df, s in sections:
        placed = placed.unionByName(df.select("x", F.lit(s).alias("section_level"), none.alias("table_level")))
    missed = related.union(tables).distinct().join(placed.select("x"), "x", "left_anti").join(edges.select(F.col("parent").alias("x")).distinct(), "x", "left_semi")
    rest = cyclic_levels(missed, edges)
    placed = placed.unionByName(rest.select("x", F.lit(4).alias("section_level"), "table_level"))
    out = placed.select(F.col("x.s").alias("schema_name"), F.col("x.t").alias("table_name"), "section_level", "table_level").join(priorities, "schema_name", "left")
    rank = Window.orderBy(F.asc_nulls_first("section_level"), F.asc_nulls_first("table_level"), F.asc_nulls_first("schema_priority"))
    return out.withColumn("Hierarchy", F.dense_rank().over(rank)).select("schema_name", "table_name", "schema_priority", "section_level", "table_level", "Hierarchy")


def cyclic_levels(missed: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of what no section holds: by the greatest number among the missed parents, in the order of names."""
    numbered = missed.withColumn("id", F.dense_rank().over(Window.orderBy("x.s", "x.t")))
    up = edges.join(numbered.select(F.col("x").alias("parent"), F.col("id").alias("above")), "parent").groupBy("child").agg((F.max("above") + 1).alias("level"))
    return numbered.join(up.withColumnRenamed("child", "x"), "x", "left").withColumn("table_level", F.dense_rank().over(Window.orderBy(F.asc_nulls_first("level"))).cast("double"))
