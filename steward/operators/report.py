"""Quality reports over audit and stat tables: views with the names of fields and targets, and a list of reports over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET = ("TargetSchemaName", "TargetTableName", "TargetFieldName")


def share(good: str, bad: str, digits: int) -> Column:
    """Percentage of good ones; null if there are none of either."""
    return F.round(F.try_divide(F.col(good).cast("double"), F.col(good) + F.col(bad)) * 100, digits)


def named(rows: DataFrame, mappings: DataFrame, number: str) -> DataFrame:
    """Rows with the names of their mapping in place of its id; _ID is called number (null if the table has none). The mapping
    table is configuration, broadcast if it is small.
    """
    rows = rows.withColumnRenamed("_ID", number) if "_ID" in rows.columns else rows.withColumn(number, F.lit(None).cast("long"))
    return rows.join(mappings.select(F.col("_ID").alias("MappingID"), "FullFieldName", *TARGET), "MappingID").drop("MappingID")


def audit_view(audit: DataFrame, mappings: DataFrame) -> DataFrame:
    return named(audit, mappings, "LogID")


def stat_view(stats: DataFrame, mappings: DataFrame) -> DataFrame:
    return named(stats, mappings, "StatisticID").withColumn("PercentageQualified", share("RowsQualified", "RowsDisqualified", 0))


@dataclass(frozen=True)
class Report:
    """order: columns, "-" before one that falls. by: what rows are grouped by; counted: name of their number, or sums: new name -> column."""

    order: tuple[str, ...]
    by: tuple[str, ...] = ()
    counted: str | None = None
    sums: tuple[tuple[str, str], ...] = ()
    #: name and digits of the share of the first sum in both
    percent: tuple[str, int] | None = None

    def of(self, view: DataFrame, execution_id: str | None = None, below: float | None = None) -> DataFrame:
        """Of one execution, or of all; below: only rows with a lower PercentageQualified."""
        if execution_id:
            view = view.where(F.col("ExecutionID") == execution_id)
        if below is not None:
            view = view.where(F.col("PercentageQualified") < below)
        if self.by:
            view = view.groupBy(*self.by).agg(*([F.count("*").alias(self.counted)] if self.counted else []), *(F.sum(c).alias(n) for n, c in self.sums))
        if self.percent:
            view = view.withColumn(self.percent[0], share(*(n for n, _ in self.sums), self.percent[1]))
        return view.orderBy(*(F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in self.order))


#: Over the audit view.
VIOLATIONS = Report(("FullFieldName", "LogID", "ViolationType", "InputValue"))
BY_VIOLATION = Report((*TARGET[1:], "ViolationType"), ("FullFieldName", "GeneratedOn", "ExecutionID", *TARGET, "ViolationType"), "RecordCount")
BY_FIELD = Report(("-RecordCount", "FullFieldName", *TARGET[1:], "ViolationType"), ("FullFieldName", *TARGET[1:], "ViolationType"), "RecordCount")
#: Over the stat view.
SCORES = Report(("PercentageQualified",))
BY_TABLE = Report(("TableQualityPct",), ("TargetTableName",), sums=(("TotalQualified", "RowsQualified"), ("TotalDisqualified", "RowsDisqualified")), percent=("TableQualityPct", 1))
