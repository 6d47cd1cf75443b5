"""Small tables as rows for Spark and as text for SQL, and the texts both share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Values:
    """A constant table. columns: "name type, ..." in Spark's words."""

    def __init__(self, columns: str, rows: list[tuple]):
        self.columns, self.data = [c.strip().split(" ") for c in columns.split(",")], rows
        self.ddl = ", ".join(f"`{n}` {t}" for n, t in self.columns)

    def frame(self, spark: SparkSession) -> DataFrame:
        import datetime

        def typed(v, t):
            if v is None or not isinstance(v, str):
                return v
            return datetime.date.fromisoformat(v) if t == "date" else datetime.datetime.fromisoformat(v) if t == "timestamp" else v

        return spark.createDataFrame([tuple(typed(v, t) for v, (_, t) in zip(r, self.columns, strict=True)) for r in self.data], self.ddl)

    @property
    def sql(self) -> str:
        """As a subquery for DuckDB."""
        names = {"string": "varchar", "long": "bigint"}
        show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
        listed = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in self.data)
        cast = ", ".join(f"cast(c{i} as {names.get(t, t)}) as {n}" for i, (n, t) in enumerate(self.columns))
        return f"(select {cast} from (values {listed}) as t({', '.join(f'c{i}' for i in range(len(self.columns)))}))"


#: Dirty values, picked by event_id; the text is read by Spark and DuckDB alike.
DIRTY_VALUES = [
    "null", "''", "' '", "'ab '", "'--'", "'-- --'", "'n/a'", "'N/A n/a'", "'nullx'", "'zzzz'", "'1111'", "'12.5'", "'.5'", "'1.'", "'0'", "'1'",
    "'10:20:99'", "'24:00:00'", "'08:15:30.25'", "'2024-02-30'", "'20240101'", "'15 Jan 2024'", "'2024-01-01 00:00:00'", "'2024-01-01 10:00'", "'é'", "'A1'", "'٣'",
    "'😀😀'", "chr(9)", "chr(160)", "'abc DEF'", "'a@b.co'", "'x.y.z.w@q.example.com'", "'user@'", "'test'", "'foo|bar'", "'a_b?'", "' 77 88 '", "'not set'",
    "'mail@x.y.z.example.org'", "'a.b@@c.de'", "'me@site.org-'", "concat('id', event_id)", "event_type",
]
DIRTY = f"case event_id % {len(DIRTY_VALUES)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(DIRTY_VALUES)) + " end"
