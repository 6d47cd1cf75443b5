"""Assessment of a stream: each micro-batch by the same one-pass projection as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assess import Mapping, audit, checked, stats, write_back
from ..plans.compile import Field


def flagged(stream: DataFrame, mappings: list[Mapping], fields: dict[str, Field]) -> DataFrame:
    """The stream with row flags: stateless, so any output mode and source will do."""
    return write_back(checked(stream, mappings, fields), mappings)


def violations_by_window(stream: DataFrame, mappings: list[Mapping], fields: dict[str, Field], time: str, width: str, late: str) -> DataFrame:
    """Failures by event-time window, mapping and type; rows later than the watermark are left out."""
    found = checked(stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late), mappings, fields)
    entries = F.array_compact(F.array(*(F.when(~F.col(f"_dq_{m.id}")["result"], F.struct(F.lit(m.id).alias("MappingID"), F.col(f"_dq_{m.id}")["violation_type"].alias("ViolationType"))) for m in mappings)))
    return found.select(time, F.explode(entries).alias("v")).groupBy(F.window(time, width), "v.MappingID", "v.ViolationType").agg(F.count("*").alias("RecordCount"))


def assess(stream: DataFrame, mappings: list[Mapping], fields: dict[str, Field], sink: Callable[[str, DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch checked once; sink gets ("rows" | "audit" | "stats", frame, batch id) and must write idempotently by batch id."""

    def batch(df: DataFrame, number: int) -> None:
        done = checked(df, mappings, fields).persist()
        run = f"batch-{number}"
        sink("rows", write_back(done, mappings), number)
        sink("audit", audit(done, mappings, run), number)
        sink("stats", stats(done, mappings, run), number)
        done.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
