"""Assessment: all mapped fields of a table in one pass."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compile import Compiled, Custom, Field, Rule, apply, compile_field
from ..plans.resolve import resolve

ELIGIBLE, VIOLATIONS, FIELDS, ROW_ID = "DQEligible", "DQViolations", "DQFields", "DQRowID"


@dataclass(frozen=True)
class Mapping:
    """A field's rules applied to a column."""

    id: int
    field: str
    table: str
    column: str
    schema: str = "curated"


def fields_from(rules: DataFrame | None = None, patterns: DataFrame | None = None, values: DataFrame | None = None, custom: DataFrame | None = None) -> dict[str, Field]:
    """Field specifications from the configuration tables (some rows a field; they are read on the driver to build the plan)."""
    found: dict[str, dict] = defaultdict(lambda: {"rules": [], "custom": [], "length": (None, None), "values": (None, None)})
    on = lambda df: df.where(F.coalesce("IsActive", F.lit(True))) if "IsActive" in df.columns else df
    if rules is not None:
        for r in resolve(rules, patterns).collect():
            found[r["FullFieldName"]]["rules"].append(Rule(r["PatternID"], r["PatternName"], r["PatternCategory"], r["PatternPriority"], r["PatternValue"], bool(r["IsPatternAllowed"])))
    if values is not None:
        for r in on(values).collect():
            found[r["FullFieldName"]] |= {"length": (r["MinDataLength"], r["MaxDataLength"]), "values": (r["MinDataValue"], r["MaxDataValue"])}
    if custom is not None:
        for r in on(custom).collect():
            found[r["FullFieldName"]]["custom"].append(Custom(r["_ID"], r["CustomQueryType"] or "", r["CustomQuery"] or "", bool(r["IsConditionAllowed"])))
    return {k: Field(k, tuple(v["rules"]), tuple(v["custom"]), v["length"], v["values"]) for k, v in found.items()}


def valid_sql(spark: SparkSession, custom: list[Custom]) -> dict[int, str | None]:
    """Per SQL rule None, or why it can't be analysed. Nothing runs."""
    out: dict[int, str | None] = {}
    for c in custom:
        try:
            _ = spark.range(1).selectExpr(f"cast(({c.expression.replace('@InputValue', 'cast(null as string)')}) as boolean) as x").schema
            out[c.id] = None
        except Exception as e:
            out[c.id] = str(e).splitlines()[0]
    return out


def result_name(m: Mapping) -> str:
    return f"_dq_{m.id}"


def compile_all(df: DataFrame, mappings: list[Mapping], fields: dict[str, Field], validators: dict[str, Callable] | None = None, exact_timestamps: bool = False) -> list[tuple[Mapping, Compiled]]:
    """Compiled rules of the mappings whose field has any, by id. Unparsable SQL rules are left out."""
    out = []
    for m in sorted(mappings, key=lambda m: m.id):
        if m.field not in fields:
            continue
        if m.column not in df.columns:
            raise ValueError(f"{m.table} has no column {m.column}")
        f = fields[m.field]
        broken = {i for i, why in valid_sql(df.sparkSession, [c for c in f.custom if c.kind.upper() == "SQL"]).items() if why}
        f = Field(f.name, f.rules, tuple(c for c in f.custom if c.id not in broken), f.length, f.values, f.one_sided)
        column = f"`{m.column}`" if dict(df.dtypes)[m.column] == "string" else f"cast(`{m.column}` as string)"
        out.append((m, compile_field(f, column, f"_s{m.id}", validators, exact_timestamps)))
    return out


def checked(df: DataFrame, mappings: list[Mapping], fields: dict[str, Field], **options) -> DataFrame:
    """df plus one result struct for each mapping: one projection over one scan, whatever the number of fields."""
    plan = compile_all(df, mappings, fields, **options)
    return apply(df, ((m.column, c, result_name(m)) for m, c in plan))


def _present(df: DataFrame, mappings: list[Mapping]) -> list[Mapping]:
    return [m for m in sorted(mappings, key=lambda m: m.id) if result_name(m) in df.columns]


def write_back(df: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """A checked table with its row flags brought up to date and the result structs dropped.

    DQEligible stays false once false; DQViolations and DQFields grow by what was assessed, in the order of mapping ids.
    """
    present = _present(df, mappings)
    ok = [F.col(result_name(m))["result"] for m in present]
    if not present:
        return df
    every = ok[0]
    for o in ok[1:]:
        every = every & o
    old = {c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in ((ELIGIBLE, "boolean"), (VIOLATIONS, "string"), (FIELDS, "string"))}
    found = [F.when(~o, F.concat(F.lit(f"[{m.column}: "), F.col(result_name(m))["violation_type"], F.lit("]"))) for m, o in zip(present, ok, strict=True)]
    joined = F.concat_ws(", ", old[VIOLATIONS], *found)
    return df.withColumns({
        ELIGIBLE: F.when(~old[ELIGIBLE], F.lit(False)).otherwise(every),
        VIOLATIONS: F.nullif(joined, F.lit("")),
        FIELDS: F.concat_ws(", ", old[FIELDS], F.lit(", ".join(f"[{m.column}]" for m in present))),
    }).drop(*(result_name(m) for m in present))


def reset(df: DataFrame) -> DataFrame:
    """Flags of disqualified rows cleared, so that they are assessed anew."""
    was = F.coalesce(~F.col(ELIGIBLE), F.lit(False))
    return df.withColumns({c: F.when(was, F.lit(None)).otherwise(F.col(c)) for c in (ELIGIBLE, VIOLATIONS, FIELDS)})


def prepared(df: DataFrame, row_id: Column | None = None) -> DataFrame:
    """df with the four flag columns; missing row ids are filled (by row_id, or at random)."""
    for c, t in ((ROW_ID, "string"), (ELIGIBLE, "boolean"), (VIOLATIONS, "string"), (FIELDS, "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df.withColumn(ROW_ID, F.coalesce(ROW_ID, row_id if row_id is not None else F.uuid()))


def audit(df: DataFrame, mappings: list[Mapping], execution_id: str, generated_on: Column | None = None) -> DataFrame:
    """A row for each failure of a checked table: MappingID, InputValue, Result, ViolationType, LogMessage.

    Failures are unpivoted where the rows are; passing rows make no output, and nothing is shuffled or collected.
    """
    present = _present(df, mappings)
    entry = lambda m: F.when(~F.col(result_name(m))["result"], F.struct(F.lit(m.id).alias("MappingID"), F.col(f"`{m.column}`").cast("string").alias("InputValue"), F.col(result_name(m)).alias("r")))
    rows = df.select(F.explode(F.array_compact(F.array(*map(entry, present)))).alias("a"))
    when = generated_on if generated_on is not None else F.current_timestamp()
    return rows.select(when.alias("GeneratedOn"), F.lit(execution_id).alias("ExecutionID"), "a.MappingID", "a.InputValue", "a.r.result", "a.r.violation_type", "a.r.log_message").toDF("GeneratedOn", "ExecutionID", "MappingID", "InputValue", "Result", "ViolationType", "LogMessage")


def stats(df: DataFrame, mappings: list[Mapping], execution_id: str, logged_on: Column | None = None) -> DataFrame:
    """MappingID, RowsQualified, RowsDisqualified of a checked table: all fields in one aggregation."""
    present = _present(df, mappings)
    counts = [F.count_if(F.col(result_name(m))["result"] if good else ~F.col(result_name(m))["result"]).alias(f"{'q' if good else 'd'}{m.id}") for m in present for good in (True, False)]
    entries = F.array(*(F.struct(F.lit(m.id).alias("MappingID"), F.col(f"q{m.id}").alias("RowsQualified"), F.col(f"d{m.id}").alias("RowsDisqualified")) for m in present))
    rows = df.agg(*counts).select(F.explode(entries).alias("s"))
    when = logged_on if logged_on is not None else F.current_timestamp()
    return rows.select(when.alias("LoggedOn"), F.lit(execution_id).alias("ExecutionID"), "s.*")


def mapping_frame(spark: SparkSession, mappings: list[Mapping]) -> DataFrame:
    rows = [(m.id, m.field, m.schema, m.table, m.column) for m in mappings]
    return spark.createDataFrame(rows, "_ID int, FullFieldName string, TargetSchemaName string, TargetTableName string, TargetFieldName string")
