"""Headers, names, sections and signatures of sheets, over a table of cells.

Cells: sheet, row, col (1-based), value (text or null), kind ("text", "number", "date", "boolean").
Headers: sheet, idx, header ("[A].[B]").
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER_POPULATION, DATA_SHARE, SCAN_ROWS = 0.3, 0.35, 20
STRUCTURED_ID = r"(?i)^[A-Z]{2,6}-[A-Z0-9]{2,}"


def header_text(parts: Column) -> Column:
    """[a].[b] of the non-blank parts; [Unnamed] without any."""
    named = F.filter(parts, lambda p: p.isNotNull() & ~p.rlike(r"^\s*$"))
    return F.when(F.size(named) == 0, "[Unnamed]").otherwise(F.array_join(F.transform(named, lambda p: F.concat(F.lit("["), p, F.lit("]"))), "."))


def sanitised(text: Column) -> Column:
    """A level of a header as an identifier: & and % spelled, others _, squeezed and trimmed; digits get a prefix."""
    t = F.replace(F.replace(F.lower(text), F.lit("&"), F.lit("and")), F.lit("%"), F.lit("pct"))
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(t == "", "col").when(t.rlike("^[0-9]"), F.concat(F.lit("col_"), t)).otherwise(t)


def levels(header: Column) -> Column:
    """The levels of a hierarchical header, as identifiers."""
    found = F.regexp_extract_all(header, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return F.when(F.size(found) == 0, F.array(F.lit("col"))).otherwise(F.transform(found, sanitised))


def bronze_names(headers: DataFrame) -> DataFrame:
    """headers plus bronze_name: the leaf if it is the only one of its sheet, else the full path, else numbered."""
    h = headers.withColumn("_levels", levels(F.col("header")))
    h = h.withColumn("_leaf", F.element_at("_levels", -1))
    h = h.withColumn("_name", F.when(F.count("*").over(Window.partitionBy("sheet", "_leaf")) > 1, F.array_join("_levels", "__")).otherwise(F.col("_leaf")))
    same = Window.partitionBy("sheet", "_name")
    number = F.row_number().over(same.orderBy("idx"))
    return h.withColumn("bronze_name", F.when(F.count("*").over(same) > 1, F.concat_ws("_", "_name", number)).otherwise(F.col("_name"))).drop("_levels", "_leaf", "_name")


def sections(columns: DataFrame) -> DataFrame:
    """columns (sheet, idx, is_blank) plus section_id: a blank column starts the next section."""
    order = Window.partitionBy("sheet").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return columns.withColumn("section_id", (1 + F.sum(F.col("is_blank").cast("int")).over(order)).cast("int"))


def signature(headers: DataFrame) -> DataFrame:
    """sheet, signature: SHA-256 of the headers in column order, joined by |. A sheet's headers are some hundred at most."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "header"))), lambda x: x["header"])
    return headers.groupBy("sheet").agg(F.sha2(F.array_join(ordered, "|"), 256).alias("signature"))


def superset(named: DataFrame) -> DataFrame:
    """All bronze names, once each, in order."""
    return named.select("bronze_name").distinct().orderBy("bronze_name")


def blank(value: Column) -> Column:
    return value.isNull() | value.rlike(r"^\s*$")


def row_profile(cells: DataFrame) -> DataFrame:
    """Per sheet and row: width, number of filled cells, of data-like ones, and whether it looks like data."""
    filled = ~blank(F.col("value"))
    data = filled & (F.col("kind").isin("number", "date") | ((F.col("kind") == "text") & F.trim("value").rlike(STRUCTURED_ID)))
    rows = cells.groupBy("sheet", "row").agg(F.count_if(filled).alias("filled"), F.count_if(data).alias("data_like"))
    width = cells.groupBy("sheet").agg(F.max("col").alias("width"))
    return rows.join(width, "sheet").withColumn("is_data", (F.col("filled") > 0) & (F.col("data_like") > DATA_SHARE * F.col("filled")))


def header_zone(cells: DataFrame, max_rows: int = SCAN_ROWS, threshold: float = HEADER_POPULATION) -> DataFrame:
    """sheet, header_rows, data_start_row, fell_back: leading filled rows up to a gap or a row of data.

    A sheet whose scan ends within its headers, and one without any, has row 1 as its only header.
    """
    last = cells.groupBy("sheet").agg(F.max("row").alias("last"))
    rows = row_profile(cells).join(last, "sheet").where(F.col("row") <= F.least(F.lit(max_rows), F.col("last")))
    rows = rows.withColumn("thin", F.col("filled") / F.col("width") < threshold).withColumn("limit", F.least(F.lit(max_rows), F.col("last")))
    before = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    # the zone starts at the first row that isn't thin; from there a thin row, a missing row or a row of data ends it
    rows = rows.withColumn("started", F.coalesce(F.max(~F.col("thin")).over(before), F.lit(False)))
    by = Window.partitionBy("sheet").orderBy("row")
    gap = F.col("started") & (F.col("row") - F.lag("row").over(by) > 1)
    rows = rows.withColumn("stops", (~F.col("thin") & F.col("is_data")) | (F.col("thin") & F.col("started")) | F.coalesce(gap, F.lit(False)))
    rows = rows.withColumn("over", F.max("stops").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = rows.groupBy("sheet").agg(F.array_sort(F.collect_list(F.when(~F.col("over") & ~F.col("thin"), F.col("row")))).alias("found"), F.max("limit").alias("limit"))
    fell = F.array_contains("found", F.col("limit"))
    heads = F.when(fell | (F.size("found") == 0), F.array(F.lit(1))).otherwise(F.col("found"))
    return found.select("sheet", heads.alias("header_rows"), (F.array_max(heads) + 1).alias("data_start_row"), fell.alias("fell_back"))


def headers(cells: DataFrame, zones: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """sheet, idx, header of each column: its values in the header rows; a merge along one row names all its columns."""
    top = cells.join(zones.select("sheet", F.explode("header_rows").alias("row")), ["sheet", "row"]).select("sheet", "row", "col", F.trim("value").alias("value"))
    if merges is not None:
        flat = merges.where("min_row = max_row and max_col > min_col")
        spread = flat.join(top.select("sheet", "row", "col", F.col("value").alias("label")), (flat["sheet"] == top["sheet"]) & (flat["min_row"] == F.col("row")) & (flat["min_col"] == F.col("col"))).select(flat["sheet"], F.col("row"), F.explode(F.sequence(F.col("min_col") + 1, F.col("max_col"))).alias("col"), "label")
        top = top.join(spread, ["sheet", "row", "col"], "full_outer").withColumn("value", F.coalesce("label", "value"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"])
    named = top.groupBy("sheet", "col").agg(parts.alias("parts"))
    widths = cells.groupBy("sheet").agg(F.max("col").alias("width")).select("sheet", F.explode(F.sequence(F.lit(1), "width")).alias("col"))
    return widths.join(named, ["sheet", "col"], "left").select("sheet", F.col("col").alias("idx"), header_text(F.coalesce("parts", F.array().cast("array<string>"))).alias("header"))


def blank_columns(cells: DataFrame, rows: int = SCAN_ROWS) -> DataFrame:
    """sheet, idx, is_blank: nothing but blanks in the first rows."""
    widths = cells.groupBy("sheet").agg(F.max("col").alias("width")).select("sheet", F.explode(F.sequence(F.lit(1), "width")).alias("idx"))
    seen = cells.where((F.col("row") <= rows) & ~blank(F.col("value"))).select("sheet", F.col("col").alias("idx")).distinct().withColumn("_seen", F.lit(True))
    return widths.join(seen, ["sheet", "idx"], "left").select("sheet", "idx", F.col("_seen").isNull().alias("is_blank"))


def structure_status(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """sheet, status: EMPTY_FILE, NO_HEADERS, NO_DATA or VALID."""
    known = cells.join(zones, "sheet").groupBy("sheet").agg(
        F.count_if(~blank(F.col("value"))).alias("filled"), F.count_if(~blank(F.col("value")) & F.array_contains("header_rows", F.col("row"))).alias("heads"), F.count_if(~blank(F.col("value")) & (F.col("row") >= F.col("data_start_row"))).alias("data"),
    )
    return known.select("sheet", F.when(F.col("filled") == 0, "EMPTY_FILE").when(F.col("heads") == 0, "NO_HEADERS").when(F.col("data") == 0, "NO_DATA").otherwise("VALID").alias("status"))


def cleaned(value: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(value, r"^\s+|\s+$", "")), F.lit(""))


def combine(frames: list[tuple[DataFrame, str, str]], inserted, order: list[str] | None = None) -> DataFrame:
    """All frames as text under the sorted union of their columns, missing ones null, plus file, sheet and time."""
    union = order or sorted({c for df, _, _ in frames for c in df.columns})
    out = None
    for df, file, sheet in frames:
        one = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)).withColumns({"source_file": F.lit(file), "source_sheet": F.lit(sheet), "insert_timestamp": inserted})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    for c in union:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*(F.col(f"`{c}`") for c in union), "source_file", "source_sheet", "insert_timestamp")


def column_letter(n: int) -> str:
    """1 -> A, 27 -> AA"""
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def cell_range(min_row: int, min_col: int, max_row: int, max_col: int) -> str:
    return f"{column_letter(min_col)}{min_row}:{column_letter(max_col)}{max_row}"


def row_list(value) -> list[int]:
    """Rows given as a list, or as text like "[1, 2]"; nothing else is read as numbers."""
    if value is None:
        return []
    if isinstance(value, (list, tuple)):
        return [int(v) for v in value]
    if not re.fullmatch(r"\s*\[?\s*(\d+\s*(,\s*\d+\s*)*)?\]?\s*", str(value)):
        raise ValueError(f"not a list of rows: {value!r}")
    return [int(v) for v in re.findall(r"\d+", str(value))]
