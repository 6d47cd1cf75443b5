"""Workbooks from path to table: validate, find the structure, name, map, load, combine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import mapping as M
from .operators import sheets as H
from .sources import xlsx


@dataclass
class Config:
    """What is known of a file; rows are given as lists or as text like "[1, 2]"."""

    sheet: str | None = None
    static_header_rows: list[int] = field(default_factory=list)
    data_start_row: int | None = None
    ignore_rows: list[int] = field(default_factory=list)
    skip_hidden: bool = False
    max_rows_to_scan: int = H.SCAN_ROWS
    header_population_threshold: float = H.HEADER_POPULATION

    @classmethod
    def from_row(cls, row: dict) -> Config:
        c = cls(row.get("sheet"), H.row_list(row.get("static_header_rows")), row.get("data_start_row"), H.row_list(row.get("ignore_rows")), bool(row.get("skip_hidden", False)))
        c.max_rows_to_scan = row.get("max_rows_to_scan") or c.max_rows_to_scan
        c.header_population_threshold = row.get("header_population_threshold") or c.header_population_threshold
        return c


@dataclass
class Result:
    """status: PASSED, WARNING or FAILED of the file, then VALID, NO_HEADERS, NO_DATA, EMPTY_FILE or SHEET_NOT_SPECIFIED of the sheet."""

    path: str
    validation: str
    reason: str = ""
    sheet: str | None = None
    status: str | None = None
    warnings: list[str] = field(default_factory=list)
    names: list[tuple[int, str]] = field(default_factory=list)
    data_start: int = 1
    signature: str | None = None
    columns: DataFrame | None = None
    mapped: DataFrame | None = None
    cells: DataFrame | None = None
    config: Config = field(default_factory=Config)

    @property
    def loadable(self) -> bool:
        return self.validation != "FAILED" and self.status == "VALID"


class SheetIngest:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def validate(self, path: str) -> tuple[str, str]:
        return xlsx.validate_path(self.spark, path)

    def structure(self, path: str, config: Config | None = None) -> Result:
        """Sheet, header zone, names and sections of one file. Only what is of the size of a header goes to the driver."""
        config = config or Config()
        status, reason = self.validate(path)
        out = Result(path, status, reason, config=config)
        if status == "FAILED":
            return out
        found = xlsx.files(self.spark, path)
        every = xlsx.cells(found).cache()  # one file
        known = [(s, s in {r[0] for r in every.where("sheet_hidden").select("sheet").distinct().collect()}) for s in xlsx.validated(found).first()["sheets"]]
        out.sheet, out.status = xlsx.sheet_to_read(known, config.sheet)
        if out.sheet is None:
            return out
        cells = out.cells = every.where(F.col("sheet") == out.sheet)
        zones = self._zones(cells, config)
        zone = zones.first()
        if zone is None:
            out.status = "EMPTY_FILE"
            return out
        if zone["fell_back"]:
            out.warnings.append("headers reach the scan limit; row 1 is taken as the only header row")
        out.data_start = zone["data_start_row"]
        out.status = H.structure_status(cells, zones).first()["status"]
        merges = xlsx.merges(found).where(F.col("sheet") == out.sheet)
        named = H.bronze_names(H.headers(cells, zones, merges))
        parts = H.sections(H.blank_columns(cells))
        out.columns = named.join(parts, ["sheet", "idx"]).select("sheet", "idx", "header", "bronze_name", "section_id", "is_blank")
        out.names = [(r["idx"], r["bronze_name"]) for r in out.columns.orderBy("idx").select("idx", "bronze_name").collect()]
        out.signature = H.signature(named).first()["signature"]
        return out

    def _zones(self, cells: DataFrame, config: Config) -> DataFrame:
        if config.static_header_rows:
            heads = F.array(*(F.lit(r) for r in sorted(config.static_header_rows)))
            start = F.lit(config.data_start_row or max(config.static_header_rows) + 1)
            return cells.select("sheet").distinct().select("sheet", heads.alias("header_rows"), start.alias("data_start_row"), F.lit(False).alias("fell_back"))
        if config.data_start_row == 1:
            return cells.select("sheet").distinct().select("sheet", F.array().cast("array<int>").alias("header_rows"), F.lit(1).alias("data_start_row"), F.lit(False).alias("fell_back"))
        zones = H.header_zone(cells, config.max_rows_to_scan, config.header_population_threshold)
        return zones.withColumn("data_start_row", F.lit(config.data_start_row)) if config.data_start_row else zones

    def map_to_canonical(self, result: Result, canonical: dict[str, list[str]], prior: DataFrame | None = None, model: Callable[[DataFrame], DataFrame] | None = None, skip_blank: bool = True) -> DataFrame:
        columns = result.columns.where("not is_blank") if skip_blank else result.columns
        headers = columns.select(F.col("idx").alias("id"), "header", F.lit(None).cast("string").alias("section"))
        result.mapped = M.map_columns(headers, M.dictionary(self.spark, canonical), prior, model)
        return result.mapped

    def load(self, result: Result) -> DataFrame:
        """The sheet's rows as text columns."""
        if not result.loadable:
            raise ValueError(f"{result.path}: {result.validation} {result.status} {result.reason}")
        return xlsx.load(result.cells, result.names, result.data_start, result.config.ignore_rows, result.config.skip_hidden).drop("_row")

    def ingest(self, path: str, canonical: dict[str, list[str]] | None = None, config: Config | None = None, **mapping) -> Result:
        """Validate, find the structure, and map; stops at the first of these that fails."""
        out = self.structure(path, config)
        if out.loadable and canonical:
            self.map_to_canonical(out, canonical, **mapping)
        return out

    def combine(self, results: list[Result], inserted: Column | None = None) -> DataFrame:
        """All loadable results under the union of their names, hidden columns included (null where they were skipped)."""
        done = [r for r in results if r.loadable]
        union = sorted({n for r in done for _, n in r.names})
        when = inserted if inserted is not None else F.current_timestamp()
        return H.combine([(self.load(r), r.path, r.sheet) for r in done], when, union)
