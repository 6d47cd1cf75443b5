"""Workbooks (xlsx, xlsm) as tables of cells, by the standard library alone.

Files are read by Spark (binaryFile) and parsed on the executors, one workbook a row; a workbook is a file that someone
opened, so it fits one task. Encrypted workbooks and the old binary format can't be opened and are reported as FAILED.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats that show dates; first bytes of encrypted and old workbooks.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
OLE_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FORMATS = (".xlsx", ".xlsm", ".xls")
CELLS = "path string, sheet string, sheet_hidden boolean, row int, col int, value string, kind string, col_hidden boolean"
MERGES = "path string, sheet string, min_row int, max_row int, min_col int, max_col int"


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def place(ref: str) -> tuple[int, int]:
    """B3 -> (3, 2)"""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref)
    return int(m[2]), column_number(m[1])


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


class Workbook:
    """Sheets in order: (name, hidden, path in the archive)."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        book = self._xml("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        at = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = [(s.get("name"), s.get("state", "visible") != "visible", at(targets[s.get(f"{LINK}id")])) for s in book.iter(f"{MAIN}sheet")]
        pr = next(book.iter(f"{MAIN}workbookPr"), None)
        self.epoch = datetime(1904, 1, 1) if pr is not None and pr.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        names = self.zip.namelist()
        self.strings = [_text(si) for si in self._xml("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _date_styles(self) -> set[int]:
        styles = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
        cells = styles.find(f"{MAIN}cellXfs")
        return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def read(self, path: str) -> tuple[list[tuple], list[tuple], set[int]]:
        """Cells (row, col, value, kind), merges (min_row, max_row, min_col, max_col) and hidden columns of a sheet."""
        root = self._xml(path)
        hidden = {n for c in root.iter(f"{MAIN}col") if c.get("hidden") in ("1", "true") for n in range(int(c.get("min")), min(int(c.get("max")), 16384) + 1)}
        merges = []
        for m in root.iter(f"{MAIN}mergeCell"):
            (a, b), (c, d) = map(place, m.get("ref").split(":")) if ":" in m.get("ref") else (place(m.get("ref")),) * 2
            merges.append((a, c, b, d))
        cells, row_no = [], 0
        for row in root.iter(f"{MAIN}row"):
            row_no = int(row.get("r", row_no + 1))
            col_no = 0
            for c in row.iter(f"{MAIN}c"):
                col_no = place(c.get("r"))[1] if c.get("r") else col_no + 1
                value, kind = self._value(c)
                if value is not None:
                    cells.append((row_no, col_no, value, kind))
        return cells, merges, hidden

    def _value(self, c) -> tuple[str | None, str]:
        kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
        if kind == "inlineStr":
            return _text(c), "text"
        if v is None or v.text is None:
            return None, "text"
        if kind == "s":
            return self.strings[int(v.text)], "text"
        if kind == "b":
            return "True" if v.text == "1" else "False", "boolean"
        if kind in ("str", "e"):
            return v.text, "text"
        if kind == "d":
            return v.text.replace("T", " "), "date"
        if int(c.get("s", 0)) in self.dates:
            return str(self.epoch + timedelta(seconds=round(float(v.text) * 86400))), "date"
        n = float(v.text)
        return str(int(n)) if n.is_integer() and abs(n) < 1e15 else repr(n), "number"


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def cells(found: DataFrame) -> DataFrame:
    """A row for each cell with a value, of all sheets of all workbooks that can be opened."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                if check(path, content)[0] == "FAILED":
                    continue
                book, out = Workbook(content), []
                for name, hidden, inner in book.sheets:
                    got, _, gone = book.read(inner)
                    out += [(path, name, hidden, r, c, v, k, c in gone) for r, c, v, k in got]
                yield pd.DataFrame(out, columns=["path", "sheet", "sheet_hidden", "row", "col", "value", "kind", "col_hidden"])

    return found.mapInPandas(parse, CELLS)


def merges(found: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                if check(path, content)[0] == "FAILED":
                    continue
                book = Workbook(content)
                yield pd.DataFrame([(path, name, *m) for name, _, inner in book.sheets for m in book.read(inner)[1]], columns=["path", "sheet", "min_row", "max_row", "min_col", "max_col"])

    return found.mapInPandas(parse, MERGES)


def check(path: str, content: bytes) -> tuple[str, str]:
    """PASSED, WARNING (hidden sheets) or FAILED, and why."""
    if not path.lower().endswith(FORMATS):
        return "FAILED", "unsupported format"
    if content[:8] == OLE_MAGIC:
        return "FAILED", "password protected" if b"E\x00n\x00c\x00r\x00y\x00p\x00t" in content else "unsupported format"
    try:
        hidden = [name for name, h, _ in Workbook(content).sheets if h]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return "FAILED", "not a workbook"
    return ("WARNING", "hidden sheets: " + ", ".join(hidden)) if hidden else ("PASSED", "")


def validated(found: DataFrame) -> DataFrame:
    """path, status, reason, sheets for each file."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                status, why = check(path, content)
                out.append((path, status, why, [s[0] for s in Workbook(content).sheets] if status != "FAILED" else []))
            yield pd.DataFrame(out, columns=["path", "status", "reason", "sheets"])

    return found.mapInPandas(work, "path string, status string, reason string, sheets array<string>")


def validate_path(spark: SparkSession, path: str) -> tuple[str, str]:
    """validated() for one path; FAILED if there is no such file."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return "FAILED", "no such file"
    row = validated(files(spark, path)).first()
    return row["status"], row["reason"]


def sheet_to_read(sheets: list[tuple[str, bool]], wanted: str | None = None) -> tuple[str | None, str]:
    """The named sheet, or the only visible one; else why not."""
    if wanted is not None:
        return (wanted, "") if wanted in [s for s, _ in sheets] else (None, "SHEET_NOT_FOUND")
    visible = [s for s, hidden in sheets if not hidden]
    return (visible[0], "") if len(visible) == 1 else (None, "SHEET_NOT_SPECIFIED")


def load(sheet_cells: DataFrame, names: list[tuple[int, str]], data_start: int, ignore: list[int] = (), skip_hidden: bool = False) -> DataFrame:
    """Data rows of one sheet as text columns (idx, name): trimmed, blank null, rows without a value left out, in no stated order but _row."""
    from ..operators.sheets import cleaned

    rows = sheet_cells.where((F.col("row") >= data_start) & ~F.col("row").isin([int(i) for i in ignore] or [-1]))
    hidden = {r[0] for r in sheet_cells.where("col_hidden").select("col").distinct().collect()} if skip_hidden else set()
    kept = [(i, n) for i, n in names if i not in hidden]
    out = rows.groupBy(F.col("row").alias("_row")).agg(*(F.max(F.when(F.col("col") == i, cleaned(F.col("value")))).alias(n) for i, n in kept))
    return out.dropna("all", subset=[n for _, n in kept]) if kept else out
