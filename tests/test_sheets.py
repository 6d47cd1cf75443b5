"""Workbooks made here, read, named and loaded; schema snapshots; streams."""

import zipfile

from pyspark.sql import functions as F

from steward.operators import sheets as H
from steward.operators.assess import Mapping
from steward.plans.compile import Field
from steward.queries.quality import rules
from steward.sources import xlsx
from steward.streaming import assess_stream


def book(path, sheets, hidden=(), merges=(), hidden_cols=()):
    """A workbook of inline strings and numbers."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"{" state=" + chr(34) + "hidden" + chr(34) if n in hidden else ""}/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts count="1"><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row, 1):
                    ref = f"{H.column_letter(c)}{r}"
                    if isinstance(v, tuple):
                        cells += f'<c r="{ref}" {v[0]}><v>{v[1]}</v></c>'
                    elif isinstance(v, (int, float)):
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                    elif v is not None:
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                body += f'<row r="{r}">{cells}</row>'
            cols = "<cols>" + "".join(f'<col min="{c}" max="{c}" hidden="1"/>' for c in hidden_cols) + "</cols>" if hidden_cols else ""
            m = "<mergeCells>" + "".join(f'<mergeCell ref="{x}"/>' for x in merges) + "</mergeCells>" if merges else ""
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}>{cols}<sheetData>{body}</sheetData>{m}</worksheet>")
    return str(path)


def test_cells(spark, tmp_path):
    p = book(tmp_path / "a.xlsx", {"S": [["Name", "When", "N"], ["x", ('s="1"', 45292), 2], [('t="s"', 1), ('s="2"', 45292.5), 2.5], [('t="b"', 1), None, " "]]})
    got = {(r["row"], r["col"]): (r["value"], r["kind"]) for r in xlsx.cells(xlsx.files(spark, p)).collect()}
    assert got[(2, 2)] == ("2024-01-01 00:00:00", "date") and got[(3, 2)] == ("2024-01-01 12:00:00", "date")
    assert got[(2, 3)] == ("2", "number") and got[(3, 3)] == ("2.5", "number") and got[(3, 1)] == ("rich", "text") and got[(4, 1)] == ("True", "boolean")


def test_from_workbook_to_table(spark, tmp_path):
    p = book(tmp_path / "b.xlsx", {"S": [["Order", None, "Customer", None], ["ID", "Date", "ID", "Name"], [1, "2024", 7, " ann "], [2, " ", 8, "bob"], [None, None, None, " "]]}, merges=["A1:B1", "C1:D1"], hidden_cols=[2])
    found = xlsx.files(spark, p)
    cells = xlsx.cells(found)
    zones = H.header_zone(cells)
    zone = zones.first()
    assert list(zone["header_rows"]) == [1, 2] and zone["data_start_row"] == 3
    named = H.bronze_names(H.headers(cells, zones, xlsx.merges(found)))
    names = sorted((r["idx"], r["bronze_name"]) for r in named.collect())
    assert names == [(1, "order__id"), (2, "date"), (3, "customer__id"), (4, "name")]
    rows = sorted((tuple(r) for r in xlsx.load(cells, names, 3).collect()), key=lambda r: r[0])
    assert rows == [(3, "1", "2024", "7", "ann"), (4, "2", None, "8", "bob")]
    assert xlsx.load(cells, names, 3, ignore=[3], skip_hidden=True).columns == ["_row", "order__id", "customer__id", "name"]
    assert H.structure_status(cells, zones).first()["status"] == "VALID"


def test_validation(spark, tmp_path):
    good = book(tmp_path / "c.xlsx", {"A": [["x"]], "B": [["y"]]})
    odd = book(tmp_path / "d.xlsx", {"A": [["x"]], "B": [["y"]]}, hidden=["B"])
    (tmp_path / "e.csv").write_text("a,b")
    (tmp_path / "f.xlsx").write_bytes(xlsx.OLE_MAGIC + "EncryptionInfo".encode("utf-16-le").replace(b"E\x00n\x00c\x00r\x00y\x00p\x00t\x00", b"E\x00n\x00c\x00r\x00y\x00p\x00t\x00"))
    (tmp_path / "g.xlsx").write_text("not a zip")
    got = {p.rsplit("/", 1)[1]: xlsx.validate_path(spark, p)[0] for p in (good, odd, *(str(tmp_path / n) for n in ("e.csv", "f.xlsx", "g.xlsx", "none.xlsx")))}
    assert got == {"c.xlsx": "PASSED", "d.xlsx": "WARNING", "e.csv": "FAILED", "f.xlsx": "FAILED", "g.xlsx": "FAILED", "none.xlsx": "FAILED"}
    assert "password" in xlsx.validate_path(spark, str(tmp_path / "f.xlsx"))[1]
    assert xlsx.sheet_to_read([("A", False), ("B", True)]) == ("A", "") and xlsx.sheet_to_read([("A", False), ("B", False)])[1] == "SHEET_NOT_SPECIFIED" and xlsx.sheet_to_read([("A", False)], "Z")[0] is None
    assert xlsx.cells(xlsx.files(spark, str(tmp_path / "f.xlsx"))).count() == 0


def test_small_helpers():
    assert [H.column_letter(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"] and xlsx.place("AAA12") == (12, 703)
    assert H.cell_range(1, 1, 3, 28) == "A1:AB3"
    assert H.row_list("[1, 2]") == [1, 2] and H.row_list([3]) == [3] and H.row_list(None) == [] and H.row_list("[]") == []


def test_stream(spark, sf_dir, tmp_path):
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(source).repartition(2).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    maps, fields = [Mapping(1, "t", "events", "event_type")], {"t": Field("t", rules(100, 126))}
    seen = []
    q = assess_stream.assess(stream, maps, fields, lambda kind, df, n: seen.append((kind, n, df.count())), str(tmp_path / "cp"))
    q.awaitTermination(120)
    total = spark.read.parquet(source).count()
    errors = spark.read.parquet(source).where("event_type = 'error'").count()
    assert sum(c for k, _, c in seen if k == "rows") == total and sum(c for k, _, c in seen if k == "audit") == errors and len({n for _, n, _ in seen}) == 2
    q = assess_stream.violations_by_window(stream, maps, fields, "ts", "7 days", "1 day").writeStream.outputMode("complete").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("late").agg(F.sum("RecordCount")).first()[0] == errors
