"""The stores and the ingest as a user calls them."""

import pytest
from pyspark.sql import functions as F
from test_sheets import book

from steward.ingest import Config, SheetIngest
from steward.monitor import RunMonitor
from steward.operators.assess import prepared
from steward.quality import Quality


def test_quality(spark, tmp_path):
    q = Quality(spark, str(tmp_path), "2024-01-01 00:00:00")
    q.setup()
    q.setup()
    f = "s.part.name"
    assert q.register_field(f, 2) == 1
    q.set_field_values(f, min_data_length=2, max_data_length=9)
    q.block_category(f, "DataEmptiness")
    q.allow_pattern(f, "Is Virtually Empty with -")
    q.add_custom_query_sql(f, "@InputValue like '%zz%'", False)
    q.add_custom_query_regex(f, "^[^0-9]*$")
    with pytest.raises(ValueError):
        q.add_invalid_keyword("soon", 5)
    q.add_invalid_keyword("Soon", 1001)
    q.block_pattern(f, "Has Keyword-soon")
    with pytest.raises(ValueError):
        q.generate_rules()  # no mapping yet
    m = q.add_mapping(f, "curated", "part", "p_name")
    assert q.generate_rules() == [f] and q.verify_config().count() == 0
    got = {r["value"]: r["result"] for r in q.test_checker(f, "ok", "--", "..", "x", "soon!", "azz", "a1", None).collect()}
    assert got == {"ok": True, "--": True, "..": False, "x": False, "soon!": False, "azz": False, "a1": False, None: False}
    assert any("L01" in s for s in q.inspect_checker(f)) and len(q.inspect_checker(f, True)) > len(q.inspect_checker(f))
    df = prepared(spark.createDataFrame([(1, "ok"), (2, "a1"), (3, None)], "i int, p_name string"), F.col("i").cast("string"))
    run, out = q.run_assessment({"part": df, "other": df}, execution_id="e1")
    assert run == "e1" and list(out) == ["part"]
    assert {r["i"]: r["DQEligible"] for r in out["part"].collect()} == {1: True, 2: False, 3: False}
    q.run_assessment({"part": out["part"]}, execution_id="e2", reset_eligible_flag=True)
    assert q.violations("e1").count() == 2 and q.violations().count() == 4 and q.quality_scores("e1").first()["PercentageQualified"] == 33.0
    assert len({r["LogID"] for r in q.violations().collect()}) == 4
    assert q.fields_below_threshold(50).count() == 2 and q.summary_by_table("e1").first()["TableQualityPct"] == 33.3
    assert q.summary_by_violation_type("e1").count() == 2 and q.mappings(table="part")[0].id == m and q.mappings(schema="none") == []
    assert {r["Level"] for r in q.field_rule_summary("part.p_name").collect()} == {"L01", "L02", "L03"}
    assert q.config_summary().where("TableName = 'mapDQChecks'").first()["Active"] == 1
    assert list(q.validate_custom_queries_sql().values()) == [None]
    q.set_field_values(f, config_id=1, min_data_length=2, max_data_length=None)
    assert q.store.read("configFieldValues").first()["MaxDataLength"] is None  # an edit to null isn't lost
    q.add_mapping("s.unknown", "curated", "part", "i")
    assert q.verify_config().first()["CheckName"] == "unknown_reference"


def test_monitor(spark, tmp_path):
    times = iter(f"2024-05-01 00:{i // 60:02d}:{i % 60:02d}" for i in range(3000))
    r = RunMonitor(spark, str(tmp_path), clock=lambda: next(times))
    r.setup()
    r.register_organisation("O", "Org")
    r.register_project("P", "Project", organisation_code="O")
    r.register_process("P", "D", "Daily", owner="ann")
    r.register_task("P", "D", 0, 0, 0, "Go", LoadFrequency="D", TaskMandatory=True)
    r.register_task("P", "D", 1, 1, 2, "Load", LoadFrequency="D", TaskMandatory=True, SourceSystemCode="SRC")
    with pytest.raises(ValueError):
        r.register_task("P", "D", 2, 1, 2, "Bad", nonsense=1)
    r.register_parameter("P", "D", "SRC", "DELTA_DATE", "first")
    r.register_parameter("P", "D", "SYSDT", "SYSTEM")
    assert r.processing_date(r.task_of("e", "P", "D", 1, 2, 1, "x").process) == "2024-05-01"
    assert {x["TaskID"] for x in r.get_pending_tasks("E1", "P", "D", "2024-05-01").collect()} == {0, 1}
    t = r.task_of("E1", "P", "D", 1, 2, 1, "2024-05-01")
    with pytest.raises(KeyError), r.task(t) as runs:
        assert runs
        raise KeyError("no")
    assert r.views()["v_currentFailures"].first()["LogMessage"] == "KeyError: 'no'"
    r.get_pending_tasks("E2", "P", "D", "2024-05-01")
    t2 = r.task_of("E2", "P", "D", 1, 2, 1, "2024-05-01")
    with r.task(t2) as runs:
        assert runs
    assert r.task_status(t2) == "NULL"
    with r.task(t2) as runs:
        assert not runs
    assert r.get_active_watermark("P", "D", "SRC").first()["ValueDateTime"] is not None
    r.register_parameter("P", "D", "SRC", "DELTA_DATE", "second")
    row = r.get_active_watermark("P", "D", "SRC").first()
    assert row["ValueDateTime"] is not None
    r.status_reset("P", "D", "2024-05-01", execution_id="E2")
    assert r.task_status(t2) == "RQUE"
    r.skip_task(t2)
    assert r.task_status(t2) == "NULL"
    r.unskip_task(t2)
    r.advance_watermark("P", "D", "SRC", to_time="2024-04-01 00:00:00")
    assert r.get_active_watermark("P", "D", "SRC").first()["ActiveValue"] == "2024-04-01 00:00:00"
    assert r.set_processing_mode("P", "D", historic_date="2024-02-03").where("ParameterName = 'SYSDT'").first()["ValueDateTime"] is not None
    assert r.processing_date(t.process) == "2024-02-03"
    assert r.get_status("P", "D", summary=True).count() == 2 and r.get_status("P", "D", "2024-05-01", execution_id="E2").count() == 2
    r.create_views("t_")
    assert spark.table("t_v_runSummary").count() == 2 and len(r.views()) == 6


def test_ingest(spark, tmp_path):
    rows = [["Order ID", "Customer Name", None, "Price"], [1, "ann", None, 2.5], [2, "bob", None, 3]]
    a = book(tmp_path / "a.xlsx", {"S": rows})
    b = book(tmp_path / "b.xlsx", {"S": [["Order ID", "Note"], [3, "x"]], "T": [["z"]]})
    s = SheetIngest(spark)
    r = s.ingest(a, {"order_id": ["order id"], "customer_name": ["customer name"], "amount": ["price"]}, prior=spark.createDataFrame([("[Order ID]", "order_id")], "header string, field string"))
    assert r.loadable and [n for _, n in r.names] == ["order_id", "customer_name", "unnamed", "price"] and len(r.signature) == 64
    assert [x["section_id"] for x in r.columns.orderBy("idx").collect()] == [1, 1, 2, 2]
    got = {x["id"]: (x["field"], x["status"]) for x in r.mapped.collect()}
    assert got == {1: ("order_id", "NEEDS_REVIEW"), 2: ("customer_name", "REQUIRES_HUMAN"), 4: ("amount", "REQUIRES_HUMAN")}
    assert s.ingest(b).status == "SHEET_NOT_SPECIFIED"
    r2 = s.ingest(b, config=Config.from_row({"sheet": "S", "static_header_rows": "[1]"}))
    both = s.combine([r, r2, s.ingest(str(tmp_path / "none.xlsx"))])
    assert both.columns == ["customer_name", "note", "order_id", "price", "unnamed", "source_file", "source_sheet", "insert_timestamp"] and both.count() == 3
    with pytest.raises(ValueError):
        s.load(s.ingest(str(tmp_path / "none.xlsx")))
    plain = s.ingest(a, config=Config(data_start_row=1))
    assert plain.status == "NO_HEADERS"
