"""A day of runs: fail, reset, retry."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from steward.monitor import RunMonitor
from steward.operators import drift as D
from steward.operators import runs as R
from steward.operators import views as V
from steward.operators.upsert import insert_only, next_id, upsert
from steward.queries.runs import PARAMETERS, STAGES, TASKS
from steward.sources.store import TABLES, Store, evolve

P, DAY = R.Process("P1", "DAILY"), "2024-03-01"


@pytest.fixture
def world(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create_all(["ETLProcessingSteps"])
    return store, TASKS.frame(spark), STAGES.frame(spark), PARAMETERS.frame(spark)


def status(steps):
    return {(r["TaskID"], r["Attempts"]): r["Status"] for r in steps.collect()}


def test_retry_skips_what_is_done(world):
    store, tasks, stages, parameters = world
    name = "ETLProcessingSteps"
    store.write(name, R.generate_steps(store.read(name), tasks, stages, P, "E1", DAY, "2024-03-01 01:00:00"))
    assert len(status(store.read(name))) == 6 and {a for _, a in status(store.read(name))} == {0}
    load, save = lambda: store.read(name), lambda df: store.write(name, df)
    t1 = R.Task("E1", P, 1, 2, 1, DAY)
    with R.task(load, save, lambda s: R.start(s, tasks, stages, t1, 0, now="2024-03-01 02:00:00"), t1, 0) as runs:
        assert runs
    assert status(load())[(1, 0)] == "DONE"
    t2 = R.Task("E1", P, 2, 3, 1, DAY)
    with pytest.raises(RuntimeError), R.task(load, save, lambda s: R.start(s, tasks, stages, t2, 0), t2, 0):
        raise RuntimeError("x" * 5000)
    row = load().where("TaskID = 2").first()
    assert row["Status"] == "FAIL" and len(row["LogMessage"]) == R.MESSAGE_LIMIT
    assert status(load())[(0, 0)] == "NQUE"
    pending = R.pending(load(), tasks, parameters, P, "E1", DAY).collect()
    assert [r["TaskID"] for r in pending] == [0, 3, 4, 2, 6]
    assert next(r for r in pending if r["TaskID"] == 0)["WatermarkType"] == "DELTA_DATE"
    # the retry leaves out the task that is done; a task without a frequency is always run again
    more = R.generate_steps(load(), tasks, stages, P, "E2", DAY)
    assert sorted(status(more)) == [(0, 1), (2, 1), (3, 1), (4, 1), (6, 1)]
    save(load().unionByName(more))
    assert {r["TaskID"] for r in V.current_failures(load()).collect()} == {2}
    summary = {r["ExecutionID"]: r["OverallStatus"] for r in V.run_summary(load()).collect()}
    assert summary == {"E1": "RUNNING", "E2": "RUNNING"}
    assert len({(r["TaskID"], r["Attempts"]) for r in V.status_detail(load(), "P1", "DAILY", DAY, "E2").collect()}) == 5
    save(R.reset(load(), P, DAY, remark="again"))
    assert status(load())[(1, 0)] == "RQUE"


def test_month_and_year(world):
    store, tasks, stages, _ = world
    first = R.generate_steps(store.read("ETLProcessingSteps"), tasks, stages, P, "E1", DAY)
    done = R.changed(first, first["TaskID"].isin(2, 3, 4), Status="DONE")
    later = R.generate_steps(done, tasks, stages, P, "E2", "2024-03-02")
    assert {r["TaskID"] for r in later.collect()} == {0, 1, 4, 6}
    april = R.generate_steps(done, tasks, stages, P, "E3", "2024-04-01")
    assert {r["TaskID"]: r["FullFileName"] for r in april.collect()} == {0: None, 1: "payroll_20240401.csv", 2: "month_202404.csv", 4: None, 6: None}


def test_worker_row_and_skip(world):
    store, tasks, stages, parameters = world
    steps = R.generate_steps(store.read("ETLProcessingSteps"), tasks, stages, P, "E1", DAY)
    assert R.worker_row(steps, tasks, parameters, P, "E1", DAY, 1).first()["Status"] == "NQUE"
    t = R.Task("E1", P, 1, 2, 1, DAY)
    skipped = R.skip(steps, t)
    assert R.worker_row(skipped, tasks, parameters, P, "E1", DAY, 1).first()["Status"] == "NULL"
    assert R.worker_row(R.skip(skipped, t, on=False), tasks, parameters, P, "E1", DAY, 1).first()["Status"] == "NQUE"
    assert 1 not in {r["TaskID"] for r in R.pending(skipped, tasks, parameters, P, "E1", DAY).collect()}


def test_watermark_moves_on_done(world):
    store, tasks, stages, parameters = world
    t = R.Task("E1", P, 0, 0, 0, DAY)
    steps = R.start(R.generate_steps(store.read("ETLProcessingSteps"), tasks, stages, P, "E1", DAY), tasks, stages, t, 0, now="2024-03-01 05:00:00")
    moved = R.advance_on_done(parameters, R.end(steps, t, 0, now="2024-03-01 05:01:30"), t, 0)
    assert str(moved.where("ParameterName = 'SRC0'").first()["ValueDateTime"]) == "2024-03-01 05:00:00"
    assert R.end(steps, t, 0, now="2024-03-01 05:01:30").where("TaskID = 0").first()["DurationSeconds"] == 90
    assert moved.count() == parameters.count()


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "x")], "k int, v string, who string")
    new = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "k int, v string")
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in upsert(old, new, ["k"], ["v"], stamp={"who": F.lit("y")}).collect())
    assert got == [(1, "b", "y"), (2, None, "x"), (3, "c", "y")]
    blank = spark.createDataFrame([(2, "")], "k int, v string")
    assert upsert(old, blank, ["k"], ["v"]).where("k = 2").first()["v"] == ""
    assert upsert(old, blank, ["k"], ["v"], blank_is_null=True).where("k = 2").first()["v"] is None
    assert sorted(r["k"] for r in insert_only(old, new, ["k"]).collect()) == [1, 2, 3] and next_id(old, "k") == 3 and next_id(old.limit(0), "k") == 1


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.seed("2024-01-01 00:00:00")
    assert store.read("masterPattern").count() == 119 and store.read("ETLconfigSequence").count() == 7
    assert store.read("auditDQChecks").count() == 0 and not store.exists("auditDQChecks")
    held = store.read("masterDataCategory")
    store.write("masterDataCategory", held.limit(1))
    assert held.count() == 27 and store.read("masterDataCategory").count() == 1  # a reader keeps its version
    store.append("masterDataCategory", held.limit(1))
    assert store.read("masterDataCategory").count() == 2
    assert len(TABLES) == 17 and evolve(held.select("_ID"), store.schema("masterDataCategory")).columns[-1] == "LastUpdatedOn"


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    row = lambda i: spark.createDataFrame([(i,)], "i int")
    a.write("t", row(0))
    asked = []

    def change(old):
        asked.append(1)
        if len(asked) == 1:
            b.update("t", lambda x: x.union(row(1)))  # comes between reading and writing
        return old.union(row(2))

    opened = a.read("t")
    a.update("t", change)
    assert len(asked) == 2 and sorted(r["i"] for r in b.read("t").collect()) == [0, 1, 2]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: (a, b)[i % 2].append("t", row(i)), range(10, 16)))
        list(pool.map(lambda i: (a, b)[i % 2].update("t", lambda x: x.union(row(i))), range(20, 24)))
    assert sorted(r["i"] for r in a.read("t").collect()) == [0, 1, 2, *range(10, 16), *range(20, 24)]
    assert [r["i"] for r in opened.collect()] == [0]
    a.update("t", lambda x: None)
    before = a._current("t")
    a.vacuum("t", 1)
    assert a._current("t") == before and a.read("t").count() == 13 and len(a._numbers("t")) == 1


def test_a_pointer_without_content_is_a_lost_writer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("steward.sources.store.WAIT", 0.1)
    s = Store(spark, str(tmp_path))
    s.write("t", spark.range(3))
    (tmp_path / "t" / "_current_" / "0000000002").touch()
    assert s.read("t").count() == 3
    s.append("t", spark.range(2))
    assert s.read("t").count() == 5 and s._numbers("t") == [1, 2, 3]


def test_views_that_stay(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("region", spark.range(2))
    s.append("region", spark.range(1))
    s.views(["region"], "v_", database="default")
    try:
        assert spark.newSession().table("default.v_region").count() == 3
    finally:
        spark.sql("drop view default.v_region")


def monitor(spark, path):
    times = iter(f"2024-05-01 01:{i // 60:02d}:{i % 60:02d}" for i in range(3000))
    r = RunMonitor(spark, str(path), clock=lambda: next(times))
    r.setup()
    r.register_task("P", "D", 1, 1, 1, "load", LoadFrequency="D", SourceSystemCode="SRC")
    r.register_parameter("P", "D", "SRC", "DELTA_DATE")
    return r


def test_start_takes_the_attempt_that_waits(spark, tmp_path):
    r = monitor(spark, tmp_path)
    r.generate_execution_steps("E", "P", "D", DAY)
    t = r.task_of("E", "P", "D", 1, 1, 1, DAY)
    assert r.start_task(t) == 0
    r.end_task(t, 0, "FAIL")
    r.start_task(t, 1)
    r.end_task(t, 1)
    r._steps(lambda s: R.changed(s, s["Attempts"] == 0, Status="RQUE"))  # as after a reset of the first attempt
    assert r.start_task(t) == 0
    assert status(r.store.read("ETLProcessingSteps"))[(1, 1)] == "DONE"


def test_a_step_is_closed_before_its_watermark_moves(spark, tmp_path, monkeypatch):
    r = monitor(spark, tmp_path)
    r.generate_execution_steps("E", "P", "D", DAY)
    t = r.task_of("E", "P", "D", 1, 1, 1, DAY)
    r.start_task(t, timestamp="2024-03-01 05:00:00")
    monkeypatch.setattr(R, "advance_on_done", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        r.end_task(t, 0)
    assert status(r.store.read("ETLProcessingSteps"))[(1, 0)] == "DONE"
    assert r.get_active_watermark("P", "D", "SRC").first()["ValueDateTime"] is None
    monkeypatch.undo()
    r.end_task(t, 0)
    assert str(r.get_active_watermark("P", "D", "SRC").first()["ValueDateTime"]) == "2024-03-01 05:00:00"


def test_diff_follows_case_and_missing_properties(spark):
    shape = "schema_name string, table_name string, column_name string, data_type string"
    new = D.snapshot(spark.createDataFrame([("s", "t", "a", "INT", "x"), ("s", "t", "b", "int", None), ("s", "t", "n", "int", None)], f"{shape}, owner string"))
    old = D.snapshot(spark.createDataFrame([("s", "t", "a", "int"), ("s", "t", "b", "int"), ("s", "t", "o", "int")], shape))
    got = {r["FullFieldName"][-2]: r for r in D.diff(new, old).collect()}
    assert got["a"]["ChangedColumns"] == "[SHA256Hash], [owner]" and got["b"]["Action"] == "Unchanged"
    assert (got["n"]["Action"], got["n"]["SHA256Hash_from_n_minus_1"], got["o"]["SHA256Hash_from_n"]) == ("Added", "Missing", "Missing")


def test_a_catalogs_keys_order_its_tables(spark):
    from steward.operators.hierarchy import hierarchy
    from steward.queries.drift import PRIORITIES, catalog

    got = {r["table_name"]: (r["section_level"], r["Hierarchy"]) for r in hierarchy(catalog(spark).where("schema_name = 'dbo'"), PRIORITIES.frame(spark)).collect()}
    assert got == {"cust": (1, 1), "orders": (3, 2), "line": (3, 3), "item": (999, 4)}
