"""Queries of run tracking, over a step log made of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seed
from ..operators import runs as R
from ..operators import upsert as U
from ..operators import views as V
from .tables import Values, table

QUERIES: dict = {}
ORACLES: dict = {}
P, EXEC, DAY, NOW = R.Process("P1", "DAILY"), "EX-DAILY-2024-01-05", "2024-01-05", "2024-02-01 08:00:00"

#: The step log: the same text for Spark and DuckDB. One row per day, load, task and attempt.
STEPS = """select cast(ts as date) as ProcessingDate, 'P1' as ProjectCode, case when user_id % 2 = 0 then 'DAILY' else 'HOURLY' end as ProcessLoad,
 cast(user_id % 5 as int) as TaskID, cast(event_id % 3 as int) as Attempts, count(*) as n, min(ts) as a, max(ts) as b, min(event_type) as e, max(value) as x from events group by 1, 2, 3, 4, 5"""
STEP = """select ProcessingDate, ProjectCode, ProcessLoad, concat('EX-', ProcessLoad, '-', cast(ProcessingDate as {text})) as ExecutionID, cast(case when TaskID = 0 then 0 else 1 end as int) as WorkFlowID, TaskID,
 cast(case when TaskID = 0 then 0 else TaskID % 3 + 1 end as int) as SequenceID, Attempts, case e when 'click' then 'DONE' when 'error' then 'FAIL' when 'purchase' then 'NQUE' else 'RQUE' end as Status, concat('Task ', TaskID) as TaskName,
 'SEQ' as SequenceCode, TaskID % 2 = 0 as TaskMandatory, concat('SRC', TaskID) as SourceSystemCode, cast(null as {text}) as FullFileName, cast(null as {text}) as InFilePath, cast(null as {text}) as OutFilePath,
 n % 7 = 0 as ForceSkip, a as StartTime, case when n % 4 <> 0 then b end as EndTime, cast(n * 3 as int) as DurationSeconds, cast(null as {text}) as LogMessage, cast(null as {text}) as LogType, cast(null as {text}) as LogCode, 'JOB' as SourceType,
 cast(null as {text}) as SourceRunID, cast(null as {text}) as ClusterID, b as LastUpdatedOn, 'u' as LastUpdatedBy from ({steps}) t"""
STEPS_SQL = "(" + STEP.format(text="varchar", steps=STEPS) + ")"

TASKS = Values("TaskID int,ProjectCode string,ProcessLoad string,WorkFlowID int,SequenceID int,TaskName string,SourceSystemCode string,FileNameMask string,FileExtension string,InFilePath string,OutFilePath string,LoadFrequency string,TaskMandatory boolean,IsActive boolean", [
    (0, "P1", "DAILY", 0, 0, "Task 0", "SRC0", None, None, None, None, "D", True, True), (1, "P1", "DAILY", 1, 2, "Task 1", "SRC1", "payroll", ".csv", "/in", "", "D", False, True),
    (2, "P1", "DAILY", 1, 3, "Task 2", "SRC2", "month", ".csv", "/in", "/out", "M", True, True), (3, "P1", "DAILY", 1, 1, "Task 3", "SRC3", "year", None, None, None, "Y", False, True),
    (4, "P1", "DAILY", 1, 2, "Task 4", "SRC4", "", None, None, None, None, True, True), (5, "P1", "DAILY", 1, 2, "Task 5", "SRC5", "x", ".txt", None, None, "W", True, False),
    (6, "P1", "DAILY", 1, 9, "Task 6", "SRC6", "w", ".txt", None, None, "W", True, True), (0, "P1", "HOURLY", 0, 0, "Task 0", "SRC0", None, None, None, None, "D", True, True),
])
PARAMETERS = Values("ProjectCode string,ProcessLoad string,ParameterName string,ParameterDescription string,ParameterType string,ValueINT long,ValueDateTime timestamp,ValueBIT boolean,CreatedBy string,CreatedOn timestamp,LastUpdatedBy string,LastUpdatedOn timestamp", [
    ("P1", "DAILY", "SRC0", "d", "DELTA_DATE", None, "2023-12-31 00:00:00", None, "a", "2023-01-01 00:00:00", "a", "2023-01-01 00:00:00"), ("P1", "DAILY", "SRC1", "d", "DELTA_ID", 42, None, None, "a", "2023-01-01 00:00:00", "a", "2023-01-01 00:00:00"),
    ("P1", "DAILY", "SRC2", None, "DELTA_DATE", None, None, None, "a", "2023-01-01 00:00:00", "a", "2023-01-01 00:00:00"), ("P1", "DAILY", "SRC3", "f", "FLAG", None, None, True, "a", "2023-01-01 00:00:00", "a", "2023-01-01 00:00:00"),
    ("P1", "DAILY", "SRC4", "i", "DELTA_ID", 0, None, None, "a", "2023-01-01 00:00:00", "a", "2023-01-01 00:00:00"), ("P1", "DAILY", "SYSDT", "s", "SYSTEM", None, None, None, "a", "2023-01-01 00:00:00", "a", "2023-01-01 00:00:00"),
    ("P1", "HOURLY", "SYSDT", "s", "SYSTEM", None, "2024-01-01 00:00:00", None, "a", "2023-01-01 00:00:00", "a", "2023-01-01 00:00:00"), ("P1", None, "ODD", "s", "OTHER", 1, None, None, "a", "2023-01-01 00:00:00", "a", "2023-01-01 00:00:00"),
])
PROCESSES = Values("ProjectCode string,ProcessLoad string,ProcessName string,ProcessOwner string", [("P1", "DAILY", "Daily load", "ann"), ("P2", "DAILY", "Other", "bob")])
STAGES = Values("SequenceID int,SequenceCode string,SequenceName string,SequenceDescription string,SortOrder int", seed.STAGES)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    grouped = events.groupBy(F.to_date("ts").alias("ProcessingDate"), F.lit("P1").alias("ProjectCode"), F.when(F.col("user_id") % 2 == 0, "DAILY").otherwise("HOURLY").alias("ProcessLoad"), (F.col("user_id") % 5).cast("int").alias("TaskID"), (F.col("event_id") % 3).cast("int").alias("Attempts")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.min("event_type").alias("e"))
    text = STEP.format(text="string", steps="{grouped}")
    return spark.sql(text.replace("({grouped})", "{grouped}"), grouped=grouped)


TIMES = "cast({0} as timestamp)"
KEYS = ["ProcessingDate", "ProcessLoad", "ExecutionID", "TaskID", "Attempts"]


def add(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return register


S = STEPS_SQL
HERE = f"s.ProjectCode = 'P1' and s.ProcessLoad = 'DAILY'"
NEXT = f"(select coalesce(max(Attempts), -1) + 1 from {S} s where {HERE} and ProcessingDate = date '{DAY}')"
GENERATED = f"""select date '{DAY}' as ProcessingDate, t.TaskID, {NEXT}::int as Attempts, 'NQUE' as Status, q.SequenceCode, case when coalesce(t.FileNameMask, '') = '' then null when LoadFrequency = 'D' then FileNameMask || '_20240105' || coalesce(FileExtension, '')
 when LoadFrequency = 'M' then FileNameMask || '_202401' || coalesce(FileExtension, '') when LoadFrequency = 'Y' then FileNameMask || '_2024' || coalesce(FileExtension, '') end as FullFileName, nullif(t.InFilePath, '') as InFilePath, nullif(t.OutFilePath, '') as OutFilePath
 from {TASKS.sql} t left join {STAGES.sql} q on t.SequenceID = q.SequenceID where t.ProjectCode = 'P1' and t.ProcessLoad = 'DAILY' and t.IsActive and not exists (select 1 from {S} s where {HERE} and s.Status = 'DONE' and s.WorkFlowID = t.WorkFlowID and s.TaskID = t.TaskID and s.SequenceID = t.SequenceID
 and ((t.LoadFrequency in ('D', 'W') and s.ProcessingDate = date '{DAY}' and s.Attempts < {NEXT}) or (t.LoadFrequency = 'M' and strftime(s.ProcessingDate, '%Y-%m') = '2024-01') or (t.LoadFrequency = 'Y' and year(s.ProcessingDate) = 2024)))"""


@add("run_steps_generate", GENERATED)
def run_steps_generate(spark, sf_dir):
    return R.generate_steps(steps(spark, sf_dir), TASKS.frame(spark), STAGES.frame(spark), P, "EX-NEW", DAY, NOW).select("ProcessingDate", "TaskID", "Attempts", "Status", "SequenceCode", "FullFileName", "InFilePath", "OutFilePath")


@add("run_steps_first", f"select t.TaskID, 0 as Attempts, case when coalesce(FileNameMask, '') = '' then null when LoadFrequency = 'D' then FileNameMask || '_20300101' || coalesce(FileExtension, '') when LoadFrequency = 'M' then FileNameMask || '_203001' || coalesce(FileExtension, '') when LoadFrequency = 'Y' then FileNameMask || '_2030' || coalesce(FileExtension, '') end as FullFileName from {TASKS.sql} t where ProcessLoad = 'DAILY' and IsActive")
def run_steps_first(spark, sf_dir):
    return R.generate_steps(steps(spark, sf_dir), TASKS.frame(spark), STAGES.frame(spark), P, "EX-NEW", "2030-01-01", NOW).select("TaskID", "Attempts", "FullFileName")


WM = "case p.ParameterType when 'DELTA_DATE' then strftime(p.ValueDateTime, '%Y-%m-%d %H:%M:%S') when 'DELTA_ID' then p.ValueINT::varchar when 'FLAG' then p.ValueBIT::varchar end as WatermarkValue"
JOINS = f"join {TASKS.sql} t on t.TaskID = s.TaskID and t.WorkFlowID = s.WorkFlowID and t.SequenceID = s.SequenceID and t.ProjectCode = s.ProjectCode and t.ProcessLoad = s.ProcessLoad {{active}} left join {PARAMETERS.sql} p on coalesce(p.ProjectCode, '') = s.ProjectCode and coalesce(p.ProcessLoad, '') = s.ProcessLoad and p.ParameterName = s.SourceSystemCode"


@add("run_pending", f"select s.TaskID, s.Attempts, s.Status, p.ParameterType as WatermarkType, {WM} from {S} s {JOINS.format(active='and t.IsActive')} where {HERE} and s.ExecutionID = '{EXEC}' and s.ProcessingDate = date '{DAY}' and s.Status <> 'DONE' and not coalesce(s.ForceSkip, false)")
def run_pending(spark, sf_dir):
    return R.pending(steps(spark, sf_dir), TASKS.frame(spark), PARAMETERS.frame(spark), P, EXEC, DAY).select("TaskID", "Attempts", "Status", "WatermarkType", "WatermarkValue")


@add("run_worker_row", f"select coalesce(case when coalesce(t.IsActive, false) and not coalesce(s.ForceSkip, false) then s.Status end, 'NULL') as Status, coalesce(s.ExecutionID, '{EXEC}') as ExecutionID, s.Attempts, s.TaskName from (select 1 as one) o left join (select * from {S} s where {HERE} and ExecutionID = '{EXEC}' and ProcessingDate = date '{DAY}' and TaskID = 1 and Status in ('NQUE', 'RQUE', 'FAIL')) s on true left {JOINS.format(active='')}")
def run_worker_row(spark, sf_dir):
    return R.worker_row(steps(spark, sf_dir), TASKS.frame(spark), PARAMETERS.frame(spark), P, EXEC, DAY, 1).select("Status", "ExecutionID", "Attempts", "TaskName")


@add("run_worker_none", f"select 'NULL' as Status, 'EX-NONE' as ExecutionID, null::int as Attempts")
def run_worker_none(spark, sf_dir):
    return R.worker_row(steps(spark, sf_dir), TASKS.frame(spark), PARAMETERS.frame(spark), P, "EX-NONE", DAY, 1).select("Status", "ExecutionID", "Attempts")


T = R.Task(EXEC, P, 1, 2, 1, DAY)
IS = f"(ExecutionID = '{EXEC}' and ProjectCode = 'P1' and ProcessLoad = 'DAILY' and TaskID = 1 and SequenceID = 2 and WorkFlowID = 1 and Attempts = 1)"
SHOW = ["ProcessingDate", "ProcessLoad", "TaskID", "Attempts", "Status", "ForceSkip", "StartTime", "EndTime", "DurationSeconds", "LogMessage"]


def shown(**to) -> str:
    return ", ".join(f"{to[c]} as {c}" if c in to else c for c in SHOW)


@add("run_start", f"select {shown(Status=f"case when {IS} and ProcessingDate = date '{DAY}' then 'RQUE' else Status end", StartTime=f"case when {IS} and ProcessingDate = date '{DAY}' then timestamp '{NOW}' else StartTime end")} from {S} s")
def run_start(spark, sf_dir):
    return R.start(steps(spark, sf_dir), TASKS.frame(spark), STAGES.frame(spark), T, 1, now=NOW).where("LastUpdatedBy = 'u'").select(SHOW)


@add("run_start_added", f"select TaskID, Attempts, Status, SequenceCode, StartTime from (select 1 as TaskID, 77 as Attempts, 'RQUE' as Status, 'LOAD_DB_TRAN' as SequenceCode, timestamp '{NOW}' as StartTime)")
def run_start_added(spark, sf_dir):
    return R.start(steps(spark, sf_dir), TASKS.frame(spark), STAGES.frame(spark), T, 77, now=NOW).where("Attempts = 77").select("TaskID", "Attempts", "Status", "SequenceCode", "StartTime")


FIRST = f"(ExecutionID = '{EXEC}' and ProjectCode = 'P1' and ProcessLoad = 'DAILY' and WorkFlowID = 0 and SequenceID = 0)"


@add("run_end_fail", f"select {shown(Status=f"case when {IS} then 'FAIL' when {FIRST} then 'NQUE' else Status end", EndTime=f"case when {IS} or {FIRST} then timestamp '{NOW}' else EndTime end", DurationSeconds=f"case when {IS} then (epoch(date_trunc('second', timestamp '{NOW}')) - epoch(date_trunc('second', StartTime)))::int else DurationSeconds end", LogMessage=f"case when {IS} then 'boom' else LogMessage end")} from {S} s")
def run_end_fail(spark, sf_dir):
    return R.end(steps(spark, sf_dir), T, 1, "FAIL", "boom", now=NOW).select(SHOW)


T0 = R.Task(EXEC, P, 0, 0, 0, DAY)
AT0 = f"(select StartTime from {S} s where ExecutionID = '{EXEC}' and TaskID = 0 and Attempts = 0 and ProcessingDate = date '{DAY}')"


@add("run_advance_on_done", f"select ProcessLoad, ParameterName, case when ProcessLoad = 'DAILY' and ParameterName = 'SRC0' and ParameterType = 'DELTA_DATE' and {AT0} is not null then {AT0} else ValueDateTime end as ValueDateTime from {PARAMETERS.sql} p")
def run_advance_on_done(spark, sf_dir):
    return R.advance_on_done(PARAMETERS.frame(spark), steps(spark, sf_dir), T0, 0, NOW).select("ProcessLoad", "ParameterName", "ValueDateTime")


@add("run_skip", f"select {shown(ForceSkip=f"case when {IS.replace(' and Attempts = 1', '')} and Status <> 'DONE' then true else ForceSkip end")} from {S} s")
def run_skip(spark, sf_dir):
    return R.skip(steps(spark, sf_dir), T, now=NOW).select(SHOW)


@add("run_reset_day", f"select {shown(Status=f"case when {HERE} and ProcessingDate = date '{DAY}' and Status = 'DONE' then 'RQUE' else Status end", ForceSkip=f"case when {HERE} and ProcessingDate = date '{DAY}' then false else ForceSkip end", LogMessage=f"case when {HERE} and ProcessingDate = date '{DAY}' and Status = 'DONE' then 'again' else LogMessage end")} from {S} s")
def run_reset_day(spark, sf_dir):
    return R.reset(steps(spark, sf_dir), P, DAY, remark="again", now=NOW).select(SHOW)


RUN = f"({HERE} and ProcessingDate = date '{DAY}' and ExecutionID = '{EXEC}' and Attempts <= 1)"


@add("run_reset_execution", f"select {shown(Status=f"case when {RUN} and Status = 'DONE' and (WorkFlowID = 1 or SequenceID = 0) then 'RQUE' else Status end", ForceSkip=f"case when {RUN} and WorkFlowID = 1 then false else ForceSkip end", LogMessage=f"case when {RUN} and Status = 'DONE' and (WorkFlowID = 1 or SequenceID = 0) then 'again' else LogMessage end")} from {S} s")
def run_reset_execution(spark, sf_dir):
    return R.reset(steps(spark, sf_dir), P, DAY, EXEC, 1, workflow_id=1, remark="again", now=NOW).select(SHOW)


PSHOW = ["ProcessLoad", "ParameterName", "ValueINT", "ValueDateTime", "ValueBIT"]


@add("run_mode_bulk", f"select ProcessLoad, ParameterName, case when ProcessLoad = 'DAILY' and ParameterType = 'DELTA_DATE' then -1 when ProcessLoad = 'DAILY' and ParameterType = 'DELTA_ID' then 0 else ValueINT end as ValueINT, case when ProcessLoad = 'DAILY' and ParameterType in ('DELTA_DATE', 'DELTA_ID') then null when ProcessLoad = 'DAILY' and ParameterName = 'SYSDT' then timestamp '2024-01-09 00:00:00' else ValueDateTime end as ValueDateTime, ValueBIT from {PARAMETERS.sql} p")
def run_mode_bulk(spark, sf_dir):
    return R.set_mode(PARAMETERS.frame(spark), P, "2024-01-09", bulk=True, now=NOW).select(PSHOW)


@add("run_mode_single", f"select ProcessLoad, ParameterName, case when ProcessLoad = 'DAILY' and ParameterName = 'SRC1' then 7 else ValueINT end as ValueINT, case when ProcessLoad = 'DAILY' and ParameterName = 'SYSDT' then null else ValueDateTime end as ValueDateTime, ValueBIT from {PARAMETERS.sql} p")
def run_mode_single(spark, sf_dir):
    return R.set_mode(PARAMETERS.frame(spark), P, name="SRC1", to_int=7, now=NOW).select(PSHOW)


@add("run_watermark_advance", f"select ProcessLoad, ParameterName, ValueINT, case when ProcessLoad = 'DAILY' and ParameterName = 'SRC2' then timestamp '2024-01-02 03:04:05' else ValueDateTime end as ValueDateTime, ValueBIT from {PARAMETERS.sql} p")
def run_watermark_advance(spark, sf_dir):
    return R.advance(PARAMETERS.frame(spark), P, "SRC2", "2024-01-02 03:04:05", now=NOW).select(PSHOW)


AV = "case ParameterType when 'DELTA_DATE' then strftime(ValueDateTime, '%Y-%m-%d %H:%M:%S') when 'DELTA_ID' then ValueINT::varchar when 'FLAG' then ValueBIT::varchar when 'SYSTEM' then strftime(ValueDateTime, '%Y-%m-%d %H:%M:%S') end as ActiveValue"


@add("run_active_watermark", f"select ParameterName, ParameterType, {AV} from {PARAMETERS.sql} p where ProcessLoad = 'DAILY' and ParameterName = 'SRC0'")
def run_active_watermark(spark, sf_dir):
    return R.active_watermark(PARAMETERS.frame(spark), P, "SRC0").select("ParameterName", "ParameterType", "ActiveValue")


def n(*status: str) -> str:
    return f"count(*) filter (Status in ({', '.join(map(repr, status))}))"


SECONDS = "trunc(epoch_us({1}) / 1000000.0 - epoch_us({0}) / 1000000.0)::bigint"
WALL = "((epoch_us(max(EndTime)) - epoch_us(min(StartTime))) // 1000000)"


@add("view_process_status", f"select ProcessingDate, s.ProjectCode, s.ProcessLoad, ProcessName, ProcessOwner, Attempts as LatestAttempt, count(distinct ExecutionID) as TotalRuns, {n('DONE')} as Done, {n('FAIL')} as Failed, {n('NQUE', 'RQUE')} as Pending, min(StartTime) as RunStart, max(EndTime) as RunEnd, {WALL} as WallClockSeconds, max(case when WorkFlowID = 0 and SequenceID = 0 then Status end) as OverallStatus from {S} s left join {PROCESSES.sql} p on s.ProjectCode = p.ProjectCode and s.ProcessLoad = p.ProcessLoad group by 1, 2, 3, 4, 5, 6")
def view_process_status(spark, sf_dir):
    return V.process_status(steps(spark, sf_dir), PROCESSES.frame(spark))


@add("view_run_summary", f"select ProcessingDate, ProjectCode, ProcessLoad, ExecutionID, Attempts, count(*) as TotalTasks, {n('DONE')} as Done, {n('FAIL')} as Failed, {n('NQUE', 'RQUE')} as Pending, min(StartTime) as RunStart, max(EndTime) as RunEnd, sum(DurationSeconds)::bigint as TotalDurationSeconds, {WALL} as WallClockSeconds, case when {n('NQUE', 'RQUE')} > 0 then 'RUNNING' when {n('FAIL')} > 0 then 'FAILED' else 'COMPLETE' end as OverallStatus, max(LastUpdatedOn) as LastActivity from {S} s group by 1, 2, 3, 4, 5")
def view_run_summary(spark, sf_dir):
    return V.run_summary(steps(spark, sf_dir))


@add("view_task_detail", f"select ExecutionID, TaskID, Attempts, Status, StartTime, SourceType from {S} s")
def view_task_detail(spark, sf_dir):
    return V.task_detail(steps(spark, sf_dir)).select("ExecutionID", "TaskID", "Attempts", "Status", "StartTime", "SourceType")


LATEST = f"Attempts = (select max(Attempts) from {S} y where y.ExecutionID = s.ExecutionID and y.ProjectCode = s.ProjectCode and y.ProcessLoad = s.ProcessLoad and y.WorkFlowID = s.WorkFlowID and y.TaskID = s.TaskID and y.SequenceID = s.SequenceID)"


@add("view_blockers", f"select ExecutionID, TaskID, Attempts, Status from {S} s where TaskMandatory and Status in ('FAIL', 'NQUE', 'RQUE') and {LATEST}")
def view_blockers(spark, sf_dir):
    return V.mandatory_blockers(steps(spark, sf_dir)).select("ExecutionID", "TaskID", "Attempts", "Status")


@add("view_failures", f"select ExecutionID, TaskID, Attempts, Status from {S} s where Status = 'FAIL' and {LATEST}")
def view_failures(spark, sf_dir):
    return V.current_failures(steps(spark, sf_dir)).select("ExecutionID", "TaskID", "Attempts", "Status")


@add("view_watermarks", f"""select p.ProjectCode, p.ProcessLoad, p.ParameterName, {AV}, case p.ParameterType when 'DELTA_DATE' then case when ValueDateTime is null then 'BULK MODE' else 'DELTA: ' || strftime(ValueDateTime, '%Y-%m-%d %H:%M:%S') end
 when 'DELTA_ID' then case when ValueINT is null or ValueINT in (-1, 0) then 'BULK MODE' else 'DELTA: ' || ValueINT::varchar end when 'FLAG' then ValueBIT::varchar when 'SYSTEM' then case when ValueDateTime is null then 'LIVE DATE' else 'HISTORIC: ' || strftime(ValueDateTime, '%Y-%m-%d %H:%M:%S') end else 'UNKNOWN' end as WatermarkState,
 t.TaskName as LinkedTaskName from {PARAMETERS.sql} p left join {TASKS.sql} t on coalesce(t.ProjectCode, '') = coalesce(p.ProjectCode, '') and coalesce(t.ProcessLoad, '') = coalesce(p.ProcessLoad, '') and coalesce(t.SourceSystemCode, '') = coalesce(p.ParameterName, '')""")
def view_watermarks(spark, sf_dir):
    return V.watermarks(PARAMETERS.frame(spark), TASKS.frame(spark)).select("ProjectCode", "ProcessLoad", "ParameterName", "ActiveValue", "WatermarkState", "LinkedTaskName")


@add("run_status_summary", f"select ProcessLoad, ProcessingDate, Attempts, min(StartTime) as StartTime, max(EndTime) as EndTime, ((epoch_us(max(coalesce(EndTime, timestamp '{NOW}'))) - epoch_us(min(StartTime))) // 1000000) as DurationSeconds, max(case when WorkFlowID = 0 and SequenceID = 0 then Status end) as OverallStatus, case when max(EndTime) is null then 'Some tasks are not yet complete; run may still be active.' end as Remark from {S} s where {HERE} group by 1, 2, 3")
def run_status_summary(spark, sf_dir):
    return V.status_summary(steps(spark, sf_dir), "P1", "DAILY", now=NOW).drop("ProjectCode")


@add("run_status_detail", f"select TaskID, Attempts, Status, TaskName from {S} s where {HERE} and ExecutionID = '{EXEC}' and ProcessingDate = date '{DAY}' and Attempts = (select max(Attempts) from {S} s where {HERE} and ExecutionID = '{EXEC}' and ProcessingDate = date '{DAY}')")
def run_status_detail(spark, sf_dir):
    return V.status_detail(steps(spark, sf_dir), "P1", "DAILY", DAY, EXEC).select("TaskID", "Attempts", "Status", "TaskName")


def changed_nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey + 10 as int) as n_nationkey", "case when n_nationkey % 2 = 0 then concat('NATION_', n_nationkey + 10) else concat('NEW_', n_nationkey) end as n_name", "n_regionkey")


NEW_NATIONS = "(select (n_nationkey + 10)::int as n_nationkey, case when n_nationkey % 2 = 0 then concat('NATION_', n_nationkey + 10) else concat('NEW_', n_nationkey) end as n_name, n_regionkey from nation)"


@add("upsert_insert_only", f"select n_nationkey, n_name, n_regionkey from nation union all select n_nationkey, n_name, n_regionkey from {NEW_NATIONS} x where n_nationkey not in (select n_nationkey from nation)")
def upsert_insert_only(spark, sf_dir):
    return U.insert_only(table(spark, sf_dir, "nation"), changed_nations(spark, sf_dir), ["n_nationkey"])


@add("upsert_changed", f"select coalesce(o.n_nationkey, x.n_nationkey) as n_nationkey, coalesce(x.n_name, o.n_name) as n_name, case when o.n_nationkey is null then x.n_regionkey else o.n_regionkey end as n_regionkey, case when o.n_nationkey is null then 'new' when x.n_name <> o.n_name then 'new' else 'old' end as by_whom from nation o full join {NEW_NATIONS} x on o.n_nationkey = x.n_nationkey")
def upsert_changed(spark, sf_dir):
    old = table(spark, sf_dir, "nation").withColumn("by_whom", F.lit("old"))
    return U.upsert(old, changed_nations(spark, sf_dir), ["n_nationkey"], ["n_name"], stamp={"by_whom": F.lit("new")})
