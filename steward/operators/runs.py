"""Run tracking: pure transforms of the step and parameter tables. Times and users are arguments, so results can be repeated."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
STEP_COLUMNS = "ProcessingDate date, ProjectCode string, ProcessLoad string, ExecutionID string, WorkFlowID int, TaskID int, SequenceID int, Attempts int, Status string, TaskName string, SequenceCode string, TaskMandatory boolean, SourceSystemCode string, FullFileName string, InFilePath string, OutFilePath string, ForceSkip boolean, StartTime timestamp, EndTime timestamp, DurationSeconds int, LogMessage string, LogType string, LogCode string, SourceType string, SourceRunID string, ClusterID string, LastUpdatedOn timestamp, LastUpdatedBy string"  # noqa: E501
OPEN = ("NQUE", "RQUE")
RUNNABLE = ("NQUE", "RQUE", "FAIL")


@dataclass(frozen=True)
class Process:
    project: str
    load: str

    def of(self, df: DataFrame) -> DataFrame:
        return df.where((F.col("ProjectCode") == self.project) & (F.col("ProcessLoad") == self.load))

    @property
    def here(self) -> Column:
        return (F.col("ProjectCode") == self.project) & (F.col("ProcessLoad") == self.load)


def day(value) -> Column:
    return F.lit(value).cast("date")


def moment(value) -> Column:
    return F.lit(value).cast("timestamp") if value is not None else F.current_timestamp()


def file_name(frequency: Column, mask: Column, extension: Column, date: Column) -> Column:
    """MASK_yyyyMMdd.EXT for daily, yyyyMM for monthly, yyyy for yearly files; null for others and without a mask."""
    stamp = F.when(frequency == "D", F.date_format(date, "yyyyMMdd")).when(frequency == "M", F.date_format(date, "yyyyMM")).when(frequency == "Y", F.date_format(date, "yyyy"))
    return F.when(F.coalesce(mask, F.lit("")) != "", F.concat(mask, F.lit("_"), stamp, F.coalesce(extension, F.lit(""))))


def next_attempt(steps: DataFrame, p: Process, date) -> DataFrame:
    """One row: Attempts for the next run of the day (0 for the first)."""
    return p.of(steps).where(F.col("ProcessingDate") == day(date)).agg((F.coalesce(F.max("Attempts"), F.lit(-1)) + 1).cast("int").alias("Attempts"))


def generate_steps(steps: DataFrame, tasks: DataFrame, stages: DataFrame, p: Process, execution_id: str, date, now=None, user: str = "system") -> DataFrame:
    """New rows for the active tasks that aren't done for the period that their frequency means.

    Daily and other frequencies: done on the same day in an earlier attempt; monthly: any time in the month; yearly: in the
    year; without a frequency a task is never taken as done. An anti-join on the task's key with the period as residual.
    """
    d = day(date)
    t = p.of(tasks).where("IsActive").crossJoin(F.broadcast(next_attempt(steps, p, date))).alias("t")  # one row: the attempt
    done = p.of(steps).where("Status = 'DONE'").alias("e")
    same_day = (F.col("e.ProcessingDate") == d) & (F.col("e.Attempts") < F.col("t.Attempts"))
    frequency = F.col("t.LoadFrequency")
    covered = (
        ((frequency == "D") & same_day)
        | ((frequency == "M") & (F.date_format("e.ProcessingDate", "yyyy-MM") == F.date_format(d, "yyyy-MM")))
        | ((frequency == "Y") & (F.year("e.ProcessingDate") == F.year(d)))
        | (~frequency.isin("D", "M", "Y") & same_day)
    )
    keys = [F.col(f"e.{k}") == F.col(f"t.{k}") for k in ("WorkFlowID", "TaskID", "SequenceID")]
    left = t.join(done, keys[0] & keys[1] & keys[2] & covered, "left_anti")
    left = left.join(stages.select(F.col("SequenceID").alias("_stage"), "SequenceCode"), F.col("t.SequenceID") == F.col("_stage"), "left")
    rows = left.select(
        d.alias("ProcessingDate"), "ProjectCode", "ProcessLoad", F.lit(execution_id).alias("ExecutionID"), "WorkFlowID", "TaskID", "SequenceID", "Attempts",
        F.lit("NQUE").alias("Status"), "TaskName", "SequenceCode", "TaskMandatory", "SourceSystemCode",
        file_name(frequency, F.col("FileNameMask"), F.col("FileExtension"), d).alias("FullFileName"),
        F.nullif("InFilePath", F.lit("")).alias("InFilePath"), F.nullif("OutFilePath", F.lit("")).alias("OutFilePath"),
        F.lit(False).alias("ForceSkip"), moment(now).alias("StartTime"), moment(now).alias("LastUpdatedOn"), F.lit(user).alias("LastUpdatedBy"),
    )
    return steps.limit(0).unionByName(rows, allowMissingColumns=True)


def watermark_text(with_system: bool = False) -> Column:
    """A parameter's value as text, by its type."""
    out = F.when(F.col("ParameterType") == "DELTA_DATE", F.col("ValueDateTime").cast("string")).when(F.col("ParameterType") == "DELTA_ID", F.col("ValueINT").cast("string")).when(F.col("ParameterType") == "FLAG", F.col("ValueBIT").cast("string"))
    return out.when(F.col("ParameterType") == "SYSTEM", F.col("ValueDateTime").cast("string")) if with_system else out


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _task_join() -> Column:
    out = F.col("t.TaskID") == F.col("s.TaskID")
    for k in ("WorkFlowID", "SequenceID"):
        out = out & (F.col(f"t.{k}") == F.col(f"s.{k}"))
    for k in ("ProjectCode", "ProcessLoad"):
        out = out & (_blank(f"t.{k}") == _blank(f"s.{k}"))
    return out


def _parameter_join(other: str = "s") -> Column:
    return (_blank("p.ProjectCode") == _blank(f"{other}.ProjectCode")) & (_blank("p.ProcessLoad") == _blank(f"{other}.ProcessLoad")) & (_blank("p.ParameterName") == _blank(f"{other}.SourceSystemCode"))


STEP_INFO = ["WorkFlowID", "SequenceID", "TaskID", "TaskName", "SequenceCode", "TaskMandatory", "SourceSystemCode", "SourceType", "Attempts", "StartTime", "ForceSkip", "FullFileName", "InFilePath", "OutFilePath"]


def pending(steps: DataFrame, tasks: DataFrame, parameters: DataFrame, p: Process, execution_id: str, date, sequence_id: int | None = None, workflow_id: int | None = None) -> DataFrame:
    """Steps of an execution that are neither done nor skipped and whose task is active, in running order."""
    s = p.of(steps).where((F.col("ExecutionID") == execution_id) & (F.col("ProcessingDate") == day(date)) & (F.col("Status") != "DONE") & ~F.coalesce("ForceSkip", F.lit(False)))
    s = _scoped(s, workflow_id, sequence_id)
    out = s.alias("s").join(tasks.where("IsActive").alias("t"), _task_join()).join(parameters.alias("p"), _parameter_join(), "left")
    return out.select("s.Status", "s.ExecutionID", "s.ProjectCode", "s.ProcessLoad", *(f"s.{c}" for c in STEP_INFO), F.col("p.ParameterType").alias("WatermarkType"), watermark_text().alias("WatermarkValue")).orderBy("WorkFlowID", "SequenceID", "TaskID")


def worker_row(steps: DataFrame, tasks: DataFrame, parameters: DataFrame, p: Process, execution_id: str, date, task_id: int, sequence_id: int | None = None, workflow_id: int | None = None) -> DataFrame:
    """The step that a worker may run, as one row at least: Status is the text 'NULL' if there is none or it is skipped."""
    s = p.of(steps).where((F.col("ExecutionID") == execution_id) & (F.col("ProcessingDate") == day(date)) & (F.col("TaskID") == task_id) & F.col("Status").isin(*RUNNABLE))
    s = _scoped(s, workflow_id, sequence_id)
    one = steps.sparkSession.range(1).alias("one")
    out = one.join(s.alias("s"), F.lit(True), "left").join(tasks.alias("t"), _task_join(), "left").join(parameters.alias("p"), _parameter_join(), "left")
    runs = F.coalesce("t.IsActive", F.lit(False)) & ~F.coalesce("s.ForceSkip", F.lit(False))
    return out.select(
        F.coalesce(F.when(runs, F.col("s.Status")), F.lit("NULL")).alias("Status"), F.coalesce("s.ExecutionID", F.lit(execution_id)).alias("ExecutionID"),
        F.coalesce("s.ProjectCode", F.lit(p.project)).alias("ProjectCode"), F.coalesce("s.ProcessLoad", F.lit(p.load)).alias("ProcessLoad"),
        *(f"s.{c}" for c in STEP_INFO), F.col("p.ParameterType").alias("WatermarkType"), watermark_text().alias("WatermarkValue"),
    )


def _scoped(df: DataFrame, workflow_id=None, sequence_id=None, task_id=None) -> DataFrame:
    for c, v in (("WorkFlowID", workflow_id), ("SequenceID", sequence_id), ("TaskID", task_id)):
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


@dataclass(frozen=True)
class Task:
    """Which step: an execution's task."""

    execution: str
    process: Process
    task_id: int
    sequence_id: int
    workflow_id: int
    date: str

    @property
    def step(self) -> Column:
        return (F.col("ExecutionID") == self.execution) & self.process.here & (F.col("WorkFlowID") == self.workflow_id) & (F.col("SequenceID") == self.sequence_id) & (F.col("TaskID") == self.task_id)

    @property
    def today(self) -> Column:
        return self.step & (F.col("ProcessingDate") == day(self.date))


def changed(df: DataFrame, where: Column, **to) -> DataFrame:
    """df with columns set where a condition holds (null counts as no)."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in to.items()})


def start(steps: DataFrame, tasks: DataFrame, stages: DataFrame, t: Task, attempts: int, source_type: str = "NOTEBOOK", run_id: str | None = None, cluster_id: str | None = None, now=None, user: str = "system") -> DataFrame:
    """The step set running (RQUE after the first attempt, else NQUE) from now on; added if the execution lacks it."""
    status = "RQUE" if attempts > 0 else "NQUE"
    hit = t.today & (F.col("Attempts") == attempts)
    at = moment(now)
    updated = changed(steps, hit, Status=status, SourceType=source_type, SourceRunID=F.lit(run_id).cast("string"), ClusterID=F.lit(cluster_id).cast("string"), StartTime=at, LastUpdatedOn=at)
    task = t.process.of(tasks).where((F.col("TaskID") == t.task_id) & (F.col("WorkFlowID") == t.workflow_id))
    fresh = task.join(steps.where(hit).limit(1).select(F.lit(1).alias("_there")), F.lit(True), "left_anti").join(stages.select(F.col("SequenceID").alias("_stage"), "SequenceCode"), F.col("SequenceID") == F.col("_stage"), "left")
    row = fresh.select(
        day(t.date).alias("ProcessingDate"), "ProjectCode", "ProcessLoad", F.lit(t.execution).alias("ExecutionID"), F.lit(t.workflow_id).alias("WorkFlowID"), F.lit(t.task_id).alias("TaskID"), F.lit(t.sequence_id).alias("SequenceID"),
        F.lit(attempts).alias("Attempts"), F.lit(status).alias("Status"), "TaskName", "SequenceCode", "TaskMandatory", "SourceSystemCode", F.lit(source_type).alias("SourceType"),
        F.lit(run_id).cast("string").alias("SourceRunID"), F.lit(cluster_id).cast("string").alias("ClusterID"), at.alias("StartTime"), at.alias("LastUpdatedOn"), F.lit(user).alias("LastUpdatedBy"),
    )
    return updated.unionByName(row, allowMissingColumns=True)


def queued_attempt(steps: DataFrame, t: Task) -> int:
    """Attempts of the step's row that waits (NQUE or RQUE; the last of several), else 0."""
    return steps.where(t.today & F.col("Status").isin("NQUE", "RQUE")).agg(F.coalesce(F.max("Attempts"), F.lit(0))).first()[0]


def running_attempt(steps: DataFrame, t: Task) -> int:
    """Attempts of the step's RQUE row, else 0."""
    row = steps.where(t.today & (F.col("Status") == "RQUE")).select("Attempts").limit(1).collect()
    return row[0][0] if row else 0


def end(steps: DataFrame, t: Task, attempts: int | None = None, status: str = "DONE", message: str | None = None, kind: str | None = None, code: str | None = None, now=None) -> DataFrame:
    """The step closed with its duration. A failure sets the execution's initiation step (workflow 0, stage 0) back to NQUE."""
    if attempts is None:
        attempts = running_attempt(steps, t)
    at, text = moment(now), lambda x: F.lit(x).cast("string")
    hit = t.step & (F.col("Attempts") == attempts)
    out = changed(steps, hit, Status=status, EndTime=at, DurationSeconds=F.unix_timestamp(at) - F.unix_timestamp("StartTime"), LogMessage=text(message), LogType=text(kind), LogCode=text(code), LastUpdatedOn=at)
    if status == "FAIL":
        first = (F.col("ExecutionID") == t.execution) & t.process.here & (F.col("WorkFlowID") == 0) & (F.col("SequenceID") == 0)
        out = changed(out, first, Status="NQUE", EndTime=at, LastUpdatedOn=at)
    return out


def advance_on_done(parameters: DataFrame, steps: DataFrame, t: Task, attempts: int, now=None, user: str = "system") -> DataFrame:
    """DELTA_DATE parameters named like the step's source set to its start time. The step is one row, joined as such."""
    s = steps.where(t.today & (F.col("Attempts") == attempts)).select(F.col("SourceSystemCode").alias("_source"), F.col("StartTime").alias("_start")).limit(1)
    hit = t.process.here & (F.col("ParameterType") == "DELTA_DATE") & F.col("_source").isNotNull()
    out = parameters.join(F.broadcast(s), F.col("ParameterName") == F.col("_source"), "left")
    return changed(out, hit, ValueDateTime=F.col("_start"), LastUpdatedOn=moment(now), LastUpdatedBy=user).drop("_source", "_start")


def skip(steps: DataFrame, t: Task, on: bool = True, now=None) -> DataFrame:
    """A step that isn't done marked to be skipped, or no longer."""
    return changed(steps, t.today & (F.col("Status") != "DONE"), ForceSkip=on, LastUpdatedOn=moment(now))


def advance(parameters: DataFrame, p: Process, name: str, to_time=None, to_int: int | None = None, now=None, user: str = "system") -> DataFrame:
    """A watermark moved by hand."""
    to: dict = {"LastUpdatedOn": moment(now), "LastUpdatedBy": user}
    if to_time is not None:
        to["ValueDateTime"] = moment(to_time)
    if to_int is not None:
        to["ValueINT"] = to_int
    return changed(parameters, p.here & (F.col("ParameterName") == name), **to)


def active_watermark(parameters: DataFrame, p: Process, name: str) -> DataFrame:
    return p.of(parameters).where(F.col("ParameterName") == name).select("ParameterName", "ParameterType", "ValueINT", "ValueDateTime", "ValueBIT", watermark_text(True).alias("ActiveValue"))


def reset(steps: DataFrame, p: Process, date, execution_id: str | None = None, attempts: int | None = None, workflow_id: int | None = None, sequence_id: int | None = None, task_id: int | None = None, remark: str | None = None, now=None) -> DataFrame:
    """Done steps set to run again. Without an execution and attempts: the whole day; else up to an attempt (the execution's latest by default), the initiation step included."""
    at, today = moment(now), p.here & (F.col("ProcessingDate") == day(date))
    text = F.lit(remark).cast("string")
    if execution_id is None and attempts is None:
        out = changed(steps, today & (F.col("Status") == "DONE"), Status="RQUE", ForceSkip=False, LogMessage=text, LastUpdatedOn=at)
        return changed(out, today & F.col("ForceSkip"), ForceSkip=False, LastUpdatedOn=at)
    run = today & (F.col("ExecutionID") == execution_id) if execution_id else today
    if attempts is None:
        attempts = steps.where(run).agg(F.max("Attempts")).first()[0] or 0
    run = run & (F.col("Attempts") <= attempts)
    scope = run
    for c, v in (("WorkFlowID", workflow_id), ("SequenceID", sequence_id), ("TaskID", task_id)):
        if v is not None:
            scope = scope & (F.col(c) == v)
    out = changed(steps, scope & (F.col("Status") == "DONE"), Status="RQUE", ForceSkip=False, LogMessage=text, LastUpdatedOn=at)
    out = changed(out, scope & F.col("ForceSkip"), ForceSkip=False, LastUpdatedOn=at)
    return changed(out, run & (F.col("Status") == "DONE") & (F.col("WorkFlowID") == 0) & (F.col("SequenceID") == 0), Status="RQUE", LogMessage=text, LastUpdatedOn=at)


def set_mode(parameters: DataFrame, p: Process, historic_date=None, bulk: bool = False, name: str | None = None, to_time=None, to_int=None, to_bit=None, now=None, user: str = "system") -> DataFrame:
    """Historic (SYSDT set) or live (cleared); bulk: date watermarks null and -1, id watermarks null and 0; or one parameter set."""
    by = {"LastUpdatedOn": moment(now), "LastUpdatedBy": user}
    system = (F.col("ProjectCode") == p.project) & (_blank("ProcessLoad") == (p.load or "")) & (F.col("ParameterName") == "SYSDT") & (F.col("ParameterType") == "SYSTEM")
    out = changed(parameters, system, ValueDateTime=F.lit(historic_date).cast("timestamp"), **by)
    if bulk:
        none = F.lit(None).cast("timestamp")
        out = changed(out, p.here & (F.col("ParameterType") == "DELTA_DATE"), ValueINT=-1, ValueDateTime=none, **by)
        return changed(out, p.here & (F.col("ParameterType") == "DELTA_ID"), ValueINT=0, ValueDateTime=none, **by)
    if name:
        to = dict(by)
        if to_time is not None:
            to["ValueDateTime"] = moment(to_time)
        if to_int is not None:
            to["ValueINT"] = to_int
        if to_bit is not None:
            to["ValueBIT"] = to_bit
        out = changed(out, p.here & (F.col("ParameterName") == name), **to)
    return out


MESSAGE_LIMIT = 2000


@contextmanager
def task(load: Callable[[], DataFrame], save: Callable[[DataFrame], None], begin: Callable[[DataFrame], DataFrame], t: Task, attempts: int | None = None, runs: bool = True) -> Iterator[bool]:
    """Run a body between start and end; an exception closes the step as FAIL and goes on. Yields whether the body is to run.

    load and save read and write the step table's snapshot; begin starts the step. runs: what worker_row says of the step.
    """
    if not runs:
        log.info("task %s is not to run", t.task_id)
        yield False
        return
    save(begin(load()))
    try:
        yield True
    except Exception as e:
        save(end(load(), t, attempts, "FAIL", f"{type(e).__name__}: {e}"[:MESSAGE_LIMIT], "ERROR", type(e).__name__))
        raise
    save(end(load(), t, attempts))
