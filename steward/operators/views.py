"""Run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import _blank, day, moment, watermark_text


def _seconds(a, b) -> Column:
    return F.timestamp_diff("SECOND", a, b)


def _count(*status: str) -> Column:
    return F.sum(F.when(F.col("Status").isin(*status), 1).otherwise(0))


def process_status(steps: DataFrame, processes: DataFrame) -> DataFrame:
    """One row per day, process and attempt."""
    p = processes.select("ProjectCode", "ProcessLoad", "ProcessName", "ProcessOwner")
    first = (F.col("WorkFlowID") == 0) & (F.col("SequenceID") == 0)
    return steps.join(p, ["ProjectCode", "ProcessLoad"], "left").groupBy("ProcessingDate", "ProjectCode", "ProcessLoad", "ProcessName", "ProcessOwner", F.col("Attempts").alias("LatestAttempt")).agg(
        F.countDistinct("ExecutionID").alias("TotalRuns"), _count("DONE").alias("Done"), _count("FAIL").alias("Failed"), _count("NQUE", "RQUE").alias("Pending"),
        F.min("StartTime").alias("RunStart"), F.max("EndTime").alias("RunEnd"), _seconds(F.min("StartTime"), F.max("EndTime")).alias("WallClockSeconds"), F.max(F.when(first, F.col("Status"))).alias("OverallStatus"),
    )


def run_summary(steps: DataFrame) -> DataFrame:
    """One row per execution and attempt: RUNNING before FAILED before COMPLETE."""
    return steps.groupBy("ProcessingDate", "ProjectCode", "ProcessLoad", "ExecutionID", "Attempts").agg(
        F.count("*").alias("TotalTasks"), _count("DONE").alias("Done"), _count("FAIL").alias("Failed"), _count("NQUE", "RQUE").alias("Pending"),
        F.min("StartTime").alias("RunStart"), F.max("EndTime").alias("RunEnd"), F.sum("DurationSeconds").alias("TotalDurationSeconds"), _seconds(F.min("StartTime"), F.max("EndTime")).alias("WallClockSeconds"),
        F.when(_count("NQUE", "RQUE") > 0, "RUNNING").when(_count("FAIL") > 0, "FAILED").otherwise("COMPLETE").alias("OverallStatus"), F.max("LastUpdatedOn").alias("LastActivity"),
    )


def task_detail(steps: DataFrame) -> DataFrame:
    return steps.select("ProcessingDate", "ProjectCode", "ProcessLoad", "ExecutionID", "Attempts", "WorkFlowID", "SequenceCode", "SequenceID", "TaskName", "TaskID", "TaskMandatory", "SourceSystemCode", "FullFileName", "InFilePath", "OutFilePath", "Status", "StartTime", "EndTime", "DurationSeconds", "SourceType", "SourceRunID", "LogType", "LogMessage", "LastUpdatedBy")


def latest(steps: DataFrame) -> DataFrame:
    """Each step's rows of its latest attempt, by one window instead of a correlated query."""
    key = Window.partitionBy("ExecutionID", "ProjectCode", "ProcessLoad", "WorkFlowID", "TaskID", "SequenceID")
    return steps.withColumn("_latest", F.max("Attempts").over(key)).where("Attempts = _latest").drop("_latest")


def mandatory_blockers(steps: DataFrame) -> DataFrame:
    return latest(steps).where(F.col("TaskMandatory") & F.col("Status").isin("FAIL", "NQUE", "RQUE")).select("ProcessingDate", "ProjectCode", "ProcessLoad", "ExecutionID", "WorkFlowID", "SequenceID", "SequenceCode", "TaskID", "TaskName", "Attempts", "Status", "StartTime", "LogType", "LogMessage", "SourceType", "SourceSystemCode")


def current_failures(steps: DataFrame) -> DataFrame:
    return latest(steps).where("Status = 'FAIL'").select("ProcessingDate", "ProjectCode", "ProcessLoad", "ExecutionID", "WorkFlowID", "SequenceID", "SequenceCode", "TaskID", "TaskName", "TaskMandatory", "Attempts", "Status", "StartTime", "LogType", "LogMessage", "SourceType", "SourceRunID")


def watermarks(parameters: DataFrame, tasks: DataFrame) -> DataFrame:
    """Parameters with their active value and state; a row for each task that loads the parameter's source."""
    kind, when, number = F.col("ParameterType"), F.col("ValueDateTime"), F.col("ValueINT")
    state = (
        F.when(kind == "DELTA_DATE", F.when(when.isNull(), "BULK MODE").otherwise(F.concat(F.lit("DELTA: "), when.cast("string"))))
        .when(kind == "DELTA_ID", F.when(number.isin(-1, 0) | number.isNull(), "BULK MODE").otherwise(F.concat(F.lit("DELTA: "), number.cast("string"))))
        .when(kind == "FLAG", F.col("ValueBIT").cast("string"))
        .when(kind == "SYSTEM", F.when(when.isNull(), "LIVE DATE").otherwise(F.concat(F.lit("HISTORIC: "), when.cast("string"))))
        .otherwise("UNKNOWN")
    )
    on = (_blank("t.ProjectCode") == _blank("p.ProjectCode")) & (_blank("t.ProcessLoad") == _blank("p.ProcessLoad")) & (_blank("t.SourceSystemCode") == _blank("p.ParameterName"))
    out = parameters.alias("p").join(tasks.alias("t"), on, "left")
    return out.select("p.ProjectCode", "p.ProcessLoad", "ParameterName", "ParameterType", "ParameterDescription", "ValueINT", "ValueDateTime", "ValueBIT", watermark_text(True).alias("ActiveValue"), state.alias("WatermarkState"), F.col("t.TaskName").alias("LinkedTaskName"), "p.LastUpdatedOn", "p.LastUpdatedBy")


def status_summary(steps: DataFrame, project: str, load: str, date=None, now=None) -> DataFrame:
    """Per day and attempt: times, duration up to now while a step is open, the initiation step's status, and a remark."""
    s = steps.where((F.col("ProjectCode") == project) & (F.col("ProcessLoad") == load))
    if date is not None:
        s = s.where(F.col("ProcessingDate") == day(date))
    first = (F.col("WorkFlowID") == 0) & (F.col("SequenceID") == 0)
    return s.groupBy("ProjectCode", "ProcessLoad", "ProcessingDate", "Attempts").agg(
        F.min("StartTime").alias("StartTime"), F.max("EndTime").alias("EndTime"), _seconds(F.min("StartTime"), F.max(F.coalesce("EndTime", moment(now)))).alias("DurationSeconds"),
        F.max(F.when(first, F.col("Status"))).alias("OverallStatus"), F.when(F.max("EndTime").isNull(), "Some tasks are not yet complete; run may still be active.").alias("Remark"),
    ).orderBy(F.desc("ProcessingDate"), F.desc("Attempts"))


def status_detail(steps: DataFrame, project: str, load: str, date, execution_id: str | None = None, attempts: int | None = None, workflow_id: int | None = None, sequence_id: int | None = None, task_id: int | None = None) -> DataFrame:
    """Steps of a day; of an execution's latest attempt unless another is named."""
    s = steps.where((F.col("ProjectCode") == project) & (F.col("ProcessLoad") == load) & (F.col("ProcessingDate") == day(date)))
    if execution_id:
        s = s.where(F.col("ExecutionID") == execution_id)
        if attempts is None:
            s = s.withColumn("_latest", F.max("Attempts").over(Window.partitionBy("ExecutionID"))).where("Attempts = _latest").drop("_latest")
    for c, v in (("Attempts", attempts), ("WorkFlowID", workflow_id), ("SequenceID", sequence_id), ("TaskID", task_id)):
        if v is not None:
            s = s.where(F.col(c) == v)
    return s.select("ProcessingDate", "ProjectCode", "ProcessLoad", "ExecutionID", "Attempts", "TaskName", "Status", "WorkFlowID", "SequenceID", "TaskID", "TaskMandatory", "SourceSystemCode", "SourceType", "StartTime", "EndTime", "DurationSeconds", "LogMessage", "LogType", "LogCode", "LastUpdatedOn").orderBy("WorkFlowID", "SequenceID", "TaskID", "Attempts")
