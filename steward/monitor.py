"""The run store as an object: register processes and tasks, run them, report."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import runs as R
from .operators import views as V
from .operators.upsert import upsert
from .sources.store import Store

TABLES = ["ETLOrganisation", "ETLconfigProject", "ETLconfigSequence", "ETLconfigProcess", "ETLconfigTasks", "ETLconfigParameters", "ETLProcessingSteps", "ETLsysLogs"]
STEPS, TASKS, PARAMETERS, STAGES = "ETLProcessingSteps", "ETLconfigTasks", "ETLconfigParameters", "ETLconfigSequence"
#: Ids below this are kept for seeded stages.
FIRST_OWN_STAGE = 10


class RunMonitor:
    """Never schedules anything. clock gives the time of what is written, as text; by default Spark's own."""

    def __init__(self, spark: SparkSession, root: str, user: str = "system", clock: Callable[[], str | None] = lambda: None):
        self.spark, self.store, self.user, self.clock = spark, Store(spark, root), user, clock

    def setup(self) -> None:
        self.store.create_all(TABLES)
        self.store.seed("2000-01-01 00:00:00", self.user)

    # registry ------------------------------------------------------------------------------------------------------

    def _put(self, table: str, keys: list[str], row: dict, update: list[str] | None = None) -> None:
        schema = self.store.read(table).schema
        now, update = R.moment(self.clock()), update if update is not None else [c for c in row if c not in keys]
        values = {"IsActive": True, **row}
        new = self.spark.createDataFrame([tuple(values.get(f.name) for f in schema.fields)], schema).withColumns({"CreatedBy": F.lit(self.user), "CreatedOn": now, "LastUpdatedBy": F.lit(self.user), "LastUpdatedOn": now})
        self.store.update(table, lambda old: upsert(old, new, keys, update, stamp={"LastUpdatedBy": F.lit(self.user), "LastUpdatedOn": now}))

    def register_organisation(self, code: str, name: str, description: str | None = None) -> None:
        self._put("ETLOrganisation", ["OrganisationCode"], {"OrganisationCode": code, "OrganisationName": name, "OrganisationDescription": description})

    def register_project(self, code: str, name: str, description: str | None = None, organisation_code: str | None = None) -> None:
        self._put("ETLconfigProject", ["ProjectCode"], {"ProjectCode": code, "ProjectName": name, "ProjectDescription": description, "OrganisationCode": organisation_code})

    def register_process(self, project: str, load: str, name: str | None = None, description: str | None = None, owner: str | None = None, load_frequency: str | None = None) -> None:
        self._put("ETLconfigProcess", ["ProjectCode", "ProcessLoad"], {"ProjectCode": project, "ProcessLoad": load, "ProcessName": name, "ProcessDescription": description, "ProcessOwner": owner, "LoadFrequency": load_frequency})

    def register_stage(self, stage_id: int, code: str, name: str, description: str | None = None, sort_order: int | None = None) -> None:
        if stage_id < FIRST_OWN_STAGE:
            raise ValueError(f"ids below {FIRST_OWN_STAGE} are kept for seeded stages")
        self._put(STAGES, ["SequenceID"], {"SequenceID": stage_id, "SequenceCode": code, "SequenceName": name, "SequenceDescription": description, "SortOrder": sort_order})

    def register_task(self, project: str, load: str, task_id: int, workflow_id: int, sequence_id: int, task_name: str, **more) -> None:
        """more: further columns of the task table (LoadFrequency, TaskMandatory, SourceSystemCode, FileNameMask, ...)."""
        row = {"ProjectCode": project, "ProcessLoad": load, "TaskID": task_id, "WorkFlowID": workflow_id, "SequenceID": sequence_id, "TaskName": task_name, **more}
        unknown = set(row) - set(self.store.schema(TASKS).names)
        if unknown:
            raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
        self._put(TASKS, ["ProjectCode", "ProcessLoad", "TaskID", "WorkFlowID", "SequenceID"], row)

    def register_parameter(self, project: str, load: str, name: str, kind: str, description: str | None = None, value_datetime=None, value_int: int | None = None, value_bit: bool | None = None) -> None:
        """Added with its value; of one that is there only the description changes, so watermarks survive."""
        if kind not in ("DELTA_DATE", "DELTA_ID", "FLAG", "SYSTEM"):
            raise ValueError(f"unknown parameter type {kind}")
        self._put(PARAMETERS, ["ProjectCode", "ProcessLoad", "ParameterName"], {"ProjectCode": project, "ProcessLoad": load, "ParameterName": name, "ParameterType": kind, "ParameterDescription": description, "ValueDateTime": value_datetime, "ValueINT": value_int, "ValueBIT": value_bit}, ["ParameterDescription"])

    # runs ----------------------------------------------------------------------------------------------------------

    def processing_date(self, p: R.Process) -> str:
        """The SYSDT parameter's date if it is set (historic mode), else today."""
        row = p.of(self.store.read(PARAMETERS)).where("ParameterName = 'SYSDT' and ParameterType = 'SYSTEM'").select(F.coalesce(F.to_date("ValueDateTime"), F.to_date(R.moment(self.clock()))).cast("string")).first()
        return row[0] if row else self.spark.range(1).select(F.to_date(R.moment(self.clock())).cast("string")).first()[0]

    def _steps(self, change: Callable[[DataFrame], DataFrame]) -> None:
        self.store.update(STEPS, change)

    def generate_execution_steps(self, execution_id: str, project: str, load: str, date: str | None = None) -> None:
        """New steps for an execution that has none yet."""
        p = R.Process(project, load)

        def fresh(steps: DataFrame) -> DataFrame | None:
            if not steps.where(F.col("ExecutionID") == execution_id).isEmpty():
                return None
            return steps.unionByName(R.generate_steps(steps, self.store.read(TASKS), self.store.read(STAGES), p, execution_id, date or self.processing_date(p), self.clock(), self.user))

        self._steps(fresh)

    def get_pending_tasks(self, execution_id: str, project: str, load: str, date: str | None = None, sequence_id: int | None = None, workflow_id: int | None = None, task_id: int | None = None) -> DataFrame:
        """Steps to run; with a task the one row for its worker. Steps are made first if the execution has none."""
        p = R.Process(project, load)
        date = date or self.processing_date(p)
        self.generate_execution_steps(execution_id, project, load, date)
        tables = self.store.read(STEPS), self.store.read(TASKS), self.store.read(PARAMETERS)
        if task_id is not None:
            return R.worker_row(*tables, p, execution_id, date, task_id, sequence_id, workflow_id)
        return R.pending(*tables, p, execution_id, date, sequence_id, workflow_id)

    def task_of(self, execution_id: str, project: str, load: str, task_id: int, sequence_id: int, workflow_id: int, date: str | None = None) -> R.Task:
        p = R.Process(project, load)
        return R.Task(execution_id, p, task_id, sequence_id, workflow_id, date or self.processing_date(p))

    def start_task(self, t: R.Task, attempts: int | None = None, source_type: str = "NOTEBOOK", run_id: str | None = None, cluster_id: str | None = None, timestamp: str | None = None) -> int:
        """Set the step running; by default the attempt that waits (NQUE or RQUE), else 0."""
        attempts = R.queued_attempt(self.store.read(STEPS), t) if attempts is None else attempts
        self._steps(lambda s: R.start(s, self.store.read(TASKS), self.store.read(STAGES), t, attempts, source_type, run_id, cluster_id, timestamp or self.clock(), self.user))
        return attempts

    def end_task(self, t: R.Task, attempts: int | None = None, status: str = "DONE", message: str | None = None, log_type: str | None = None, log_code: str | None = None, timestamp: str | None = None) -> None:
        """Close the step, then move its watermark: what stops between the two leaves a window that is loaded again, not one left out."""
        attempts = R.running_attempt(self.store.read(STEPS), t) if attempts is None else attempts
        self._steps(lambda steps: R.end(steps, t, attempts, status, message, log_type, log_code, timestamp or self.clock()))
        if status == "DONE":
            steps = self.store.read(STEPS)
            self.store.update(PARAMETERS, lambda parameters: R.advance_on_done(parameters, steps, t, attempts, self.clock(), self.user))

    def fail_task(self, t: R.Task, attempts: int | None = None, message: str = "", log_code: str | None = None, timestamp: str | None = None) -> None:
        self.end_task(t, attempts, "FAIL", message[: R.MESSAGE_LIMIT], "ERROR", log_code, timestamp)

    def task_status(self, t: R.Task) -> str:
        """The status its worker sees: 'NULL' if it isn't to run."""
        return self.get_pending_tasks(t.execution, t.process.project, t.process.load, t.date, t.sequence_id, t.workflow_id, t.task_id).first()["Status"]

    @contextmanager
    def task(self, t: R.Task, source_type: str = "NOTEBOOK") -> Iterator[bool]:
        """Start, run the body, end; an exception ends the step as FAIL and goes on. Yields whether the body is to run."""
        if self.task_status(t) == "NULL":
            yield False
            return
        attempts = self.start_task(t, source_type=source_type)
        try:
            yield True
        except Exception as e:
            self.fail_task(t, attempts, f"{type(e).__name__}: {e}", type(e).__name__)
            raise
        self.end_task(t, attempts)

    def skip_task(self, t: R.Task) -> None:
        self._steps(lambda s: R.skip(s, t, True, self.clock()))

    def unskip_task(self, t: R.Task) -> None:
        self._steps(lambda s: R.skip(s, t, False, self.clock()))

    def status_reset(self, project: str, load: str, date: str, **scope) -> None:
        self._steps(lambda s: R.reset(s, R.Process(project, load), date, now=self.clock(), **scope))

    def advance_watermark(self, project: str, load: str, name: str, to_time=None, to_int: int | None = None) -> None:
        self.store.update(PARAMETERS, lambda old: R.advance(old, R.Process(project, load), name, to_time, to_int, self.clock(), self.user))

    def get_active_watermark(self, project: str, load: str, name: str) -> DataFrame:
        return R.active_watermark(self.store.read(PARAMETERS), R.Process(project, load), name)

    def set_processing_mode(self, project: str, load: str, **mode) -> DataFrame:
        """historic_date, bulk, name with to_time, to_int, to_bit; returns the parameters as they are then."""
        p = R.Process(project, load)
        self.store.update(PARAMETERS, lambda old: R.set_mode(old, p, now=self.clock(), user=self.user, **mode))
        return p.of(self.store.read(PARAMETERS)).orderBy("ParameterType", "ParameterName")

    # reports -------------------------------------------------------------------------------------------------------

    def get_status(self, project: str, load: str, date: str | None = None, summary: bool = False, **scope) -> DataFrame:
        steps = self.store.read(STEPS)
        if summary:
            return V.status_summary(steps, project, load, date, self.clock())
        return V.status_detail(steps, project, load, date or self.processing_date(R.Process(project, load)), **scope)

    def views(self) -> dict[str, DataFrame]:
        steps, tasks = self.store.read(STEPS), self.store.read(TASKS)
        return {
            "v_processStatus": V.process_status(steps, self.store.read("ETLconfigProcess")), "v_runSummary": V.run_summary(steps), "v_taskDetail": V.task_detail(steps),
            "v_mandatoryBlockers": V.mandatory_blockers(steps), "v_currentFailures": V.current_failures(steps), "v_watermarks": V.watermarks(self.store.read(PARAMETERS), tasks),
        }

    def create_views(self, prefix: str = "") -> None:
        for name, df in self.views().items():
            df.createOrReplaceTempView(f"{prefix}{name}")
