"""Snapshot tables: each change makes a new version, a numbered pointer names its folders.

Readers keep the version they opened. Pointers are small files below root/table/_current_, each created only if its number isn't there
yet, so of two writers who saw the same version one comes first, and the other one reads again (update) or follows it (write, append).
A version is one Parquet folder; an append adds a folder to those of the version before. Pointers are written last, so a failed write
leaves the old version current. All files go through Spark, so root may be any store that Spark reads and that can refuse to create
a file that exists.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import seed

AUDITED = "IsActive boolean, CreatedBy string, CreatedOn timestamp, LastUpdatedBy string, LastUpdatedOn timestamp"
STAMPS = "CreatedBy string, CreatedOn timestamp, LastUpdatedBy string, LastUpdatedOn timestamp"
#: Tables of the quality and run-tracking stores.
TABLES = {
    "masterDataCategory": f"_ID int, DataCategoryType string, DataType string, DataCategoryShortDescription string, DataCategoryDescription string, {AUDITED}",
    "masterPattern": f"_ID int, PatternName string, PatternCategory string, PatternSubCategory string, PatternPriority int, PatternDescription string, PatternValue string, {AUDITED}",
    "masterField": f"_ID int, FullFieldName string, DataCategoryTypeID int, {AUDITED}",
    "configFieldValues": f"_ID int, FieldID int, FullFieldName string, MinDataLength int, MaxDataLength int, MinDataValue string, MaxDataValue string, {AUDITED}",
    "configFieldAllowedPattern": f"_ID int, FullFieldName string, PatternCategory string, PatternSubCategory string, PatternName string, IsPatternAllowed boolean, {AUDITED}",
    "configCustomQuery": f"_ID int, FullFieldName string, CustomQuery string, CustomQueryType string, CustomQueryDescription string, IsConditionAllowed boolean, {AUDITED}",
    "mapDQChecks": f"_ID int, FullFieldName string, TargetCatalogName string, TargetSchemaName string, TargetTableName string, TargetFieldName string, DQFunctionSchemaName string, DQFunctionName string, {AUDITED}",
    "auditDQChecks": "_ID long, GeneratedOn timestamp, ExecutionID string, MappingID int, InputValue string, Result boolean, ViolationType string, LogMessage string",
    "statDQChecks": "_ID long, LoggedOn timestamp, ExecutionID string, MappingID int, RowsQualified long, RowsDisqualified long",
    "ETLOrganisation": f"OrganisationCode string, OrganisationName string, OrganisationDescription string, {AUDITED}",
    "ETLconfigProject": f"ProjectCode string, OrganisationCode string, ProjectName string, ProjectDescription string, {AUDITED}",
    "ETLconfigSequence": f"SequenceID int, SequenceCode string, SequenceName string, SequenceDescription string, SortOrder int, {AUDITED}",
    "ETLconfigProcess": f"ProjectCode string, ProcessLoad string, ProcessName string, ProcessDescription string, ProcessOwner string, LoadFrequency string, {AUDITED}",
    "ETLconfigTasks": f"TaskID int, ProjectCode string, ProcessLoad string, WorkFlowID int, SequenceID int, TaskName string, TaskDescription string, SourceType string, SourceIdentifier string, SourceSystemCode string, FileNameMask string, FileExtension string, InFilePath string, OutFilePath string, LoadFrequency string, TaskMandatory boolean, {AUDITED}",
    "ETLconfigParameters": f"ProjectCode string, ProcessLoad string, ParameterName string, ParameterDescription string, ParameterType string, ValueINT long, ValueDateTime timestamp, ValueBIT boolean, {STAMPS}",
    "ETLProcessingSteps": "ProcessingDate date, ProjectCode string, ProcessLoad string, ExecutionID string, WorkFlowID int, TaskID int, SequenceID int, Attempts int, Status string, TaskName string, SequenceCode string, TaskMandatory boolean, SourceSystemCode string, FullFileName string, InFilePath string, OutFilePath string, ForceSkip boolean, StartTime timestamp, EndTime timestamp, DurationSeconds int, LogMessage string, LogType string, LogCode string, SourceType string, SourceRunID string, ClusterID string, LastUpdatedOn timestamp, LastUpdatedBy string",
    "ETLsysLogs": "_ID long, ProcessingDate date, ProjectCode string, ProcessLoad string, SourceType string, RunID string, ExecutionID string, CorrelationID string, PipelineName string, ActivityName string, OperationName string, Level int, LogTimeUTC timestamp, Message string",
}


#: Times that an update is tried again, and seconds that a pointer may stay without content before its writer counts as lost.
TRIES, WAIT = 30, 5.0


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        path, fs = self._path(name, "_current_")
        return sorted(int(f) for s in fs.listStatus(path) if (f := s.getPath().getName()).isdigit()) if fs.exists(path) else []

    def _folders(self, name: str, number: int) -> list[str]:
        path, fs = self._path(name, "_current_", f"{number:010d}")
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _current(self, name: str) -> tuple[int, list[str]]:
        """Greatest number, and the folders of the last version; waits for a pointer that is being written."""
        numbers, end = self._numbers(name), time.monotonic() + WAIT
        for n in reversed(numbers):
            while True:
                if found := self._folders(name, n):
                    return numbers[-1], found
                if time.monotonic() > end:
                    break
                time.sleep(0.05)
        return (numbers or [0])[-1], []

    def _claim(self, name: str, number: int, folders: list[str]) -> bool:
        """Make folders the version of this number; False if another writer has it."""
        path, fs = self._path(name, "_current_", f"{number:010d}")
        try:
            fs.mkdirs(path.getParent())
            if fs.getScheme() == "file":  # the local file system's create() looks first and creates then
                if not self.spark._jvm.java.io.File(path.toUri().getPath()).createNewFile():
                    return False
                out = fs.create(path, True)
            else:
                out = fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray("\n".join(folders).encode()))
        out.close()
        return True

    def _save(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        version = f"v{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{name}/{version}")
        return version

    def _drop(self, name: str, version: str) -> None:
        path, fs = self._path(name, version)
        fs.delete(path, True)

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(TABLES[name])

    def exists(self, name: str) -> bool:
        return bool(self._current(name)[1])

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.parquet(*(f"{self.root}/{name}/{f}" for f in folders))

    def read(self, name: str) -> DataFrame:
        """The current version; an empty table of a known name if there is none."""
        return self._read(name, self._current(name)[1])

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        """df as the new version, whatever the last one is."""
        version = self._save(name, df, partition_by)
        while not self._claim(name, self._current(name)[0] + 1, [version]):
            pass

    def append(self, name: str, df: DataFrame) -> None:
        """Rows added to the version that is current when they are named; versions that readers have open stay as they are."""
        version = self._save(name, df)
        while True:
            number, folders = self._current(name)
            if self._claim(name, number + 1, [*folders, version]):
                return

    def update(self, name: str, change: Callable[[DataFrame], DataFrame | None]) -> None:
        """The current version replaced by what change makes of it (None: nothing to change). If another writer was
        faster, change is asked again with that one's version, so that no update is lost.
        """
        for _ in range(TRIES):
            number, folders = self._current(name)
            df = change(self._read(name, folders))
            if df is None:
                return
            version = self._save(name, df)
            if self._claim(name, number + 1, [version]):
                return
            self._drop(name, version)
        raise RuntimeError(f"{name} was changed by others {TRIES} times")

    def vacuum(self, name: str, keep: int = 10) -> None:
        """Delete the files of all but the last versions; readers of older ones must be done."""
        numbers = self._numbers(name)
        used = {f for n in numbers[-keep:] for f in self._folders(name, n)}
        for n in numbers[:-keep]:
            for f in self._folders(name, n):
                if f not in used:
                    self._drop(name, f)
            path, fs = self._path(name, "_current_", f"{n:010d}")
            fs.delete(path, False)

    def create_all(self, names: list[str] | None = None) -> None:
        """Empty tables where there are none."""
        for n in names or list(TABLES):
            if not self.exists(n):
                self.write(n, self.spark.createDataFrame([], self.schema(n)))

    def seed(self, now, user: str = "system") -> None:
        """Master rows that are missing, by id; rows that are there stay as they are."""
        from ..operators.upsert import insert_only

        stamp = {"IsActive": F.lit(True), "CreatedBy": F.lit(user), "CreatedOn": F.lit(now).cast("timestamp"), "LastUpdatedBy": F.lit(user), "LastUpdatedOn": F.lit(now).cast("timestamp")}
        rows = {
            "masterDataCategory": (seed.CATEGORIES, "_ID int, DataCategoryType string, DataType string, DataCategoryShortDescription string, DataCategoryDescription string", ["_ID"]),
            "masterPattern": (seed.patterns(), seed.PATTERN_COLUMNS, ["_ID"]),
            "ETLconfigSequence": (seed.STAGES, "SequenceID int, SequenceCode string, SequenceName string, SequenceDescription string, SortOrder int", ["SequenceID"]),
        }
        for name, (values, columns, keys) in rows.items():
            self.update(name, lambda old, values=values, columns=columns, keys=keys: insert_only(old, self.spark.createDataFrame(values, columns).withColumns(stamp), keys))

    def views(self, names: list[str], prefix: str = "", database: str | None = None) -> None:
        """Temporary views, or with a database views that stay, of the versions that are current now."""
        for n in names:
            if database is None:
                self.read(n).createOrReplaceTempView(f"{prefix}{n}")
            else:
                parts = [f"select * from parquet.`{self.root}/{n}/{f}`" for f in self._current(n)[1]]
                self.spark.sql(f"create or replace view `{database}`.`{prefix}{n}` as {' union all '.join(parts)}")


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema that it lacks, as nulls."""
    for f in schema.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def catalog_exists(spark: SparkSession, name: str) -> bool:
    return any(c.name == name for c in spark.catalog.listCatalogs())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def frame(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """Dicts as a table with stated columns; keys that a row lacks are null."""
    schema = T.StructType.fromDDL(ddl)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
