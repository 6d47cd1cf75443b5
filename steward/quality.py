"""The quality store as an object: configure rules, compile them, assess tables, report."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import seed
from .functions.mail import VALIDATORS
from .operators import assess, config, report
from .operators.upsert import next_id, upsert
from .plans.compile import Custom, Field, compile_field
from .plans.resolve import resolve
from .sources.store import Store

#: Ids below this are kept for seeded patterns.
FIRST_OWN_PATTERN = 1000


class Quality:
    """Master data, configuration and results in a Store; curated tables are the caller's DataFrames.

    now and user are arguments of the object, so that what it writes can be repeated.
    """

    def __init__(self, spark: SparkSession, root: str, now: str | None = None, user: str = "system"):
        self.spark, self.store, self.user = spark, Store(spark, root), user
        self.now: Column = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        self.validators: dict[str, Callable] = {}
        self.fields: dict[str, Field] = {}

    def setup(self) -> None:
        """All tables of the quality store, seeded. Running it again adds what is missing."""
        self.store.create_all(["masterField", "configFieldValues", "configFieldAllowedPattern", "configCustomQuery", "mapDQChecks", "auditDQChecks", "statDQChecks"])
        names = ("masterDataCategory", "masterPattern")
        self.store.create_all(list(names))
        self.store.seed("2000-01-01 00:00:00", self.user)

    # configuration -------------------------------------------------------------------------------------------------

    def _put(self, table: str, row: dict, update: list[str]) -> int:
        """A configuration row by _ID: added, or its columns updated if one differs. The id is the next one unless given."""
        old = self.store.read(table)
        row["_ID"] = row.get("_ID") or next_id(old)
        schema = old.schema
        values = {**{"IsActive": True}, **row}
        new = self.spark.createDataFrame([tuple(values.get(f.name) for f in schema.fields)], schema).withColumns({"CreatedBy": F.lit(self.user), "CreatedOn": self.now, "LastUpdatedBy": F.lit(self.user), "LastUpdatedOn": self.now})
        stamp = {"LastUpdatedBy": F.lit(self.user), "LastUpdatedOn": self.now}
        self.store.update(table, lambda now: upsert(now, new, ["_ID"], [*update, "IsActive"], stamp=stamp))
        return row["_ID"]

    def register_field(self, full_field_name: str, data_category_type_id: int, field_id: int | None = None, is_active: bool = True) -> int:
        return self._put("masterField", {"_ID": field_id, "FullFieldName": full_field_name, "DataCategoryTypeID": data_category_type_id, "IsActive": is_active}, ["FullFieldName", "DataCategoryTypeID"])

    def set_field_values(self, full_field_name: str, config_id: int | None = None, field_id: int | None = None, min_data_length: int | None = None, max_data_length: int | None = None, min_data_value: str | None = None, max_data_value: str | None = None, is_active: bool = True) -> int:
        columns = ["FieldID", "FullFieldName", "MinDataLength", "MaxDataLength", "MinDataValue", "MaxDataValue"]
        return self._put("configFieldValues", dict(zip(["_ID", *columns, "IsActive"], [config_id, field_id, full_field_name, min_data_length, max_data_length, min_data_value, max_data_value, is_active], strict=True)), columns)

    def add_pattern_rule(self, full_field_name: str, is_pattern_allowed: bool, rule_id: int | None = None, pattern_name: str | None = None, pattern_category: str | None = None, pattern_subcategory: str | None = None, is_active: bool = True) -> int:
        if not (pattern_name or pattern_category or pattern_subcategory):
            raise ValueError("a rule names a pattern, a category or a sub-category")
        columns = ["FullFieldName", "PatternCategory", "PatternSubCategory", "PatternName", "IsPatternAllowed"]
        return self._put("configFieldAllowedPattern", dict(zip(["_ID", *columns, "IsActive"], [rule_id, full_field_name, pattern_category, pattern_subcategory, pattern_name, is_pattern_allowed, is_active], strict=True)), columns)

    def block_category(self, full_field_name: str, pattern_category: str, rule_id: int | None = None) -> int:
        return self.add_pattern_rule(full_field_name, False, rule_id, pattern_category=pattern_category)

    def allow_pattern(self, full_field_name: str, pattern_name: str, rule_id: int | None = None) -> int:
        return self.add_pattern_rule(full_field_name, True, rule_id, pattern_name=pattern_name)

    def block_pattern(self, full_field_name: str, pattern_name: str, rule_id: int | None = None) -> int:
        return self.add_pattern_rule(full_field_name, False, rule_id, pattern_name=pattern_name)

    def add_custom_query(self, full_field_name: str, expression: str, is_condition_allowed: bool, query_id: int | None = None, custom_query_type: str = "PYTHON", description: str | None = None, is_active: bool = True) -> int:
        columns = ["FullFieldName", "CustomQuery", "CustomQueryType", "CustomQueryDescription", "IsConditionAllowed"]
        return self._put("configCustomQuery", dict(zip(["_ID", *columns, "IsActive"], [query_id, full_field_name, expression, custom_query_type, description, is_condition_allowed, is_active], strict=True)), columns)

    def add_custom_query_regex(self, full_field_name: str, pattern: str, must_match: bool = True, query_id: int | None = None, description: str | None = None) -> int:
        return self.add_custom_query(full_field_name, pattern, must_match, query_id, "REGEX", description)

    def add_custom_query_sql(self, full_field_name: str, expression: str, is_condition_allowed: bool = True, query_id: int | None = None, description: str | None = None) -> int:
        return self.add_custom_query(full_field_name, expression, is_condition_allowed, query_id, "SQL", description)

    def add_mapping(self, full_field_name: str, schema: str, table: str, column: str, mapping_id: int | None = None, catalog: str | None = None, is_active: bool = True) -> int:
        columns = ["FullFieldName", "TargetCatalogName", "TargetSchemaName", "TargetTableName", "TargetFieldName", "DQFunctionSchemaName", "DQFunctionName"]
        name = "fn_DQ_" + "_".join(full_field_name.split(".", 2))
        return self._put("mapDQChecks", dict(zip(["_ID", *columns, "IsActive"], [mapping_id, full_field_name, catalog, schema, table, column, "dq", name, is_active], strict=True)), columns)

    def add_custom_pattern(self, pattern_id: int, category: str, name: str, priority: int, value: str | None = None, subcategory: str | None = None, description: str | None = None) -> int:
        if pattern_id < FIRST_OWN_PATTERN:
            raise ValueError(f"ids below {FIRST_OWN_PATTERN} are kept for seeded patterns")
        columns = ["PatternName", "PatternCategory", "PatternSubCategory", "PatternPriority", "PatternDescription", "PatternValue"]
        return self._put("masterPattern", dict(zip(["_ID", *columns], [pattern_id, name, category, subcategory, priority, description, value], strict=True)), columns)

    def add_invalid_keyword(self, keyword: str, pattern_id: int, priority: int = 30, description: str | None = None) -> int:
        return self.add_custom_pattern(pattern_id, "InvalidKeyword", f"Has Keyword-{keyword.lower()}", priority, keyword.lower(), "Custom", description)

    def register_validator(self, name: str, check: Callable[[str], bool]) -> None:
        self.validators[name] = check

    def verify_config(self) -> DataFrame:
        """Issues of the configuration; none is a good sign."""
        read = self.store.read
        return config.issues(read("masterField"), read("configFieldValues"), read("configFieldAllowedPattern"), read("configCustomQuery"), read("mapDQChecks"), read("masterPattern"))

    def field_rule_summary(self, field: str | None = None) -> DataFrame:
        read = self.store.read
        active = lambda n: read(n).where("IsActive")
        return config.rule_listing(active("configFieldValues"), resolve(read("configFieldAllowedPattern"), read("masterPattern")), active("configCustomQuery"), active("mapDQChecks"), field)

    def config_summary(self) -> DataFrame:
        """Rows and active rows of each configuration table."""
        out = None
        for n in ("masterField", "configFieldValues", "configFieldAllowedPattern", "configCustomQuery", "mapDQChecks"):
            one = self.store.read(n).agg(F.lit(n).alias("TableName"), F.count("*").alias("Rows"), F.count_if("IsActive").alias("Active"))
            out = one if out is None else out.unionByName(one)
        return out

    def validate_custom_queries_sql(self) -> dict[int, str | None]:
        """Per SQL rule None, or why Spark can't analyse it."""
        rows = self.store.read("configCustomQuery").where("IsActive and upper(CustomQueryType) = 'SQL'").collect()
        return assess.valid_sql(self.spark, [Custom(r["_ID"], "SQL", r["CustomQuery"], r["IsConditionAllowed"]) for r in rows])

    # assessment ----------------------------------------------------------------------------------------------------

    def generate_rules(self) -> list[str]:
        """Field specifications compiled from the configuration; issues abort. Returns the fields that have rules."""
        bad = self.verify_config().limit(20).collect()
        if bad:
            raise ValueError("configuration: " + "; ".join(f"{r['CheckName']} {r['TableName']} {r['KeyText']}" for r in bad))
        read = self.store.read
        self.fields = assess.fields_from(read("configFieldAllowedPattern"), read("masterPattern"), read("configFieldValues"), read("configCustomQuery"))
        return sorted(self.fields)

    def mappings(self, schema: str | None = None, table: str | None = None, field: str | None = None) -> list[assess.Mapping]:
        """Active mappings within a scope, by id."""
        df = self.store.read("mapDQChecks").where("IsActive")
        for column, value in (("TargetSchemaName", schema), ("TargetTableName", table), ("TargetFieldName", field)):
            if value is not None:
                df = df.where(F.col(column) == value)
        return [assess.Mapping(r["_ID"], r["FullFieldName"], r["TargetTableName"], r["TargetFieldName"], r["TargetSchemaName"]) for r in df.orderBy("_ID").collect()]

    def inspect_checker(self, field: str, show_all: bool = False) -> list[str]:
        """The steps that a field's rules compile to; show_all: also the rules that can't fail."""
        spec = self.fields[field]
        steps = compile_field(spec, "`v`", validators=self.validators).steps
        return steps + [f"{r.name} (allowed)" for r in spec.rules if r.allowed] if show_all else steps

    def test_checker(self, field: str, *values: str | None) -> DataFrame:
        """value, result, violation_type, log_message of some values."""
        df = self.spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
        done = assess.checked(df, [assess.Mapping(1, field, "values", "value")], self.fields, validators=self.validators)
        return done.orderBy("i").select("value", "_dq_1.*")

    def run_assessment(self, tables: dict[str, DataFrame], schema: str | None = None, table: str | None = None, field: str | None = None, reset_eligible_flag: bool = False, execution_id: str | None = None) -> tuple[str, dict[str, DataFrame]]:
        """Assess the tables (name -> prepared DataFrame) by the mappings in scope; audit and stats are appended.

        Returns the execution id and the tables with their flags, which the caller writes. Each table is scanned for the
        audit and for the stats; nothing but counts goes to the driver.
        """
        if not self.fields:
            self.generate_rules()
        run, out = execution_id or str(uuid.uuid4()), {}
        for name, df in tables.items():
            scope = [m for m in self.mappings(schema, table, field) if m.table == name and m.field in self.fields]
            if not scope or (table and name != table):
                continue
            before = assess.reset(df) if reset_eligible_flag else df
            done = assess.checked(before, scope, self.fields, validators=self.validators)
            self._append("auditDQChecks", assess.audit(done, scope, run, self.now), ["MappingID", "InputValue"])
            self._append("statDQChecks", assess.stats(done, scope, run, self.now), ["MappingID"])
            out[name] = assess.write_back(done, scope)
        return run, out

    def _append(self, table: str, rows: DataFrame, order: list[str]) -> None:
        """Rows added with ids above those there are. Ids are unique and rise within partitions, as an identity's do."""
        first = next_id(self.store.read(table))
        ids = F.row_number().over(Window.orderBy(*order)) if table == "statDQChecks" else F.monotonically_increasing_id() + 1
        self.store.append(table, rows.select((ids + (first - 1)).cast("long").alias("_ID"), "*"))

    # reports -------------------------------------------------------------------------------------------------------

    def audit_view(self) -> DataFrame:
        return report.audit_view(self.store.read("auditDQChecks"), self.store.read("mapDQChecks"))

    def stat_view(self) -> DataFrame:
        return report.stat_view(self.store.read("statDQChecks"), self.store.read("mapDQChecks"))

    def violations(self, execution_id: str | None = None) -> DataFrame:
        return report.VIOLATIONS.of(self.audit_view(), execution_id)

    def quality_scores(self, execution_id: str | None = None) -> DataFrame:
        return report.SCORES.of(self.stat_view(), execution_id)

    def fields_below_threshold(self, threshold: float = 80) -> DataFrame:
        return report.SCORES.of(self.stat_view(), below=threshold)

    def summary_by_violation_type(self, execution_id: str | None = None) -> DataFrame:
        return report.BY_VIOLATION.of(self.audit_view(), execution_id)

    def summary_by_table(self, execution_id: str | None = None) -> DataFrame:
        return report.BY_TABLE.of(self.stat_view(), execution_id)

    def create_views(self, prefix: str = "") -> None:
        """Temporary views of the audit and the stats."""
        self.audit_view().createOrReplaceTempView(f"{prefix}v_auditDQChecks")
        self.stat_view().createOrReplaceTempView(f"{prefix}v_statDQChecks")

    @staticmethod
    def builtin_validators() -> list[str]:
        return sorted(VALIDATORS)

    @staticmethod
    def seeded_patterns() -> list[tuple]:
        return seed.patterns()
