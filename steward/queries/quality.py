"""Queries of table quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seed
from ..operators import config, report
from ..operators.assess import ELIGIBLE, FIELDS, ROW_ID, VIOLATIONS, Mapping, audit, checked, fields_from, mapping_frame, reset, stats, write_back
from ..plans.compile import Custom, Field, Rule
from ..plans.resolve import resolve
from .tables import DIRTY, Values, table

QUERIES: dict = {}
ORACLES: dict = {}
BY_ID = {p[0]: p for p in seed.patterns()}
EMPTY, SPACES, SPACE, NUMERIC, DECIMAL, TEXT, ALNUM, DATE, TIME, TIMESTAMP, BOOLEAN, DUPLICATED, UNICODE, LOWER, UPPER = 60, 61, 50, 1, 2, 3, 4, 5, 6, 7, 8, 150, 160, 170, 171
SPECIALS, EMPTIES, WORDS = range(10, 42), range(62, 94), range(100, 140)

#: White space that is stripped, for DuckDB.
WS = "concat(" + ", ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + ")"
STRIP = f"trim(v, {WS})"
NOSPACE = f"replace({STRIP}, ' ', '')"


def rules(*ids: int, allowed: bool = False) -> tuple[Rule, ...]:
    return tuple(Rule(i, BY_ID[i][1], BY_ID[i][2], BY_ID[i][4], BY_ID[i][5], allowed) for i in ids)


def quoted(token: str) -> str:
    return "'" + token.replace("'", "''") + "'"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(DIRTY).alias("v"))


DIRTY_SQL = f"(select event_id, {DIRTY} as v from events)"


def check(name: str, spec: Field, violation: str, fails: str) -> None:
    """A query that checks the dirty values by one specification; fails: DuckDB condition over v."""
    m = [Mapping(1, "f", "dirty", "v")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checked(dirty(spark, sf_dir), m, {"f": spec}).select("event_id", "v", F.col("_dq_1.result").alias("ok"), F.col("_dq_1.violation_type").alias("violation"))

    QUERIES[name] = run
    ORACLES[name] = f"select event_id, v, not bad as ok, case when bad then '{violation}' end as violation from (select event_id, v, coalesce({fails}, false) as bad from {DIRTY_SQL}) t"


def family(ids, condition: str) -> str:
    return " or ".join(condition.replace("{k}", quoted(BY_ID[i][5])) for i in ids)


DATES = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{1,2}\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+[0-9]{4}|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+[0-9]{1,2},?\s+[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$"
TIMES = r"^[0-9]{1,2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$"
IS_TIME = f"(length({NOSPACE}) between 8 and 16 and regexp_matches({NOSPACE}, '{TIMES}') and try_cast(split_part({NOSPACE}, ':', 1) as int) <= 23 and try_cast(split_part({NOSPACE}, ':', 2) as int) <= 59)"

check("dq_length", Field("f", length=(2, 8)), "Data Length", "length(v) < 2 or length(v) > 8")
check("dq_range", Field("f", values=("1", "n")), "Data Value Range", "v < '1' or v > 'n'")
check("dq_empty", Field("f", rules(EMPTY)), "Data Emptiness", "v is null or v = ''")
check("dq_spaces", Field("f", rules(SPACES)), "Data Emptiness", f"{STRIP} = '' or (instr(v, ' ') > 0 and instr(v, ' ') = length(v))")
check("dq_virtually_empty", Field("f", rules(*EMPTIES)), "Data Emptiness", f"{NOSPACE} <> '' and ({family(EMPTIES, f'replace({NOSPACE}, ' + '{k}' + ', chr(0)) = repeat(chr(0), length(' + NOSPACE + '))')})".replace("chr(0)", "''").replace(f"repeat('', length({NOSPACE}))", "''"))
check("dq_space_found", Field("f", rules(SPACE)), "Space Found", "instr(v, ' ') > 0")
check("dq_numeric", Field("f", rules(NUMERIC)), "Data Type", rf"regexp_matches({NOSPACE}, '^\p{{Nd}}+$')")
check("dq_numeric_required", Field("f", rules(NUMERIC, allowed=True)), "Data Type", rf"not regexp_matches({NOSPACE}, '^\p{{Nd}}+$')")
check("dq_decimal", Field("f", rules(DECIMAL)), "Data Type", rf"regexp_matches({NOSPACE}, '^[0-9]+\.[0-9]+$')")
check("dq_boolean", Field("f", rules(BOOLEAN)), "Data Type", f"{NOSPACE} in ('0', '1')")
check("dq_time", Field("f", rules(TIME)), "Data Type", IS_TIME)
check("dq_date", Field("f", rules(DATE)), "Data Type", f"regexp_matches(lower({STRIP}), '{DATES}')")
check("dq_date_required", Field("f", rules(DATE, allowed=True)), "Data Type", f"not regexp_matches(lower({STRIP}), '{DATES}')")
check("dq_timestamp", Field("f", rules(TIMESTAMP)), "Data Type", rf"regexp_matches({STRIP}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}(\.[0-9]+)?)?$')")
check("dq_text", Field("f", rules(TEXT)), "Data Type", "not regexp_matches(v, '[0-9]')")
check("dq_alphanumeric", Field("f", rules(ALNUM)), "Data Type", r"regexp_matches(v, '\p{Nd}') and regexp_matches(v, '\p{L}')")
check("dq_special_char", Field("f", rules(*SPECIALS)), "Special Character", family(SPECIALS, "contains(v, {k})"))
check("dq_keyword", Field("f", rules(*WORDS)), "Invalid Keyword", f"lower({STRIP}) <> '' and ({family(WORDS, f'2 * (length({STRIP}) - length(replace(lower({STRIP}), ' + '{k}' + f', {quoted("")}))) >= length({STRIP}) and contains(lower({STRIP}), ' + '{k})')})")
check("dq_dup_char", Field("f", rules(DUPLICATED)), "Fully Duplicated Character", rf"length({NOSPACE}) > 1 and replace({NOSPACE}, left({NOSPACE}, 1), '') = '' and not regexp_matches({NOSPACE}, '^\p{{Nd}}')")
check("dq_unicode", Field("f", rules(UNICODE)), "Unicode Characters", f"length({NOSPACE}) > 1 and regexp_matches({NOSPACE}, '[^ -~]')")
check("dq_lowercase", Field("f", rules(LOWER)), "Casing Issue", "regexp_matches(v, '[a-z]')")
check("dq_uppercase", Field("f", rules(UPPER)), "Casing Issue", "regexp_matches(v, '[A-Z]')")
check("dq_custom_regex", Field("f", custom=(Custom(7, "REGEX", r"^[a-z]+[0-9]*$", True),)), "Custom Query", "not regexp_matches(v, '^[a-z]+[0-9]*$')")
check("dq_custom_sql", Field("f", custom=(Custom(8, "SQL", "length(@InputValue) > 5 and @InputValue like '%a%'", False),)), "Custom Query", "length(v) > 5 and v like '%a%'")
check("dq_custom_unknown", Field("f", custom=(Custom(9, "PYTHON", "nobody", True),)), "Custom Query", "v is not null")
AFTER, DOTS = "substr(v, instr(v, '@') + 1)", "(length({x}) - length(replace({x}, '.', '')))"
ADOTS, LDOTS = DOTS.replace("{x}", AFTER), DOTS.replace("{x}", "split_part(v, '@', 1)")
MAIL = {
    "email_basic_format": r"regexp_matches(v, '^[^@\s]+@[^@\s]+\.[^@\s]+$')",
    "email_at_validation": f"instr(v, '@') > 1 and instr(v, '@') < length(v) and length(v) - length(replace(v, '@', '')) = 1 and contains({AFTER}, '.')",
    "email_domain_format": f"contains(v, '@') and {ADOTS} between 1 and 3 and len(list_filter(string_split({AFTER}, '.'), lambda x: length(x) < 2)) = 0",
    "email_local_part_dots": f"contains(v, '@') and {LDOTS} < 3",
    "email_no_placeholder": "contains(lower(v), 'noemaildress')",
    "email_no_trailing_special": "regexp_matches(v, '[-._]$')",
}
for i, (k, condition) in enumerate(MAIL.items()):
    wanted = i < 4
    check(f"dq_{k}", Field("f", custom=(Custom(20 + i, "PYTHON", k, wanted),)), "Custom Query", f"v is not null and {'not ' if wanted else ''}coalesce({condition}, false)")


# first failure, with the form of the value that each rule sees
FIRST = Field("f", rules(EMPTY, SPACES, 64, NUMERIC, SPACE, 24, 30, 100, 101, 127, 135, DUPLICATED, UNICODE, LOWER), length=(0, 100))
_kw = lambda k: f"(2 * (length({STRIP}) - length(replace(lower({STRIP}), '{k}', ''))) >= length({STRIP}) and contains(lower({STRIP}), '{k}'))"
_msg = lambda value, rule: f"concat('Debug:: The value <', coalesce({value}, 'NULL'), '> has [FAILED]. Rule: ', {rule}, ' :<NOT Allowed>')"
_steps = [
    ("v is null or v = ''", "Data Emptiness", "v", "'Is Empty or NULL'"),
    (f"{STRIP} = '' or (instr(v, ' ') > 0 and instr(v, ' ') = length(v))", "Data Emptiness", "v", "'Is Virtually Empty with Spaces'"),
    (f"{NOSPACE} <> '' and replace({NOSPACE}, '-', '') = ''", "Data Emptiness", NOSPACE, "'Is Virtually Empty with ''-'''"),
    (rf"regexp_matches({NOSPACE}, '^\p{{Nd}}+$')", "Data Type", NOSPACE, "'Is Fully Numeric'"),
    (f"contains({NOSPACE}, ' ')", "Space Found", NOSPACE, "'Has Space'"),
    (f"contains({NOSPACE}, '|')", "Special Character", NOSPACE, "'Has ''|'''"),
    (f"contains({NOSPACE}, '.')", "Special Character", NOSPACE, "'Has ''.'''"),
    *((_kw(k), "Invalid Keyword", f"lower({STRIP})", f"'Has Keyword-''{k}'''") for k in ("n/a", "null", "test", "zzz")),
    (rf"length({NOSPACE}) > 1 and replace({NOSPACE}, left({NOSPACE}, 1), '') = '' and not regexp_matches({NOSPACE}, '^\p{{Nd}}')", "Fully Duplicated Character", NOSPACE, "'Has Fully Duplicated Character'"),
    (f"length({NOSPACE}) > 1 and regexp_matches({NOSPACE}, '[^ -~]')", "Unicode Characters", NOSPACE, "'Has Unicode Characters'"),
    (f"regexp_matches({NOSPACE}, '[a-z]')", "Casing Issue", NOSPACE, "'Has Lowercase Character'"),
]


def dq_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(dirty(spark, sf_dir), [Mapping(1, "f", "dirty", "v")], {"f": FIRST}).select("event_id", F.col("_dq_1.result").alias("ok"), F.col("_dq_1.violation_type").alias("violation"), F.col("_dq_1.log_message").alias("message"))


QUERIES["dq_first_failure"] = dq_first_failure
ORACLES["dq_first_failure"] = f"select event_id, violation is null as ok, violation, message from (select event_id, case {' '.join(f"when {c} then '{x}'" for c, x, _, _ in _steps)} end as violation, case {' '.join(f'when {c} then {_msg(v, r)}' for c, _, v, r in _steps)} end as message from {DIRTY_SQL}) t"

# whole tables: documents, part and customer by configuration tables
CONFIG_RULES = Values("_ID int,FullFieldName string,PatternCategory string,PatternSubCategory string,PatternName string,IsPatternAllowed boolean,IsActive boolean", [
    (1, "s.docs.text", "DataEmptiness", None, None, False, True), (2, "s.docs.text", None, None, "Is Virtually Empty with -", True, True), (3, "s.docs.text", "InvalidKeyword", None, None, False, True),
    (4, "s.docs.text", "UnicodeCharacters", None, None, False, True), (5, "s.part.name", "DataEmptiness", None, None, False, True), (6, "s.part.name", None, "Symbol", None, False, True),
    (7, "s.part.name", None, None, "Has Space", False, True), (8, "s.part.name", "SpaceFound", None, None, True, True), (9, "s.part.type", "CasingCheck", None, None, False, True),
    (10, "s.part.type", None, None, "Has Uppercase Character", True, True), (11, "s.part.type", None, None, "Has Uppercase Character", False, True), (12, "s.cust.name", "SpecialCharacter", None, None, False, True),
    (13, "s.cust.name", None, "Symbol", None, True, True), (14, "s.cust.segment", "DataType1", None, None, True, False), (15, "s.part.brand", None, "Symbol", None, False, True),
])
CONFIG_VALUES = Values("_ID int,FullFieldName string,MinDataLength int,MaxDataLength int,MinDataValue string,MaxDataValue string,IsActive boolean", [
    (1, "s.part.name", 8, 14, None, None, True), (2, "s.cust.segment", None, None, "B", "HZ", True), (3, "s.docs.text", 100, 100000, None, None, True), (4, "s.part.type", 1, None, None, None, True),
])
CONFIG_CUSTOM = Values("_ID int,FullFieldName string,CustomQuery string,CustomQueryType string,IsConditionAllowed boolean,IsActive boolean", [
    (1, "s.cust.segment", "@InputValue like '%I%'", "SQL", False, True), (2, "s.cust.name", "^Customer#[0-9]+$", "REGEX", True, True), (3, "s.cust.name", "nonsense(@InputValue)", "SQL", True, True),
])
MAPPINGS = {
    "part": [Mapping(1, "s.part.name", "part", "p_name"), Mapping(2, "s.part.type", "part", "p_type"), Mapping(3, "s.part.brand", "part", "p_brand"), Mapping(4, "s.none", "part", "p_size")],
    "customer": [Mapping(5, "s.cust.name", "customer", "c_name"), Mapping(6, "s.cust.segment", "customer", "c_mktsegment")],
    "documents": [Mapping(7, "s.docs.text", "documents", "text")],
}
ALL = [m for ms in MAPPINGS.values() for m in ms]
PATTERNS = Values("_ID int,PatternName string,PatternCategory string,PatternSubCategory string,PatternPriority int,PatternValue string", seed.patterns())
RUN, WHEN = "run-1", "2024-01-01 00:00:00"
#: DuckDB: is the value bad, and by what, for each mapping.
BAD = {
    1: ("part", "p_name", "case when length(p_name) not between 8 and 14 then 'Data Length' when p_name is null or p_name = '' then 'Data Emptiness' when instr(p_name, ' ') > 0 and instr(p_name, ' ') = length(p_name) then 'Data Emptiness' when contains(replace(p_name, ' ', ''), ' ') then 'Space Found' when regexp_matches(p_name, '[!@#$%^&*~+<>?=]') then 'Special Character' end"),
    2: ("part", "p_type", "case when regexp_matches(p_type, '[a-z]') then 'Casing Issue' end"),
    3: ("part", "p_brand", "case when contains(p_brand, '#') then 'Special Character' end"),
    5: ("customer", "c_name", "case when not regexp_matches(c_name, '^Customer#[0-9]+$') then 'Custom Query' when regexp_matches(c_name, '[()\\[\\]{}|\\\\/,;:._\"`-]') then 'Special Character' end"),
    6: ("customer", "c_mktsegment", "case when c_mktsegment not between 'B' and 'HZ' then 'Data Value Range' when c_mktsegment like '%I%' then 'Custom Query' end"),
}


def configured(spark: SparkSession) -> dict[str, Field]:
    return fields_from(CONFIG_RULES.frame(spark), PATTERNS.frame(spark), CONFIG_VALUES.frame(spark), CONFIG_CUSTOM.frame(spark))


def assessed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return checked(table(spark, sf_dir, name), MAPPINGS[name], configured(spark))


def dq_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: whole documents through length, emptiness, keyword and character rules, as shares by source."""
    done = assessed(spark, sf_dir, "documents")
    return done.groupBy("source", F.col("_dq_7.violation_type").alias("violation")).agg(F.count("*").alias("documents"))


def _all(spark: SparkSession, sf_dir: str, what) -> DataFrame:
    out = None
    for name in ("part", "customer"):
        one = what(assessed(spark, sf_dir, name), MAPPINGS[name])
        out = one if out is None else out.unionByName(one)
    return out


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, lambda df, m: audit(df, m, RUN, F.lit(WHEN).cast("timestamp")))


def all_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, lambda df, m: stats(df, m, RUN, F.lit(WHEN).cast("timestamp")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stat_view(all_stats(spark, sf_dir), mapping_frame(spark, ALL)).drop("StatisticID", "LoggedOn")


def audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.audit_view(audits(spark, sf_dir), mapping_frame(spark, ALL))


def dq_row_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "part").withColumns({
        ELIGIBLE: F.when(F.col("p_partkey") % 5 == 0, F.lit(False)), VIOLATIONS: F.when(F.col("p_partkey") % 5 == 0, "[old: X]"), FIELDS: F.when(F.col("p_partkey") % 5 == 0, "[old]"),
    })
    done = write_back(checked(before, MAPPINGS["part"], configured(spark)), MAPPINGS["part"])
    return done.select("p_partkey", ELIGIBLE, VIOLATIONS, FIELDS)


def dq_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lit(False)).when(F.col("p_partkey") % 3 == 1, F.lit(True)).alias(ELIGIBLE), F.lit("[a: X]").alias(VIOLATIONS), F.lit("[a]").alias(FIELDS))
    return reset(before)


def dq_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.assess import prepared

    return prepared(table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "kept").alias(ROW_ID)), F.sha2(F.col("s_suppkey").cast("string"), 256))


def dq_resolve_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(CONFIG_RULES.frame(spark), PATTERNS.frame(spark)).select("FullFieldName", "PatternID", "PatternName", "IsPatternAllowed", "Specificity")


CONFIG_FIELDS = Values("_ID int,FullFieldName string", [(1, "s.part.name"), (2, "s.part.type"), (2, "s.cust.name")])


def dq_config_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.issues(CONFIG_FIELDS.frame(spark), CONFIG_VALUES.frame(spark), CONFIG_RULES.frame(spark), CONFIG_CUSTOM.frame(spark), mapping_frame(spark, ALL), PATTERNS.frame(spark))


def dq_rule_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.rule_listing(CONFIG_VALUES.frame(spark), resolve(CONFIG_RULES.frame(spark), PATTERNS.frame(spark)), CONFIG_CUSTOM.frame(spark), mapping_frame(spark, ALL), "part.p_name")


def dq_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("customer", "orders", "events"):
        one = config.suggest(spark, table(spark, sf_dir, name).schema, name)
        out = one if out is None else out.unionByName(one)
    return out.select("FullFieldName", "ColumnName", "Kind", "CategoryID", F.array_join("Block", ",").alias("Block"))


def dq_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PATTERNS.frame(spark).groupBy("PatternCategory").agg(F.count("*").alias("patterns"), F.min("_ID").alias("first_id"), F.max("PatternPriority").alias("priority"))


for f in (dq_documents, dq_row_flags, dq_reset, dq_prepare, dq_resolve_precedence, dq_config_issues, dq_rule_listing, dq_suggest, dq_patterns):
    QUERIES[f.__name__] = f
QUERIES |= {
    "dq_audit": lambda s, d: audits(s, d).drop("GeneratedOn", "LogMessage"),
    "dq_stats": lambda s, d: all_stats(s, d).drop("LoggedOn"),
    "dq_violations": lambda s, d: report.VIOLATIONS.of(audit_view(s, d), RUN).select("FullFieldName", "TargetTableName", "TargetFieldName", "InputValue", "ViolationType"),
    "dq_scores": lambda s, d: report.SCORES.of(scores(s, d)).drop("ExecutionID"),
    "dq_below_threshold": lambda s, d: report.SCORES.of(scores(s, d), below=80).select("FullFieldName", "PercentageQualified"),
    "dq_violation_summary": lambda s, d: report.BY_VIOLATION.of(audit_view(s, d), RUN).select("FullFieldName", "ViolationType", "RecordCount"),
    "dq_run_summary": lambda s, d: report.BY_FIELD.of(audit_view(s, d)),
    "dq_table_summary": lambda s, d: report.BY_TABLE.of(scores(s, d)),
}

_kwd = " or ".join(f"(2 * (length(t) - length(replace(t, {quoted(k)}, ''))) >= length(t) and contains(t, {quoted(k)}))" for k in seed.KEYWORDS)
_trim = STRIP.replace("(v,", "(text,")
_nos = NOSPACE.replace("(v,", "(text,")
_tok = " or ".join(f"replace(n, {quoted(k)}, '') = ''" for k in seed.EMPTY_TOKENS if k != "-")
ORACLES["dq_documents"] = f"""
select source, violation, count(*) as documents from (
  select source, case when length(text) not between 100 and 100000 then 'Data Length' when text is null or text = '' then 'Data Emptiness'
    when s = '' or (instr(text, ' ') > 0 and instr(text, ' ') = length(text)) then 'Data Emptiness' when n <> '' and ({_tok}) then 'Data Emptiness'
    when t <> '' and ({_kwd}) then 'Invalid Keyword' when length(n) > 1 and regexp_matches(n, '[^ -~]') then 'Unicode Characters' end as violation
  from (select source, text, {_trim} as s, {_nos} as n, lower({_trim}) as t from documents) d) x group by all"""
_each = " union all ".join(f"select {i} as MappingID, {c} as InputValue, {x} as ViolationType from {t}" for i, (t, c, x) in BAD.items())
_map = Values("MappingID int,FullFieldName string,TargetTableName string,TargetFieldName string", [(m.id, m.field, m.table, m.column) for m in ALL]).sql
_stats = f"(select MappingID, count(*) filter (ViolationType is null) as RowsQualified, count(*) filter (ViolationType is not null) as RowsDisqualified from ({_each}) group by 1)"
_scores = f"(select FullFieldName, 'curated' as TargetSchemaName, TargetTableName, TargetFieldName, RowsQualified, RowsDisqualified, round(RowsQualified::double / (RowsQualified + RowsDisqualified) * 100, 0) as PercentageQualified from {_stats} join {_map} m using (MappingID))"
ORACLES |= {
    "dq_audit": f"select '{RUN}' as ExecutionID, MappingID, InputValue, false as Result, ViolationType from ({_each}) where ViolationType is not null",
    "dq_stats": f"select '{RUN}' as ExecutionID, * from {_stats}",
    "dq_violations": f"select FullFieldName, TargetTableName, TargetFieldName, InputValue, ViolationType from ({_each}) e join {_map} m using (MappingID) where ViolationType is not null",
    "dq_scores": f"select * from {_scores}",
    "dq_below_threshold": f"select FullFieldName, PercentageQualified from {_scores} where PercentageQualified < 80",
    "dq_violation_summary": f"select FullFieldName, ViolationType, count(*) as RecordCount from ({_each}) e join {_map} m using (MappingID) where ViolationType is not null group by all",
    "dq_run_summary": f"select FullFieldName, TargetTableName, TargetFieldName, ViolationType, count(*) as RecordCount from ({_each}) e join {_map} m using (MappingID) where ViolationType is not null group by all",
    "dq_table_summary": f"select TargetTableName, sum(RowsQualified)::bigint as TotalQualified, sum(RowsDisqualified)::bigint as TotalDisqualified, round(sum(RowsQualified)::double / nullif(sum(RowsQualified) + sum(RowsDisqualified), 0) * 100, 1) as TableQualityPct from {_scores} group by 1",
    "dq_row_flags": f"""select p_partkey, case when p_partkey % 5 = 0 then false else a is null and b is null and c is null end as {ELIGIBLE},
      nullif(concat_ws(', ', case when p_partkey % 5 = 0 then '[old: X]' end, '[p_name: ' || a || ']', '[p_type: ' || b || ']', '[p_brand: ' || c || ']'), '') as {VIOLATIONS},
      concat_ws(', ', case when p_partkey % 5 = 0 then '[old]' end, '[p_name], [p_type], [p_brand]') as {FIELDS} from (select p_partkey, {BAD[1][2]} as a, {BAD[2][2]} as b, {BAD[3][2]} as c from part) t""",
    "dq_reset": f"select p_partkey, case when p_partkey % 3 = 1 then true end as {ELIGIBLE}, case when p_partkey % 3 <> 0 then '[a: X]' end as {VIOLATIONS}, case when p_partkey % 3 <> 0 then '[a]' end as {FIELDS} from part",
    "dq_prepare": f"select s_suppkey, case when s_suppkey % 2 = 0 then 'kept' else sha256(s_suppkey::varchar) end as {ROW_ID}, null::boolean as {ELIGIBLE}, null::varchar as {VIOLATIONS}, null::varchar as {FIELDS} from supplier",
    "dq_resolve_precedence": f"""select FullFieldName, PatternID, PatternName, IsPatternAllowed, Specificity from (select r.FullFieldName, p._ID as PatternID, p.PatternName, IsPatternAllowed,
      case when r.PatternName = p.PatternName then 3 when r.PatternSubCategory = p.PatternSubCategory then 2 else 1 end as Specificity,
      row_number() over (partition by FullFieldName, PatternValue, p.PatternName order by case when r.PatternName = p.PatternName then 3 when r.PatternSubCategory = p.PatternSubCategory then 2 else 1 end desc, IsPatternAllowed desc, r._ID) as n
      from {CONFIG_RULES.sql} r join {PATTERNS.sql} p on r.PatternName = p.PatternName or r.PatternSubCategory = p.PatternSubCategory or r.PatternCategory = p.PatternCategory where IsActive) t where n = 1""",
    "dq_patterns": f"select PatternCategory, count(*) as patterns, min(_ID) as first_id, max(PatternPriority) as priority from {PATTERNS.sql} group by 1",
    "dq_rule_listing": f"""select 's.part.name' as FullFieldName, 'L01' as Level, 1 as RuleID, 'length 8..14' as Rule, true as IsAllowed, 'curated' as TargetSchemaName, 'part' as TargetTableName, 'p_name' as TargetFieldName
      union all select 's.part.name', 'L03', _ID, PatternName, false, 'curated', 'part', 'p_name' from {PATTERNS.sql} p where PatternCategory in ('DataEmptiness', 'SpaceFound') or PatternSubCategory = 'Symbol'""",
}
_id_sources = {"masterField": CONFIG_FIELDS.sql, "configFieldValues": CONFIG_VALUES.sql, "configFieldAllowedPattern": CONFIG_RULES.sql, "configCustomQuery": CONFIG_CUSTOM.sql, "mapDQChecks": _map.replace("MappingID", "_ID")}
ORACLES["dq_config_issues"] = " union all ".join(
    [f"select 'duplicate_id' as CheckName, '{t}' as TableName, _ID::varchar as KeyText, count(*) as Count from {sql} x group by _ID having count(*) > 1" for t, sql in _id_sources.items()]
    + [f"select 'duplicate_rule', 'configFieldAllowedPattern', concat_ws('|', FullFieldName, coalesce(PatternCategory, ''), coalesce(PatternSubCategory, ''), coalesce(PatternName, '')), count(*) from {CONFIG_RULES.sql} x group by 3 having count(*) > 1"]
    + [f"select 'unknown_reference', '{t}', FullFieldName, count(*) from {_id_sources[t]} x where FullFieldName not in (select FullFieldName from {CONFIG_FIELDS.sql} f) group by 3" for t in ("configFieldAllowedPattern", "configCustomQuery", "mapDQChecks")]
    + [f"select 'unknown_{c}', 'configFieldAllowedPattern', {c}, count(*) from {CONFIG_RULES.sql} x where {c} is not null and {c} not in (select {c} from {PATTERNS.sql} p) group by 3" for c in ("PatternCategory", "PatternName")]
)
_hint = "case when regexp_matches(column_name, 'name') then {0} when regexp_matches(column_name, 'code|flag|status|priority') then {1} else {2} end"
_typed = "case when column_type in ('INTEGER', 'BIGINT') and regexp_matches(column_name, '(id|key)$') then {0} when column_type = 'DOUBLE' then {1} when column_type = 'TIMESTAMP' then {2} else {3} end"
ORACLES["dq_suggest"] = " union all ".join(
    f"""select '{t}.' || column_name as FullFieldName, column_name as ColumnName, {_typed.format("'reference id'", "'decimal'", "'timestamp'", _hint.format("'name'", "'code'", "'free text'"))} as Kind,
      {_typed.format(17, 15, 21, _hint.format(2, 3, 2))} as CategoryID, {_typed.format("'DataEmptiness'", "'DataEmptiness'", "'DataEmptiness'", _hint.format("'DataEmptiness,InvalidKeyword,FullyDuplicatedCharacter'", "'DataEmptiness,InvalidKeyword'", "'DataEmptiness'"))} as Block from (describe {t})"""
    for t in ("customer", "orders", "events")
)
