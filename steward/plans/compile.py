"""Rules of a field as one SQL expression: first failure wins.

The compiler threads the form of the value through the checks at compile time, drops checks that can't fail, and folds
neighbouring tokens of a family into one condition; only in a failing branch is the first token picked for the message. The
whole CASE is one SQL text, so building a plan costs one parse a field, not one call a rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.checks import FOLDED, Check, any_of, check_for, first_of
from ..functions.mail import VALIDATORS, validator
from ..functions.states import RAW, literal, state_sql

RESULT = "struct<result:boolean,violation_type:string,log_message:string>"
PASSED = "named_struct('result', true, 'violation_type', cast(null as string), 'log_message', cast(null as string))"


@dataclass(frozen=True)
class Rule:
    """A resolved pattern rule."""

    pattern_id: int
    name: str
    category: str
    priority: int
    token: str | None
    allowed: bool


@dataclass(frozen=True)
class Custom:
    """A custom rule. kind: REGEX, SQL (text with @InputValue) or PYTHON (name of a validator)."""

    id: int
    kind: str
    expression: str
    allowed: bool


@dataclass(frozen=True)
class Field:
    """Everything that is checked of one field."""

    name: str
    rules: tuple[Rule, ...] = ()
    custom: tuple[Custom, ...] = ()
    length: tuple[int | None, int | None] = (None, None)
    values: tuple[str | None, str | None] = (None, None)
    #: a bound without the other counts too
    one_sided: bool = False


@dataclass
class Compiled:
    """SQL for a column: states (name -> SQL) for a projection below, udfs (name -> function) on the raw value, result."""

    states: dict[str, str] = field(default_factory=dict)
    udfs: dict[str, Callable] = field(default_factory=dict)
    result: str = PASSED
    steps: list[str] = field(default_factory=list)


def failed(violation: str, value: str, rule: str) -> str:
    """The struct of a failure; rule is SQL."""
    message = f"concat('Debug:: The value <', coalesce({value}, 'NULL'), '> has [FAILED]. Rule: ', {rule})"
    return f"named_struct('result', false, 'violation_type', {literal(violation)}, 'log_message', {message})"


def label(allowed: bool) -> str:
    return ":<Allowed>" if allowed else ":<NOT Allowed>"


def _condition(check: Check, v: str, token: str | None, allowed: bool) -> str | None:
    """SQL of the failure; null counts as no failure but for the empty check. None: can't fail."""
    holds = check.holds(v, token)
    if check.null_fails:
        return None if allowed else f"({v} is null or {holds})"
    if allowed:
        return f"not {holds}" if check.two_way else None
    return holds


def _range(v: str, low, high, one_sided: bool, show: Callable) -> str | None:
    if low is not None and high is not None:
        return f"not ({v} between {show(low)} and {show(high)})"
    if one_sided and (low is not None or high is not None):
        return f"{v} < {show(low)}" if low is not None else f"{v} > {show(high)}"
    return None


def compile_field(spec: Field, column: str, prefix: str = "_s", validators: dict[str, Callable] | None = None, exact_timestamps: bool = False) -> Compiled:
    """SQL of the result struct for a string column.

    column is quoted SQL; the states it needs are to be projected under their names first. exact_timestamps: a date parser (Arrow
    batches) decides what a timestamp is; otherwise its ISO shapes do, within the JVM.
    """
    out, branches = Compiled(), []

    def form(state: str) -> str:
        if state == RAW:
            return column
        name = f"{prefix}_{state}"
        out.states[name] = state_sql(state, column)
        return f"`{name}`"

    def add(condition: str, result: str, step: str) -> None:
        branches.append(f"when {condition} then {result}")
        out.steps.append(step)

    bad_length = _range(f"length({column})", *spec.length, spec.one_sided, str)
    if bad_length:
        add(bad_length, failed("Data Length", column, "'Data Length is NOT within the desired range'"), "L01 length")
    for c in sorted(spec.custom, key=lambda c: c.id):
        if c.kind.upper() == "SQL":
            continue
        holds = custom_sql(c, column, out, prefix, validators or {})
        end = "is/are NOT matched but is desired to be mandatorily :<Allowed>" if c.allowed else "is/are matched but this is :<NOT Allowed>"
        if holds is None:
            add(f"{column} is not null", failed("Custom Query", column, literal(f"Custom Query Condition(s) of ID [{c.id}] is/are NOT DEFINED and is :<Unknown>")), f"L02 {c.id} unknown")
            continue
        add(f"{column} is not null and {'not ' if c.allowed else ''}coalesce({holds}, {'false' if c.allowed else 'true'})", failed("Custom Query", column, literal(f"Custom Query Condition(s) of ID [{c.id}] {end}")), f"L02 {c.id}")

    state = RAW
    known = [(r, check) for r in sorted(spec.rules, key=lambda r: (r.priority, r.pattern_id)) if (check := check_for(r.category, r.name, r.token))]
    i = 0
    while i < len(known):
        r, check = known[i]
        state = check.reads or state
        v = form(state)
        if check.family in FOLDED:
            tokens = []
            while i < len(known) and known[i][1] is check:
                if not known[i][0].allowed:
                    tokens.append(known[i][0].token)
                i += 1
            if tokens:
                pre, post = check.label("\0").split("\0")
                name = f"concat({literal(pre)}, {first_of(check, v, tokens)}, {literal(post + ' ' + label(False))})"
                add(any_of(check, v, tokens), failed(check.violation, v, name), f"L03 {check.family} x{len(tokens)}")
            continue
        i += 1
        if check.family == "timestamp" and exact_timestamps:
            out.udfs[f"{prefix}_is_timestamp"] = is_timestamp
            condition = f"{'not ' if r.allowed else ''}`{prefix}_is_timestamp`"
        else:
            condition = _condition(check, v, r.token, r.allowed)
        if condition:
            add(condition, failed(check.violation, v, literal(f"{check.label(r.token)} {label(r.allowed)}")), f"L03 {check.family}")

    bad_value = _range(column, *spec.values, spec.one_sided, lambda x: literal(str(x)))
    if bad_value:
        add(bad_value, failed("Data Value Range", column, "'Data Value is NOT within the desired range'"), "L04 range")
    for c in sorted(spec.custom, key=lambda c: c.id):
        if c.kind.upper() == "SQL" and c.expression:
            holds = f"cast(({c.expression.replace('@InputValue', column)}) as boolean)"
            end = "is/are NOT matched but is desired to be mandatorily :<Allowed>" if c.allowed else "is/are matched but this is :<NOT Allowed>"
            add(f"{column} is not null and {'not ' if c.allowed else ''}{holds}", failed("Custom Query", column, literal(f"Custom Query Condition(s) of ID [{c.id}] {end}")), f"L02 SQL {c.id}")
    if branches:
        out.result = f"case {' '.join(branches)} else {PASSED} end"
    return out


def custom_sql(c: Custom, column: str, out: Compiled, prefix: str, validators: dict[str, Callable]) -> str | None:
    """SQL of a REGEX or PYTHON rule's condition; None if nothing is known of it."""
    kind = c.kind.upper()
    if kind == "REGEX":
        return f"{column} rlike {literal(c.expression)}"
    if c.expression in validators:
        name = f"{prefix}_udf{c.id}"
        out.udfs[name] = batch(validators[c.expression])
        return f"`{name}`"
    if c.expression in VALIDATORS:
        return validator(c.expression, column)
    if kind not in ("PYTHON",) and any(x in c.expression for x in "^$[]\\*+?(){}|"):
        return f"{column} rlike {literal(c.expression)}"
    return None


def batch(check: Callable[[str], bool]) -> Callable:
    """A value-by-value validator as an Arrow-batched function; an exception counts as unknown (null)."""

    def one(value):
        try:
            return None if value is None else bool(check(value))
        except Exception:
            return None

    return lambda s: s.map(one).astype("object")


def is_timestamp(s):
    """Whether a date parser reads a value that has a colon and a hyphen, with a time other than midnight or a fraction."""
    from dateutil import parser

    def one(value):
        if value is None:
            return None
        value = value.strip()
        if ":" not in value or "-" not in value:
            return False
        try:
            t = parser.parse(value)
        except (ValueError, OverflowError):
            return False
        return bool(t.hour or t.minute or t.second or "." in value)

    return s.map(one).astype("object")


def apply(df, columns: Iterable[tuple[str, Compiled, str]]):
    """df plus a result struct for each (column name, compiled, result name), in two projections and no other pass."""
    columns = list(columns)
    below = {}
    for name, c, _ in columns:
        below |= {k: F.expr(v) for k, v in c.states.items()}
        for k, f in c.udfs.items():
            below[k] = F.pandas_udf(f, "boolean")(F.col(f"`{name}`").cast("string"))
    out = df.withColumns(below) if below else df
    return out.withColumns({result: F.expr(c.result) for _, c, result in columns}).drop(*below)
