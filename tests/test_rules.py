"""The checks against a plain restatement of what they mean."""

import random
import re

import pytest
from pyspark.sql import functions as F

from steward.functions import seed
from steward.functions.mail import VALIDATORS, validator
from steward.operators.assess import Mapping, audit, checked, fields_from, prepared, reset, stats, valid_sql, write_back
from steward.plans.compile import Custom, Field, Rule, compile_field
from steward.queries.quality import BY_ID, rules

VALUES = [
    None, "", " ", "\t", " ", "ab ", "--", "-- --", "n/a", "N/A n/a", "nullx", "zzzz", "1111", "12.5", ".5", "1.", "0", "1", "10:20:99", "24:00:00", "8:15:30.25", "2024-02-30", "20240101", "15 Jan 2024",
    "Jan 5, 2024", "2024-01-01 00:00:00", "2024-01-01 10:00", "2024-01-01T10:00:05.5", "é", "A1", "٣", "٣٣", "😀😀", "a b", " 7 7 ", "x\ny", "null null", "ＡＢ", " em ", "a|b", "..", "'''", "test1234", "aa", "A", "TEST", "²a",
]


def python_check(pattern, value, current, allowed):
    """(failed, next current) of one pattern."""
    i, name, category, _, _, token = pattern
    strip = lambda v: v.strip()
    nospace = None if value is None else strip(value).replace(" ", "")
    digits = r"\d"
    if name == "Is Empty or NULL":
        return not allowed and current in (None, ""), current
    if name == "Is Virtually Empty with Spaces":
        bad = current is not None and (strip(current) == "" or (" " in current and current.find(" ") + 1 == len(current)))
        return not allowed and bad, current
    if category == "DataEmptiness":
        t = nospace or ""
        return not allowed and t != "" and t.replace(token, "") == "", t
    if name == "Has Space":
        return not allowed and " " in (current or ""), current
    if category in ("DataType1", "DataType3") and name != "Is Fully Text":
        if value is None:
            return False, None
        t = strip(value) if name in ("Is Date", "Is Timestamp") else nospace
        month = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
        is_ = {
            "Is Fully Numeric": bool(re.fullmatch(rf"{digits}+", t)),
            "Is Fully Decimal": bool(re.fullmatch(r"[0-9]+\.[0-9]+", t)),
            "Is Boolean": t in ("0", "1"),
            "Is Time": 8 <= len(t) <= 16 and bool(m := re.fullmatch(r"([0-9]{1,2}):([0-9]{2})(:[0-9]{2}(\.[0-9]+)?)?", t)) and int(m[1]) <= 23 and int(m[2]) <= 59,
            "Is Date": any(re.fullmatch(p, t, re.I) for p in (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}/[0-9]{2}/[0-9]{4}", r"[0-9]{2}-[0-9]{2}-[0-9]{4}", rf"[0-9]{{1,2}}\s+{month}\s+[0-9]{{4}}", rf"{month}\s+[0-9]{{1,2}},?\s+[0-9]{{4}}", r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}")),
            "Is Timestamp": bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?", t)),
        }[name]
        return is_ != allowed, t
    if name in ("Is Fully Text", "Is AlphaNumeric"):
        if current is None:
            return False, None
        is_ = not re.search("[0-9]", current) if name == "Is Fully Text" else any(c.isdigit() for c in current) and any(c.isalpha() for c in current)
        return is_ != allowed, current
    if category == "CasingCheck":
        return not allowed and bool(re.search("[a-z]" if "Lower" in name else "[A-Z]", current or "")), current
    if category == "SpecialCharacter":
        return not allowed and token in (current or ""), current
    if category == "InvalidKeyword":
        t = (value or "").lower().strip()
        return not allowed and t != "" and 2 * (len(t) - len(t.replace(token, ""))) >= len(t), t
    t = nospace or ""
    if name == "Has Fully Duplicated Character":
        return not allowed and len(t) > 1 and t == t[0] * len(t) and not t[0].isdecimal(), t
    return not allowed and len(t) > 1 and any(not " " <= c <= "~" for c in t), t


def python_field(ids, value):
    current = value
    for i, allowed in sorted(ids, key=lambda x: (BY_ID[x[0]][4], x[0])):
        bad, current = python_check(BY_ID[i], value, current, allowed)
        if bad:
            return False
    return True


def run(spark, spec, values=VALUES):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return {r["i"]: r["_dq_1"] for r in checked(df, [Mapping(1, "f", "t", "v")], {"f": spec}).collect()}


@pytest.mark.parametrize("group", ["DataType1", "DataType2", "DataType3", "SpecialCharacter", "SpaceFound", "DataEmptiness", "InvalidKeyword", "FullyDuplicatedCharacter", "UnicodeCharacters", "CasingCheck"])
def test_each_pattern(spark, group):
    ids = [i for i, p in BY_ID.items() if p[2] == group]
    ids = ids if len(ids) < 10 else ids[::4]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    maps, fields = [], {}
    for i in ids:
        for allowed in (False, True):
            n = 2 * i + allowed
            maps.append(Mapping(n, str(n), "t", "v"))
            fields[str(n)] = Field(str(n), rules(i, allowed=allowed))
    for r in checked(df, maps, fields).collect():
        for m in maps:
            assert r[f"_dq_{m.id}"]["result"] == python_field([(m.id // 2, bool(m.id % 2))], VALUES[r["i"]]), (BY_ID[m.id // 2], bool(m.id % 2), VALUES[r["i"]])


def test_threaded_forms(spark):
    rng = random.Random(8)
    maps, fields, wanted = [], {}, {}
    for n in range(1, 25):
        ids = [(i, rng.random() < 0.4) for i in rng.sample(sorted(BY_ID), rng.randint(1, 12))]
        maps.append(Mapping(n, str(n), "t", "v"))
        fields[str(n)] = Field(str(n), tuple(r for i, allowed in ids for r in rules(i, allowed=allowed)))
        wanted[n] = ids
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    for r in checked(df, maps, fields).collect():
        for n, ids in wanted.items():
            assert r[f"_dq_{n}"]["result"] == python_field(ids, VALUES[r["i"]]), (ids, VALUES[r["i"]])


def test_first_token_in_rule_order_is_named(spark):
    got = run(spark, Field("f", rules(10, 24, 30)), ["a.b|c", "x!y.", "plain"])
    assert got[0]["log_message"] == "Debug:: The value <a.b|c> has [FAILED]. Rule: Has '|' :<NOT Allowed>"
    assert got[1]["log_message"].endswith("Has '!' :<NOT Allowed>") and got[2]["result"] and got[2]["log_message"] is None


def test_allowed_one_way_rules_cost_nothing():
    c = compile_field(Field("f", rules(*range(10, 42), allowed=True) + rules(60, allowed=True)), "`v`")
    assert c.steps == []


def test_families_are_folded():
    c = compile_field(Field("f", tuple(r for i in BY_ID for r in rules(i))), "`v`")
    assert len(c.steps) <= 20


def test_exact_timestamps(spark):
    values = ["Jan 5 2024 10:00-05:00", "2024-01-01 00:00:00", "2024-01-01 10:00", "10:00", "2024-13-45 99:99", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r["i"]: r["_dq_1"]["result"] for r in checked(df, [Mapping(1, "f", "t", "v")], {"f": Field("f", rules(7, allowed=True))}, exact_timestamps=True).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False, 5: True}


def test_registered_validators(spark):
    def odd(v):
        if v == "boom":
            raise ValueError
        return len(v) % 2 == 1

    df = spark.createDataFrame([(0, "a"), (1, "ab"), (2, "boom"), (3, None)], "i int, v string")
    spec = Field("f", custom=(Custom(1, "PYTHON", "odd", True),))
    got = {r["i"]: r["_dq_1"]["result"] for r in checked(df, [Mapping(1, "f", "t", "v")], {"f": spec}, validators={"odd": odd}).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True}


def test_custom_rules(spark):
    spec = Field("f", custom=(Custom(1, "REGEX", "^[a-z]+$", True), Custom(2, "SQL", "length(@InputValue) > 3", False), Custom(3, "SQL", "@InputValue > cast(null as string)", True), Custom(4, "SQL", "no_such(@InputValue)", True)))
    got = run(spark, spec, ["abc", "abcd", "A", None])
    assert [got[i]["result"] for i in range(4)] == [True, False, False, True]
    assert valid_sql(spark, list(spec.custom))[4] and valid_sql(spark, list(spec.custom))[2] is None


def test_one_sided_bounds(spark):
    assert run(spark, Field("f", length=(3, None)), ["a"])[0]["result"]
    assert not run(spark, Field("f", length=(3, None), one_sided=True), ["a"])[0]["result"]
    assert not run(spark, Field("f", values=(None, "m"), one_sided=True), ["z"])[0]["result"]


def test_mail_validators(spark):
    mails = ["a@b.co", "a@@b.co", "@b.co", "a@b", "a.b.c.d@e.fg", "a@b.c", "a@bb.cc.dd.ee.ff", "a@b..co", "a@b.co.", "a b@c.de", "", None, "NoEmailDress@x.yz", "x@y.zz-", "a@b.co\n", "p@q@r.st"]

    def py(name, v):
        if not v:
            return False
        if name == "email_basic_format":
            return bool(re.match(r"^[^@\s]+@[^@\s]+\.[^@\s]+$", v))
        at, domain = v.find("@"), v.split("@", 1)[1] if "@" in v else ""
        return {
            "email_at_validation": 0 < at < len(v) - 1 and v.count("@") == 1 and "." in domain,
            "email_domain_format": "@" in v and 1 <= domain.count(".") <= 3 and all(len(x) >= 2 for x in domain.split(".")),
            "email_local_part_dots": "@" in v and v.split("@", 1)[0].count(".") < 3,
            "email_no_placeholder": "noemaildress" in v.lower(),
            "email_no_trailing_special": bool(re.search(r"[-._]$", v)),
        }[name]

    df = spark.createDataFrame([(i, m) for i, m in enumerate(mails)], "i int, v string")
    for r in df.select("i", *(F.expr(validator(n, "v")).alias(n) for n in VALIDATORS)).collect():
        assert {n: r[n] for n in VALIDATORS} == {n: py(n, mails[r["i"]]) for n in VALIDATORS}, mails[r["i"]]


def test_seeds():
    found = seed.patterns()
    assert len(found) == 119 and len({p[0] for p in found}) == 119 and len(seed.CATEGORIES) == 27 and len(seed.STAGES) == 7


def test_assessment_end_to_end(spark):
    df = prepared(spark.createDataFrame([(1, "ok", "x"), (2, "", "y"), (3, "no!", None)], "i int, a string, b string"), F.concat(F.lit("row"), F.col("i")))
    maps, fields = [Mapping(1, "fa", "t", "a"), Mapping(2, "fb", "t", "b"), Mapping(3, "none", "t", "i")], {"fa": Field("fa", rules(60, 10)), "fb": Field("fb", rules(60))}
    done = checked(df, maps, fields)
    flags = {r["i"]: r for r in write_back(done, maps).collect()}
    assert flags[1]["DQEligible"] and flags[1]["DQViolations"] is None and flags[1]["DQFields"] == "[a], [b]"
    assert flags[3]["DQViolations"] == "[a: Special Character], [b: Data Emptiness]" and flags[3]["DQEligible"] is False
    assert audit(done, maps, "x").count() == 3
    assert {r["MappingID"]: (r["RowsQualified"], r["RowsDisqualified"]) for r in stats(done, maps, "x").collect()} == {1: (1, 2), 2: (2, 1)}
    again = write_back(done, maps)
    second = write_back(checked(again, maps[:1], {"fa": Field("fa")}), maps[:1])
    assert {r["i"]: r["DQEligible"] for r in second.collect()} == {1: True, 2: False, 3: False}
    assert {r["i"]: r["DQEligible"] for r in reset(second).collect()} == {1: True, 2: None, 3: None}
    assert "Python" not in done._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        checked(df, [Mapping(1, "fa", "t", "zz")], fields)


def test_one_scan_for_all_fields(spark, sf_dir):
    from steward.queries.quality import MAPPINGS, assessed

    plan = stats(assessed(spark, sf_dir, "part"), MAPPINGS["part"], "r")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 1 and "p_retailprice" not in plan


def test_empty_configuration(spark):
    assert fields_from() == {}
    none = spark.createDataFrame([], "i int, v string")
    assert checked(none, [Mapping(1, "f", "t", "v")], {"f": Field("f", rules(60))}).count() == 0


def test_rule_is_hashable():
    assert len({Rule(1, "a", "b", 1, None, True), Rule(1, "a", "b", 1, None, True)}) == 1
