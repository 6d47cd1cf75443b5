"""Pattern checks as SQL text.

A check has a form it reads (None: whatever the check before left), a failure condition over that form, a violation type
and a label. Two-way checks fail for the opposite when allowed; one-way checks can't fail when allowed, and only change
the form that the next check sees.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from .states import LOWER_STRIP, NOSPACE, NOSPACE_EMPTY, SPACE_CLASS, STRIP, literal

DIGITS = r"\p{Nd}²³¹⁰⁴-⁹₀-₉"
MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DATES = [r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}/[0-9]{2}/[0-9]{4}", r"[0-9]{2}-[0-9]{2}-[0-9]{4}", rf"[0-9]{{1,2}}\s+{MONTH}\s+[0-9]{{4}}", rf"{MONTH}\s+[0-9]{{1,2}},?\s+[0-9]{{4}}", r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"]
TIME = r"(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-9]{2}(?:\.[0-9]+)?)?"
#: Timestamps by their shape, where no date parser is at hand.
TIMESTAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?"


def matches(v: str, pattern: str, whole: bool = True) -> str:
    return f"{v} rlike {literal(f'^(?:{pattern})' + chr(92) + 'z' if whole else pattern)}"


@dataclass(frozen=True)
class Check:
    """family: checks of one family that see the same form are folded into one condition."""

    family: str
    violation: str
    label: Callable[[str | None], str]
    reads: str | None
    #: SQL of the condition that the check is about, from the SQL of the form and the token
    holds: Callable[[str, str | None], str]
    two_way: bool = False
    #: null values are exempt (two-way checks) or count as failing (the empty check)
    null_fails: bool = False


def _named(name: str) -> Callable[[str | None], str]:
    return lambda token: name


def half(v: str, k: str, plain: bool) -> str:
    """SQL: k makes up half of v or more. Bytes are counted where that is the same (plain: k is ASCII): they are known without a look
    at the text, whose characters are counted last, and only if k has an eighth of the bytes.
    """
    size = "octet_length" if plain else "length"
    gone = f"({size}({v}) - {size}(replace({v}, {k}, '')))"
    return f"contains({v}, {k}) and " + (f"8 * {gone} >= octet_length({v}) and " if plain else "") + f"2 * {gone} >= length({v})"


def _keyword(v: str, k: str | None) -> str:
    k = (k or "").lower()
    return f"({v} <> '' and {half(v, literal(k), k.isascii())})"


#: By pattern name, or by category where the name has a token.
CHECKS: dict[str, Check] = {
    "Is Empty or NULL": Check("empty", "Data Emptiness", _named("Is Empty or NULL"), None, lambda v, k: f"{v} = ''", null_fails=True),
    "Is Virtually Empty with Spaces": Check("spaces", "Data Emptiness", _named("Is Virtually Empty with Spaces"), None, lambda v, k: f"({matches(v, SPACE_CLASS + '*')} or (instr({v}, ' ') > 0 and instr({v}, ' ') = length({v})))"),
    "Has Space": Check("space", "Space Found", _named("Has Space"), None, lambda v, k: f"instr({v}, ' ') > 0"),
    "Is Fully Numeric": Check("numeric", "Data Type", _named("Is Fully Numeric"), NOSPACE, lambda v, k: matches(v, r"\p{Nd}+"), True),
    "Is Fully Decimal": Check("decimal", "Data Type", _named("Is Fully Decimal"), NOSPACE, lambda v, k: matches(v, r"[0-9]+\.[0-9]+"), True),
    "Is Boolean": Check("boolean", "Data Type", _named("Is Boolean"), NOSPACE, lambda v, k: f"{v} in ('0', '1')", True),
    "Is Time": Check("time", "Data Type", _named("Is Time"), NOSPACE, lambda v, k: f"(length({v}) between 8 and 16 and {matches(v, TIME)})", True),
    "Is Date": Check("date", "Data Type", _named("Is Date"), STRIP, lambda v, k: matches(v, "(?i)" + "|".join(DATES)), True),
    "Is Timestamp": Check("timestamp", "Data Type", _named("Is Timestamp"), STRIP, lambda v, k: matches(v, TIMESTAMP), True),
    "Is Fully Text": Check("text", "Data Type", _named("Is Fully Text"), None, lambda v, k: f"not {matches(v, '[0-9]', False)}", True),
    "Is AlphaNumeric": Check("alphanumeric", "Data Type", _named("Is AlphaNumeric"), None, lambda v, k: f"({matches(v, f'[{DIGITS}]', False)} and {matches(v, chr(92) + 'p{L}', False)})", True),
    "Has Lowercase Character": Check("lower", "Casing Issue", _named("Has Lowercase Character"), None, lambda v, k: matches(v, "[a-z]", False)),
    "Has Uppercase Character": Check("upper", "Casing Issue", _named("Has Uppercase Character"), None, lambda v, k: matches(v, "[A-Z]", False)),
    "Has Fully Duplicated Character": Check("duplicated", "Fully Duplicated Character", _named("Has Fully Duplicated Character"), NOSPACE_EMPTY, lambda v, k: f"{v} rlike {literal('(?s)^(' + chr(92) + 'P{Nd})' + chr(92) + '1+' + chr(92) + 'z')}"),
    "Has Unicode Characters": Check("unicode", "Unicode Characters", _named("Has Unicode Characters"), NOSPACE_EMPTY, lambda v, k: f"(length({v}) > 1 and {matches(v, r'[^ -~]', False)})"),
}
BY_CATEGORY: dict[str, Check] = {
    "DataEmptiness": Check("char", "Data Emptiness", lambda k: f"Is Virtually Empty with '{k}'", NOSPACE_EMPTY, lambda v, k: f"({v} <> '' and replace({v}, {literal(k or '')}, '') = '')"),
    "SpecialCharacter": Check("special", "Special Character", lambda k: f"Has '{k}'", None, lambda v, k: f"instr({v}, {literal(k or '')}) > 0"),
    "InvalidKeyword": Check("keyword", "Invalid Keyword", lambda k: f"Has Keyword-'{k}'", LOWER_STRIP, _keyword),
}
#: Families whose tokens are folded: one condition for all of them, then the first token in rule order for the message.
FOLDED = ("char", "special", "keyword")


def check_for(category: str, name: str, token: str | None) -> Check | None:
    """The check of a pattern; None for a pattern that nothing is known of (it is skipped)."""
    if name in CHECKS:
        return CHECKS[name]
    return BY_CATEGORY.get(category) if token else None


def any_of(check: Check, v: str, tokens: list[str]) -> str:
    """SQL: the condition holds for one of the tokens, at the price of one pass over the value."""
    if check.family == "keyword":
        return f"({v} <> '' and exists({array(tokens, True)}, k -> {half(v, 'k', ''.join(tokens).lower().isascii())}))"
    escaped = [re.sub(r"([^\w\s])", r"\\\1", t) for t in tokens]
    if check.family == "char":
        return f"({v} <> '' and {matches(v, '|'.join(f'(?:{e})+' for e in escaped))})"
    return f"({matches(v, '|'.join(escaped), False)})"


def first_of(check: Check, v: str, tokens: list[str]) -> str:
    """SQL: the first token, in rule order, that the condition holds for."""
    condition = {
        "char": f"replace({v}, k, '') = ''",
        "special": f"instr({v}, k) > 0",
        "keyword": half(v, "lower(k)", "".join(tokens).lower().isascii()),
    }[check.family]
    return f"element_at(filter({array(tokens)}, k -> {condition}), 1)"


def array(tokens: list[str], lower: bool = False) -> str:
    return "array(" + ", ".join(literal(t.lower() if lower else t) for t in tokens) + ")"
