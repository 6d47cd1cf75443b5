"""Built-in e-mail validators as SQL text: each says whether a value has the property. Null and '' have none."""

from __future__ import annotations

from .states import literal

def _after_first(v: str) -> str:
    return f"substring({v}, instr({v}, '@') + 1)"


def _dots(sql: str) -> str:
    return f"(length({sql}) - length(replace({sql}, '.', '')))"


VALIDATORS = {
    # something@something.something, one at-sign, no white space; a line break may end it
    "email_basic_format": lambda v: f"{v} rlike {literal('^[^@' + chr(92) + 's]+@[^@' + chr(92) + 's]+' + chr(92) + '.[^@' + chr(92) + 's]+' + chr(92) + 'n?' + chr(92) + 'z')}",
    # one at-sign, neither first nor last, and a dot after it
    "email_at_validation": lambda v: f"(instr({v}, '@') > 1 and instr({v}, '@') < length({v}) and length({v}) - length(replace({v}, '@', '')) = 1 and instr({_after_first(v)}, '.') > 0)",
    # domain with 1 to 3 dots and labels of two characters at least
    "email_domain_format": lambda v: f"(instr({v}, '@') > 0 and {_dots(_after_first(v))} between 1 and 3 and forall(split({_after_first(v)}, '[.]'), l -> length(l) >= 2))",
    # at most two dots before the at-sign
    "email_local_part_dots": lambda v: f"(instr({v}, '@') > 0 and {_dots(f'substring_index({v}, {literal(chr(64))}, 1)')} < 3)",
    # Fixed value: the placeholder
    "email_no_placeholder": lambda v: f"instr(lower({v}), 'noemaildress') > 0",
    "email_no_trailing_special": lambda v: f"{v} rlike {literal('[-._]' + chr(92) + 'n?' + chr(92) + 'z')}",
}


def validator(name: str, v: str) -> str:
    """SQL: whether the value passes; false for null and ''."""
    return f"coalesce({v} <> '' and {VALIDATORS[name](v)}, false)"
