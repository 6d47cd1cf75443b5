"""The five forms a value takes while checks run, as SQL text over one column.

What a check leaves behind for the next one never depends on whether it passed, so the form that each check sees is known when
the rules are compiled.
"""

from __future__ import annotations

RAW, NOSPACE, NOSPACE_EMPTY, STRIP, LOWER_STRIP = "raw", "nospace", "nospace_empty", "strip", "lower_strip"

#: White space as text tools strip it: ASCII, the separators 1C-1F, NEL, NBSP and the Unicode spaces.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"


def literal(text: str) -> str:
    """text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(sql: str) -> str:
    return f"regexp_replace({sql}, {literal(f'^{SPACE_CLASS}+|{SPACE_CLASS}+' + chr(92) + 'z')}, '')"


def state_sql(state: str, column: str) -> str:
    """SQL of a state of a column (quoted already, of type string)."""
    return {
        RAW: column,
        NOSPACE: f"replace({strip(column)}, ' ', '')",
        NOSPACE_EMPTY: f"coalesce(replace({strip(column)}, ' ', ''), '')",
        STRIP: strip(column),
        LOWER_STRIP: f"coalesce(lower({strip(column)}), '')",
    }[state]
