"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs, digits, URL schemes and
identifier cues. At each anchor a small deterministic parser walks left and right over the characters that the kind
allows, and validates what it has walked over. The four base kinds (email, ip, card, phone) give exactly the leftmost
non-overlapping matches of their patterns: an expansion never starts before the end of the kind's last match,
a match that fails its test is dropped and not retried. Spans that only cues can find are added:

* account: an account, passport, tax or insurance number, IBAN, token, key or password after its cue word;
* login: the user:password part of a URL;
* address: house number and street name before or after a street cue;
* secret: a key after one of the prefixes that services give them, a bearer token, a private key between its header and footer.

Spans are code points, end exclusive. A null or empty text has none; a text is searched whole, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_pandas, require, result_columns, schema_with

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login", "address", "secret")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = frozenset("0123456789")
LOCAL = frozenset(LETTERS + "0123456789._%+-")
HOST = frozenset(LETTERS + "0123456789-")
PHONE = frozenset(" ().0123456789-")
SECRET = frozenset(LETTERS + "0123456789_-+/=.~!#$%^&*")
LOGIN = SECRET | {":"}
#: Words before an account or secret; found in lower case, as whole words.
ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "tax id", "routing", "token", "password", "passwd", "api_key", "apikey", "api key", "secret", "konto", "kontonummer", "cuenta", "compte")
SCHEMES = ("://",)
#: What keys begin with, as written; so many characters at least, two of them digits.
KEY_PREFIXES = ("sk-", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "AKIA", "ASIA", "AIza", "eyJ", "hf_", "npm_", "SG.")
LEAST_KEY = 20
KEY = frozenset(LETTERS + "0123456789_-+/=.")
BEARER, PEM = "bearer ", "-----begin "
STREET_AFTER = ("street", "avenue", "road", "boulevard", "lane", "straße", "strasse")
STREET_BEFORE = ("rue ", "calle ", "avenida ")
_house_before = re.compile(r"\d{1,5}[a-z]?,? (?:[^\W\d_]+ ){0,3}\Z", re.I)
_house_after = re.compile(r",? \d{1,5}[a-z]?\b", re.I)
_after_cue = re.compile(r"(?:[ _](?:number|no\.?|nr\.?|is|key))?[ ]?[:=#]?[ ]?[\"']?")
#: A token that ends in a number, and what may follow it: digits, a single space or hyphen between two groups.
_number = re.compile(r"(?:\A|[^A-Za-z0-9])([A-Za-z]{0,4}[0-9]+)\Z")
_groups = re.compile(r"(?: [0-9]++(?:-[0-9]++)*+(?![A-Za-z0-9_+/=~#$%^&*-]|[.!][A-Za-z0-9]))*+")
_iban = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3}(?![A-Za-z0-9]))?")
_name_after = re.compile(r"(?:[^\W\d_]+ ?){1,4}")


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in DIGITS:
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for kind, words in (("account", ACCOUNT_CUES), ("scheme", SCHEMES), ("after", STREET_AFTER), ("before", STREET_BEFORE), ("bearer", (BEARER,)), ("pem", (PEM, PEM.upper())), ("key", sorted({x for p in KEY_PREFIXES for x in (p, p.lower())}))):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def run_right(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address whose at-sign is at at and that starts at floor or later."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_right(text, at + 1, HOST)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := run_right(text, end + 1, HOST)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def ip_at(text: str, at: int) -> tuple[int, int, bool] | None:
    """Four runs of digits joined by dots from at on, and whether each is 255 at most."""
    ends, start, ok = [run_right(text, at, DIGITS)], at, True
    while True:
        part = text[start : ends[-1]].lstrip("0")
        ok = ok and len(part) <= 3 and int(part or "0") <= 255
        if len(ends) == 4:
            return at, ends[-1], ok
        start = ends[-1] + 1
        if text[ends[-1] : start] != "." or (end := run_right(text, start, DIGITS)) == start:
            return None
        ends.append(end)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def card_at(text: str, at: int) -> tuple[int, int, bool] | None:
    """Two digits or more from at on, a space or hyphen between them allowed, and whether they are a card number."""
    end, n = run_right(text, at, DIGITS), len(text)
    while end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
        end = run_right(text, end + 1, DIGITS)
    if end - at < 2:
        return None
    digits = "" if end - at > 40 else text[at:end].replace(" ", "").replace("-", "")
    return at, end, 14 <= len(digits) <= 19 and luhn(digits)


def phone_at(text: str, at: int) -> tuple[int, int, bool] | None:
    """From the plus sign at at: a digit, and so on up to the last digit of the run."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run_right(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return None
    digits = sum(c in DIGITS for c in text[at:end])
    return at, end, 10 <= digits <= 15


def iban_end(text: str, at: int) -> int:
    """The end of the longest run of groups from at on, single spaces between them, that has an IBAN's check digits; at if none has."""
    m, best = _iban.match(text, at), at
    for stop in [i for i in range(at, m.end() + 1) if i == m.end() or text[i] == " "] if m else ():
        found = text[at:stop].replace(" ", "").upper()
        if 15 <= len(found) <= 34 and not text[stop : stop + 1].isalnum() and int("".join(str(int(c, 36)) for c in found[4:] + found[:4])) % 97 == 1:
            best = stop
    return best


def account_at(text: str, end: int, start: int, floor: int) -> tuple[int, int, int, bool] | None:
    """What follows a cue that ends at end (a sign or "number"/"is" may stand between): start, end, how far was walked, and
    whether it is a number or secret. None if it isn't a cue, or if what follows starts before floor.

    After a number (four letters at most, then digits) more groups of digits or of an IBAN may follow, a space between them.
    """
    if start and (text[start - 1].isalnum()) or end < len(text) and text[end].isalnum():
        return None
    at = _after_cue.match(text, end).end()
    if at < floor:
        return None
    walked = stop = run_right(text, at, SECRET)
    while stop > at and text[stop - 1] in ".!":
        stop -= 1
    if stop == walked and (number := _number.search(text[at:stop])):
        groups = _groups.match(text, stop).end()
        stop = walked = max(groups, iban_end(text, at + number.start(1)))
    found = text[at:stop].replace(" ", "")
    return at, stop, walked, 6 <= len(found) and sum(c in DIGITS for c in found) >= 2


def key_at(text: str, start: int, at: int) -> tuple[int, int, bool]:
    """The key from start on, whose characters are looked at from at on; how far was walked, and whether it is one."""
    end = walked = run_right(text, at, KEY)
    while end > at and text[end - 1] in "._-=":
        end -= 1
    return end, walked, end - start >= LEAST_KEY and sum(c in DIGITS for c in text[start:end]) >= 2


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then by kind as in KINDS."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    last = dict.fromkeys(KINDS, 0)
    run = 0  # end of the digit run that was looked at last
    last_foot = 0  # of a private key; negative if there is none further on
    low = text.lower()
    folded = len(low) == len(text)  # a few capitals get longer in lower case; cues are then sought as they stand
    for last_char, (kind, n) in automaton().iter(low if folded else text):
        if kind == "digit":
            if last_char < run or text[last_char] not in DIGITS:
                continue
            run = run_right(text, last_char, DIGITS)
            for name, found in (("ip", ip_at), ("card", card_at)):
                if last_char >= last[name] and (m := found(text, last_char)):
                    last[name] = m[1]
                    if m[2]:
                        out.append((name, m[0], m[1]))
        elif kind == "at":
            if m := email_at(text, last_char, last["email"]):
                last["email"] = m[1]
                out.append(("email", *m))
        elif kind == "plus":
            if last_char >= last["phone"] and (m := phone_at(text, last_char)):
                last["phone"] = m[1]
                if m[2]:
                    out.append(("phone", m[0], m[1]))
        elif kind == "scheme":
            end = last_char + 1
            if end < last["login"]:
                continue
            stop = last["login"] = run_right(text, end, LOGIN)
            if stop < len(text) and text[stop] == "@" and ":" in text[end:stop] and stop > end + 2:
                out.append(("login", end, stop))
        elif kind in ("key", "bearer"):
            start = last_char + 1 - n if kind == "key" else last_char + 1
            # in what was walked over no key starts: it would be a part of what failed, or of what was found
            if start < last["secret"] or kind == "key" and (start and text[start - 1].isalnum() or text[start : last_char + 1] not in KEY_PREFIXES):
                continue
            end, last["secret"], ok = key_at(text, start, last_char + 1)
            if ok:
                out.append(("secret", start, end))
        elif kind == "pem":
            start = last_char + 1 - n
            if start >= last["secret"] and "PRIVATE KEY" in text[start : start + 60]:
                foot = text.find("-----END ", start) if last_foot >= 0 else -1
                last_foot = foot
                stop = text.find("-----", foot + 9, foot + 80) if foot >= 0 else -1
                end = stop + 5 if stop >= 0 else text.find("-----", last_char, last_char + 60) + 5
                if end > start:
                    last["secret"] = end
                    out.append(("secret", start, end))
        elif kind == "account":
            if m := account_at(text, last_char + 1, last_char + 1 - n, last["account"]):
                last["account"] = m[2]  # no number starts in what was walked over (a part of what failed has no more digits); a cue may
                if m[3]:
                    out.append(("account", m[0], m[1]))
        elif kind == "after":
            end, start = last_char + 1, last_char + 1 - n
            if m := _house_before.search(text, max(last["address"], start - 80), start):
                if text[start - 1] == " " and not text[end : end + 1].isalnum():
                    last["address"] = end
                    out.append(("address", m.start(), end))
            elif n >= 6 and start >= last["address"] and (m := _house_after.match(text, end)):
                while start > last["address"] and text[start - 1].isalpha():
                    start -= 1
                last["address"] = m.end()
                out.append(("address", start, m.end()))
        elif m := _house_before.search(text, max(last["address"], last_char - n - 20), last_char + 1 - n):
            if name := _name_after.match(text, last_char + 1):
                last["address"] = name.end()
                out.append(("address", m.start(), name.end()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None) -> str | None:
    """The text with each span, overlapping ones together, replaced by [KIND] of the first."""
    spans = find(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted, then n_account, n_login, n_address, n_secret and n_spans (of all kinds).

    Row by row, no shuffle. Null text: no spans, redacted null. Repeated rows give equal results, an empty table an
    empty one; names that clash get a suffix.
    """
    require(docs, text)
    names = result_columns(docs, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "redacted", *(f"n_{k}" for k in KINDS[len(BASE) :]), "n_spans")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find(t) for t in b[text]]
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            columns = [[sum(s[0] == k for s in spans) for spans in base] for k in BASE]
            columns += [[sha256(joined(spans).encode()).hexdigest() for spans in base], [joined(s) for s in found], [redact(t) if s else t for t, s in zip(b[text], found, strict=True)]]
            columns += [[sum(s[0] == k for s in spans) for spans in found] for k in KINDS[len(BASE) :]] + [[len(s) for s in found]]
            yield b.assign(**dict(zip(names, columns, strict=True)))

    kinds = [T.LongType()] * 4 + [T.StringType()] * 3 + [T.LongType()] * 5
    return in_pandas(docs, scan, schema_with(docs, *zip(names, kinds, strict=True)))
