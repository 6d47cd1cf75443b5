"""Language identification: script ranges, then Viterbi over per-word scores with a switching penalty.

Fit: every learnable document is counted, none is sampled. A partition adds up hashed counts of the 3-grams around each letter
per language, and the letters per script, and emits the non-empty ones once (or each time it has met HELD other languages), so what is
shuffled and what the driver gets is bounded by languages x BUCKETS. Every language that has a letter is learned. A language is a candidate for a word only if at least SCRIPT_SHARE of its
letters are in the word's script.

Predict: words get one log score per language (the sum over their 3-grams), a Viterbi pass over the words
labels spans; changing the language between words costs SWITCH. The language with the most letters wins; the score
is its share of all letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_class, in_pandas, map_rows, require, result_columns, saved, schema_with

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SWITCH = 10.0
SCRIPT_SHARE = 0.001
#: Languages that a partition counts, and that the driver takes in, at a time.
HELD = 64
HELD_OUT = (4, 2)
UNKNOWN = "und"

#: First code point of each script range, and its script ("" for none).
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"),
    (0x2E00, "Other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x20000, "Han"), (0x40000, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_script = np.zeros(0x110000, np.uint8)
for _start, _name in SCRIPT_STARTS:
    _script[_start:] = SCRIPTS.index(_name)
_words = regex.compile(r"\p{L}+").findall
_ascii_words = re.compile(r"[a-z]+").findall
#: Longer words (scripts without spaces, junk) are scored by pieces of this many letters, so no letter is left out.
PIECE = 24
#: Characters handled at a time; bounds the memory for texts of any length.
BLOCK = 200_000


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters (Unicode's), long ones cut into pieces."""
    low = text.lower()
    found = _ascii_words(low) if low.isascii() else _words(low)
    if max(map(len, found), default=0) > PIECE:
        found = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def blocks(words: list[str], limit: int = BLOCK) -> Iterator[list[str]]:
    size, low = 0, 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size > limit:
            yield words[low : i + 1]
            size, low = 0, i + 1
    if low < len(words):
        yield words[low:]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a few words: the bucket of the 3-gram around each letter (a space before and after each word), where each word starts
    in these, and each word's script: that of two of its first, middle and last letter, else of the first.
    """
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letter = np.flatnonzero(c != 32)
    wide = c.astype(np.uint64)
    h = wide[letter - 1] * np.uint64(0x9E3779B97F4A7C15) + wide[letter] * np.uint64(0xC2B2AE3D27D4EB4F) + wide[letter + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    starts = np.cumsum(sizes) - sizes
    script = _script[c[letter]]
    first, middle, last = script[starts], script[starts + sizes // 2], script[starts + sizes - 1]
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), starts, np.where((middle == first) | (middle == last), middle, first)


@dataclass
class LanguageModel:
    """langs: sorted names; weights: BUCKETS x langs, log probabilities; allowed: scripts x langs."""

    langs: list[str]
    weights: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row per word: log score per language, 0 for the best; nan where no language has the word's script."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        at = 0
        for part in blocks(words, BLOCK * 16 // max(16, len(self.langs))):
            bucket, starts, script = grams(part)
            sums = np.add.reduceat(self.weights[bucket], starts, axis=0)
            allowed = self.allowed[script]
            sums[~allowed] = -1e6
            sums -= sums.max(axis=1, keepdims=True)
            sums[~allowed.any(axis=1)] = np.nan
            out[at : at + len(part)] = sums
            at += len(part)
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from all rows of docs that have a text and a language.

    A language whose texts have no letter isn't learned. Without any, the model knows none and predicts "und".
    """
    require(docs, text, lang)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pd.DataFrame]:
            for name, n in total.items():
                i = np.flatnonzero(n)
                yield pd.DataFrame({"lang": name, "bucket": i, "n": n[i]})
            total.clear()

        for b in batches:
            for name, t in zip(b["lang"], b["text"], strict=True):
                if name not in total:
                    if len(total) == HELD:
                        yield from counted()
                    total[name] = np.zeros(BUCKETS + len(SCRIPTS), np.int64)
                for part in blocks(words_of(t)):
                    bucket, starts, script = grams(part)
                    sizes = np.diff(starts, append=len(bucket))
                    total[name][:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    total[name][BUCKETS:] += np.bincount(script, sizes, len(SCRIPTS)).astype(np.int64)
        yield from counted()

    counts = saved(map_rows(rows, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    weights, allowed = np.empty((BUCKETS, len(langs)), np.float32), np.empty((len(SCRIPTS), len(langs)), bool)
    for low in range(0, len(langs), HELD):
        some = langs[low : low + HELD]
        got = counts.where(F.col("lang").isin(some)).toPandas()  # HELD x (BUCKETS + scripts) rows at most
        counted = np.zeros((BUCKETS + len(SCRIPTS), len(some)))
        counted[got["bucket"].to_numpy(dtype=int), got["lang"].map({name: i for i, name in enumerate(some)}).to_numpy(dtype=int)] = got["n"].to_numpy(dtype=float)
        seen, scripts = counted[:BUCKETS], counted[BUCKETS:]
        weights[:, low : low + HELD] = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * BUCKETS))
        allowed[:, low : low + HELD] = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    return LanguageModel(langs, weights, allowed)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label per row of scores (rows x labels) when each change of label costs switch; ties: the earlier label.

    The label of the greatest total is best throughout, with no need to search, if no other label gains more than one switch
    over it on any interval (a path that keeps it somewhere and has m other spans changes m times at least), and if
    the best other label of each word, taken together, gains no more than one switch (paths that keep it nowhere).
    """
    total = scores.sum(axis=0)
    best = int(total.argmax())
    other = scores - scores[:, [best]]
    gain = np.cumsum(other, axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros(scores.shape[1], gain.dtype), gain[:-1]]), axis=0)
    if (gain - low).max() <= switch:
        other[:, best] = -np.inf
        if other.max(axis=1).sum() <= switch:
            return np.full(len(scores), best)
    n = scores.shape[1]
    back, v = [], [float(x) for x in scores[0]]
    for row in scores[1:].tolist():
        top = max(v)
        j = v.index(top)
        from_ = [i if v[i] >= top - switch else j for i in range(n)]
        v = [(x if x >= top - switch else top - switch) + r for x, r in zip(v, row, strict=True)]
        back.append(from_)
    path = [v.index(max(v))]
    for from_ in reversed(back):
        path.append(from_[path[-1]])
    return np.array(path[::-1])


class Labeller:
    def __init__(self, model: LanguageModel):
        self.model = model

    def spans(self, text: str | None) -> list[tuple[str, int]]:
        """(language, letters) of each span; "und" where no language fits the script."""
        words = words_of(text or "")
        if not words or not self.model.langs:
            return [(UNKNOWN, sum(map(len, words)))] if words else []
        scores = self.model.word_scores(words)
        sizes = np.fromiter(map(len, words), int, len(words))
        none = np.isnan(scores[:, 0])
        labels = np.full(len(words), len(self.model.langs))
        if not none.all():
            labels[~none] = viterbi(scores[~none])
        cuts = np.r_[0, np.flatnonzero(np.diff(labels)) + 1]
        names = [*self.model.langs, UNKNOWN]
        return [(names[labels[a]], int(n)) for a, n in zip(cuts, np.add.reduceat(sizes, cuts), strict=True)]

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """(language, share of the letters, number of spans).

        A text whose letters are in scripts of no language gets the language of the greatest score all the same, with a share of 0.
        """
        spans = self.spans(text)
        letters: Counter = Counter()
        for name, n in spans:
            letters[name] += n
        if not letters or not self.model.langs:
            return UNKNOWN, 0.0, 0
        name = min(letters, key=lambda x: (x == UNKNOWN, -letters[x], x))
        if name == UNKNOWN:
            total = sum(self.model.weights[grams(part)[0]].sum(axis=0) for part in blocks(words_of(text or "")))
            return self.model.langs[int(np.argmax(total))], 0.0, len(spans)
        return name, letters[name] / sum(letters.values()), len(spans)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs plus lang_pred, score (share of letters in that language) and n_spans.

    Null text, or one without a letter: "und", 0. Letters in scripts of no learned language: some learned one, 0. No other column is read. Repeated rows give equal results; an
    empty table an empty one; names that clash get a suffix. A text is handled whole, at any length.
    """
    require(docs, text)
    names = result_columns(docs, "lang_pred", "score", "n_spans")
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x 4 bytes a language; grows with the labels, not with the rows

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(held.value)
        for b in batches:
            got = [labeller.predict(t) for t in b[text]]
            yield b.assign(**{names[0]: [g[0] for g in got], names[1]: [g[1] for g in got], names[2]: [g[2] for g in got]})

    return in_pandas(docs, label, schema_with(docs, (names[0], T.StringType()), (names[1], T.DoubleType()), (names[2], T.IntegerType())))


def held_out(doc_id):
    """Documents kept from the fit: crc32 of doc_id as text modulo 4 is 2."""
    return crc_class(doc_id, HELD_OUT[0]) == HELD_OUT[1]


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
