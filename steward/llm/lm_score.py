"""Masked pseudo-likelihood: a bidirectional window network in numpy predicts every token from both of its sides.

Tokens: the most frequent words of the corpus (all words of all documents are counted; as many as the root of the number of words
divided by GROWTH, MOST_WORDS at most), others in hash buckets, half as many; a boundary token on both sides of a document.
Network: the embeddings of the SIDE tokens before and after, one table for each place, are added and pass a tanh layer. Two
softmax layers over it give first a class and then the token within its class, so that the context decides between any two tokens.
Classes have near equal shares of the corpus, frequent tokens first; there are as many as the root of the number of tokens. A
word that shares a bucket has an equal part of the bucket. A document's score is the sum of log p(token | the tokens on both sides)
over all its tokens.

Training covers every token: each partition starts from the same weights (without context, a token has its share of the
corpus), goes once over all its tokens, and sends weights and number of tokens; their mean, weighted by tokens, is the next
round's start. Weights are added up in rounds of streamed partial sums, so that no task holds more than two of them. What is
counted, and the network up to its bound, grow with the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nsmallest
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import REMEMBERED, in_pandas, require, result_columns, saved, schema_with

#: Words for each squared word of the vocabulary; least and greatest number of words; hash values of the others, folded to as many buckets as are used.
GROWTH, LEAST_WORDS, MOST_WORDS, HASHES = 64, 256, 1 << 15, 1 << 14
SIDE = 2
HIDDEN = 16
#: Tokens of a step, for each class.
STEP = 128
RATE = 0.3
ROUNDS = 1
FAN_IN = 32
#: Scores are cut off here, where their exponentials stay far from the greatest 32-bit number.
HIGHEST = np.float32(60)
#: Different words that a partition counts before it sends them, and groups that words are sent in.
COUNTED, GROUPS = 150_000, 1024
#: What separates words, outside of ASCII; in it, as a table of bytes.
_apart = re.compile(r"[^\w\x00-\x7f]+").sub
_ascii = bytes(i if i > 127 or chr(i).isalnum() or chr(i) == "_" else 32 for i in range(256))
PLACES = 2 * SIDE


def _words(text: str) -> list[str]:
    r"""What re.findall(r"\w+", text) finds, in less time."""
    if not text.isascii():
        text = _apart(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_ascii).decode("utf-8", "surrogatepass").split()


def hash_of(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % HASHES


@dataclass
class Lexicon:
    """Tokens are numbered by falling count. ids: of the frequent words; buckets: the token of each bucket; counts, and
    parts (the different words that share a token), by token.
    """

    ids: dict[str, int]
    buckets: np.ndarray
    counts: np.ndarray
    parts: np.ndarray
    starts: np.ndarray = field(init=False)  # first token of each class, and the number of tokens
    classes: np.ndarray = field(init=False)
    share: np.ndarray = field(init=False)

    def __post_init__(self):
        n = self.counts + 1.0
        before = (np.cumsum(n) - n) / n.sum()
        _, first, self.classes = np.unique((before * max(1, int(len(n) ** 0.5))).astype(np.int32), return_index=True, return_inverse=True)
        self.starts = np.r_[first, len(n)]
        self.share = -np.log(np.maximum(1, self.parts)).astype(np.float32)

    @property
    def edge(self) -> int:
        """The boundary token; predicted never."""
        return len(self.counts)

    def look(self) -> dict:
        buckets = self.buckets.tolist()

        class Look(dict):
            def __missing__(look, word):
                if len(look) >= REMEMBERED:
                    look.clear()
                    look.update(self.ids)
                value = look[word] = buckets[hash_of(word) % len(buckets)]
                return value

        return Look(self.ids)


def ids_of(text: str | None, look: dict) -> np.ndarray:
    words = _words(text.lower()) if text else []
    return np.fromiter(map(look.__getitem__, words), np.uint16, len(words))


def joined(texts, edge_token: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token ids with SIDE edges around each text, text number of each or -1 for an edge), a few texts at a time; texts: arrays of ids."""
    ids, owner, size = [], [], 0
    edge, none = np.full(SIDE, edge_token, np.uint16), np.full(SIDE, -1)
    for i, t in enumerate(texts):
        ids += [edge, t]
        owner += [none, np.full(len(t), i)]
        size += len(t)
        if size > 200_000:
            yield np.concatenate([*ids, edge]), np.concatenate([*owner, none])
            ids, owner, size = [], [], 0
    if size:
        yield np.concatenate([*ids, edge]), np.concatenate([*owner, none])


def read(column, look: dict | None) -> Iterator[np.ndarray]:
    """Arrays of ids of a column of texts, or of ids as bytes."""
    for t in column:
        yield np.frombuffer(t, np.uint16) if isinstance(t, (bytes, bytearray)) else ids_of(t, look)


def taken(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """table[rows], in less time where rows are short; no row is out of bounds."""
    return table.take(rows, axis=0, mode="clip")


def row_sums(z: np.ndarray) -> np.ndarray:
    """By a matrix product, which is faster than a sum over short rows."""
    return z @ np.ones(z.shape[1], np.float32)


class Network:
    def __init__(self, known: Lexicon, weights: np.ndarray | None = None):
        self.known, n, c = known, len(known.counts), len(known.starts) - 1
        shapes = [(PLACES, n + 1, HIDDEN), (HIDDEN + 1, c), (n, HIDDEN + 1)]  # the hidden layer ends in 1, so biases are weights of it
        ends = np.cumsum([int(np.prod(x)) for x in shapes])
        self.all = np.zeros(ends[-1], np.float32) if weights is None else np.array(weights, np.float32)
        self.seen = np.full_like(self.all, 1e-3)
        views = lambda flat: [part.reshape(x) for part, x in zip(np.split(flat, ends[:-1]), shapes, strict=True)]
        (self.embed, self.out_all, self.word_all), self.memory = views(self.all), views(self.seen)
        self.out, self.bias = self.out_all[:HIDDEN], self.out_all[HIDDEN]
        self.word, self.word_bias = self.word_all[:, :HIDDEN], self.word_all[:, HIDDEN]
        if weights is None:
            rng = np.random.default_rng(7)
            for x in (self.embed, self.out, self.word):
                x[:] = rng.normal(0, 0.1, x.shape)
            share = known.counts + 1.0
            mass = np.add.reduceat(share, known.starts[:-1])
            self.bias[:] = np.log(mass / mass.sum())
            self.word_bias[:] = np.log(share / mass[known.classes])

    @staticmethod
    def context(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.stack([ids[at + s] for s in (*range(-SIDE, 0), *range(1, SIDE + 1))])  # 16 bits: sorted by radix

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden layer, with a 1 behind it, and the log scores of the classes."""
        h = taken(self.embed[0], context[0])
        for table, c in zip(self.embed[1:], context[1:], strict=True):
            h += taken(table, c)
        out = np.ones((len(h), HIDDEN + 1), np.float32)
        np.tanh(h, out=out[:, :HIDDEN])
        return out, self.scores(out, self.out_all, self.high(self.out_all, 0).any())

    @staticmethod
    def scores(h: np.ndarray, out: np.ndarray, high: bool) -> np.ndarray:
        z = h @ out
        return np.minimum(z, HIGHEST, out=z) if high else z

    @staticmethod
    def high(weights: np.ndarray, axis: int) -> np.ndarray:
        """Where scores may be beyond HIGHEST: the hidden layer is within -1 and 1 (a weight that is no number counts as high)."""
        return ~(np.abs(weights).sum(axis=axis) < HIGHEST)

    def by_class(self, token: np.ndarray) -> np.ndarray:
        return np.argsort(self.known.classes[token].astype(np.uint16), kind="stable")

    def within(self, token: np.ndarray) -> Iterator[tuple[slice, int, int]]:
        """(rows, first token, end) of each class of several tokens; token: in the order of classes."""
        classes = self.known.classes[token]
        cuts = np.flatnonzero(np.diff(classes, prepend=-1))
        for low, high in zip(cuts, [*cuts[1:], len(token)], strict=True):
            a, b = self.known.starts[classes[low] : classes[low] + 2]
            if b > a + 1:
                yield slice(low, high), a, b

    def log_probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        order = self.by_class(token)
        token = token[order]
        h, z = self.forward(context.take(order, axis=1))
        p = z[np.arange(len(token)), self.known.classes[token]] - np.log(row_sums(np.exp(z, out=z)))
        high = self.high(self.word_all, 1)
        for rows, a, b in self.within(token):
            z = self.scores(h[rows], self.word_all[a:b].T, high[a:b].any())
            p[rows] += z[np.arange(len(z)), token[rows] - a] - np.log(row_sums(np.exp(z, out=z)))
        out = np.empty_like(p)
        out[order] = p + self.known.share[token]
        return out

    @staticmethod
    def softmax_error(z: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
        np.exp(z, out=z)
        z *= (np.float32(1 / n) / row_sums(z))[:, None]
        z[np.arange(len(right)), right] -= np.float32(1 / n)
        return z

    def move(self, place: int, rows, gradient: np.ndarray) -> None:
        """A step for some rows of a table, each weight's scaled by what it has seen."""
        seen, table = self.memory[place], (self.embed, self.out_all, self.word_all)[place]
        now = seen[rows] + gradient * gradient
        seen[rows] = now
        np.sqrt(now, out=now)
        gradient *= RATE
        gradient /= now
        table[rows] -= gradient

    def move_rows(self, k: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        """move() for rows of the k-th table of embeddings."""
        seen, table = self.memory[0][k], self.embed[k]
        now = taken(seen, rows)
        now += gradient * gradient
        seen[rows] = now
        np.sqrt(now, out=now)
        gradient *= RATE
        gradient /= now
        table[rows] = taken(table, rows) - gradient

    def learn(self, context: np.ndarray, token: np.ndarray) -> None:
        """One step on a batch of tokens: gradient of the mean log probability."""
        order = self.by_class(token)
        token, context = token[order], context.take(order, axis=1)
        h, z = self.forward(context)
        z = self.softmax_error(z, self.known.classes[token], len(token))
        dh = z @ self.out_all.T
        self.move(1, slice(None), h.T @ z)
        high = self.high(self.word_all, 1)
        for rows, a, b in self.within(token):
            mine = h[rows]
            z = self.softmax_error(self.scores(mine, self.word_all[a:b].T, high[a:b].any()), token[rows] - a, len(token))
            dh[rows] += z @ self.word_all[a:b]
            self.move(2, slice(a, b), z.T @ mine)
        dh, h = np.ascontiguousarray(dh[:, :HIDDEN]), h[:, :HIDDEN]
        dh *= 1 - h * h
        for k, c in enumerate(context):
            order = np.argsort(c, kind="stable")
            first = np.flatnonzero(np.diff(c[order].astype(np.int32), prepend=-1))
            self.move_rows(k, c[order][first], np.add.reduceat(taken(dh, order), first, axis=0))


def steps(known: Lexicon, at: np.ndarray) -> Iterator[np.ndarray]:
    size = STEP * (len(known.starts) - 1)
    for i in range(0, len(at), size):
        yield at[i : i + size]


def lexicon(docs: DataFrame, text: str) -> Lexicon:
    """All words of all texts are counted.

    A partition sends each word once for every COUNTED different ones it has met, packed by a hash of the word into GROUPS rows; a
    reducer adds up one group at a time and keeps the MOST_WORDS most frequent words, and for each hash its words and their sum.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()

        def packed() -> pd.DataFrame:
            groups: dict[int, list[str]] = {}
            for w, n in c.items():
                groups.setdefault(crc32(w.encode("utf-8", "surrogatepass")) // HASHES % GROUPS, []).append(f"{w} {n}")
            c.clear()
            return pd.DataFrame({"g": pd.Series([*groups], dtype="int64"), "words": pd.Series([" ".join(x) for x in groups.values()], dtype=object)})

        for b in batches:
            for t in b["text"]:
                c.update(_words(t.lower()) if t else ())
                if len(c) > COUNTED:
                    yield packed()
        yield packed()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, parts, top = np.zeros(HASHES, np.int64), np.zeros(HASHES, np.int64), []
        now, c = None, Counter()

        def close() -> None:
            nonlocal top
            for w, n in c.items():
                h = hash_of(w)
                sums[h] += n
                parts[h] += 1
            top += [(-n, w) for w, n in c.items()]
            if len(top) > 4 * MOST_WORDS:
                top = nsmallest(MOST_WORDS, top)
            c.clear()

        for b in batches:
            for g, words in zip(b["g"], b["words"], strict=True):
                if g != now:
                    close()
                    now = g
                found = words.split(" ")
                for w, n in zip(found[::2], found[1::2], strict=True):
                    c[w] += int(n)
        close()
        top, i = nsmallest(MOST_WORDS, top), np.flatnonzero(sums)
        yield pd.DataFrame({"word": [w for _, w in top] + [None] * len(i), "h": [hash_of(w) for _, w in top] + i.tolist(), "n": [-n for n, _ in top] + sums[i].tolist(), "parts": [1] * len(top) + parts[i].tolist()}).astype({"word": object, "h": "int64", "n": "int64", "parts": "int64"})

    packs = in_pandas(docs.select(F.col(text).cast("string").alias("text")), count, "g long, words string")
    spread = packs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g")
    counts = saved(in_pandas(spread, add, "word string, h long, n long, parts long"))
    total, parts = np.zeros(HASHES), np.zeros(HASHES)
    for r in counts.where("word is null").groupBy("h").agg(F.sum("n").alias("n"), F.sum("parts").alias("parts")).collect():
        total[r["h"]], parts[r["h"]] = r["n"], r["parts"]
    wanted = min(MOST_WORDS, max(LEAST_WORDS, int((total.sum() / GROWTH) ** 0.5)))
    top = counts.where("word is not null").orderBy(F.desc("n"), "word").limit(wanted).collect()
    for r in top:  # frequent words have tokens of their own
        total[r["h"]] -= r["n"]
        parts[r["h"]] -= 1
    buckets = min(HASHES, 1 << (wanted // 2).bit_length() - 1)  # a power of two: hash values are folded
    n = np.r_[[float(r["n"]) for r in top], total.reshape(-1, buckets).sum(axis=0)]
    several = np.r_[np.ones(len(top)), parts.reshape(-1, buckets).sum(axis=0)]
    order = np.argsort(-n, kind="stable")
    place = np.argsort(order, kind="stable")
    return Lexicon({r["word"]: int(place[i]) for i, r in enumerate(top)}, place[len(top) :].astype(np.uint16), n[order], several[order])


def encoded(docs: DataFrame, known: Lexicon, text: str) -> DataFrame:
    """docs with ids (two bytes a token) in the place of the text, so that it is cut into words once."""
    held = docs.sparkSession.sparkContext.broadcast(known)  # MOST_WORDS words and HASHES buckets at most
    shape = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in docs.schema.fields])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = held.value.look()
        for b in batches:
            yield b.assign(**{text: [ids_of(t, look).tobytes() for t in b[text]]})

    return in_pandas(docs, work, shape)


def train(docs: DataFrame, text: str, known: Lexicon, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after rounds over every token of docs; the column has texts, or ids from encoded()."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"))
    weights = Network(known).all
    shape = "weights binary, n double"

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n = 0.0, 0.0
        for b in batches:
            for w, k in zip(b["weights"], b["n"], strict=True):
                s, n = s + np.frombuffer(w, np.float32) * np.float64(k), n + k
        if n:
            yield pd.DataFrame({"weights": [(s / n).astype(np.float32).tobytes()], "n": [n]})

    for _ in range(rounds):
        held = spark.sparkContext.broadcast((known, weights))  # bounded by the network's size

        def learn(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            known, weights = held.value
            net, look, n = Network(known, weights), known.look(), 0
            for b in batches:
                for ids, owner in joined(read(b["text"], look), known.edge):
                    at = np.flatnonzero(owner >= 0)
                    for part in steps(known, at[np.random.default_rng(len(at)).permutation(len(at))]):
                        net.learn(net.context(ids, part), ids[part].astype(np.int64))
                    n += len(at)
            if n:
                yield pd.DataFrame({"weights": [net.all.tobytes()], "n": [float(n)]})

        sums = saved(in_pandas(rows, learn, shape))
        left = sums.count()
        while left > 1:
            left = -(-left // FAN_IN)
            sums = in_pandas(sums.repartition(left), total, shape)
        got = sums.collect()  # one row of the network's size
        if got:
            weights = np.frombuffer(got[0]["weights"], np.float32)
    return weights


def score(docs: DataFrame, known: Lexicon, weights: np.ndarray, text: str = "text") -> DataFrame:
    """docs plus n_tokens, log_likelihood (sum over all tokens) and mean_log_likelihood.

    Null texts and texts without a word: 0, 0.0 and null. Repeated rows give equal results, an empty table an empty
    one; names that clash get a suffix. A long text is scored whole.
    """
    require(docs, text)
    names = result_columns(docs, "n_tokens", "log_likelihood", "mean_log_likelihood")
    held = docs.sparkSession.sparkContext.broadcast((known, weights))  # bounded by the network's size

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, weights = held.value
        net, look = Network(known, weights), known.look()
        for b in batches:
            n, total = np.zeros(len(b), np.int64), np.zeros(len(b))
            for ids, owner in joined(read(b[text], look), known.edge):
                for part in steps(known, np.flatnonzero(owner >= 0)):
                    p = net.log_probability(net.context(ids, part), ids[part].astype(np.int64))
                    low = owner[part[0]]
                    sums = np.bincount(owner[part] - low, p)
                    total[low : low + len(sums)] += sums
                    n[low : low + len(sums)] += np.bincount(owner[part] - low)
            with np.errstate(invalid="ignore"):
                yield b.assign(**{names[0]: n, names[1]: total, names[2]: pd.Series(total / n, index=b.index).astype(object).where(n > 0, None)})

    return in_pandas(docs, work, schema_with(docs, (names[0], T.LongType()), (names[1], T.DoubleType()), (names[2], T.DoubleType())))


def score_corpus(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Train on all of docs, then score all of docs: the other columns of docs, n_tokens, log_likelihood and mean_log_likelihood.

    Null, empty, long and repeated texts, clashing names and empty tables are as score() says; all of them are trained on.
    """
    require(docs, text)
    known = lexicon(docs, text)
    ids = saved(encoded(docs, known, text))
    return score(ids, known, train(ids, text, known, rounds), text).drop(text)
