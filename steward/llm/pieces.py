"""The piece lattice that token counting and n-best segmentation share.

Vocabulary: the pieces and scores of a SentencePiece model file (its path is a parameter). The file's bytes are read on
the driver and broadcast (the file bounds their size); executors need no local file. Scores are used as a unigram
model's log probabilities, in 64-bit arithmetic.

Normalisation is the file's own: spaces become U+2581, and one is put in front. A character that isn't a piece, and a literal
U+2581 of the text, costs the least score less 10 and is spelled as its UTF-8 bytes, so that decoding gives the text back exactly.

A text is cut where no piece of the vocabulary reaches over: around characters that no piece has; before a space that follows
another character, if no piece has one there; between letters and others, if no piece has both. The best paths of the parts are the
best path of the whole; a vocabulary that reaches over more leaves longer parts. A part is solved once and remembered;
new parts are solved many at a time, by one pass of an Aho-Corasick automaton over all of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame


MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters of new parts that are solved in one pass.
TOGETHER = 50_000
#: Parts that a Python worker remembers at most (some 300 bytes each).
PARTS_REMEMBERED = 300_000
#: Longer parts seldom come again and aren't remembered.
LONG = 64
LEAST = float("-inf")


class Trie:
    """The automaton's words as a trie in arrays: many places take a step at once. Node 0 is the root, letter 0 is in no word."""

    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, automaton: ahocorasick.Automaton):
        words = list(automaton.items())
        letters = {c: i for i, c in enumerate(sorted({c for w, _ in words for c in w}), 1)}
        self.letters = np.zeros(0x110000, np.int32)  # by code point
        self.letters[[ord(c) for c in letters]] = list(letters.values())
        self.base = len(letters) + 1
        nodes: dict[int, int] = {}  # parent and letter: node
        ends = {}
        for w, (_, _, i) in words:
            node = 0
            for c in w:
                node = nodes.setdefault(node * self.base + letters[c], len(nodes) + 1)
            ends[node] = i
        #: The id of the word that ends at a node, or -1.
        self.word = np.full(len(nodes) + 1, -1, np.int32)
        self.word[list(ends)] = list(ends.values())
        # open addressing, at most a quarter full; key 0 stands for an empty slot and is no node's
        bits = max(4, (4 * len(nodes)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.nodes = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        key, node = np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int32)
        slot = self._slot(key)
        while key.size:
            first = np.zeros(key.size, bool)
            first[np.unique(slot, return_index=True)[1]] = True
            first &= self.keys[slot] == 0
            self.keys[slot[first]], self.nodes[slot[first]] = key[first], node[first]
            key, node, slot = key[~first], node[~first], (slot[~first] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * self.SPREAD >> self.shift).view(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes that letters lead to from nodes, 0 where there is none."""
        key = node.astype(np.int64) * self.base + letter
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.nodes[slot], 0)
        left = np.flatnonzero((there != key) & (there != 0))
        while left.size:
            slot[left] = s = (slot[left] + 1) & self.mask
            there = self.keys[s]
            found = there == key[left]
            out[left[found]] = self.nodes[s[found]]
            left = left[~found & (there != 0)]
        return out


class Vocabulary:
    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.scores = [float(sp.get_score(i)) for i in range(self.size)]
        normal = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes_ = {int(self.pieces[i][3:-1], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.unknown = min(self.scores[i] for i in normal) - UNKNOWN_PENALTY
        #: Each id as four bytes, and what it stands for, as bytes.
        self.code = [i.to_bytes(4, "little") for i in range(self.size)]
        self.raw = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in self.pieces]
        for b, i in self.bytes_.items():
            self.raw[i] = bytes([b])
        has = {c for i in normal for c in self.pieces[i]}
        self._has = has - {SPACE}
        #: Pieces that an id stands for: one, but for ids after the vocabulary's, each a character of pieces that is none itself.
        self.width = [1] * self.size
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), self.scores[i], i))
        for c in sorted(has - {self.pieces[i] for i in normal}):
            ids = self.spelled(" " if c == SPACE else c)
            self.automaton.add_word(c, (1, self.unknown, len(self.code)))
            self.code.append(b"".join(self.code[i] for i in ids))
            self.width.append(len(ids))
        self.automaton.make_automaton()
        #: Stands between parts; no piece has it.
        self.mark = next(c for c in map(chr, (10, *range(0x110000))) if c not in has)
        inner = [self.pieces[i].lstrip(SPACE) for i in normal]
        mixed = any(a.isalpha() != b.isalpha() for p in inner for a, b in zip(p, p[1:], strict=False) if SPACE not in (a, b))
        spaced = any(SPACE in p for p in inner)
        letters, others = ("".join(re.escape(c) for c in sorted(self._has - {" "}) if c.isalpha() == kind) for kind in (True, False))
        runs = [f"[{x}]+" for x in ([letters + others] if mixed else [letters, others]) if x]
        if spaced:  # a part goes on over spaces
            self._parts = re.compile(f"[ {letters}{others}]+|[^ {letters}{others}]").findall
        else:  # spaces with what follows them
            self._parts = re.compile("|".join([f" +(?:{'|'.join(runs)})?", *runs, f"[^ {letters}{others}]"])).findall

    @cached_property
    def trie(self) -> Trie:
        return Trie(self.automaton)

    @cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """code in one array, and each id's score."""
        scores = np.full(len(self.code), self.unknown)
        scores[: self.size] = self.scores
        return np.frombuffer(b"".join(self.code), "<i4"), scores

    def parts(self, text: str) -> list[str]:
        """The parts that the best path can be put together from."""
        return self._parts(" " + text) if text else []

    def is_spelled(self, part: str) -> bool:
        """Whether the part is a character that is spelled in bytes."""
        return len(part) == 1 and part != " " and part not in self._has

    def spelled(self, character: str) -> list[int]:
        return [self.bytes_[b] for b in character.encode("utf-8", "surrogatepass")]

    def decode(self, ids) -> str:
        """The text that ids stand for; the space put in front is dropped."""
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]

    def matches(self, parts: list[str]) -> tuple[list[int], Iterator]:
        """Where each part starts in all of them put together, and the pieces found there: (last place, (length, score, id)),
        by last place, of one the longest first.
        """
        starts, at = [], 0
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        return starts, self.automaton.iter(self.mark.join(parts).replace(" ", SPACE))


def solved(v: Vocabulary, parts: list[str]) -> list[tuple[float, int]]:
    """Best score and number of pieces of each part: count-only Viterbi, nothing is kept to trace back.

    Ties as the unigram tokenizer resolves them: edges into a place are tried by rising start and must be better to
    replace, so of equal paths the one whose last piece is longest wins.
    """
    starts, found = v.matches(parts)
    size = starts[-1] + len(parts[-1]) + 2 if parts else 1
    best, count = [LEAST] * size, [0] * size  # places are counted by the character before them
    for s in starts:
        best[s - 1] = 0.0
    width = v.width
    for at, (n, score, i) in found:
        new = best[at - n] + score
        if new > best[at]:
            best[at] = new
            count[at] = count[at - n] + width[i]
    return [(v.unknown, len(p.encode("utf-8", "surrogatepass"))) if v.is_spelled(p) else (best[s + len(p) - 1], count[s + len(p) - 1]) for p, s in zip(parts, starts, strict=True)]


class Remembered:
    """What solve says of parts, for many new parts at a time. Two generations: when the young one is full the old one goes,
    and what is used again becomes young.
    """

    def __init__(self, solve: Callable[[list[str]], list], together: int = TOGETHER, limit: int = PARTS_REMEMBERED):
        self.solve, self.together, self.limit, self.young, self.old = solve, together, limit, {}, {}

    def of(self, texts: list[list[str]]) -> Iterator[list]:
        """The values of the parts of each text, in order. New parts of several texts are solved together."""
        held, new, size = [], set(), 0
        for parts in texts:
            held.append(parts)
            fresh = set(parts).difference(self.young, new)
            if fresh:
                for p in fresh:
                    if p in self.old:
                        self.young[p] = self.old[p]
                    else:
                        new.add(p)
                        size += len(p)
            if size > self.together:
                yield from self._settle(held, list(new))
                held, new, size = [], set(), 0
        yield from self._settle(held, list(new))

    def _settle(self, held: list[list[str]], new: list[str]) -> Iterator[list]:
        young = self.young
        if new:
            young.update(zip(new, self.solve(new), strict=True))
        for parts in held:
            yield [young[p] for p in parts]
        for p in new:
            if len(p) > LONG:
                del young[p]
        if len(young) > self.limit // 2:
            self.old, self.young = young, {}


def broadcast(df: DataFrame, model: str) -> Broadcast:
    with open(model, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


_last: list = [None, None]


def vocabulary(held: Broadcast) -> Vocabulary:
    """The vocabulary of a broadcast model file, built once in a Python worker."""
    if _last[0] != hash(held.value):
        _last[:] = [hash(held.value), Vocabulary(held.value)]
    return _last[1]
