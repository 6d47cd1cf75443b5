"""N-best segmentation: forward Viterbi scores are the exact heuristic of a backward A* search over the piece lattice.

The forward pass gives each place of a part (see pieces) the best score from the start; the search goes back from the end, and the
score so far plus the place's forward score is exactly that of the best completion, so complete paths come out best
first. As the heuristic is exact, a state is followed to the start at once by the best edges, and only the edges not taken
are queued; the queue keeps no more of them than paths are still wanted.

Parts don't interact: the N best segmentations of a text combine the parts' lists, and only the N - 1 parts whose second path loses
least can take part in them. So a part's first path is followed and what its second would lose is noted, and both are remembered; the
search goes on only for the parts of a text that lose least.

First paths are sought for many parts in step: all parts' places of one distance from the start are solved by array operations, an edge
length at a time, longest first; then all parts are followed back together, an edge at a time. Long parts, of which there are few, are solved alone.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from hashlib import sha256
from heapq import nsmallest
from itertools import chain, pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_arrow, require, result_columns, schema_with
from .pieces import LEAST, LONG, MODEL, SPACE, Remembered, Vocabulary, broadcast, vocabulary

N_BEST = 3
#: Rows handled at a time, characters solved together, parts remembered: little memory for a step among others, or more for less work.
LEAN, WIDE = (256, 20_000, 100_000), (1000, 200_000, 600_000)
#: Parts looked up at a time.
MANY = 1 << 18


class Lattice:
    """Many parts put together; places are counted by the character before them. best: score of the best path from a part's start to each place."""

    def __init__(self, v: Vocabulary, parts: list[str]):
        self.v, self.parts = v, parts
        self.starts, found = v.matches(parts)
        size = self.starts[-1] + len(parts[-1]) + 2 if parts else 1
        self.found = found = list(found)
        self.first = first = [0] * size  # of the edges into a place
        self.taken = taken = [0] * size  # the best of them; of equal ones the longest
        self.best = best = [LEAST] * size
        for s in self.starts:
            best[s - 1] = 0.0  # of the first part: the last place of all, which is nowhere else used
        for k, (at, (n, score, _)) in enumerate(found):
            new = best[at - n] + score
            old = best[at]
            if new > old:
                if old == LEAST:
                    first[at] = k
                best[at] = new
                taken[at] = k
        found.append((-1, (0, 0.0, 0)))

    def first_path(self, p: int) -> tuple[float, list[int], float]:
        """Score and ids of the best path of a part, and what the second one loses (infinite if there is none)."""
        part, start = self.parts[p], self.starts[p]
        if self.v.is_spelled(part):
            return self.v.unknown, self.v.spelled(part), -LEAST
        found, first, taken, best = self.found, self.first, self.taken, self.best
        at = start + len(part) - 1
        total, done, second, ids = best[at], 0.0, LEAST, []
        while at >= start:
            k, mine = first[at], taken[at]
            last, edge = found[k]
            while last == at:
                if k != mine:
                    f = done + edge[1] + best[at - edge[0]]
                    if f > second:
                        second = f
                k += 1
                last, edge = found[k]
            n, score, i = found[mine][1]
            ids.append(i)
            done += score
            at -= n
        ids.reverse()
        return total, ids, total - second

    def paths(self, p: int, n: int) -> list[tuple[float, list[int]]]:
        """(score, ids) of the n best paths of a part, best first."""
        part, start = self.parts[p], self.starts[p]
        if self.v.is_spelled(part):
            return [(self.v.unknown, self.v.spelled(part))]
        found, first, taken, best = self.found, self.first, self.taken, self.best
        out: list[tuple[float, list[int]]] = []
        end = start + len(part) - 1
        queue: list[tuple] = [(best[end], end, 0.0, None)]  # falling: score of the best completion, place, score so far, path so far
        while queue and len(out) < n:
            total, at, done, path = queue.pop(0)
            room = n - len(out) - 1
            while at >= start:
                k, mine = first[at], taken[at]
                while found[k][0] == at:
                    if k != mine and room:
                        size, score, i = found[k][1]
                        f = done + score + best[at - size]
                        if len(queue) < room or f > queue[-1][0]:
                            j = len(queue)
                            while j and queue[j - 1][0] < f:
                                j -= 1
                            queue.insert(j, (f, at - size, done + score, (i, path)))
                            del queue[room:]
                    k += 1
                size, score, i = found[mine][1]
                done, path, at = done + score, (i, path), at - size
            ids = []
            while path:
                i, path = path
                ids.append(i)
            out.append((total, ids))
        return out


class Firsts(NamedTuple):
    """First paths of parts: score, what the second path loses, number of ids; the ids of all, one part after the other."""

    score: np.ndarray
    loss: np.ndarray
    count: np.ndarray
    ids: np.ndarray


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each start, one after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def joined(firsts: list[Firsts]) -> Firsts:
    return Firsts(*map(np.concatenate, zip(*firsts, strict=True)))


def first_paths(v: Vocabulary, parts: list[str]) -> Firsts:
    """What Lattice.first_path says of each part, for all in step. Parts come by falling length; none is longer than LONG or spelled in bytes."""
    trie, (code, worth) = v.trie, v.codes
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    text = v.mark.join(parts).replace(" ", SPACE) + v.mark
    letters = trie.letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes + 1)
    place = (np.arange(len(letters)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)).astype(np.int32)

    # edges: the part, what orders them (by end, of one end the longest first), the id
    of, order, ids, n = [], [], [], 0
    at, node = np.arange(len(letters)), np.zeros(len(letters), np.int32)
    while at.size:
        node = trie.step(node, letters[at + n])
        live = np.flatnonzero(node)
        at, node, n = at[live], node[live], n + 1
        word = trie.word[node]
        ends = np.flatnonzero(word >= 0)
        s = at[ends]
        of.append(part[s])
        order.append(((place[s] + n - 1) * (LONG + 1) + LONG - n).astype(np.uint16))
        ids.append(word[ends])
    order = np.concatenate(order)
    sort = np.argsort(order, kind="stable")
    of, order, ids = np.concatenate(of)[sort], order[sort], np.concatenate(ids)[sort]
    length, score = LONG - (order % (LONG + 1)).astype(np.int64), worth[ids]

    # forward: places lie by their distance from the start, of one distance by part; longer parts come first, so each distance has the first ones
    many = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    column = np.r_[0, np.cumsum(many)]
    best, second, taken = np.full(column[-1], LEAST), np.full(column[-1], LEAST), np.zeros(column[-1], np.int64)
    begin = np.zeros(len(parts))
    cuts = [0, *(np.flatnonzero(np.diff(order)) + 1).tolist(), len(order)]
    for low, high in pairwise(cuts):
        end, back = int(order[low]) // (LONG + 1), int(order[low]) // (LONG + 1) - int(length[low])
        here, p = slice(column[end], column[end + 1]), of[low:high]
        new = (begin if back < 0 else best[column[back] : column[back + 1]])[p] + score[low:high]
        old = best[here][p]
        better = np.flatnonzero(new > old)
        second[here][p] = np.maximum(second[here][p], np.minimum(old, new))
        best[here][p] = np.maximum(old, new)
        taken[here][p[better]] = low + better

    # back
    total = best[column[sizes - 1] + np.arange(len(parts))]
    p, at, done, other, steps = np.arange(len(parts)), sizes, np.zeros(len(parts)), np.full(len(parts), LEAST), []
    while p.size:
        here = column[at - 1] + p
        edge = taken[here]
        other[p] = np.maximum(other[p], done + second[here])
        steps.append((p, ids[edge]))
        at, done = at - length[edge], done + score[edge]
        live = np.flatnonzero(at > 0)
        p, at, done = p[live], at[live], done[live]
    count = np.bincount(np.concatenate([p for p, _ in steps]), minlength=len(parts))
    last, path = np.cumsum(count) - 1, np.empty(count.sum(), np.int32)
    for k, (p, i) in enumerate(steps):
        path[last[p] - k] = i
    if path.max() >= v.size:  # characters that are no pieces, spelled in bytes
        width = np.array(v.width)
        first = np.cumsum(width) - width
        count = np.bincount(np.repeat(np.arange(len(parts)), count), width[path], len(parts)).astype(np.int64)
        path = code[ranges(first[path], width[path])]
    return Firsts(total, total - other, count, path)


class Known:
    """First paths of parts, remembered as pieces.Remembered does, in arrays."""

    def __init__(self, v: Vocabulary, together: int, limit: int):
        self.v, self.together, self.limit = v, together, limit
        self.old, self.young = self._none(), self._none()

    @staticmethod
    def _none() -> tuple[dict[str, int], Firsts, np.ndarray]:
        """Where parts are; their paths; where each one's ids begin."""
        return {}, Firsts(np.empty(0), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32)), np.empty(0, np.int64)

    def _alone(self, parts: list[str]) -> Firsts:
        lattice = Lattice(self.v, parts)
        found = [lattice.first_path(p) for p in range(len(parts))]
        raw = [b"".join([self.v.code[i] for i in ids]) for _, ids, _ in found]
        return Firsts(np.array([f[0] for f in found]), np.array([f[2] for f in found]), np.array([len(r) // 4 for r in raw], np.int64), np.frombuffer(b"".join(raw), "<i4"))

    def _solved(self, parts: list[str]) -> Iterator[tuple[list[str], Firsts]]:
        alone, others = [], []
        for p in parts:
            (alone if len(p) > LONG or self.v.is_spelled(p) else others).append(p)
        others.sort(key=len, reverse=True)
        for some, solve in ((alone, self._alone), (others, lambda x: first_paths(self.v, x))):
            held, size = [], 0
            for p in some:
                held.append(p)
                size += len(p)
                if size > self.together:
                    yield held, solve(held)
                    held, size = [], 0
            if held:
                yield held, solve(held)

    def of(self, parts: list[str]) -> Firsts:
        """The first paths of parts, in order."""
        return joined([self._of(parts[k : k + MANY]) for k in range(0, len(parts) or 1, MANY)])

    def _of(self, parts: list[str]) -> Firsts:
        where, firsts, begin = self.young
        slot = np.fromiter(map(where.get, parts, repeat(-1)), np.int64, len(parts))
        fresh = np.flatnonzero(slot < 0).tolist()
        if fresh:
            new = list(dict.fromkeys([parts[k] for k in fresh]))
            before, theirs, first = self.old
            again = [p for p in new if p in before]
            more = list(self._solved([p for p in new if p not in before]))
            if again:
                at = np.fromiter(map(before.__getitem__, again), np.int64, len(again))
                more.append((again, Firsts(theirs.score[at], theirs.loss[at], theirs.count[at], theirs.ids[ranges(first[at], theirs.count[at])])))
            where.update(zip(chain.from_iterable([p for p, _ in more]), range(len(begin), len(begin) + len(new)), strict=True))
            firsts = joined([firsts, *(f for _, f in more)])
            begin = np.cumsum(firsts.count) - firsts.count
            slot[fresh] = np.fromiter(map(where.__getitem__, [parts[k] for k in fresh]), np.int64, len(fresh))
            for p in new:
                if len(p) > LONG:
                    del where[p]
            self.young = where, firsts, begin
            if len(begin) > self.limit // 2 or len(firsts.ids) > 4 * self.limit:
                self.old, self.young = self.young, self._none()
        count = firsts.count[slot]
        return Firsts(firsts.score[slot], firsts.loss[slot], count, firsts.ids[ranges(begin[slot], count)])


def n_best(v: Vocabulary, parts: list[str], n: int = N_BEST) -> list[list[tuple[float, list[int]]]]:
    """The n best paths of each part."""
    lattice = Lattice(v, parts)
    return [lattice.paths(p, n) for p in range(len(parts))]


def nearest(losses: list[float], n: int) -> list[int]:
    """The n - 1 parts whose second path loses least, if they have one."""
    return [p for x, p in nsmallest(n - 1, zip(losses, range(len(losses)), strict=True)) if x < -LEAST]


def nearest_of(losses: np.ndarray, n: int) -> list[int]:
    """nearest, of an array."""
    if len(losses) < n or n < 2:
        return nearest(losses.tolist(), n)
    low = np.flatnonzero(losses <= np.partition(losses, n - 2)[n - 2])
    return low[nearest(losses[low].tolist(), n)].tolist()


def combined(lists: list[list[tuple]], n: int = N_BEST) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n best choices of one path for each part: (what it loses, ((part, rank), ...)) with the parts whose best isn't taken.

    lists: (score, ...) of each part's paths, best first; the parts that lose least suffice.
    """
    choices: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    for p, x in enumerate(lists):
        choices = nsmallest(n, choices + [(c + x[0][0] - x[k][0], (*taken, (p, k))) for k in range(1, len(x)) for c, taken in choices])
    return choices


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """docs plus ids (of the best segmentation), scores (of the n best), sizes (pieces of the n best), decoded.

    Row by row, no shuffle. Null and empty texts: no ids, one score of 0.0, decoded empty. decoded is made from ids
    alone and equals the text. A text has fewer than n scores if it has fewer segmentations. Repeated rows give equal
    results, an empty table an empty one; names that clash get a suffix.
    """
    require(docs, text)
    names = result_columns(docs, "ids", "scores", "sizes", "decoded")
    held = broadcast(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, got in segmented(batches, text, held, n):
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(g[0]) // 4 for g in got)]), pa.int32()), pa.Array.from_buffers(pa.int32(), sum(len(g[0]) for g in got) // 4, [None, pa.py_buffer(b"".join([g[0] for g in got]))]))
            new = [ids, pa.array([g[1] for g in got], pa.list_(pa.float64())), pa.array([g[2] for g in got], pa.list_(pa.int64())), pa.array([g[3] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    kinds = (T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType()), T.StringType())
    return in_arrow(docs, work, schema_with(docs, *zip(names, kinds, strict=True)))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as 4-byte little-endian integers), scores, sizes, round_trip."""
    require(docs, doc_id, text)
    held = broadcast(docs, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, got in segmented(batches, text, held, n, WIDE):
            same = [g[3] == (t or "") for g, t in zip(got, b.column(text).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column(doc_id), pa.array([g[2][0] for g in got], pa.int64()), pa.array([sha256(g[0]).hexdigest() for g in got], pa.string()),
                pa.array([g[1] for g in got], pa.list_(pa.float64())), pa.array([g[2] for g in got], pa.list_(pa.int64())), pa.array(same, pa.bool_()),
            ], names=["doc_id", "n_pieces", "ids_sha256", "scores", "sizes", "round_trip"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return in_arrow(docs.select(doc_id, text), work, f"doc_id {kind}, n_pieces long, ids_sha256 string, scores array<double>, sizes array<long>, round_trip boolean")


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows: what is made of a batch stays small beside the batch itself."""
    for b in batches:
        for low in range(0, b.num_rows, rows):
            yield b.slice(low, rows)


def cut(v: Vocabulary, texts: list[str | None]) -> Iterator[list[list[str]]]:
    """The parts of each text, of a few texts at a time: as many as have MANY parts."""
    held, size = [], 0
    for t in texts:
        held.append(v.parts(t or ""))
        size += len(held[-1])
        if size > MANY:
            yield held
            held, size = [], 0
    if held:
        yield held


def segmented(batches: Iterator[pa.RecordBatch], column: str, held, n: int, use: tuple[int, int, int] = LEAN) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Per few rows: (ids as bytes, scores, sizes, decoded) of each text."""
    v = vocabulary(held)
    gc.disable()  # millions of tuples, none in a cycle; counting references frees them
    try:
        known = Known(v, *use[1:])
        more = Remembered(lambda parts: [[(s, sum([v.width[i] for i in ids])) for s, ids in paths] for paths in n_best(v, parts, n)])
        for b in slices(batches, use[0]):
            out = []
            for texts in cut(v, b.column(column).to_pylist()):
                rows, wanted = [], []
                firsts = known.of(list(chain.from_iterable(texts)))
                ends = np.r_[0, np.cumsum(firsts.count)].tolist()
                high = 0
                for parts in texts:
                    low, high = high, high + len(parts)
                    wanted.append([parts[p] for p in nearest_of(firsts.loss[low:high], n)])
                    rows.append((firsts.ids[ends[low] : ends[high]], sum(firsts.score[low:high].tolist())))
                for (ids, total), lists in zip(rows, more.of(wanted), strict=True):
                    best = combined(lists, n)
                    scores = [float(total - c) for c, _ in best]
                    sizes = [len(ids) + sum([lists[p][k][1] - lists[p][0][1] for p, k in taken]) for _, taken in best]
                    out.append((ids.tobytes(), scores, sizes, v.decode(ids.tolist())))
            yield b, out
    finally:
        gc.enable()
