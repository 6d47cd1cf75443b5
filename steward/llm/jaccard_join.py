"""Exact Jaccard join of documents as a join in metric space, and its connected components.

The distance 1 - J is a metric on shingle sets; two sets link at a distance of TAU at most (0.1 unless
told otherwise). What is done:

1. Equal sets are folded into one representative, so groups of exact copies cost one row.
2. The pivots of the whole space are the one-shingle sets, in one order for all (rare first by a sketch of the corpus,
   then by hash). A set's nearest pivot, ties broken by the order, is its first shingle: its Voronoi region. Two sets within TAU
   share l shingles among the first |S| - overlap + l of either, for any l up to the overlap, so a set is replicated to these
   regions and no more (the window). A region falls apart where the sizes allow no link (triangle inequality with the
   empty set: sizes within the threshold, and a place in the order bounds what can be shared). Regions carry ids, sizes and places only.
   l is EXTRA of the size: two sets that meet in small regions only (SMALL sets at most) must meet in l of them;
   sets that meet in a larger one aren't counted. Both are held against their parities: bit i says whether an odd number of
   shingles hash to i, so the bits that differ are no more than the shingles that only one of two sets has, and linked sets always pass.
3. What shares a region is a candidate neighbourhood (components of the candidate graph). Its texts are shipped once, compressed. One
   with more than LIMIT_SETS sets or LIMIT_GRAMS shingles is split again: documents as pivots, exact distances, a
   document goes to its nearest pivot's region and to every pivot q with d(x, q) <= d(x, nearest) + 2 TAU (no linked pair is
   lost: d(x, q) <= d(x, y) + d(y, q)). Documents linked with a pivot are one group; those that no other document of the
   region can be near enough to are done with, so a dense group of near copies costs its rows once and not their pairs. A
   region that doesn't shrink so is cut into blocks, and each pair of blocks is a task of bounded memory.
4. In a task regions split recursively the same way; small ones compare their sets by one matrix product. Sets already
   joined are not compared. Only links that join two groups leave a task, less than one a set, each to the group's least id.

No step drops or caps candidates; the result is that of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_128_digest

from .common import SEGMENT, ascending, counted, forget, in_arrow, in_pandas, lean, longs, map_rows, packed, packed_bytes, require, runs_of, saved, shingles, unpacked, unpacked_bytes, words_of
from .components import connected

SHINGLE = 3
#: Links need PERCENT * |x | y| <= 100 * |x & y|.
PERCENT = 90
#: Words and percentage of near duplicates where nothing else is asked for.
NEAR = {"k": 5, "percent": 80}
#: Counters of the corpus sketch: one for every LOAD words, within these (a byte each where they are broadcast). With too few, what some
#: hundred documents share passes for rare, and windows, regions and pairs grow faster than the corpus.
SKETCH_BITS, MOST_SKETCH_BITS, LOAD = 20, 24, 8
SKETCH = 1 << SKETCH_BITS
#: Counters that are added up together.
BLOCK = 1 << 18
#: Shared shingles asked for, for each hundred of a set, beyond the first.
EXTRA = 3
#: Bits of a set's parities: the first power of two from two thirds of its size on, within these. Beyond the most, fewer unlinked sets are told apart.
FEWEST_BITS, MOST_BITS = 128, 4096
#: Sets of a region whose pairs are counted; SMALL * (SMALL - 1) / 2 rows at most.
SMALL = 12
LIMIT_SETS = 512
LIMIT_GRAMS = 1_000_000
#: Sets compared by one matrix product.
LEAF = 128
ROUNDS = 4
#: Pivots of a region at most, and slices that its rows are dealt in for each part that it needs.
PIVOTS, SLICES = 16, 4
DEALT = {"region": "string", "doc_id": "long", "n": "long", "z": "binary", "joined": "long", "old": "long", "near": "double", "pivot": "long", "linked": "boolean"}


def linked(both, x, y, percent: int = PERCENT):
    """Whether sets of x and y shingles that share both of them link; exact in integers."""
    return (100 * both >= percent * (x + y - both)) & (both > 0)


def ranked(grams: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set in the order of the pivots: rare first by the sketch, then by hash."""
    return grams[np.argsort(level[grams >> np.uint64(65 - len(level).bit_length())], kind="stable")]  # grams ascend already


def least_shared(n: int, percent: int = PERCENT) -> int:
    """l: shared shingles that a set of n asks for; no more than it must share with any set that it links with."""
    return min(1 + EXTRA * n // 100, -(-percent * n // 100))


def window(n: int, percent: int = PERCENT) -> tuple[int, np.ndarray]:
    """Regions a set of n shingles goes to, and for each place the greatest size of a partner that may share it among the first l.

    With t = percent/100 linked sets of n and m share at least t/(1+t) * (n + m), and m >= t*n. Before the l-th shared
    shingle stand at most l - 1 shared ones and those that aren't shared: place i leaves n - (i - l + 1) to share.
    """
    need, l = -(-percent * n // 100), least_shared(n, percent)
    count = min(n, n - need + l)
    i = np.maximum(0, np.arange(count, dtype=np.int64) - (l - 1))
    reach = (n - i) * (100 + percent) // percent - n
    return count, np.minimum(reach, n * 100 // percent)


def parities(grams: np.ndarray, bits: int) -> np.ndarray:
    """Words of 64 bits: whether an odd number of shingles hash to each bit. Half as many bits are one half XOR the other."""
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Parities by row, as of width words."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(FEWEST_BITS, 1 << (2 * n // 3).bit_length()))


def alike(ids: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (src, dst) over the sets of an island, in the order of sizes n, whose sizes and parities allow a link.

    Pairs that are one group already are passed over, so near copies cost their rows and not their pairs.
    """
    group, top = np.arange(len(ids)), np.searchsorted(n, n * 100 // percent, side="right")
    width = np.array([len(b) // 8 for b in bits])
    for w in np.unique(width):
        low, high = np.searchsorted(width, [w, w + 1])
        parts = [folded(np.frombuffer(b"".join(bits[width == v]), np.uint64).reshape(-1, v), w) for v in np.unique(width[low : top[high - 1]])]
        words = np.concatenate(parts)
        for i in range(low, high):
            j = slice(i + 1, top[i])
            c = i + 1 + np.flatnonzero(group[j] != group[i])
            if not len(c):
                continue
            apart = np.bitwise_count(words[c - low] ^ words[i - low]).sum(axis=1, dtype=np.int64)
            c = c[apart * (100 + percent) <= (n[c] + n[i]) * (100 - percent)]
            if len(c):
                one = np.unique(group[np.r_[i, c]])
                group[np.isin(group, one)] = one[0]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    dst = least[group]
    return ids[ids != dst], dst[ids != dst]


def alike_by_island(rows: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) of alike() for each island of rows (island, doc_id, n, bits)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = []  # of the island that the next rows may go on with

        def stars() -> tuple[np.ndarray, np.ndarray]:
            return alike(*(np.concatenate(c) for c in list(zip(*held, strict=True))[1:]), percent)

        for b in batches:
            columns, out = [b[c].to_numpy() for c in ("island", "doc_id", "n", "bits")], []
            cuts = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1
            for low, high in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if low == high:
                    continue
                if held and held[0][0][0] != columns[0][low]:
                    out.append(stars())
                    held = []
                held.append([c[low:high] for c in columns])
            if out:
                yield pd.DataFrame({"src": np.concatenate([o[0] for o in out]), "dst": np.concatenate([o[1] for o in out])})
        if held:
            yield pd.DataFrame(dict(zip(("src", "dst"), stars(), strict=True)))

    rows = rows.select("island", "doc_id", F.col("n").cast("long").alias("n"), "bits")
    return in_pandas(rows.repartition("island").sortWithinPartitions("island", "n"), work, "src long, dst long")


def sketch_bits(size: int) -> int:
    """Bits of a counter's number for texts of so many bytes, some six a word."""
    return min(MOST_SKETCH_BITS, max(SKETCH_BITS, int(size / (6 * LOAD)).bit_length()))


def sketch(docs: DataFrame, text: str, k: int = SHINGLE) -> np.ndarray:
    """Level of each counter: its count in steps of a fourth of a power of two. Counts all shingles of all documents."""
    bits = sketch_bits(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    shift, blocks = np.uint64(64 - bits), (1 << bits) // BLOCK

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size = np.zeros(1 << bits, np.uint32), [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                np.add.at(total, np.concatenate(held), np.uint32(1))
            held, size = [], 0

        for b in batches:
            for t in b["text"]:
                held.append((shingles(t, k, distinct=False) >> shift).astype(np.int64))
                size += len(held[-1])
                if size > SKETCH:
                    flush()
        flush()
        parts = [(i, total[i * BLOCK : (i + 1) * BLOCK]) for i in range(blocks)]
        yield pd.DataFrame([(i, packed_bytes(p.tobytes())) for i, p in parts if p.any()], columns=["block", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b["block"], b["counts"], strict=True):
                totals.setdefault(i, np.zeros(BLOCK, np.int64))
                totals[i] += np.frombuffer(unpacked_bytes(c), np.uint32)
        for i, total in totals.items():
            yield pd.DataFrame({"block": [i], "levels": [np.minimum(127, 4 * np.log2(1 + total)).astype(np.int8).tobytes()]})

    parts = map_rows(docs.select(F.col(text).cast("string").alias("text")), count, "block int, counts binary")
    level = np.zeros(1 << bits, np.int8)
    for r in in_pandas(parts.repartition(blocks, "block"), add, "block int, levels binary").collect():
        level[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["levels"], np.int8)
    return level


class Sets:
    """Shingle sets by row, over codes of the shingles that two of them have."""

    def __init__(self, grams: list[np.ndarray]):
        self.sizes = np.array([len(g) for g in grams], np.int64)
        _, codes, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        kept = counts > 1
        to = np.cumsum(kept) - 1
        row = np.repeat(np.arange(len(grams)), self.sizes)
        keep = kept[codes]
        self.codes, row, self.n_codes = to[codes[keep]], row[keep], int(kept.sum())
        self.starts = np.searchsorted(row, np.arange(len(grams) + 1))

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.starts[i] : self.starts[i + 1]]

    def shared(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """How many shingles each of the rows has in common with the pivot."""
        mark = np.zeros(self.n_codes + 1, np.int64)
        mark[self.of(pivot)] = 1
        sums = np.r_[0, np.cumsum(mark[self.codes])]
        return sums[self.starts[rows + 1]] - sums[self.starts[rows]]


class Groups:
    """Union-find over rows that keeps the links that joined two groups; a group's root is its first row."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def merge(self, i: int, j: int) -> bool:
        """Make the groups of i and j one; whether they were two."""
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def join(self, i: int, j: int) -> None:
        if self.merge(i, j):
            self.links.append((i, j))

    def one(self, rows) -> bool:
        return len({self.root(int(i)) for i in rows}) == 1


def compare(sets: Sets, rows: np.ndarray, groups: Groups, percent: int) -> None:
    """All pairs of a few rows at once: a matrix product in blocks of shingles counts what each two share."""
    parts = [sets.of(i) for i in rows]
    codes, local = np.unique(np.concatenate(parts), return_inverse=True) if parts else (np.array([]), np.array([], int))
    at = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
    both = np.zeros((len(rows), len(rows)), np.float32)
    for low in range(0, len(codes), 8192):
        part = (local >= low) & (local < low + 8192)
        m = np.zeros((len(rows), min(8192, len(codes) - low)), np.float32)
        m[at[part], local[part] - low] = 1
        both += m @ m.T
    n = sets.sizes[rows]
    for i, j in zip(*np.nonzero(np.triu(linked(both.astype(np.int64), n[:, None], n[None, :], percent), 1)), strict=True):
        groups.join(int(rows[i]), int(rows[j]))


def join_rows(sets: Sets, rows: np.ndarray, groups: Groups, percent: int, depth: int = 0) -> None:
    """Join all linked rows: pivots among the rows, Voronoi regions with windows of twice the distance, recursively."""
    if len(rows) < 2 or groups.one(rows):
        return
    if len(rows) <= LEAF:
        return compare(sets, rows, groups, percent)
    far = 2 * (100 - percent) / 100 + 1e-9
    pivots = rows[np.linspace(0, len(rows) - 1, 8).astype(int)]
    distance = np.empty((len(pivots), len(rows)))
    for k, p in enumerate(pivots):
        both = sets.shared(int(p), rows)
        union = sets.sizes[rows] + sets.sizes[p] - both
        distance[k] = 1 - both / union
        for i in rows[linked(both, sets.sizes[rows], sets.sizes[p], percent)]:
            groups.join(int(p), int(i))
    near = distance <= distance.min(axis=0) + far
    regions = [rows[near[k]] for k in range(len(pivots))]
    if depth < 6 and max(map(len, regions)) < 0.7 * len(rows):
        for region in regions:
            join_rows(sets, region, groups, percent, depth + 1)
        return
    order = rows[np.argsort(sets.sizes[rows], kind="stable")]  # no gain by pivots: blocks by size, and pairs of blocks whose sizes allow a link
    blocks = [order[i : i + LEAF // 2] for i in range(0, len(order), LEAF // 2)]
    for i, x in enumerate(blocks):
        for y in blocks[i:]:
            if 100 * sets.sizes[x[-1]] >= percent * sets.sizes[y[0]] and not groups.one((*x, *y)):
                compare(sets, np.unique(np.concatenate([x, y])), groups, percent)


def component_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: links at percent of Jaccard similarity of k-word shingles.

    Null or blank texts have no shingles and link with nothing. Rows that repeat a doc_id share its component; a null
    doc_id is an id of its own that nothing reaches: component_id null. Extra columns are not read.
    """
    require(docs, doc_id, text)
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    level = spark.sparkContext.broadcast(sketch(docs, "text", k))  # bounded: 2 ** MOST_SKETCH_BITS bytes

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                g = shingles(t, k)
                count, reach = window(len(g), percent) if len(g) else (0, np.empty(0, int))
                words = parities(g, bits_for(len(g))) if len(g) else np.zeros(1, np.uint64)
                fold = folded(words[None, :], 1).view(np.int64)[0, 0]
                out.append((len(g), xxh3_128_digest(g.tobytes()) if len(g) else None, longs(ranked(g, level.value)[:count]), reach, words.tobytes(), fold))
            yield pd.DataFrame({"doc_id": b["doc_id"]} | {c: [o[i] for o in out] for i, c in enumerate(("n", "same", "first", "reach", "bits", "fold"))})

    ddl = "doc_id string, n long, same binary, first array<long>, reach array<long>, bits binary, fold long"
    rows = saved(map_rows(docs.withColumn("doc_id", F.col("doc_id").cast("string")), regions, ddl).withColumn("doc_id", F.col("doc_id").cast("long")))
    known = rows.where("same is not null and doc_id is not null")
    reps = saved(known.groupBy("same").agg(F.min("doc_id").alias("rep")))

    # Regions of the first level: ids and sizes only. In the order of sizes an island ends where no smaller set reaches further.
    # the other copies are left out by their ids, so that the wide rows aren't shuffled for it
    copies = known.select("doc_id", "same").join(reps, "same").where("doc_id <> rep").select("doc_id", "same").distinct()
    ones = known.join(counted(copies), ["doc_id", "same"], "left_anti").withColumn("n", F.col("n").cast("int"))
    own = ones.select("doc_id", "n", F.explode(F.arrays_zip("first", "reach")).alias("z"))
    own = own.select("doc_id", "n", F.col("z.first").alias("key"), F.col("z.reach").cast("int").alias("reach"))
    by = Window.partitionBy("key").orderBy("n", "doc_id")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(F.col("n") > F.max("reach").over(before), F.lit(True))
    islands = own.withColumn("starts", starts).withColumn("island", F.sum(F.col("starts").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    each_island = Window.partitionBy("key", "island")
    islands = islands.withColumn("sets", F.count("*").over(each_island).cast("int")).withColumn("all", F.bit_xor(F.xxhash64("doc_id", "n")).over(each_island))
    islands = saved(islands.where("sets > 1").select("key", "island", "sets", "doc_id", "n", "reach", "all"))
    # islands of the same sets are one; stars, not chains: the components of stars take few rounds
    large = islands.where(F.col("sets") > SMALL).select(F.col("all").alias("island"), "doc_id", "n").distinct()
    kept = alike_by_island(large.join(ones.select("doc_id", "n", "bits").distinct(), ["doc_id", "n"]), percent).distinct()
    member = F.struct("n", "doc_id", "reach", "fold")
    small = islands.where(F.col("sets") <= SMALL).join(ones.select("doc_id", "n", "fold").distinct(), ["doc_id", "n"]).groupBy("key", "island").agg(F.array_sort(F.collect_list(member)).alias("m"))
    pair = lambda x, y: F.struct(x["doc_id"].alias("src"), y["doc_id"].alias("dst"), x["n"].alias("n"))
    apart = lambda x, y: F.bit_count(x["fold"].bitwiseXOR(y["fold"]))
    allowed = lambda x, y: apart(x, y) * (100 + percent) <= (x["n"] + y["n"]) * (100 - percent)
    meets = lambda x, y: (y["n"] <= x["reach"]) & (x["n"] <= y["reach"]) & (y["doc_id"] != x["doc_id"]) & allowed(x, y)
    each = F.transform("m", lambda x, i: F.transform(F.filter(F.col("m"), lambda y, j: (j > i) & meets(x, y)), lambda y: pair(x, y)))
    met = small.select(F.explode_outer(F.flatten(each)).alias("p")).where("p is not null").groupBy("p.src", "p.dst", "p.n").agg(F.count("*").alias("c"))
    asked = F.least(1 + F.floor(F.col("n") * EXTRA / 100), F.ceil(F.col("n") * percent / 100))
    near = connected(kept.union(met.where(F.col("c") >= asked).select("src", "dst")))
    forget(islands)

    # Each candidate's text is shipped once, to its neighbourhood.
    # rows that repeat an id come to the same region, where one of each text is taken
    texts = docs.where("doc_id is not null").join(counted(near.select(F.col("node").alias("doc_id"), F.col("component").alias("region"))), "doc_id")
    labels = connected(links_within(candidates(texts, k), percent, k))
    groups = known.select("doc_id", "same").join(reps, "same").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("to"))
    # an id with several texts joins their groups
    final = connected(groups.select(F.col("doc_id").alias("src"), F.col("to").alias("dst")).distinct()) if several(known) else groups.select(F.col("doc_id").alias("node"), F.col("to").alias("component")).distinct()
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def candidates(texts: DataFrame, k: int) -> DataFrame:
    """What links_within takes, of rows (region, doc_id, text); texts without words are left out."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame({"region": b["region"].astype(str), "doc_id": b["doc_id"], "n": [len(shingles(t, k)) for t in b["text"]], "z": [packed(t) for t in b["text"]]})
            yield out[out["n"] > 0]

    now = map_rows(texts.select("region", "doc_id", "text"), work, "region string, doc_id long, n long, z binary")
    return now.withColumns({"joined": F.lit(None).cast("long"), "old": F.lit(None).cast("long")})


def links_within(now: DataFrame, percent: float, k: int) -> DataFrame:
    """Links (src, dst) that join all linked sets of each region.

    now: region, doc_id, n (size of the set), z (the packed text), joined (an id that the row is linked with already: rows
    of a region with the same one are one group), old (rows of the region that this one was split from).
    Large regions are split by pivots until they are small; those that don't shrink are compared block by block.
    """
    now, links = saved(now), None
    for depth in range(ROUNDS + 1):
        sizes = now.groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("grams_in"), F.max("old").alias("old"))
        large = saved(sizes.where((F.col("sets") > LIMIT_SETS) | (F.col("grams_in") > LIMIT_GRAMS)).withColumn("parts", F.ceil(F.greatest(F.col("sets") / LIMIT_SETS, F.col("grams_in") / LIMIT_GRAMS)).cast("int")))
        found = local(now.join(large, "region", "left_anti"), percent, k)
        if large.isEmpty():
            return found if links is None else links.union(found)
        todo = now.drop("old").join(large, "region")
        stuck = F.coalesce(F.lit(depth == ROUNDS) | (F.col("sets") > 0.7 * F.col("old")), F.lit(False))  # the last split didn't help
        found = found.union(local(blocks(todo.where(stuck)), percent, k))
        dealt = saved(split(todo.where(~stuck), depth, percent, k))
        found = found.union(dealt.where("linked").select(F.col("doc_id").alias("src"), F.col("pivot").alias("dst")))
        links = saved(found if links is None else links.union(found))
        forget(now)
        now = saved(unsettled(dealt, percent))
        forget(dealt)
    raise AssertionError("the last round leaves no large region")


def several(known: DataFrame) -> bool:
    """Whether an id has more than one text."""
    return not known.select("doc_id", "same").distinct().groupBy("doc_id").count().where("count > 1").isEmpty()


def sets_of(packs: Iterable[bytes], k: int) -> Iterator[np.ndarray]:
    """shingles() of each packed text, worked out for some SEGMENT bytes at once."""
    raws, size = [], 0
    for z in packs:
        raws.append(unpacked_bytes(z).lower())
        size += len(raws[-1])
        if size > SEGMENT:
            yield from map(ascending, runs_of([h for h, _ in words_of(raws)], k))
            raws, size = [], 0
    if raws:
        yield from map(ascending, runs_of([h for h, _ in words_of(raws)], k))


def local(now: DataFrame, percent: float, k: int) -> DataFrame:
    """Links (src, dst) within each region; a region holds LIMIT_SETS sets and LIMIT_GRAMS shingles at most, or one pair of blocks.

    Most regions are of a few sets: the rows of a partition are taken as they come, and the words of many regions hashed at once.
    """

    def star(rows: list[tuple], grams: list[np.ndarray]) -> list[tuple[int, int]]:
        groups, heads = Groups(len(rows)), {}
        for i, (_, _, joined) in enumerate(rows):
            if joined is not None:
                groups.merge(heads.setdefault(joined, i), i)
        roots = [i for i, up in enumerate(groups.up) if up == i]
        join_rows(Sets(grams), np.arange(len(rows)), groups, percent)
        # as many links, each to the first row of its group
        return [(rows[i][0], rows[groups.root(i)][0]) for i in roots if groups.up[i] != i]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, rows, seen = None, [], set()  # of the region that the next rows may go on with
        ready, size, links = [], 0, []  # regions whose words are to be hashed together

        def close() -> None:
            if len(rows) > 1:
                ready.append(rows)

        def join() -> None:
            sets = sets_of((z for part in ready for _, z, _ in part), k)
            for part in ready:
                links.extend(star(part, list(islice(sets, len(part)))))
            ready.clear()

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["src", "dst"])
            links.clear()
            return done

        for b in batches:
            for of, doc, z, joined, n in zip(*(b.column(c).to_pylist() for c in ("region", "doc_id", "z", "joined", "n")), strict=True):
                if of != region:
                    close()
                    if size > SEGMENT:
                        join()
                        size = 0
                    region, rows, seen = of, [], set()
                if (doc, z) not in seen:  # different texts of an id all count
                    seen.add((doc, z))
                    rows.append((doc, z, joined))
                    size += n
            if links:
                yield out()
        close()
        join()
        if links:
            yield out()

    rows = now.select("region", "doc_id", "z", "joined", "n")
    return in_arrow(rows.repartition("region").sortWithinPartitions("region", "doc_id"), work, "src long, dst long")


def split(todo: DataFrame, depth: int, percent: float, k: int) -> DataFrame:
    """Rows of large regions dealt to the regions of pivots within them: the nearest, and all within twice the distance of a link.

    A region has 2 pivots for each part it needs, PIVOTS at most: of each class of hashes the least, one not yet joined first. Its rows
    are dealt in slices, each with the pivots' texts once, so neither a task nor what is shuffled grows faster than the rows.
    near: distance to the region's pivot; linked: whether the row is linked with it.
    """
    far = 2 * (100 - percent) / 100 + 1e-9
    hashed = todo.select("region", "doc_id", "joined", F.least(F.lit(PIVOTS), 2 * F.col("parts")).alias("classes"), F.xxhash64("doc_id", F.lit(depth)).alias("h"))
    chosen = hashed.groupBy("region", F.pmod("h", "classes").alias("c")).agg(F.min(F.struct(F.col("joined").isNotNull().alias("late"), "h", "doc_id"))["doc_id"].alias("doc_id"))
    slices = SLICES * F.col("parts")
    pivots = todo.join(chosen, ["region", "doc_id"]).select(F.col("region").alias("of"), F.col("doc_id").alias("pivot"), F.col("z").alias("pivot_z"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    rows = todo.select("region", F.pmod(F.xxhash64("doc_id", F.lit(-1)), slices).cast("int").alias("slice"), "doc_id", "n", "z", "joined", "sets")

    def deal(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        pivots = pivots.sort_values(["pivot", "pivot_z"], kind="stable").reset_index(drop=True)
        first, out = len(pivots), []
        if not len(rows):
            return pd.DataFrame(columns=[*DEALT])
        sets = Sets([shingles(unpacked(z), k) for z in (*pivots["pivot_z"], *rows["z"])])
        at = np.arange(first, first + len(rows))
        both = np.stack([sets.shared(p, at) for p in range(first)])
        distance = 1 - both / (sets.sizes[:first, None] + sets.sizes[at][None, :] - both)
        link = linked(both, sets.sizes[:first, None], sets.sizes[at][None, :], percent)
        near = distance <= distance.min(axis=0) + far
        ids = pivots["pivot"].to_numpy()
        for i, r in enumerate(rows.itertuples(index=False)):
            joined = None if pd.isna(r.joined) else int(r.joined)
            if link[:, i].any():
                joined = int(ids[link[:, i]].min())
            out += [(f"{r.region}/{p}", r.doc_id, r.n, r.z, int(ids[p]) if link[p, i] else joined, r.sets, float(distance[p, i]), int(ids[p]), bool(link[p, i])) for p in np.flatnonzero(near[:, i])]
        out = pd.DataFrame(out, columns=[*DEALT])
        out["joined"] = out["joined"].astype("Int64")
        return out

    lean(todo.sparkSession)
    return rows.groupBy("region", "slice").cogroup(pivots.groupBy("of", "slice")).applyInPandas(deal, ", ".join(f"{name} {kind}" for name, kind in DEALT.items()))


def unsettled(dealt: DataFrame, percent: float) -> DataFrame:
    """The rows that can still have a link that isn't known.

    Rows linked with their region's pivot are one group. One of them can be linked with a row that isn't in it only if that one is
    no further from the pivot than it and a link together; with none so near, there is nothing left to compare it with.
    """
    tau = (100 - percent) / 100 + 1e-9
    edge = dealt.groupBy("region").agg(F.min(F.when(~F.col("linked"), F.col("near"))).alias("edge"))
    return dealt.join(edge, "region").where(~F.col("linked") | (F.col("near") + tau >= F.col("edge"))).select("region", "doc_id", "n", "z", "joined", "old")


def blocks(todo: DataFrame) -> DataFrame:
    """Each region's rows in blocks of half the limit, and each pair of blocks as a region of its own."""
    n = 2 * F.col("parts")
    block = F.pmod(F.xxhash64("doc_id"), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.concat_ws("-", F.col("region"), F.least(F.col("block"), j), F.greatest(F.col("block"), j)))
    return todo.withColumn("block", block).select(F.explode(pairs).alias("region"), "doc_id", "n", "z", "joined", "old")
