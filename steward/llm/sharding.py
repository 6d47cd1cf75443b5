"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id): equal texts stand together. Splitters are found without moving
rows: candidate boundaries (probes) are sent to all partitions, each counts exact bytes and rows below every one, and the probes
close in on the targets until a splitter is within TOLERANCE of its target or no key lies between its probes. Of the
boundaries within tolerance one between two texts is taken first, so a group of equal texts stays in one
shard unless it is larger than the tolerance; such a group is cut between ids. Then rows are exchanged once, each to
its range, and numbered there; the exact counts below the splitters are the offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_pandas, require, result_columns, saved

SHARDS = 24
#: Share of a shard's bytes that a splitter may miss its target by.
TOLERANCE = 0.005
PROBES = 16
#: Rows to a range at most (as the mean); a shard has one range or more.
RANGE_ROWS = 500_000
#: Bits of the text's hash and of the id's.
TEXT_BITS, ID_BITS = 64, 64
ALL_BITS = TEXT_BITS + ID_BITS


def hexed(column):
    """A hash as 16 hex digits that sort as its unsigned value."""
    return F.lpad(F.hex(column), 16, "0")


def histogram(rows: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each probe, a key of ALL_BITS; probes ascend. Partitions send one row for each interval."""
    held = rows.sparkSession.sparkContext.broadcast(np.array([f"{p:032X}" for p in probes], "U32"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, n = np.zeros(len(held.value) + 1, np.int64), np.zeros(len(held.value) + 1, np.int64)
        for b in batches:
            i = np.searchsorted(held.value, b["key"].to_numpy().astype("U32"), "right")
            np.add.at(size, i, b["size"].to_numpy())
            np.add.at(n, i, 1)
        i = np.flatnonzero(n)
        yield pd.DataFrame({"i": i, "size": size[i], "n": n[i]})

    size, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in in_pandas(rows.select("key", "size"), count, "i long, size long, n long").groupBy("i").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect():
        size[r["i"]], n[r["i"]] = r["size"], r["n"]
    return list(zip(np.cumsum(size)[:-1].tolist(), np.cumsum(n)[:-1].tolist(), strict=True))


def splitters(rows: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """(key, rows below) of parts - 1 ascending splitters for near-equal bytes; rows: key (hex) and size."""
    total = rows.agg(F.sum("size"), F.count("*")).first()
    total_bytes, n = total[0] or 0, total[1]
    if not n:
        return [(0, 0)] * (parts - 1)
    slack = tolerance * total_bytes / parts
    # per splitter: greatest key known to be at or below the target with its counts, least one known to be above
    state = [[0, (0, 0), 1 << ALL_BITS, (total_bytes, n), (j + 1) * total_bytes / parts] for j in range(parts - 1)]
    done: dict[int, tuple[int, tuple[int, int]]] = {}
    for _ in range(2 * ALL_BITS):
        wanted: dict[int, list[int]] = {}
        for j, (low, below, high, above, target) in enumerate(state):
            if j in done:
                continue
            near = [(k % (1 << ID_BITS) != 0, abs(c[0] - target), k, c) for k, c in ((low, below), (high, above)) if abs(c[0] - target) <= slack and k < 1 << ALL_BITS]
            between_texts = [x for x in near if not x[0]]
            same_text = low >> ID_BITS == (high - 1) >> ID_BITS
            if between_texts or near and same_text or high - low <= 1 or above[1] - below[1] <= 1:
                pick = min(between_texts or near or [(0, abs(c[0] - target), k, c) for k, c in ((low, below), (high, above))], key=lambda x: (x[1], x[2]))
                done[j] = (min(pick[2], (1 << ALL_BITS) - 1), pick[3])
                continue
            if same_text:
                step = max(1, (high - low) // (PROBES + 1))
                wanted[j] = [k for k in range(low + step, high, step)][:PROBES]
            else:  # probes between texts as long as the interval has more than one
                a, b = (low >> ID_BITS) + 1, -(-high >> ID_BITS)
                step = max(1, (b - a) // (PROBES + 1))
                wanted[j] = sorted({k << ID_BITS for k in [*range(a, b, step), b - 1][-PROBES - 1 :] if low < k << ID_BITS < high} | {a << ID_BITS for _ in "1" if a << ID_BITS < high})
        if not wanted:
            break
        probes = sorted({k for ks in wanted.values() for k in ks})
        counted = dict(zip(probes, histogram(rows, probes), strict=True))
        for j, ks in wanted.items():
            for k in ks:
                if counted[k][0] <= state[j][4]:
                    state[j][0:2] = [k, counted[k]]
                else:
                    state[j][2:4] = [k, counted[k]]
                    break
    out, floor = [], (0, 0)
    for j in range(parts - 1):
        key, counts = done[j]
        floor = max(floor, (key, counts[1]))
        out.append(floor)
    return out


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """docs plus size (UTF-8 bytes of the text, none for null, plus 8), shard and slot (gapless from 0 in each shard).

    All columns move in one exchange; a later select that leaves the text out keeps it from moving. Null ids and
    texts, repeated rows and shards without rows are allowed; equal rows get slots one after the other. An empty table gives
    an empty one. Names that clash get a suffix.
    """
    require(docs, doc_id, text)
    size, shard_, slot, key, part = result_columns(docs, "size", "shard", "slot", "key", "part")
    keyed = docs.withColumns({
        size: F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8,
        key: F.concat(hexed(F.xxhash64(F.coalesce(F.col(text), F.lit("")))), hexed(F.xxhash64(F.col(doc_id)))),
    })
    rows = saved(keyed.select(F.col(key).alias("key"), F.col(size).alias("size")))
    each = max(1, -(-rows.count() // (shards * RANGE_ROWS)))
    cuts = splitters(rows, shards * each, tolerance)
    bounds = docs.sparkSession.sparkContext.broadcast(np.array([f"{k:032X}" for k, _ in cuts], "U32"))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, keys.to_numpy().astype("U32"), "right").astype(np.int32))

    below = [0, *(n for _, n in cuts)]
    offsets = docs.sparkSession.sparkContext.broadcast(np.array([below[i] - below[i // each * each] for i in range(len(below))], np.int64))

    @F.pandas_udf("long")
    def offset_of(parts: pd.Series) -> pd.Series:
        return pd.Series(offsets.value[parts.to_numpy()])

    number = F.row_number().over(Window.partitionBy(part).orderBy(key, doc_id, size))
    placed = keyed.withColumn(part, range_of(key)).withColumn(slot, number + offset_of(part) - 1)
    return placed.withColumn(shard_, F.floor(F.col(part) / each).cast("int")).drop(key, part)
