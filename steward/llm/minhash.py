"""MinHash fingerprints and near duplicates.

A fingerprint has PERMUTATIONS 16-bit values: for each universal hash x -> a*x + b mod 2**64 (a odd, fixed seed)
the least over the document's distinct shingles of SHINGLE words, folded to 16 bits. The share of equal values estimates the
Jaccard similarity. Fewer words than SHINGLE: the whole sequence is the one shingle; no words: a fingerprint of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import SEGMENT, ascending, bounded, counted, in_pandas, longs, lowered, map_rows, mixed, packed, runs_of, saved, shingles, unpacked, words_of
from .components import connected
from .jaccard_join import candidates, links_within

SHINGLE = 5
PERMUTATIONS = 128
#: Bands of so many values: two sets of a similarity of 0.8 share no bucket with a probability of 5e-5.
BANDS, ROWS = 25, 5
THRESHOLD = 0.8
_rng = np.random.default_rng(20240607)
_a = _rng.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_b = _rng.integers(0, 2**63, PERMUTATIONS, np.uint64)
#: Shingles hashed at a time: the table of hashes stays in the cache, and bounded for any length of text.
BLOCK = 512
EMPTY = np.full(PERMUTATIONS, 0xFFFF, np.uint16)
_room = np.empty(PERMUTATIONS * BLOCK, np.uint64)  # a new table each time would cost more than what is done in it


def signature(text: str | None) -> np.ndarray:
    found = shingles(text, SHINGLE)
    return minima(found) if len(found) else EMPTY


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each permutation over some shingles, folded."""
    return fold(least(found))


def least(found: np.ndarray) -> np.ndarray:
    """The least value of each permutation over some shingles; of none, the greatest there is."""
    out = np.full(PERMUTATIONS, ~np.uint64(0))
    for at in range(0, len(found), BLOCK):
        part = found[at : at + BLOCK]
        hashed = _room[: PERMUTATIONS * len(part)].reshape(PERMUTATIONS, len(part))
        np.multiply(_a[:, None], part, out=hashed)
        hashed += _b[:, None]
        np.minimum(out, hashed.min(axis=1), out=out)
    return out


def fold(values: np.ndarray) -> np.ndarray:
    return (mixed(values) >> np.uint64(48)).astype(np.uint16)


class Own:
    """A text with its signature, and what the signature of its edited text takes over.

    kept: least values over the shingles that end before the last third; last: hashes of the words that go before the first
    new shingle; rest: the lower-cased bytes from there on that stay. A word that the cut may lengthen is in rest.
    """

    def __init__(self, text: str):
        self.text, self.n, raw = text, len(text) // 3, lowered(text)
        self.raw, self.stays = raw, len(raw) - len(lowered(text[len(text) - self.n :]))

    def split(self, words: np.ndarray, ends: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Fill in kept, last and rest from the words and shingles of the text; the least values over all of them."""
        whole = int(np.searchsorted(ends, self.stays))  # words that end, with a white space after them, in what stays
        first = max(0, whole - SHINGLE + 1)
        self.last, self.rest = words[first:whole], self.raw[ends[whole - 1] if whole else 0 : self.stays]
        self.shared, self.kept, self.empty, self.raw = first, least(found[:first]), not len(found), None
        return np.minimum(self.kept, least(found[first:]))


def owns(texts: list[str]) -> list[Own]:
    out = [Own(t) for t in texts]
    words = words_of([x.raw for x in out])
    found = runs_of([h for h, _ in words], SHINGLE)
    values = fold(np.array([x.split(h, ends, f) for x, (h, ends), f in zip(out, words, found, strict=True)]))
    for x, v in zip(out, values, strict=True):
        x.signature = EMPTY if x.empty else v
    return out


def edited_signatures(pairs: list[tuple[Own, Own]]) -> list[np.ndarray]:
    """The signature of edited(x.text, y.text) for each pair; only shingles that aren't x's are hashed."""
    new = words_of([x.rest + lowered(y.text[: x.n]) for x, y in pairs])
    lists = [np.concatenate([x.last, h]) if len(h) or not x.shared else h for (x, _), (h, _) in zip(pairs, new, strict=True)]
    found = runs_of(lists, SHINGLE)
    values = fold(np.array([np.minimum(x.kept, least(f)) for (x, _), f in zip(pairs, found, strict=True)]))
    return [v if x.shared or len(f) else EMPTY for (x, _), f, v in zip(pairs, found, values, strict=True)]


def fingerprint(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal values; a document without words is like another without words only."""
    if (x is EMPTY) != (y is EMPTY):
        return 0.0
    return int(np.count_nonzero(x == y)) / PERMUTATIONS


def edited(text: str, other: str) -> str:
    """The last third of the code points replaced by the first as many of the other text."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """Rows (r, carrier, at, doc_id, text, component_id): ranges of descending doc_id, each followed by the first row of the next.

    A row of groups (doc_id, component_id) comes without text before the rows of its doc_id; component_id is null in all others.

    Ids alone are range-partitioned first; the greatest id of each range (one a partition) goes to the driver. Then the texts are
    shuffled once, compressed: a row goes to its range, and the first row of a range also to the one before it, as a carrier.
    Null ids come last, repeated ids in the order of their compressed texts.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(2**63)
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(least)).alias("at"))
    tops = ids.repartitionByRange(n, F.desc("at")).groupBy(F.spark_partition_id()).agg(F.max("at").alias("at")).collect()
    first = np.array(sorted({r["at"] for r in tops}), np.int64)  # ascending; range r starts at first[-1 - r]
    held = spark.sparkContext.broadcast(first)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = held.value
        for b in batches:
            up = np.searchsorted(first, b["at"].to_numpy(), "left")
            b["text"] = [packed(t) for t in b["text"]]
            yield b.assign(r=len(first) - 1 - up, carrier=0)
            lead = b[(first[np.minimum(up, len(first) - 1)] == b["at"]) & b["component_id"].isna()]
            if len(lead):
                r = len(first) - 1 - np.searchsorted(first, lead["at"].to_numpy(), "left")
                yield lead.assign(r=np.where(r > 0, r - 1, len(first) - 1), carrier=1)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(least)).alias("at"), F.lit(None).cast("string").alias("component_id"))
    if groups is not None:
        rows = rows.union(groups.select("doc_id", F.lit(""), "doc_id", F.col("component_id").cast("string")))
    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("at", T.LongType()), T.StructField("component_id", T.StringType()), T.StructField("r", T.LongType()), T.StructField("carrier", T.LongType())])
    dealt = in_pandas(rows, deal, shape)
    return dealt.repartitionById(n, F.col("r").cast("int")).sortWithinPartitions("r", "carrier", F.desc("at"), F.desc_nulls_last("component_id"), "text")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next, component_id for each row.

    component_id is that of near_duplicates, null for a null id.

    Null text counts as empty. The next document is the one before it in ascending doc_id; after the least, the
    greatest. A single document is its own next.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # doc_id, component_id and text of the row that waits for its next one
        waits = None  # range of the last row, if it waits for its next one
        group = None, None  # doc_id and component_id of the last row of groups
        read, size, pending = [], 0, []

        def work() -> None:
            nonlocal held
            pairs = []
            for (follows, doc, component, _), now in zip(read, owns([r[3] for r in read]), strict=True):
                if follows:
                    pairs.append((*held, now))
                held = doc, component, now
            if pairs:
                for (doc, component, own, now), new in zip(pairs, edited_signatures([p[2:] for p in pairs]), strict=True):
                    pending.append((doc, len(own.text), edited(own.text, now.text), fingerprint(own.signature), fingerprint(new), likeness(own.signature, new), likeness(own.signature, now.signature), component))
            read.clear()

        def out() -> pd.DataFrame:
            done = pd.DataFrame(pending, columns=[f.name for f in SCHEMA.fields])
            for name in ("doc_id", "component_id"):
                done[name] = done[name].astype("Int64")
            pending.clear()
            return done

        for b in batches:
            for r, carrier, doc, text, component in zip(b["r"], b["carrier"], b["doc_id"], b["text"], b["component_id"], strict=True):
                if not pd.isna(component):
                    group = doc, int(component)
                    continue
                follows, waits = waits == r, None if carrier else r
                if carrier and not follows:
                    continue
                known = None if pd.isna(doc) else int(doc)
                read.append((follows, known, None if known is None else group[1] if group[0] == doc else known, unpacked(text)))
                size += len(read[-1][3])
                if size > SEGMENT or len(read) >= 500:
                    work()
                    size = 0
                if len(pending) >= 500:
                    yield out()
        if read:
            work()
        if pending:
            yield out()

    rows = with_next(docs, doc_id, text, linked_groups(docs, doc_id, text))
    return in_pandas(rows.select("r", "carrier", F.col("doc_id").cast("string").alias("doc_id"), "text", "component_id"), compare, SCHEMA)


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_text", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    T.StructField("component_id", T.LongType()),
])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, component_id: documents with a Jaccard similarity of at least threshold to one of their group.

    Two texts that share a band's bucket and are as similar are in one group always. Texts without words stand alone; null ids
    are left out; an id with several texts joins their groups.
    """
    groups = linked_groups(docs, doc_id, text, threshold)
    known = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    return known.join(groups, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, component_id of the documents that have a near duplicate; the others are left out.

    Each band's bucket joins its members to its least one; what hangs together so is a neighbourhood of candidates, which holds every
    pair that shares a bucket. Its texts are shipped once, equal shingle sets as one, and all pairs of it are compared on the
    exact sets as in jaccard_join, split where it is large: no candidate is dropped because another one is linked already.
    """
    known = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = banded(known)
    reps = saved(sets.groupBy("same").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    near = connected(bucket_edges(sets)).select(F.col("node").alias("doc_id"), F.col("component").alias("region"))
    texts = known.join(counted(near.join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")), "doc_id")
    links = links_within(candidates(texts, SHINGLE), 100 * threshold, SHINGLE)
    copies = sets.join(counted(reps.where("rep < last").select("same", "rep")), "same").where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    return connected(links.union(copies)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def banded(known: DataFrame) -> DataFrame:
    """(doc_id, same, keys) of the texts with words: a digest of the shingle set, and the bucket of each band."""
    turn = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))  # a value is another bucket in each band

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for low, high in bounded(b["text"]):
                part = b.iloc[low:high]
                sets = [ascending(g) for g in runs_of([h for h, _ in words_of([lowered(t) for t in part["text"]])], SHINGLE)]
                kept = [i for i, g in enumerate(sets) if len(g)]
                if kept:
                    keys = longs(mixed(bands(fold(np.array([least(sets[i]) for i in kept]))) ^ turn))
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[kept], "same": [xxh3_128_digest(sets[i].tobytes()) for i in kept], "keys": list(keys)})

    return saved(map_rows(known, work, "doc_id long, same binary, keys array<long>"))


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band of ROWS values; a row of them for each row of values."""
    parts = values[..., : BANDS * ROWS].reshape(*values.shape[:-1], BANDS, ROWS)
    out = np.zeros(parts.shape[:-1], np.uint64)
    for i in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[..., i].astype(np.uint64) + np.uint64(1))
    return out


def bucket_edges(sets: DataFrame) -> DataFrame:
    """Edges (src, dst) from each document to the least one of each bucket that it is in.

    Buckets are counted and their least ids found with a combine before the shuffle, so a bucket of any size is one row a task;
    only buckets of two documents or more are joined to their members (sent to all tasks if they are counted few).
    """
    met = sets.select(F.explode("keys").alias("key"), "doc_id")
    least = met.groupBy("key").agg(F.min("doc_id").alias("dst"), F.count("*").alias("n")).where("n > 1").select("key", "dst")
    return met.join(counted(least), "key").select(F.col("doc_id").alias("src"), "dst").where("src <> dst").distinct()
