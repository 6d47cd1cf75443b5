"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words: A-Z lower-cased, runs of letters, digits and non-ASCII characters. A window is WINDOW consecutive words of an item; an
item of fewer words is one window. Fingerprints: K-gram hashes, and of each WINDOW - K + 1 consecutive ones the
least; equal spans of WINDOW words have the same, so every shared span shares its fingerprint. Items shorter than
WINDOW have none, and are looked up by the hash of the whole item, for each length that occurs (at most WINDOW - 1).

Documents are read once and their texts never shuffled: the benchmark's fingerprints make a bitmap of bounded size, a
document's fingerprints are tested against it where the row is, and only those that pass leave the row, each with its place and its
words. They are joined with the benchmark's on the fingerprint and extended by comparing the words; what the
bitmap lets pass by chance finds no partner. The benchmark's table is broadcast only if it was counted and has
BROADCAST_ROWS rows at most; beyond that the join is a shuffle of fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, require, result_columns, saved

WINDOW = 10
K = 5
BROADCAST_ROWS = 200_000
#: Bits of the bitmap for each fingerprint of the benchmark, and its least and greatest size (8 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 26
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shifted(df: DataFrame, name: str, left: str, right: str, by: int, combine) -> DataFrame:
    """Column name: combine(left[i], right[i + by]) for all i where both are."""
    n = F.greatest(F.least(F.size(left), F.size(right) - by), F.lit(0))
    return df.withColumn(name, F.zip_with(F.slice(left, 1, n), F.slice(right, by + 1, n), combine))


def grams(df: DataFrame, base: str, n: int, prefix: str = "g") -> tuple[DataFrame, str]:
    """df with a column of the hashes of all runs of n words (made by doubling), and the column's name; base has hashes of words."""
    name = f"{prefix}{n}"
    if n == 1:
        return df, base
    if name in df.columns:
        return df, name
    half = 1 << (n - 1).bit_length() - 1
    df, left = grams(df, base, half, prefix)
    df, right = grams(df, base, n - half, prefix)
    return shifted(df, name, left, right, half, lambda x, y: F.xxhash64(x, y)), name


def hashed(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, words and h (a hash for each word); rows must have a column text."""
    return df.select(*keep, words(F.col("text")).alias("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def salted(name: str, n: int) -> Column:
    """Hashes of runs of n words, kept apart from those of other lengths."""
    return F.transform(name, lambda x: F.xxhash64(F.lit(n), x))


def winnowed(df: DataFrame) -> tuple[DataFrame, str]:
    """df with the least K-gram hash of each window (made by doubling), and the column's name."""
    df, least = grams(df, "h", K)
    width, done = WINDOW - K + 1, 1
    while done < width:
        step = min(done, width - done)
        df = shifted(df, f"m{done + step}", least, least, step, lambda x, y: F.least(x, y))
        least, done = f"m{done + step}", done + step
    return df, least


def fingerprints(df: DataFrame, lengths: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """df with a column of fingerprints, one for each place, for windows of each length; and the columns' names."""
    df, least = winnowed(df)
    out = {WINDOW: least}
    for n in lengths:
        df, name = grams(df, "h", n)
        df = df.withColumn(f"p{n}", salted(name, n))
        out[n] = f"p{n}"
    return df, out


def spans(name: str, n: int, passes) -> Column:
    """The places of a column of fingerprints that pass, with the n words there."""
    every = F.transform(name, lambda x, at: F.struct(at.alias("at"), x.alias("print")))
    return F.transform(F.filter(every, lambda p: passes(p["print"])), lambda p: F.struct(p["at"].alias("at"), F.lit(n).alias("n"), p["print"].alias("print"), F.array_join(F.slice("words", p["at"] + 1, n), " ").alias("span")))


def bitmap(prints: DataFrame) -> tuple[DataFrame, int]:
    """One row with an array of 64-bit words that has the bit of each print set, and the number of words; some MB at most."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * prints.count()):
        bits *= 2
    n = bits // 64
    words_ = prints.groupBy(F.pmod("print", F.lit(n)).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(print >> 57 & 63 as int))")).alias("bits"))
    every = prints.sparkSession.range(n).select(F.col("id").alias("i")).join(words_, "i", "left")
    dense = every.agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("b"))
    return dense.select(F.transform("b", lambda x: x["bits"]).alias("bitmap")), n


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item ids as strings), contaminated: one row per doc_id.

    A word is hit if it stands in an occurrence of any window. Null texts have no words. Rows that repeat a doc_id and text count
    once, and with several texts the doc_id is as its longest one, with the hits of all; null doc_ids count as one document. An empty
    benchmark hits nothing. Extra columns are not read. A document is handled as one row; a common passage makes one row for each
    place it stands in.
    """
    require(docs, doc_id, text)
    require(benchmark, "item_id", "text")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = saved(hashed(benchmark.select("item_id", F.col("text").cast("string").alias("text")), ["item_id"]).where("size(words) > 0"))
    # lengths of one-window items: a few small numbers
    short = sorted(r[0] for r in items.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect())

    # All windows of the benchmark. (Outer explodes: for plain ones the optimizer adds a filter on the array's size and
    # pushes it down through all steps that the array is made by, each time copying them.)
    own, names = fingerprints(items, short)
    always = lambda p: F.lit(True)
    every = F.when(F.size("words") >= WINDOW, spans(names[WINDOW], WINDOW, always))
    for n in short:
        every = every.when(F.size("words") == n, spans(names[n], n, always))
    windows = own.select("item_id", F.explode_outer(every).alias("w")).where("w is not null").select("item_id", "w.n", "w.print", "w.span").distinct()
    windows = saved(windows)
    bits, n_words = bitmap(saved(windows.select("print").distinct()))
    known = saved(bits)

    def passes(p: Column) -> Column:
        return F.getbit(F.get("bitmap", F.pmod(p, F.lit(n_words)).cast("int")), F.shiftright(p, 57).bitwiseAND(F.lit(63)).cast("int")) == 1

    # Documents: fingerprints that pass leave the row with their place and words.
    seen, names = fingerprints(hashed(docs, ["doc_id"]), short)
    seen = seen.withColumn("bitmap", known.select("bitmap").scalar())
    found = []
    for n, name in names.items():
        found.append(F.when(F.exists(F.array_distinct(name), passes), spans(name, n, passes)).otherwise(F.array().cast("array<struct<at:int,n:int,print:bigint,span:string>>")))
    seen = seen.select("doc_id", F.xxhash64("words").alias("doc"), F.size("words").cast("long").alias("n_words"), F.concat(*found).alias("found"))
    rows = seen.select("doc_id", "doc", "n_words", F.explode_outer("found").alias("f")).select("doc_id", "doc", "n_words", "f.*")
    matched = rows.join(bounded(windows, windows), ["print", "n", "span"], "left")
    hit = F.when(F.col("item_id").isNotNull(), F.struct("at", (F.col("at") + F.col("n")).alias("to")))
    # one row a document; words hit: starts and ends of the spans, added up from left to right
    per = matched.groupBy("doc_id", "doc").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["to"] - F.greatest(x["at"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["to"]).alias("to"))
    per = per.select("doc_id", "n_words", F.aggregate("spans", start, step)["n"].cast("long").alias("n_hit"), "items")
    out = per.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def bounded(df: DataFrame, counted: DataFrame) -> DataFrame:
    """df with a broadcast hint if counted (a saved table of as many rows) has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if counted.count() <= BROADCAST_ROWS else df


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that no benchmark window occurs in."""
    bad, = result_columns(docs, "own")
    hit = counted(contaminated(docs, benchmark, doc_id, text).where("contaminated").select(F.col("doc_id").alias(bad)))
    return docs.join(hit, docs[doc_id].eqNullSafe(hit[bad]), "left_anti")
