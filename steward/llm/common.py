"""What the operators share: tables, durable intermediate results, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words that a Python worker remembers at most; the memory is emptied when full.
REMEMBERED = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where neither the setting nor the context has one and all runs in this process (as in tests) a local folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="steward-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def saved(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/steward-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._steward_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a saved table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._steward_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids (some 20 bytes each) that are broadcast at most, after they were counted; beyond that a join shuffles both sides.
BROADCAST_IDS = 1_000_000


def counted(ids: DataFrame) -> DataFrame:
    """A table of ids, written and counted, with a broadcast hint if it has BROADCAST_IDS rows at most."""
    ids = saved(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


#: Rows that are handled at a time where texts are turned into other things, and rows of the Arrow batches that carry them.
ROWS, BATCH_ROWS = 256, 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: glibc's names: blocks from this size on are given back when freed, and so many arenas are kept for threads.
MMAP_THRESHOLD, ARENA_MAX, LARGE = -3, -8, 1 << 18


def lean(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows where the session has Spark's usual 10,000: whole texts of so many rows are held at once
    by the JVM, off its heap, and by the Python worker.
    """
    if spark.conf.get(ARROW_ROWS, None) in (None, "10000"):
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def tidy(work):
    """work, a function of batches, that gives freed memory back to the system when a task ends.

    Python workers are kept for later tasks; what the allocators hold on to would count against the executor all that time.
    """

    def run(batches):
        c = ctypes.CDLL(None)
        with contextlib.suppress(OSError, AttributeError):  # only glibc has these
            c.mallopt(MMAP_THRESHOLD, LARGE)
            c.mallopt(ARENA_MAX, 2)
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                c.malloc_trim(0)

    return run


def in_pandas(df: DataFrame, work, shape: T.StructType | str) -> DataFrame:
    """mapInPandas with small batches, in workers that give memory back."""
    lean(df.sparkSession)
    return df.mapInPandas(tidy(work), shape)


def in_arrow(df: DataFrame, work, shape: T.StructType | str) -> DataFrame:
    """mapInArrow with small batches, in workers that give memory back."""
    lean(df.sparkSession)
    return df.mapInArrow(tidy(work), shape)


def map_rows(df: DataFrame, work, ddl: str) -> DataFrame:
    """mapInPandas for a function of small frames: ROWS rows of a batch at a time, so that what is made of a batch stays small."""
    shape = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(shape)

    def run(batches):
        frames = (b.slice(low, ROWS).to_pandas() for b in batches for low in range(0, b.num_rows, ROWS))
        for out in work(frames):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return in_arrow(df, run, shape)


_pack = zstandard.ZstdCompressor(1, write_content_size=True)
_unpack = zstandard.ZstdDecompressor()


def packed_bytes(raw: bytes) -> bytes:
    return _pack.compress(raw)


def unpacked_bytes(z: bytes) -> bytes:
    return _unpack.decompress(z)


def packed(text: str | None) -> bytes:
    """A text as it is shuffled: UTF-8, compressed."""
    return packed_bytes((text or "").encode("utf-8", "surrogatepass"))


def unpacked(z: bytes) -> str:
    return unpacked_bytes(z).decode("utf-8", "surrogatepass")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def result_columns(df: DataFrame, *names: str) -> list[str]:
    """Names for result columns that don't clash with the input's (a suffix _2, _3, ... is added)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        name, i = n, 2
        while name.lower() in taken:
            name, i = f"{n}_{i}", i + 1
        taken.add(name.lower())
        out.append(name)
    return out


def schema_with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


#: Bytes hashed at a time, and the longest word that is hashed so (longer ones by xxhash): bounds the tables and the memory.
SEGMENT, LONGEST = 1 << 18, 1 << 16
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_code = np.random.default_rng(41).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_code[_space] = 0  # white space adds nothing to a sum
_base = 0x9E3779B97F4A7C15
_power = np.cumprod(np.r_[np.uint64(1), np.full(SEGMENT + LONGEST, _base, np.uint64)])
_inverse = np.cumprod(np.r_[np.uint64(1), np.full(SEGMENT + LONGEST, pow(_base, -1, 2**64), np.uint64)])


def lowered(text: str | None) -> bytes:
    """UTF-8 of the text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's words: A-Z lower-cased, split at ASCII white space."""
    return hashed_words(lowered(text))[0]


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of a lower-cased text.

    A word's hash is the sum of its bytes' codes times powers of an odd base, modulo 2**64. The sums of all words are taken at once over the
    text, with powers by place in the text, and divided by the power at the word's start (the base has an inverse).
    """
    b = np.frombuffer(raw, np.uint8)
    inside = ~_space[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[:-1] = inside
    edge[1:] ^= inside
    change = np.flatnonzero(edge)
    starts, ends = change[::2], change[1::2]
    out = np.empty(len(starts), np.uint64)
    sizes = ends - starts
    longest = sizes.max(initial=0)
    low = 0
    while low < len(starts):
        if sizes[low] > LONGEST:
            out[low] = xxhash.xxh3_64_intdigest(raw[starts[low] : ends[low]])
            low += 1
            continue
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + SEGMENT)))
        if longest > LONGEST and (long := np.flatnonzero(sizes[low:high] > LONGEST)).size:
            high = low + int(long[0])
        first, last = starts[low], ends[high - 1]
        terms = _code[b[first:last]] * _power[: last - first]
        at = starts[low:high] - first
        out[low:high] = np.add.reduceat(terms, at) * _inverse[at]
        low = high
    return mixed(out + sizes.astype(np.uint64)), starts, ends


def words_of(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and ends of the words of each lower-cased text, worked out at once: short texts cost little more than their bytes."""
    hashes, starts, ends = hashed_words(b" ".join(raws))
    out, base, at = [], 0, 0
    for raw in raws:
        to = at + int(np.searchsorted(starts[at:], base + len(raw)))
        out.append((hashes[at:to], ends[at:to] - base))
        base, at = base + len(raw) + 1, to
    return out


def bounded(texts) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have SEGMENT characters or one more text at most, to be worked out at once."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SEGMENT:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, distinct: bool = True) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k consecutive words; fewer words: the whole sequence as one; none: empty.

    distinct=False: all of them as they come.
    """
    out = runs(word_hashes(text), k)
    return ascending(out) if distinct else out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words as they come; fewer words: the whole sequence as one; none: empty."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(32)
    return mixed(out)


def runs_of(words: list[np.ndarray], k: int) -> list[np.ndarray]:
    """runs() of each, worked out at once; what reaches over from one to the next is left out."""
    found = runs(np.concatenate(words), k) if sum(map(len, words)) >= k else None
    out, at = [], 0
    for h in words:
        out.append(found[at : at + len(h) - k + 1] if len(h) >= k else runs(h, k))
        at += len(h)
    return out


def ascending(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def longs(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return x.view(np.int64)


def crc_class(column, modulus: int):
    """crc32 of the value as text, modulo modulus."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
