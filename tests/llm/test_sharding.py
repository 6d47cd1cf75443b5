import zlib

import pytest
from helpers import documents
from pyspark.sql import functions as F

from steward.llm import queries
from steward.llm import sharding as S


def check(rows, shards=S.SHARDS):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < shards for s in by)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_contract(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).collect()}
    rows = queries.op10_sharding(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes" and r["grown_shard"] is None
    sizes = check(rows)
    total, largest = sum(sizes.values()), max(r["size"] for r in rows)
    assert max(sizes.values()) <= total / 24 + largest and min(sizes.values()) >= total / 24 - largest


@pytest.mark.parametrize("ranges", [10**9, 7])
def test_balance_and_groups(spark, monkeypatch, ranges):
    monkeypatch.setattr(S, "RANGE_ROWS", ranges)
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(3000)] + [(10000 + i, "copied three times") for i in range(3)] + [(20000 + i, "hot " * 40) for i in range(1500)]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = check(got)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(sizes.values()) < 1.02 * mean and min(sizes.values()) > 0.98 * mean
    assert len({r["shard"] for r in got if r["doc_id"] // 10000 == 1}) == 1
    assert len({r["shard"] for r in got if r["doc_id"] // 20000 == 1}) > 3  # a group larger than a shard is cut


def test_histogram_is_exact(spark):
    rows = spark.range(500).select(F.concat(S.hexed(F.xxhash64("id")), S.hexed(F.xxhash64(F.col("id") + 1))).alias("key"), F.col("id").alias("size"))
    keys = sorted((int(r["key"], 16), r["size"]) for r in rows.collect())
    probes = [0, keys[3][0], keys[100][0] + 1, 1 << 127, (1 << 128) - 1]
    assert S.histogram(rows, probes) == [(sum(s for k, s in keys if k < p), sum(k < p for k, _ in keys)) for p in probes]


def test_edges(spark, edge, empty):
    check(S.shard(edge).collect())
    assert S.shard(empty).count() == 0
    out = S.shard(edge.withColumn("shard", F.lit("mine")).withColumn("key", F.lit(1)))
    assert "shard_2" in out.columns and out.first()["key"] == 1
    same = spark.createDataFrame([(1, "same")] * 50, "doc_id long, text string")
    check(S.shard(same).collect())
