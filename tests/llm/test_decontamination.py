import random
import re

from compare import actual, duck, expected
from helpers import documents
from pyspark.sql import functions as F

from steward.llm import decontamination as D
from steward.llm import queries
from steward.llm.oracles import OP6

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(D.UPPER, D.LOWER)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = WORD.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        out[i] = (len(w), len(hit), sorted(found))
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in df.collect()}


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_brute_force(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(["a", "B", "é", "dd", "9", "x.y", "Z-z"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 2, 4, 9, 10, 11, 25, 40]))) for i in range(25)] + [(90, None), (91, "!!!"), (92, "same words here"), (93, "same words here")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, f"{say(5)} {rng.choice(items)[1] or ''} {say(5)}") for i in range(40)] + [(300, None), (301, ""), (302, "SAME, words; here")]
    assert result(D.contaminated(*frames(spark, docs, items))) == brute(docs, items)


def test_every_shared_span_of_a_window_is_found(spark):
    rng = random.Random(12)
    item = [f"i{k}" for k in range(60)]
    docs = []
    for k in range(51):
        docs.append((k, " ".join([f"n{rng.randint(0, 999)}" for _ in range(7)] + item[k : k + 10] + [f"n{rng.randint(0, 999)}" for _ in range(7)])))
        docs.append((1000 + k, " ".join([f"n{rng.randint(0, 999)}" for _ in range(7)] + item[k : k + 9] + ["no"])))
    got = result(D.contaminated(*frames(spark, docs, [(1, " ".join(item))])))
    assert all(got[k][1] == 10 and got[1000 + k][1] == 0 for k in range(51))


def test_without_broadcast(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    assert actual(queries.op6_decontamination(spark, sf_dir)) == expected(duck(sf_dir), OP6)


def test_sql(spark, sf_dir):
    assert actual(queries.op6_decontamination(spark, sf_dir)) == expected(duck(sf_dir), OP6)


def test_native(spark, sf_dir):
    plan = queries.op6_decontamination(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_filter_keeps_clean_rows(spark, sf_dir):
    docs = documents(spark, sf_dir)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = D.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    bad = D.contaminated(docs, bench).where("contaminated").count()
    assert bad > 0 and kept.count() == docs.count() - bad


def test_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "C D E F G H I J K L M"), (2, "word"), (3, None)], "item_id long, text string")
    got = result(D.contaminated(edge, items))
    assert got[6] == got[7] == (16, 11, ["1"]) and got[4] == (1, 1, ["2"]) and got[1] == (0, 0, []) and got[None] == (5, 0, [])
    assert D.contaminated(empty, items).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(edge, nothing).where("contaminated").count() == 0
    assert D.contaminated(edge.withColumn("n_hit", F.lit(1)).withColumn("own", F.lit(2)), items).where("contaminated").count() == 3
    assert "own" in D.without_contaminated(edge.withColumn("own", F.lit(2)), items).columns
