import random

import numpy as np
import pytest
from compare import actual, duck, expected
from helpers import documents
from pyspark.sql import functions as F

from steward.llm import components
from steward.llm import jaccard_join as J
from steward.llm.components import connected
from steward.llm.oracles import OP8


def brute(rows, k=3, percent=90):
    sets = {i: set(J.shingles(t, k).tolist()) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def variants(rng, n, words, edits):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = f"z{rng.randint(0, 50)}"
        out.append(" ".join(t))
    return out


def fixture(rng):
    texts = [t for _ in range(6) for t in variants(rng, rng.randint(2, 25), rng.choice([5, 12, 40, 120]), 4)]
    texts += [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 12))) for _ in range(40)]
    texts += texts[:10]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_brute_force(spark):
    for seed in range(3):
        rows = fixture(random.Random(seed))
        assert result(J.component_ids(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_other_thresholds(spark):
    rows = fixture(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.component_ids(df, **J.NEAR)) == brute(rows, **J.NEAR)
    assert result(J.component_ids(df, percent=60, k=1)) == brute(rows, 1, 60)


def test_recursion_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "LIMIT_SETS", 12)
    monkeypatch.setattr(J, "LEAF", 6)
    rows = fixture(random.Random(9))
    assert result(J.component_ids(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_rows_join_exactly(monkeypatch):
    monkeypatch.setattr(J, "LEAF", 16)
    rng = random.Random(4)
    texts = variants(rng, 120, 60, 7) + variants(rng, 60, 60, 2)
    grams = [J.shingles(t, 3) for t in texts]
    groups = J.Groups(len(grams))
    J.join_rows(J.Sets(grams), np.arange(len(grams)), groups, 90)
    want = brute(list(enumerate(texts)))
    assert {i: groups.root(i) for i in range(len(grams))} == {i: r for i, (_, r) in want.items()}
    assert len(groups.links) < len(grams)


@pytest.mark.parametrize("percent", [90, 80, 55])
def test_window_is_enough(percent):
    for n in range(1, 110):
        count, reach = J.window(n, percent)
        l = J.least_shared(n, percent)  # noqa: E741
        for m in range(n, 140):
            other, back = J.window(m, percent)
            for both in range(1, n + 1):
                if J.linked(both, n, m, percent):
                    # the l-th shared shingle comes after l - 1 shared ones and all that aren't shared at the latest
                    assert l <= both
                    assert n - both + l - 1 < count and m <= reach[n - both + l - 1]
                    assert m - both + l - 1 < other and n <= back[m - both + l - 1]


def test_pairs_are_counted_and_large_regions_kept(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(J, "EXTRA", 20)
    rows = fixture(random.Random(21))
    assert result(J.component_ids(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_sql(spark, sf_dir):
    assert actual(J.component_ids(documents(spark, sf_dir))) == expected(duck(sf_dir), OP8)


def test_edges(spark, edge, empty):
    got = J.component_ids(edge).collect()
    assert len(got) == edge.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[1] == (0, 1) and by[4] == (1, 4) and by[7] == by[6] == (14, 6) and by[None] == (3, None)
    assert J.component_ids(empty).count() == 0
    assert J.component_ids(edge.withColumn("n_shingles", F.lit("x"))).count() == edge.count()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(90)] + [(500, 500)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: root(i) for i in list(up)}
    assert connected(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars are written once; a chain of three takes one round more, of two tables."""
    written, save = [], components.saved
    monkeypatch.setattr(components, "saved", lambda df: written.append(0) or save(df))
    for edges, jobs in (([(9, 1), (2, 1), (1, 7), (4, 3), (6, 6)], 1), ([(1, 2), (2, 3)], 3)):
        written.clear()
        got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == ({9: 1, 2: 1, 1: 1, 7: 1, 4: 3, 3: 3, 6: 6} if jobs == 1 else {1: 1, 2: 1, 3: 1})
        assert len(written) == jobs


def test_small_regions_are_joined_many_at_once(spark, monkeypatch, capfd):
    """Regions of a partition come as one stream, whatever their number, and what is hashed at once doesn't join them."""
    monkeypatch.setattr(J, "SEGMENT", 500)
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(f"{r}", 10 * r + i, 98, J.packed(t), j) for r in range(40) for i, (t, j) in enumerate([(a, None), (a + " x", None), (b, 2**60), (b + " x y", None), ("c d e", 2**60 + 1), ("c d e", 2**60)])]
    found = J.local(spark.createDataFrame(rows, "region string, doc_id long, n long, z binary, joined long"), 90, 3)
    assert sorted(map(tuple, found.collect())) == sorted((10 * r + i, 10 * r + j) for r in range(40) for i, j in ((1, 0), (3, 2), (4, 2)))
    found.explain()
    assert "FlatMapGroupsInPandas" not in capfd.readouterr().out


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    a, b = ([f"{x}{i}" for i in range(200)] for x in "ab")
    edit = lambda w: " ".join([*w[:100], "other", *w[101:]])
    rows = [(5, edit(a)), (5, edit(b)), (7, " ".join(a)), (9, " ".join(b))]
    got = J.component_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {5}


@pytest.mark.parametrize("how", [J.NEAR, {}])
def test_documents_that_share_lines_are_not_shipped_as_near_duplicates(spark, monkeypatch, how):
    """A sketch that is too small for the corpus tells no line from a rare one: regions are large, but only near documents may become one."""
    shipped, candidates = [], J.candidates
    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(J, "sketch", lambda *_: np.zeros(J.SKETCH, np.int8))
    monkeypatch.setattr(J, "candidates", lambda texts, k: shipped.append(texts.count()) or candidates(texts, k))
    rng = random.Random(8)
    lines = [[f"l{j}x{i}" for i in range(12)] for j in range(6)]
    texts = [" ".join([*(f"u{rng.randint(0, 10**9)}" for _ in range(60)), *rng.choice(lines), *rng.choice(lines)]) for _ in range(80)]
    texts += [t.replace(" ", " edit ", 1) for t in texts[:5]]
    rows = list(enumerate(texts))
    assert result(J.component_ids(spark.createDataFrame(rows, "doc_id long, text string"), **how)) == brute(rows, **how)
    assert shipped == [10]


@pytest.mark.parametrize("percent", [90, 80, 55])
def test_parities_lose_no_link(percent):
    rng = random.Random(percent)
    texts = [t for words in (3, 30, 70, 300) for t in variants(rng, 40, words, 9)] + [" ".join(f"v{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 300))) for _ in range(60)]
    grams = sorted((J.shingles(t, 3) for t in texts), key=len)
    n = np.array([len(g) for g in grams])
    bits = np.array([J.parities(g, J.bits_for(len(g))).tobytes() for g in grams], object)
    ids = np.arange(len(grams))[::-1].copy()
    src, dst = J.alike(ids, n, bits, percent)
    to = dict(zip(src.tolist(), dst.tolist(), strict=True))
    for i, x in enumerate(grams):
        for j, y in enumerate(grams[:i]):
            both = len(np.intersect1d(x, y))
            if J.linked(both, len(x), len(y), percent):
                assert to.get(ids[i], ids[i]) == to.get(ids[j], ids[j])
    if percent > 55:
        assert len({to.get(i, i) for i in ids.tolist()}) > 50  # the unlike stay apart


def test_sketch_grows_with_the_corpus(spark, monkeypatch):
    """With as many counters for any corpus, shingles of hundreds of documents pass for rare in a large one."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 300))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    grams = np.concatenate([J.shingles(t, 3, distinct=False) for t in texts])
    for load, bits in ((8, 20), (1 / 300, 22)):  # the second stands for a corpus that is so much larger
        monkeypatch.setattr(J, "LOAD", load, raising=False)
        level = J.sketch(df, "text")
        want = 4 * np.log2(1 + np.bincount((grams >> np.uint64(64 - bits)).astype(int), minlength=1 << bits))
        assert len(level) == 1 << bits and (level == want.astype(np.int8)).all()
    assert J.ranked(np.unique(grams), level).tolist() == sorted(np.unique(grams).tolist(), key=lambda g: (level[g >> 42], g))
