import hashlib

import numpy as np
from helpers import documents
from pyspark.sql import functions as F

from steward.llm import common as C
from steward.llm import minhash as M
from steward.llm.common import shingles


def test_contract(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).collect()}
    ids = sorted(docs, reverse=True)
    out = {r["doc_id"]: r for r in M.fingerprints(documents(spark, sf_dir)).collect()}
    assert sorted(out) == sorted(docs)
    for i, own in enumerate(ids):
        text, other = docs[own], docs[ids[(i + 1) % len(ids)]]
        n = len(text) // 3
        changed = text[: len(text) - n] + other[:n]
        r = out[own]
        assert r["n_chars"] == len(text) and r["edited_text"] == changed
        assert r["fingerprint"] == M.fingerprint(M.signature(text)) and r["edited_fingerprint"] == M.fingerprint(M.signature(changed))
        assert r["near_next"] == M.likeness(M.signature(text), M.signature(other))
    by_text = {}
    for own, r in out.items():
        assert by_text.setdefault(hashlib.md5(docs[own].encode()).digest(), r["fingerprint"]) == r["fingerprint"]


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(5000)]
    errors = []
    for share in (0.95, 0.8, 0.5, 0.2):
        a = [words[i] for i in rng.integers(0, 5000, 600)]
        b = a[: int(600 * share)] + [words[i] for i in rng.integers(0, 5000, 600 - int(600 * share))]
        x, y = " ".join(a), " ".join(b)
        true = len(np.intersect1d(shingles(x, 5), shingles(y, 5))) / len(np.union1d(shingles(x, 5), shingles(y, 5)))
        errors.append(abs(true - M.likeness(M.signature(x), M.signature(y))))
    assert max(errors) < 0.13 and np.mean(errors) < 0.06


def test_edges(spark, edge, empty):
    out = M.fingerprints(edge).collect()
    assert len(out) == edge.count()
    assert {r["doc_id"]: r["n_chars"] for r in out}[1] == 0
    assert M.fingerprints(empty).count() == 0
    one = spark.createDataFrame([(5, "alone in the table of texts")], "doc_id long, text string")
    r = M.fingerprints(one).first()
    assert r["near_next"] == 1.0 and r["edited_text"] == "alone in the table" + "alone in "
    assert M.fingerprints(edge.withColumn("fingerprint", F.lit(1))).count() == edge.count()


def test_near_duplicates(spark):
    base = [f"t{i}" for i in range(200)]
    changed = [*base[:100], "other", *base[101:]]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(base)), (4, " ".join(f"u{i}" for i in range(100))), (5, ""), (6, None), (7, " ".join(base[:60])), (None, "x")]
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chains_and_whole_table_against_brute_force(spark, sf_dir):
    base = [f"t{i}" for i in range(400)]
    rows, words = [], base
    for i in range(12):  # copies of copies, each with two more words replaced: the ends are far from each other
        rows.append((1000 + (5 * i) % 12, " ".join(words)))
        words = [*words]
        words[30 * i + 9] = words[30 * i + 20] = f"e{i}"
    rows += [(r["doc_id"] + 5000, r["text"]) for r in documents(spark, sf_dir).limit(150).collect()]
    rows += [(7, rows[0][1]), (7, rows[20][1])]  # an id with two texts
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(docs).collect()}
    sets = [set(shingles(t, 5).tolist()) for _, t in rows]
    bands = [{(i, v) for i, v in enumerate(M.bands(M.signature(t)).tolist())} if s else set() for (_, t), s in zip(rows, sets, strict=True)]
    up = {d: d for d, _ in rows}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, x in enumerate(sets):
        for j in range(i):
            if bands[i] & bands[j] and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = root(rows[i][0]), root(rows[j][0])
                up[max(a, b)] = min(a, b)
    assert got == {d: root(d) for d in up}
    assert len({got[1000 + i] for i in range(12)}) == 1
    assert {r["doc_id"]: r["component_id"] for r in M.fingerprints(docs).collect()} == got


def test_a_linked_copy_still_links_others(spark):
    rows = []
    for n in range(20):
        a = [f"t{n}-{i}" for i in range(400)]
        b = [*a[:200], "x", *a[201:]]
        c = [f"y{i}" if i % 20 == 5 and i < 160 else w for i, w in enumerate(b)]
        x, y, z = (set(shingles(" ".join(t), 5).tolist()) for t in (a, b, c))
        assert len(x & y) >= 0.8 * len(x | y) and len(y & z) >= 0.8 * len(y | z) and len(x & z) < 0.8 * len(x | z)
        rows += [(3 * n + k, " ".join(t)) for k, t in enumerate((a, b, c))]
    keys = [set(enumerate(M.bands(M.signature(t)).tolist())) for _, t in rows]
    met = [n for n in range(20) if keys[3 * n + 1] & keys[3 * n + 2]]
    # the copies of b meet it in buckets of a only
    assert any(not (keys[3 * n + 1] & keys[3 * n + 2]) - keys[3 * n] for n in met)
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[3 * n + 1] == got[3 * n + 2] == 3 * n for n in met)


def odd_texts():
    rng = np.random.default_rng(3)
    made = ["".join("aB \u00e9\u4e2d\t\n "[i] for i in rng.integers(0, 8, rng.integers(0, 60))) for _ in range(1500)]
    long = "x" * (C.LONGEST + 5)
    return [*made, "", " ", "a", "one two", "a b c d e f g h", long, f"y {long} z", f"{long} b c d e f g", "a\x0bb\x0cc\x1c d" * 9, "w " * C.SEGMENT, " " * 300 + "b", "b" + " " * 300]


def test_signatures_of_many_texts_are_those_of_each():
    texts = odd_texts()
    own = M.owns(texts)
    pairs = [(own[i - 1], own[i]) for i in range(len(own))]
    for (x, y), new in zip(pairs, M.edited_signatures(pairs), strict=True):
        for got, text in ((x.signature, x.text), (new, M.edited(x.text, y.text))):
            expected = M.signature(text)
            assert (got == expected).all() and (got is M.EMPTY) == (expected is M.EMPTY)
            assert (M.bands(np.array([got, expected])) == M.bands(expected)).all()
    for t, (h, _) in zip(texts, C.words_of([C.lowered(t) for t in texts]), strict=True):
        assert (h == C.word_hashes(t)).all()
        assert (C.ascending(C.runs(h, 5)) == np.unique(shingles(t, 5, distinct=False))).all()
    assert [t for low, high in C.bounded(texts) for t in texts[low:high]] == texts


def test_edited_texts_hash_only_what_is_new(monkeypatch):
    texts = [" ".join(f"w{n}-{i}" for i in range(300)) for n in range(20)]
    count, least = [0], M.least
    monkeypatch.setattr(M, "least", lambda found: count.__setitem__(0, count[0] + len(found)) or least(found))
    own = M.owns(texts)
    M.edited_signatures(list(zip(own, [*own[1:], own[0]], strict=True)))
    assert count[0] < 1.4 * 296 * 20  # the texts and their edited forms have twice as many
