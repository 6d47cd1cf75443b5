import random

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from steward.llm import lang_id as L


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return L.fit(L.learnable(documents(spark, sf_dir)))


def test_held_out_accuracy(spark, sf_dir, model):
    out = L.identify(documents(spark, sf_dir), model).where(L.held_out(F.col("doc_id"))).where("lang is not null")
    row = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert row[1] > 30 and row[0] > 0.95


def test_predictions_use_the_text_alone(spark, sf_dir, model):
    docs = documents(spark, sf_dir)
    blind = docs.select(F.lit(1).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("q").alias("source"))
    a = sorted(r[0] for r in L.identify(docs, model).select(F.concat_ws("|", "text", "lang_pred", "score")).collect())
    assert a == sorted(r[0] for r in L.identify(blind, model).select(F.concat_ws("|", "text", "lang_pred", "score")).collect())


def slow_viterbi(scores, switch):
    n, k = scores.shape
    v, back = list(scores[0]), []
    for t in range(1, n):
        new, b = [], []
        for j in range(k):
            best = max(range(k), key=lambda i: (v[i] - (switch if i != j else 0), i == j, -i))
            new.append(v[best] - (switch if best != j else 0) + scores[t, j])
            b.append(best)
        v, back = new, [*back, b]
    return max(v), v, back


def worth(scores, labels, switch):
    return sum(scores[i, j] for i, j in enumerate(labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:], strict=False))


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(300):
        scores = rng.normal(0, 2, (rng.integers(1, 12), rng.integers(1, 5)))
        got = L.viterbi(scores, 2.5)
        assert worth(scores, got.tolist(), 2.5) == pytest.approx(slow_viterbi(scores, 2.5)[0])


def test_mixed_text_gives_spans(spark, sf_dir, model):
    texts = {r["lang"]: r["text"] for r in documents(spark, sf_dir).where("length(text) > 1500 and lang is not null").select("lang", "text").collect()}
    a, b = texts["de"][:700], texts["fr"][:400]
    spans = L.Labeller(model).spans(a + "\n" + b)
    names = [s[0] for s in spans]
    assert names[0] == "de" and names[-1] == "fr"
    assert L.Labeller(model).predict(a + "\n" + b)[0] == "de"


def test_scripts_narrow_the_candidates(spark):
    docs = spark.createDataFrame([(1, "привет мир " * 20, "ru"), (2, "hello world " * 20, "en"), (3, "中文 " * 20, "zh")], "doc_id long, text string, lang string")
    m = L.fit(docs)
    get = lambda t: L.Labeller(m).predict(t)[0]
    assert get("мир") == "ru" and get("world") == "en" and get("中文") == "zh"
    thai = L.Labeller(m).predict("สวัสดี")
    assert thai[0] in m.langs and thai[1] == 0 and L.Labeller(m).spans("สวัสดี")[0][0] == "und"
    assert get("hello world мир hello") == "en"


def test_edges(edge, empty, model):
    out = {r["doc_id"]: r for r in L.identify(edge, model).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3, 12))
    assert 0 <= min(r["score"] for r in out.values()) and max(r["score"] for r in out.values()) <= 1
    assert L.identify(empty, model).count() == 0
    clash = L.identify(edge.withColumn("score", F.lit("mine")).withColumn("LANG_PRED", F.lit(1)), model)
    assert "score_2" in clash.columns and "lang_pred_2" in clash.columns and clash.first()["score"] == "mine"
    nothing = L.fit(empty)
    assert {r["lang_pred"] for r in L.identify(edge, nothing).collect()} == {"und"}


def test_numbers_and_marks_are_no_letters(model):
    for t in ("\u00b2", "\u00bd \u2460 \u2167", "\u00b2\u00b3 10 __", "\u3007", "\U0001d7d8"):
        assert L.Labeller(model).predict(t) == ("und", 0.0, 0), t
    assert L.words_of("x\u00b2y a_b \u00aa") == ["x", "y", "a", "b", "\u00aa"]


def test_a_thousand_languages(spark):
    """Each is learned, the rare ones too."""
    word = lambda i: "".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = [(f"l{i}", f"{word(i)} {word(i + 5000)} " * 5) for i in range(1000)] + [("l0", f"{word(0)} " * 5)] * 50 + [("none", "123 456"), (None, "text")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    m = L.fit(docs)
    assert len(m.langs) == 1000 and "none" not in m.langs
    label = L.Labeller(m)
    got = [label.predict(f"{word(i)} {word(i + 5000)} " * 5)[0] == f"l{i}" for i in range(0, 1000, 7)]
    assert sum(got) > 0.9 * len(got)
