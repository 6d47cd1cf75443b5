import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from steward.llm import lm_score as M


def small(n=30, seed=0):
    """A lexicon of n tokens, the last third buckets of several words."""
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 400, n).astype(float))[::-1]
    parts = np.where(np.arange(n) < 2 * n // 3, 1, rng.integers(1, 9, n)).astype(float)
    return M.Lexicon({f"w{i}": i for i in range(2 * n // 3)}, np.arange(2 * n // 3, n).astype(np.uint16), counts, parts)


def trained(known, seed=1):
    net = M.Network(known)
    rng = np.random.default_rng(seed)
    net.all += rng.normal(0, 0.3, net.all.shape).astype(np.float32)
    return net


def by_hand(net, context, token):
    """log p(token | context), one number at a time."""
    known, hidden = net.known, range(M.HIDDEN)
    h = [math.tanh(sum(float(net.embed[k][context[k]][i]) for k in range(M.PLACES))) for i in hidden]
    score = [math.exp(sum(h[i] * float(net.out[i][c]) for i in hidden) + float(net.bias[c])) for c in range(len(known.starts) - 1)]
    own = next(c for c in range(len(score)) if known.starts[c] <= token < known.starts[c + 1])
    inner = {t: math.exp(sum(h[i] * float(net.word[t][i]) for i in hidden) + float(net.word_bias[t])) for t in range(known.starts[own], known.starts[own + 1])}
    return math.log(score[own] / sum(score) * inner[token] / sum(inner.values()) / known.parts[token])


def test_probabilities_by_hand_and_their_sum():
    known = small()
    net, rng = trained(known), np.random.default_rng(3)
    assert 2 < len(known.starts) - 1 < 30 and max(np.diff(known.starts)) > 2
    context = rng.integers(0, 31, (M.PLACES, 30)).astype(np.uint16)
    got = net.log_probability(context, np.arange(30))
    for t in range(30):
        assert got[t] == pytest.approx(by_hand(net, context[:, t], t), abs=1e-4)
    same = np.repeat(context[:, :1], 30, axis=1)
    assert (np.exp(net.log_probability(same, np.arange(30))) * known.parts).sum() == pytest.approx(1, abs=1e-4)


def test_gradients():
    known = small()
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 30, 60).astype(np.uint16)
    at = np.arange(M.SIDE, 60 - M.SIDE)
    net = trained(known)
    context, token = net.context(ids, at), ids[at].astype(np.int64)
    before = net.all.astype(np.float64).copy()
    loss = lambda w: -float(M.Network(known, w).log_probability(context, token).astype(np.float64).mean())
    after = M.Network(known, before)
    after.learn(context, token)
    step = (after.seen - 1e-3) ** 0.5  # what the gradient was, up to its sign, which the move has turned
    for i in rng.choice(np.flatnonzero(step > 1e-3), 40):
        w = before.copy()
        w[i] += 1e-2
        up = loss(w)
        w[i] -= 2e-2
        slope = (up - loss(w)) / 2e-2
        assert abs(abs(slope) - step[i]) < 5e-3 and (after.all[i] - before[i]) * slope < 0


def test_a_step_moves_each_class_once(monkeypatch):
    """Biases are weights of the 1 behind the hidden layer, so they take no products and steps of their own; high scores are still cut off."""
    moved, move = [], M.Network.move
    monkeypatch.setattr(M.Network, "move", lambda self, place, *x: moved.append(place) or move(self, place, *x))
    known = small()
    net = M.Network(known)
    token = np.arange(30)
    context = np.zeros((M.PLACES, 30), np.uint16)
    net.learn(context, token)
    assert len(moved) == 1 + sum(b > a + 1 for a, b in zip(known.starts, known.starts[1:], strict=False))
    net.bias[:], net.word_bias[:] = 1e6, 1e6
    assert np.isfinite(net.log_probability(context, token)).all()
    assert (net.forward(context)[1] == M.HIGHEST).all()


def test_words_are_those_of_the_pattern():
    for text in (" ".join(f"a{chr(i)}b" for i in range(0x110000)), "", "plain words_9, of ascii\x1c\x85!", "\ud800x y"):
        assert M._words(text) == re.findall(r"\w+", text)


def test_lexicon_counts_all_words_and_grows(spark, sf_dir, monkeypatch):
    docs = documents(spark, sf_dir)
    known = M.lexicon(docs, "text")
    words = [w for r in docs.select("text").collect() for w in M._words((r[0] or "").lower())]
    assert known.counts.sum() == len(words) and known.parts.sum() == len(set(words))
    n = Counter(words)
    top = n.most_common(1)[0][0]
    assert known.ids[top] == 0 and known.counts[0] == n[top]
    for w in random.Random(1).sample(sorted(set(words) - set(known.ids)), 20):
        t = known.look()[w]
        assert known.counts[t] == sum(n[x] for x in set(words) - set(known.ids) if known.look()[x] == t)
    assert (np.diff(known.counts) <= 0).all()
    monkeypatch.setattr(M, "LEAST_WORDS", 8)
    few, many = (len(M.lexicon(d, "text").ids) for d in (docs.limit(20), docs))
    assert 8 <= few < many


def ordered(rng, nexts, n):
    out = [rng.choice(sorted(nexts))]
    while len(out) < n:
        out.append(rng.choice(nexts[out[-1]]) if rng.random() < 0.8 else rng.choice(sorted(nexts)))
    return " ".join(out)


def test_shipped_settings_learn_an_order(spark):
    """Text in which a word tells much of the next: better than counts on held-out text, and real text beats its own words shuffled."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    nexts = {w: [rng.choice(words) for _ in range(4)] for w in words}
    docs = spark.createDataFrame([(i, ordered(rng, nexts, 400)) for i in range(800)], "doc_id long, text string")
    known = M.lexicon(docs, "text")
    weights = M.train(docs.repartition(2), "text", known)
    held = [ordered(rng, nexts, 200) for _ in range(60)]
    mixed = [" ".join(rng.sample(t.split(), 200)) for t in held]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(held + mixed)], "doc_id long, text string")
    mean = lambda w: {r["doc_id"]: r["mean_log_likelihood"] for r in M.score(table, known, w).collect()}
    got, counts = mean(weights), mean(M.Network(known).all)
    assert np.mean([got[i] for i in range(60)]) > np.mean([counts[i] for i in range(60)]) + 0.3
    assert sum(got[i] > got[60 + i] for i in range(60)) > 54


def test_sum_over_tokens_is_that_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "b")], "doc_id long, text string")
    known = M.lexicon(docs, "text")
    net = M.Network(known, M.train(docs, "text", known))
    look = known.look()
    got = {r["doc_id"]: r["log_likelihood"] for r in M.score(docs, known, net.all).collect()}
    for i, t in ((1, "a b c a b"), (2, "b")):
        ids = [known.edge] * M.SIDE + [look[x] for x in t.split()] + [known.edge] * M.SIDE
        total = sum(by_hand(net, [ids[k + s] for s in (-2, -1, 1, 2)], ids[k]) for k in range(M.SIDE, len(ids) - M.SIDE))
        assert total == pytest.approx(got[i], abs=1e-3)


def test_edges(edge, empty):
    out = {r["doc_id"]: r for r in M.score_corpus(edge).collect()}
    assert out[1]["n_tokens"] == 0 and out[1]["log_likelihood"] == 0 and out[1]["mean_log_likelihood"] is None
    assert out[8]["n_tokens"] == 60000 and out[6]["log_likelihood"] == pytest.approx(out[7]["log_likelihood"])
    assert M.score_corpus(empty).count() == 0
    assert "n_tokens_2" in M.score_corpus(edge.withColumn("n_tokens", F.lit(1))).columns
