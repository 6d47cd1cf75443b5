import itertools
import random
import struct
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from helpers import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from steward.llm import pieces, segmentation, token_count

TEXTS = ["", " ", "  ", "a", " a", "a ", "hello  world", "tab\there", "line\nbreak\n\n", "▁", "a▁b", "éü中\U0001f600", "x" * 300, "the quick brown fox", "\x00\x7f", "...!!!", "=====", "   a   b   "]


@pytest.fixture(scope="module")
def v():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Vocabulary(f.read())


@pytest.fixture(scope="module")
def unigram(v):
    """The library's unigram tokenizer over the same pieces and scores."""
    return Tokenizer(Unigram(list(zip(v.pieces, v.scores, strict=True)), unk_id=0, byte_fallback=True))


def test_counts_are_the_unigram_tokenizers(v, unigram, spark, sf_dir):
    texts = [t for t in TEXTS if "▁" not in t] + [r[0][:3000] for r in documents(spark, sf_dir).select("text").limit(60).collect()]
    for t in texts:
        # parts don't interact, so each is compared; over a whole text the library's running sums lose precision
        parts = v.parts(t)
        for p, (_, n) in zip(parts, pieces.solved(v, parts), strict=True):
            assert n == len(unigram.encode(p.replace(" ", "▁"), add_special_tokens=False).ids), p


def all_paths(v, part):
    """(score, ids) of every path, by the vocabulary alone."""
    if v.is_spelled(part):
        return [(v.unknown, tuple(v.spelled(part)))]
    text, normal = part.replace(" ", pieces.SPACE), {p: i for i, p in enumerate(v.pieces) if i > 2 and i not in v.bytes_.values()}
    paths = {0: [(0.0, ())]}
    for end in range(1, len(text) + 1):
        paths[end] = [(s + v.scores[normal[text[start:end]]], (*p, normal[text[start:end]])) for start in range(end) if text[start:end] in normal for s, p in paths[start]]
    return paths[len(text)]


def test_n_best_is_exhaustive(v):
    rng = random.Random(5)
    parts = [p for _ in range(250) for p in v.parts("".join(rng.choice("theringsa.é9 ") for _ in range(rng.randint(1, 9)))) if p.strip()]
    lattice = segmentation.Lattice(v, parts)
    for k, (part, got, first) in enumerate(zip(parts, segmentation.n_best(v, parts, 5), pieces.solved(v, parts), strict=True)):
        every = sorted(all_paths(v, part), key=lambda x: -x[0])
        assert [s for s, _ in got] == [s for s, _ in every[:5]]
        assert {tuple(p) for _, p in got} <= {p for _, p in every} and len({tuple(p) for _, p in got}) == len(got)
        assert got[0][0] == first[0] and len(got[0][1]) == first[1]
        score, ids, loss = lattice.first_path(k)
        assert (score, ids) == got[0] and (loss == score - every[1][0] if len(every) > 1 else loss == float("inf"))


def alone(v, parts):
    """(score, loss, ids) of each part's first path, each followed alone."""
    lattice = segmentation.Lattice(v, parts)
    found = [lattice.first_path(p) for p in range(len(parts))]
    return [(s, x, b"".join(v.code[i] for i in ids)) for s, ids, x in found]


def listed(firsts):
    ends = np.r_[0, np.cumsum(firsts.count)]
    return [(s, x, firsts.ids[low:high].astype("<i4").tobytes()) for s, x, low, high in zip(firsts.score.tolist(), firsts.loss.tolist(), ends[:-1], ends[1:], strict=True)]


def some_parts(v, seed, letters="theringsa.\u00e9\u4e2d\x009 1b\n\u2581", n=400):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 5, 30, 200)))) for _ in range(n)] + ["a" * k for k in (63, 64, 65, 300)] + TEXTS
    return [p for t in texts for p in v.parts(t)]


def test_first_paths_in_step_are_those_found_alone(v):
    parts = some_parts(v, 6)
    short = sorted({p for p in parts if len(p) <= pieces.LONG and not v.is_spelled(p)}, key=len, reverse=True)
    assert listed(segmentation.first_paths(v, short)) == alone(v, short)
    assert listed(segmentation.first_paths(v, short[-1:])) == alone(v, short[-1:])


def test_known_paths_are_bounded_and_the_same(v, monkeypatch):
    known, rng, parts = segmentation.Known(v, 50, 40), random.Random(4), some_parts(v, 7)
    want = dict(zip(parts, alone(v, parts), strict=True))
    assert listed(known.of([])) == []
    for _ in range(60):
        some = rng.choices(parts, k=rng.randint(1, 60))
        assert listed(known.of(some)) == [want[p] for p in some]
        assert len(known.young[0]) <= 20 and len(known.old[0]) <= 80 and not any(len(p) > pieces.LONG for p in (*known.young[0], *known.old[0]))
    monkeypatch.setattr(segmentation, "MANY", 7)
    assert listed(known.of(parts)) == [want[p] for p in parts]
    assert [t for group in segmentation.cut(v, [*TEXTS, None]) for t in group] == [v.parts(t) for t in [*TEXTS, ""]]


def test_new_parts_cost_less_than_when_solved_alone(v):
    """Texts of words that never come again: all that is done for them takes less than half the time that their first paths take part by part."""
    rng = random.Random(9)
    words = list({"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 12))) for _ in range(60_000)})
    texts = [" ".join(words[k : k + 300]) for k in range(0, len(words), 300)]
    with open(pieces.MODEL, "rb") as f:
        held = SimpleNamespace(value=f.read())

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    batch = pa.RecordBatch.from_pydict({"text": texts})
    whole = min(seconds(lambda: list(segmentation.segmented(iter([batch]), "text", held, 3, segmentation.WIDE))) for _ in range(3))
    parts = [p for t in texts for p in v.parts(t)]
    assert 2 * whole < min(seconds(lambda: alone(v, parts)) for _ in range(3))


def test_combined_is_exhaustive():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(((-rng.randint(0, 9), i) for i in range(rng.randint(1, 4))), reverse=True) for _ in range(rng.randint(1, 5))]
        want = sorted((sum(c) for c in itertools.product(*([s for s, _ in x] for x in lists))), reverse=True)[:4]
        losses = [x[0][0] - x[1][0] if len(x) > 1 else float("inf") for x in lists]
        near = [lists[p] for p in segmentation.nearest(losses, 4)]
        assert [sum(x[0][0] for x in lists) - c for c, _ in segmentation.combined(near, 4)] == want


def test_parts_lose_nothing(v):
    for t in TEXTS:
        assert "".join(v.parts(t)) == (" " + t if t else "")


def test_whole_texts_are_best(v):
    """Cutting a text changes no best score: every path of a few short texts is tried."""
    for t in ("ab. cd", "a1b", " x  y", "né!a", "a▁\nb"):
        inner = (" " + t).replace(" ", pieces.SPACE)
        normal = {p: i for i, p in enumerate(v.pieces) if i > 2 and i not in v.bytes_.values()}
        best = [0.0]
        literal = {i for i, c in enumerate(" " + t) if v.is_spelled(c)}
        for end in range(1, len(inner) + 1):
            best.append(max([best[s] + v.scores[normal[inner[s:end]]] for s in range(end) if inner[s:end] in normal and not literal & set(range(s, end))] + ([best[end - 1] + v.unknown] if end - 1 in literal else [])))
        assert best[-1] == sum(s for s, _ in pieces.solved(v, v.parts(t)))


def test_memory_is_bounded(v):
    known = pieces.Remembered(lambda parts: pieces.solved(v, parts), 30, 20)
    rng = random.Random(3)
    texts = [v.parts(" ".join(rng.choice("abcdefgh") * rng.randint(1, 80) for _ in range(rng.randint(0, 6)))) for _ in range(300)]
    for parts, got in zip(texts, known.of(texts), strict=True):
        assert got == pieces.solved(v, parts)
    assert len(known.young) < 60 and len(known.old) < 60


def test_cuts_cross_no_piece(v):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert not any("▁" in p.lstrip("▁") or "\n" in p for p in map(model.id_to_piece, range(model.get_piece_size())))


def test_round_trip_and_counts_over_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    both = segmentation.digests(docs).join(token_count.count_tokens(docs).select("doc_id", "n_tokens", "best_score"), "doc_id")
    row = both.agg(F.bool_and("round_trip"), F.bool_and(F.col("n_pieces") == F.col("n_tokens")), F.bool_and(F.col("scores")[0] == F.col("best_score"))).first()
    assert tuple(row) == (True, True, True)


def test_edges(spark, edge, empty):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for docs in (edge, texts):
        for r in segmentation.encode(docs).collect():
            assert r["decoded"] == (r["text"] or "") and len(r["ids"]) == r["sizes"][0] and r["scores"] == sorted(r["scores"], reverse=True)
    assert segmentation.encode(empty).count() == token_count.count_tokens(empty).count() == 0
    assert token_count.count_tokens(edge).where("doc_id = 1").first()["n_tokens"] == 0
    assert "ids_2" in segmentation.encode(edge.withColumn("ids", F.lit(1))).columns
    assert "n_tokens_2" in token_count.count_tokens(edge.withColumn("n_tokens", F.lit(1))).columns


def model_file(path, pieces_):
    """A unigram model file: (piece, score) after <unk> and the bytes, put together by hand."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(n, value):
        if isinstance(value, bytes):
            return number(n << 3 | 2) + number(len(value)) + value
        return number(n << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else number(n << 3) + number(value)

    rows = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(p, s, 1) for p, s in pieces_]
    proto = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, kind)) for p, s, kind in rows)
    proto += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path.write_bytes(proto)
    return str(path)


VOCABULARIES = {
    "digits with letters": [("\u2581", -3.0), ("a", -2.0), ("b", -2.5), ("1", -2.25), ("a1", -2.75), ("\u2581a1b", -4.0), ("b1", -3.5)],
    "over spaces": [("\u2581", -3.0), ("a", -2.0), ("b", -2.5), ("1", -2.25), ("a\u2581b", -3.0), ("\u2581a\u2581b\u2581", -5.5), ("\u2581\u2581", -4.0)],
    "characters that are no pieces": [("\u2581", -3.0), ("a", -2.0), ("ab", -2.5), ("b1", -6.0), ("\u2581a", -2.25), ("1a", -3.0)],
    "line ends": [("\u2581", -3.0), ("a", -2.0), ("\n", -2.0), ("a\na", -3.25), ("1", -1.0), ("b", -1.5)],
}


@pytest.mark.parametrize("name", VOCABULARIES)
def test_any_vocabulary(spark, tmp_path, name):
    path = model_file(tmp_path / "m.model", VOCABULARIES[name])
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        v = pieces.Vocabulary(f.read())
    rng = random.Random(8)
    texts = ["", " ", "a1b b1 a b", "ab\nab\na", *("".join(rng.choice("aab1 \n\u00e9") for _ in range(rng.randint(1, 14))) for _ in range(150))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    worth = lambda ids: sum(v.scores[i] for i in ids if i not in v.bytes_.values())
    counts = {r["doc_id"]: r for r in token_count.count_tokens(docs, model=path).collect()}
    for r in segmentation.encode(docs, model=path).collect():
        t, theirs = r["text"], sp.encode(r["text"])
        assert r["decoded"] == t and len(r["ids"]) == r["sizes"][0] == counts[r["doc_id"]]["n_tokens"]
        assert r["scores"][0] == counts[r["doc_id"]]["best_score"] and r["scores"] == sorted(r["scores"], reverse=True)
        spelled = sum(i in v.bytes_.values() for i in r["ids"]), sum(i in v.bytes_.values() for i in theirs)
        assert spelled[0] == spelled[1] and worth(r["ids"]) == pytest.approx(worth(theirs)), (t, r["ids"], theirs)


@pytest.mark.parametrize("name", VOCABULARIES)
def test_any_vocabulary_in_step(tmp_path, name):
    with open(model_file(tmp_path / "m.model", VOCABULARIES[name]), "rb") as f:
        v = pieces.Vocabulary(f.read())
    parts = some_parts(v, 10, "aab1 \n\u00e9")
    assert listed(segmentation.Known(v, 100, 100).of(parts)) == alone(v, parts)


def test_nearest_of_an_array():
    rng = random.Random(11)
    for _ in range(300):
        losses = [rng.choice((0.0, 1.0, 2.0, 3.0, float("inf"))) for _ in range(rng.randint(0, 9))]
        for n in (1, 2, 3, 5):
            assert segmentation.nearest_of(np.array(losses), n) == segmentation.nearest(losses, n)
