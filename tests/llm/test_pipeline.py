import corpus_pipeline as P
from compare import duck, expected
from helpers import documents
from pyspark.sql import functions as F
from test_jaccard_join import brute

from steward.llm import jaccard_join, lang_id, pieces, pii, segmentation
from steward.llm.oracles import OP6


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages_against_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    con = duck(sf_dir)
    kept = P.language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    model = lang_id.fit(lang_id.learnable(docs))
    label = lang_id.Labeller(model)
    want = {r["doc_id"] for r in docs.collect() if (p := label.predict(r["text"]))[0] != "und" and p[1] >= P.LEAST_SHARE}
    assert ids(kept) == want and len(want) > 0.9 * docs.count()
    kept = P.near_duplicates(spark, docs, sf_dir)
    groups = brute([(r["doc_id"], r["text"]) for r in docs.collect()], **jaccard_join.NEAR)
    assert kept.columns == docs.columns and ids(kept) == {i for i, (_, first) in groups.items() if i == first}
    kept = P.benchmark(spark, docs, sf_dir)
    columns, rows = expected(con, OP6)
    assert kept.columns == docs.columns and ids(kept) == {r[columns.index("doc_id")] for r in rows if not r[columns.index("contaminated")]}
    clean = {r["doc_id"]: r for r in P.personal_data(spark, docs, sf_dir).collect()}
    for r in docs.collect():
        assert clean[r["doc_id"]]["text"] == pii.redact(r["text"]) and clean[r["doc_id"]]["n_chars"] == len(pii.redact(r["text"]))


def test_run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    got = {r["doc_id"]: r for r in P.run(spark, sf_dir).collect()}
    assert {i: r["ids"] for i, r in got.items()} == {r["doc_id"]: r["ids"] for r in docs.collect()}
    with open(pieces.MODEL, "rb") as f:
        v = pieces.Vocabulary(f.read())
    before = {r["doc_id"]: pii.redact(r["text"]) for r in documents(spark, sf_dir).collect()}
    assert 0 < len(got) < len(before)
    for i, r in got.items():
        assert v.decode(r["ids"]) == before[i] and len(r["ids"]) == r["n_pieces"]


def test_edges(spark, sf_dir, edge, empty):
    for docs in (edge.withColumn("n_chars", F.length("text").cast("long")), empty.withColumn("n_chars", F.lit(1).cast("long")), edge.withColumn("n_chars", F.lit(1).cast("long")).withColumn("score", F.lit(1)).withColumn("ids", F.lit(2))):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "lang", "source", "ids", "n_pieces"]
        docs.count()


def test_stage_names():
    assert [f for _, f in P.STAGES] == [P.language, P.near_duplicates, P.benchmark, P.personal_data, P.pieces]
    assert segmentation.N_BEST >= 2 and P.ORACLE_SQL is None
