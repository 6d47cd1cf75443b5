"""From raw documents to piece ids: each stage's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steward.llm import decontamination, jaccard_join, lang_id, pii, segmentation
from steward.llm.common import counted, shared_folder, table

#: Documents go if less than this share of their letters is in one language.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that is recognised; those without letters, or a jumble of languages, go."""
    model = lang_id.fit(lang_id.learnable(docs))
    found = lang_id.identify(docs, model)
    name, score = found.columns[len(docs.columns) : len(docs.columns) + 2]
    return found.where((F.col(name) != lang_id.UNKNOWN) & (F.col(score) >= LEAST_SHARE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near duplicates (five words, a similarity of 0.8 or more, directly or by others)."""
    groups = jaccard_join.component_ids(docs, **jaccard_join.NEAR)
    gone = counted(groups.where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a window of a benchmark item occurs in."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows."""
    found = pii.detect(docs)
    redacted = found.columns[len(docs.columns) + 6]
    out = found.withColumn("text", F.col(redacted))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (the best segmentation) and n_pieces."""
    plain = docs.select("doc_id", "lang", "source", "text")
    return segmentation.encode(plain).select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("pieces", pieces)]

#: The stages learn, search and walk lattices; SQL can't express them. tests/llm holds the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
