"""The operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, jaccard_join, lang_id, lm_score, minhash, pii, segmentation, sharding, token_count
from .common import table
from .oracles import ORACLES


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score_corpus(docs.select("doc_id", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_count.count_tokens(docs.select("doc_id", "text")).drop("text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(lang_id.learnable(docs))
    out = lang_id.identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(lang_id.held_out(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_spans")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs.select("doc_id", "text")).drop("text", "redacted")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.from_table(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    text = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": "user", "content": text}, {"role": "assistant", "content": text}]})
    planted = chat.from_json(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(record).alias("value")))
    out = chat.read_back(chat.formatted(rows.unionByName(planted.select("conv_id", "turns"))))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.component_ids(table(spark, sf_dir, "documents"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.digests(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


__all__ = ["ORACLES", "QUERIES"]
QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_token_counts, op3_language_id, op4_personal_data, op5_chat_formatting, op6_decontamination, op7_fingerprints, op8_jaccard_join, op9_sentence_pieces, op10_sharding)}

