"""Sheet headers mapped to canonical fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weights and thresholds of the score.
EXACT, PARTIAL, SECTION, PRIOR = 0.6, 0.4, 0.2, 0.3
AUTO, REVIEW = 0.9, 0.7
RULE_WEIGHT, MODEL_WEIGHT, MODEL_LEAST = 0.7, 0.3, 0.5


def dictionary(spark: SparkSession, fields: dict[str, list[str]]) -> DataFrame:
    """A row for each alias: field, ordinal (of the field), alias."""
    return spark.createDataFrame([(f, i, a) for i, (f, names) in enumerate(fields.items()) for a in names], "field string, ordinal int, alias string")


def leaf(header: Column) -> Column:
    found = F.regexp_extract_all(header, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(header)


def _within(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def scores(headers: DataFrame, aliases: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Per header (id, header, section) and field: the rule score. aliases is a dictionary of some hundred rows; each header meets
    each, as a match on substrings has no key, with the dictionary as one array of one row.
    """
    listed = aliases.groupBy("field", "ordinal").agg(F.collect_list(F.lower("alias")).alias("names"))
    book = listed.agg(F.collect_list(F.struct("ordinal", "field", "names")).alias("book"))
    h = headers.withColumn("_leaf", F.lower(leaf(F.col("header")))).join(F.broadcast(book), F.lit(True), "left")
    h = h.withColumn("_f", F.explode("book")).drop("book")
    exact = F.exists("_f.names", lambda a: a == F.col("_leaf"))
    partial = F.exists("_f.names", lambda a: _within(F.col("_leaf"), a))
    alias = F.when(exact, EXACT).when(partial, PARTIAL).otherwise(0.0)
    section = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.when(F.exists("_f.names", lambda a: _within(a, F.lower("section"))), SECTION).otherwise(0.0)).otherwise(0.0)
    if prior is not None:
        h = h.join(prior.select(F.col("header").alias("_ph"), F.col("field").alias("_pf")), (F.col("header") == F.col("_ph")) & (F.col("_f.field") == F.col("_pf")), "left")
        known = F.when(F.col("_pf").isNotNull(), PRIOR).otherwise(0.0)
    else:
        known = F.lit(0.0)
    return h.select("id", "header", F.col("_f.field").alias("field"), F.col("_f.ordinal").alias("ordinal"), F.least(F.lit(1.0), alias + section + known).alias("score"))


def best(scored: DataFrame) -> DataFrame:
    """Per header the field of the greatest score above 0; the first in dictionary order of equal ones."""
    first = Window.partitionBy("id").orderBy(F.desc("score"), "ordinal")
    top = scored.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return top.select("id", "header", F.when(F.col("score") > 0, F.col("field")).alias("field"), "score")


def status(score: Column, field: Column) -> Column:
    return F.when(field.isNull(), "UNMAPPED").when(score >= AUTO, "AUTO_APPROVED").when(score >= REVIEW, "NEEDS_REVIEW").otherwise("REQUIRES_HUMAN")


def hybrid(rule: Column, model: Column) -> Column:
    return F.round(RULE_WEIGHT * rule + MODEL_WEIGHT * model, 4)


def map_columns(headers: DataFrame, aliases: DataFrame, prior: DataFrame | None = None, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, header, field, confidence, status. model: headers -> (id, model_field, model_confidence), a pluggable second opinion."""
    out = best(scores(headers, aliases, prior))
    if model is None:
        return out.select("id", "header", "field", F.col("score").alias("confidence"), status(F.col("score"), F.col("field")).alias("status"))
    out = out.join(model(headers), "id", "left")
    sure = F.coalesce(F.col("model_confidence") >= MODEL_LEAST, F.lit(False))
    field = F.when(sure & F.col("model_field").isNotNull(), F.col("model_field")).otherwise(F.col("field"))
    confidence = F.when(F.col("model_confidence").isNotNull(), hybrid(F.col("score"), F.col("model_confidence"))).otherwise(F.col("score"))
    return out.select("id", "header", field.alias("field"), confidence.alias("confidence"), status(confidence, field).alias("status"))


#: Fields, and aliases of each, that a prompt lists at most.
PROMPT_FIELDS, PROMPT_ALIASES = 30, 5


def prompts(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """id and prompt: what a language model is asked about each header, for an answer that reply() reads."""
    listed = aliases.where(F.col("ordinal") < PROMPT_FIELDS).groupBy("ordinal", "field").agg(F.array_join(F.slice(F.collect_list("alias"), 1, PROMPT_ALIASES), ", ").alias("names"))
    book = listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "field", "names"))), lambda x: F.concat(F.lit("* "), x["field"], F.lit(": "), x["names"])), "\n").alias("book"))
    ask = F.concat(
        F.lit("Which of these fields does a column with the header "), F.to_json(F.struct("header")), F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" in the section "), F.col("section"))).otherwise(F.lit("")), F.lit(" hold?\n"), F.coalesce("book", F.lit("")),
        F.lit('\nAnswer with one JSON object: "canonical_field" (one of the fields, or null), "confidence" (0 to 1), "reasoning" (one sentence).'),
    )
    return headers.join(F.broadcast(book), F.lit(True), "left").select("id", ask.alias("prompt"))


def reply(text: Column) -> Column:
    """struct<field, confidence, reasoning> of a model's answer: the JSON between the first brace and the last, whatever stands
    around it. Without one, or with a confidence that is no number, there is no field, and the confidence is 0.
    """
    found = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "canonical_field string, confidence string, reasoning string")
    sure = F.when(found["confidence"].isNull(), 0.0).otherwise(found["confidence"].try_cast("double"))
    return F.struct(F.when(sure.isNotNull(), found["canonical_field"]).alias("field"), F.coalesce(sure, F.lit(0.0)).alias("confidence"), found["reasoning"].alias("reasoning"))


def by_replies(ask: Callable[[DataFrame], DataFrame], aliases: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A model for map_columns. ask: (id, prompt) -> (id, reply), by whatever service the caller has."""

    def model(headers: DataFrame) -> DataFrame:
        return ask(prompts(headers, aliases)).withColumn("_r", reply(F.col("reply"))).select("id", F.col("_r.field").alias("model_field"), F.col("_r.confidence").alias("model_confidence"))

    return model


def counts(mapped: DataFrame) -> DataFrame:
    """One row: columns, and how many have each status."""
    names = ("AUTO_APPROVED", "NEEDS_REVIEW", "REQUIRES_HUMAN", "UNMAPPED")
    return mapped.agg(F.count("*").alias("columns"), *(F.count_if(F.col("status") == s).alias(s.lower()) for s in names))
