"""Queries of the operators over texts and records for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import languages, lookalike, mixing, neardup, pii, quantiles, tokens
from tidewatch.llm.sql import SQL as SQL
from tidewatch.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.kinds_found(table(spark, d, "clean_reviews"))


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.replace_pii(table(spark, d, "clean_reviews"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(table(spark, d, "clean_reviews"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(table(spark, d, "clean_reviews"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.heavy_tails(table(spark, d, "feature_series"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per group, from one sketch for each calendar month, merged; values are told within a thousandth."""
    keys = ("sku", "indicator_id", "feature")
    t = table(spark, d, "feature_series").withColumn("month", F.date_format("window_end", "yyyy-MM"))
    once = quantiles.distinct_values(t, (*keys, "month"), "raw_value", ("window_end",))
    months = quantiles.sketch(once, (*keys, "month"), "raw_value")
    early, late = months.where("month < '2024-07'").drop("month"), months.where("month >= '2024-07'").drop("month")
    return quantiles.percentiles(quantiles.merge(early, late), quantiles.QUARTILES)


def p3_sketch(spark: SparkSession, d: str) -> DataFrame:
    """The sketch itself: counts of buckets per group, for days or files to be added to."""
    keys = ("sku", "indicator_id", "feature")
    once = quantiles.distinct_values(table(spark, d, "feature_series"), keys, "raw_value", ("window_end",))
    return quantiles.sketch(once, keys, "raw_value")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_pairs(table(spark, d, "clean_reviews"))


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unify(table(spark, d, "clean_reviews"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_groups(table(spark, d, "clean_reviews"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every text that does not come back from its ids, and how many did."""
    back = tokens.decode(tokens.encode(table(spark, d, "documents"), keep=("doc_id", "text")), keep=("doc_id", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.groupBy(same.alias("same")).agg(F.count("*").alias("documents"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("chars"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segment(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_masked, p2_found, p2_groups, p3_found, p3_percentiles, p3_sketch, p6_found, p6_forms, p6_groups, p8_ids, p8_roundtrip, p9_found, p9_mixture, p9_report, p10_found, p10_segments)}
