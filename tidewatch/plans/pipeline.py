"""The stages from raw records to evaluated alerts over stored tables; each replaces what it has written before."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import detect, evaluate, features, preprocess, score
from tidewatch.session import checkpointed
from tidewatch.sources import reviews as source

STAGES = ("preprocess", "features", "detect", "score", "evaluate")
KEYS = {"clean_reviews": (["review_id"], "date"), "daily_agg": (["sku", "date"], "date"), "feature_series": (["sku", "window_end", "indicator_id", "feature"], "window_end"), "indicator_matrix": (["sku", "window_end", "indicator_id"], "window_end"), "alerts": (["sku", "window_end"], "window_end")}


@dataclass(frozen=True)
class Settings:
    """Where tables lie, which category, and which days come out (inclusive; earlier days still serve as history)."""

    root: str
    category: str
    start: str | None = None
    end: str | None = None
    texts: bool = True
    tau: tuple[float, float] = score.TAU
    lookback: int = evaluate.LOOKBACK

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)


def _read(spark: SparkSession, s: Settings, name: str) -> DataFrame:
    return source.read_table(spark, s.path(name), KEYS[name][1], category=s.category)


def _write(df: DataFrame, s: Settings, name: str) -> None:
    keys, day = KEYS[name]
    if s.start:
        df = df.where(F.col(day) >= F.lit(s.start).cast("date"))
    if s.end:
        df = df.where(F.col(day) <= F.lit(s.end).cast("date"))
    source.write_table(df, s.path(name), day, keys)


def run_preprocess(spark: SparkSession, s: Settings, raw: str | DataFrame, audit: source.Audit | None = None) -> None:
    """Raw records (a path of JSON lines or a frame) to ``clean_reviews`` and ``daily_agg``."""
    loaded = source.load_reviews(source.read_raw(spark, raw) if isinstance(raw, str) else raw, source.check_category(s.category))
    normal = checkpointed(loaded.withColumn("text_norm", text.normalize(F.col("text_raw"))))
    kept = preprocess.dedup_exact(normal)
    clean = checkpointed(preprocess.spam_flags(kept))
    if audit:
        rows_in, rows_out = normal.count(), clean.count()
        audit.record("dedup_exact", rows_in, rows_out)
        audit.record("flag_spam", rows_out, rows_out, flagged=clean.where("is_spam").count())
    _write(clean, s, "clean_reviews")
    _write(preprocess.panel(preprocess.daily_counts(clean)), s, "daily_agg")


def all_features(panel: DataFrame, reviews: DataFrame | None) -> DataFrame:
    """The long table of every feature; without reviews only those of volume and rating."""
    long = features.volume_rating_long(panel)
    if reviews is None:
        return long
    scored = checkpointed(features.scored(reviews.drop("risk_hit")))
    usual = scored.where(~F.coalesce("is_spam", F.lit(False)))
    base = long.where("feature = 'neg_ratio_shrunk'").select("sku", "category", "window_end", "n_window")
    burst = base.join(features.term_burst(usual), ["sku", "window_end"], "left").withColumn("term_burst_score", F.when(F.col("n_window") > 0, F.coalesce("term_burst_score", F.lit(0.0))))
    risk = burst.join(features.risk_windows(usual), ["sku", "window_end"], "left").na.fill(0, ["risk_hits", "risk_distinct_users"])
    parts = [features.to_long(risk, ["term_burst_score", "risk_hits", "risk_distinct_users"])]
    a = features.aspect_windows(usual).withColumn("feature", F.concat(F.lit("aspect_neg_"), F.col("aspect"))).select("sku", "window_end", "feature", "n", "ratio")
    names = F.explode(F.array(*[F.lit(f) for f in features.VOCABULARY["I9"]])).alias("feature")
    aspect = base.select("sku", "category", "window_end", names).join(a, ["sku", "window_end", "feature"], "left")
    parts.append(aspect.select("sku", "category", "window_end", F.lit("I9").alias("indicator_id"), "feature", F.col("ratio").alias("raw_value"), F.coalesce("n", F.lit(0)).cast("int").alias("n_window")))
    parts.append(features.reliability(panel, scored))
    for p in parts:
        long = long.unionByName(p)
    return long


def run_features(spark: SparkSession, s: Settings) -> None:
    _write(all_features(_read(spark, s, "daily_agg"), _read(spark, s, "clean_reviews") if s.texts else None), s, "feature_series")


def run_detect(spark: SparkSession, s: Settings) -> None:
    f = checkpointed(detect.clean_features(_read(spark, s, "feature_series")))
    first = _read(spark, s, "clean_reviews").groupBy("sku").agg(F.min("date").alias("_first"))
    f = f.join(first, "sku", "left").where(F.col("_first").isNull() | (F.col("window_end") >= F.col("_first"))).drop("_first")
    _write(detect.indicator_matrix(f), s, "indicator_matrix")


def run_score(spark: SparkSession, s: Settings) -> None:
    _write(score.alerts(checkpointed(_read(spark, s, "indicator_matrix")), s.tau), s, "alerts")


def run_evaluate(spark: SparkSession, s: Settings, labels: DataFrame) -> DataFrame:
    """The policies' results, also as a CSV report."""
    report = evaluate.policy_summary(checkpointed(_read(spark, s, "alerts")), labels, s.lookback)
    source.write_csv(report, s.path("evaluation"))
    return report


def missing(reviews: DataFrame, done: DataFrame, key: str = "review_id") -> DataFrame:
    """Reviews that a stored result lacks, for incremental text features."""
    return reviews.join(done.select(key), key, "left_anti")
