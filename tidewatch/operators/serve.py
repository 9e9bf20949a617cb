"""Views for readers: latest alerts, how long a level has lasted, priorities, overview, evidence, rule-based explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import mask, short_key


def rank_of(level: Column) -> Column:
    return F.when(level == "HIGH", 2).when(level == "MEDIUM", 1).otherwise(0)


def latest(alerts: DataFrame, as_of=None) -> DataFrame:
    """The last alert of each sku up to a day."""
    a = alerts if as_of is None else alerts.where(F.col("window_end") <= F.lit(as_of).cast("date"))
    cols = [c for c in a.columns if c != "sku"]
    return a.groupBy("sku").agg(F.max_by(F.struct(*cols), "window_end").alias("_r")).select("sku", "_r.*")


def level_since(alerts: DataFrame, step: int = 1) -> DataFrame:
    """``(sku, level, since, windows)``: the first day of the run of equal levels, ``step`` days apart, that ends at the last alert."""
    w = W.partitionBy("sku").orderBy("window_end")
    same = (F.lag("level").over(w) == F.col("level")) & (F.datediff("window_end", F.lag("window_end").over(w)) == step)
    a = alerts.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = a.groupBy("sku", "_run").agg(F.first("level").alias("level"), F.min("window_end").alias("since"), F.count("*").alias("windows"))
    return g.groupBy("sku").agg(F.max_by(F.struct("level", "since", "windows"), "_run").alias("_r")).select("sku", "_r.level", F.date_format("_r.since", "yyyy-MM-dd").alias("since"), "_r.windows")


def new_high(alerts: DataFrame, as_of: Column | None = None, days: int = 7) -> DataFrame:
    """Skus that are HIGH now and whose alert before the first HIGH of the last ``days`` days was not HIGH, or does not exist."""
    end = alerts.agg(F.max("window_end")).scalar() if as_of is None else as_of
    w = W.partitionBy("sku").orderBy("window_end")
    a = alerts.withColumn("_end", end).where("window_end <= _end").withColumn("_before", F.lag("level").over(w))
    recent = (F.col("level") == "HIGH") & (F.col("window_end") > F.date_sub("_end", days))
    g = a.groupBy("sku").agg(F.max_by("level", "window_end").alias("_now"), F.min_by(F.struct(F.coalesce("_before", F.lit("")).alias("b")), F.when(recent, F.col("window_end"))).alias("_b"), F.count_if(recent).alias("_k"))
    return g.where((F.col("_now") == "HIGH") & (F.col("_k") > 0) & (F.col("_b.b") != "HIGH")).select("sku")


def priority_table(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """The most pressing skus: level, score, risk terms involved, sku; a top-k report."""
    t = latest(alerts).join(level_since(alerts).select("sku", "since", "windows"), "sku")
    i8 = F.array_contains("triggered_ids", "I8")
    return t.select("sku", "level", "score", i8.cast("int").alias("has_i8"), "since", "windows").orderBy(rank_of(F.col("level")).desc(), F.col("score").desc(), F.col("has_i8").desc(), "sku").limit(limit)


def top_alerts(alerts: DataFrame, limit: int = 100, level: str | None = None) -> DataFrame:
    a = alerts if level is None else alerts.where(F.col("level") == level)
    return a.orderBy(F.col("score").desc(), F.col("window_end").desc(), "sku").limit(min(limit, 500))


def level_trend(alerts: DataFrame) -> DataFrame:
    """``(day, level, skus)``."""
    return alerts.groupBy("window_end", "level").agg(F.count_distinct("sku").alias("skus")).select(F.date_format("window_end", "yyyy-MM-dd").alias("day"), "level", "skus")


def overview(reviews: DataFrame, days: int = 7) -> DataFrame:
    """Per sku the last ``days`` days of the table against those before: reviews, mean rating, low ratings, change of their share. One aggregation."""
    r = reviews.withColumn("_ago", F.datediff(reviews.agg(F.max("date")).scalar(), "date")).where(F.col("_ago") < 2 * days).withColumn("_low", (F.col("rating") <= 2).cast("int"))
    now, before = F.col("_ago") < days, F.col("_ago") >= days
    return r.groupBy("sku").agg(
        F.count_if(now).alias("reviews"), F.count_if(before).alias("reviews_before"), F.avg(F.when(now, F.col("rating").cast("int"))).alias("avg_rating"), F.avg(F.when(now, F.col("_low"))).alias("low_share"),
        (F.avg(F.when(now, F.col("_low"))) - F.avg(F.when(before, F.col("_low")))).alias("low_share_change"),
    )


def priority_score(risk_hit: Column, rating: Column, text: Column, verified: Column) -> Column:
    """How much a review tells: risk, low stars, some length, a verified purchase."""
    return (
        F.when(risk_hit, 10.0).otherwise(0.0) + F.when(rating == 1, 5.0).when(rating == 2, 4.0).when(rating == 3, 1.0).otherwise(0.0)
        + F.when(F.length(text) > 30, 1.0).otherwise(0.0) + F.when(verified, 0.5).otherwise(0.0)
    )


def evidence(alerts: DataFrame, reviews: DataFrame, k: int = 5, days: int = 7) -> DataFrame:
    """``(sku, window_end, rank, review_id, priority, text)``: the ``k`` most telling reviews of each alert's window, one for each opening.

    Spam is left out unless the window has nothing else. Equal openings (15 words) keep the better review; ties go to the later
    day, then the lesser id. All alerts are joined at once on sku and a range of days. ``reviews`` need ``risk_hit``.
    """
    a = alerts.select("sku", "window_end")
    r = reviews.select("sku", "date", "review_id", "text_raw", F.coalesce("is_spam", F.lit(False)).alias("spam"), priority_score(F.col("risk_hit"), F.col("rating"), F.col("text_raw"), F.col("verified_purchase")).alias("priority")).where("text_raw is not null")
    j = a.join(r.withColumnRenamed("sku", "_s"), (F.col("sku") == F.col("_s")) & F.col("date").between(F.date_sub("window_end", days - 1), F.col("window_end"))).drop("_s")
    win = W.partitionBy("sku", "window_end")
    j = j.withColumn("_clean", F.min(F.col("spam").cast("int")).over(win)).where((F.col("_clean") == 1) | ~F.col("spam"))
    order = [F.col("priority").desc(), F.col("date").desc(), F.col("review_id")]
    j = j.withColumn("_key", short_key(F.col("text_raw"))).withColumn("_n", F.row_number().over(W.partitionBy("sku", "window_end", "_key").orderBy(*order))).where("_n = 1")
    j = j.withColumn("rank", F.row_number().over(win.orderBy(*order))).where(F.col("rank") <= k)
    return j.select("sku", F.date_format("window_end", "yyyy-MM-dd").alias("window_end"), "rank", "review_id", "priority", mask(F.col("text_raw")).alias("text"))


def evidence_of(indicator: str) -> Column:
    """Which reviews speak for an indicator."""
    return {
        "I3": F.col("sentiment_score") < 0, "I4": F.col("rating") <= 2, "I6": F.col("rating").isin(1, 5), "I7": F.col("risk_hit"), "I8": F.col("risk_hit"),
        "I9": F.col("aspect").isNotNull(), "I10": F.col("mismatch"), "I11": ~F.col("verified_purchase"),
    }.get(indicator, F.lit(True))


def explanation(alerts: DataFrame) -> DataFrame:
    """``(sku, window_end, cluster, confidence)`` of HIGH alerts by rules: doubtful authenticity, then safety, then anything else."""
    doubt = F.col("verify_flag") | F.arrays_overlap("triggered_ids", F.array(F.lit("I10"), F.lit("I11")))
    safety = F.array_contains("triggered_ids", "I8")
    return alerts.where("level = 'HIGH'").select("sku", F.date_format("window_end", "yyyy-MM-dd").alias("window_end"), F.when(doubt, "Victim").when(safety, "Preventable").otherwise("Accidental").alias("cluster"), F.when(doubt, 0.75).when(safety, 0.90).otherwise(0.70).alias("confidence"))


def breakdown(matrix: DataFrame) -> DataFrame:
    """``(sku, window_end, indicator_id, triggered, strength, contribution)``: each indicator's share of the score."""
    from tidewatch.operators.score import POINTS, TOTAL

    points = F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])
    share = F.when(F.col("triggered"), F.coalesce(F.try_element_at(points, F.col("indicator_id")), F.lit(0)) / float(TOTAL)).otherwise(0.0)
    return matrix.select("sku", F.date_format("window_end", "yyyy-MM-dd").alias("window_end"), "indicator_id", F.col("triggered").cast("int").alias("triggered"), "strength", share.alias("contribution"))


def level_rollup(alerts: DataFrame) -> DataFrame:
    """Alerts by category and level with all subtotals; null stands for all."""
    return alerts.rollup("category", "level").agg(F.count("*").alias("n_alerts"), F.count_distinct("sku").alias("skus"))
