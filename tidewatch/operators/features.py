"""Daily features of products: rolling volume, rating, reliability and content measures, in the long format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import lexicon
from tidewatch.operators.bursts import term_burst  # noqa: F401

DAYS = 7
#: Which features belong to which indicator.
VOCABULARY = {
    "I1": ("log1p_daily_count",), "I2": ("growth_rate",), "I3": ("neg_ratio_shrunk",), "I4": ("low_star_ratio_shrunk",), "I5": ("rating_rolling_variance",),
    "I6": ("extreme_share", "share_1star", "share_5star"), "I7": ("term_burst_score",), "I8": ("risk_hits", "risk_distinct_users"),
    "I9": ("aspect_neg_quality", "aspect_neg_delivery", "aspect_neg_safety", "aspect_neg_refund"), "I10": ("mismatch_rate",), "I11": ("verified_ratio_all",),
}
_OF = {f: i for i, fs in VOCABULARY.items() for f in fs}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def volume_rating_wide(panel: DataFrame, days: int = DAYS) -> DataFrame:
    """All features of volume and rating of a dense panel, over one window spec: one exchange and one sort.

    Rows begin with the first full window; growth needs two full windows.
    """
    w = W.partitionBy("sku", "category").orderBy("date")
    span = w.rowsBetween(-(days - 1), 0)
    sums = {c: F.sum(c).over(span) for c in ("n", "n_neg", "n1", "n3", "n5", "sum_rating", "sumsq_rating")}
    p = panel.select("sku", "category", "date", "n", F.row_number().over(w).alias("_i"), *[c.alias(f"_{k}") for k, c in sums.items()])
    p = p.withColumn("_before", F.when(F.col("_i") >= 2 * days, F.lag("_n", days).over(w)))
    n, neg = F.col("_n"), F.col("_n_neg")
    return p.where(F.col("_i") >= days).select(
        "sku", "category", F.col("date").alias("window_end"), n.cast("int").alias("n_window"), F.log1p(F.col("n").cast("double")).alias("log1p_daily_count"),
        ((n - F.col("_before")) / (F.col("_before") + 1.0)).alias("growth_rate"), ((neg + 0.5 * F.col("_n3") + 2) / (n + 20)).alias("neg_ratio_shrunk"),
        ((neg + 2) / (n + 20)).alias("low_star_ratio_shrunk"), F.when(n >= 2, F.col("_sumsq_rating") / n - F.pow(F.col("_sum_rating") / n, 2)).alias("rating_rolling_variance"),
        _ratio(F.col("_n1") + F.col("_n5"), n).alias("extreme_share"), _ratio(F.col("_n1"), n).alias("share_1star"), _ratio(F.col("_n5"), n).alias("share_5star"),
    )


def to_long(wide: DataFrame, features: list[str]) -> DataFrame:
    """The long format ``(sku, category, window_end, indicator_id, feature, raw_value, n_window)``."""
    long = wide.select("sku", "category", "window_end", "n_window", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["sku", "category", "window_end", "n_window"], features, "feature", "raw_value")
    ids = F.create_map(*[F.lit(x) for f in features for x in (f, _OF[f])])
    return long.select("sku", "category", "window_end", ids[F.col("feature")].alias("indicator_id"), "feature", "raw_value", "n_window")


VOLUME_RATING = [f for i in ("I1", "I2", "I3", "I4", "I5", "I6") for f in VOCABULARY[i]]


def volume_rating_long(panel: DataFrame) -> DataFrame:
    return to_long(volume_rating_wide(panel), VOLUME_RATING)


def scored(reviews: DataFrame) -> DataFrame:
    """``reviews`` with the text columns: score, mismatch, risk terms, dominant aspect and its score; one projection."""
    s = lexicon.sentiment(F.col("text_norm"))
    r = reviews.withColumn("sentiment_score", s["score"]).withColumn("mismatch", lexicon.mismatch(F.col("rating"), s["p_pos"], s["p_neg"]))
    r = r.withColumn("risk_terms", lexicon.risk_terms_of("text_norm")).withColumn("_a", lexicon.aspect_of("text_norm"))
    r = r.withColumn("risk_hit", F.size("risk_terms") > 0).withColumn("aspect", F.col("_a.aspect"))
    return r.withColumn("aspect_sentiment", lexicon.sentiment(F.col("_a.aspect_text"))["score"]).drop("_a")


def reliability(panel: DataFrame, reviews: DataFrame) -> DataFrame:
    """Daily mismatch rate (with its support) and verified share of all reviews, in the long format."""
    m = reviews.where("mismatch is not null").groupBy("sku", "category", "date").agg(F.avg(F.col("mismatch").cast("int")).alias("rate"), F.count("*").cast("int").alias("support"))
    base = panel.select("sku", "category", "date", "n_all", _ratio(F.col("n_verified_all"), F.col("n_all")).alias("ratio")).join(m, ["sku", "category", "date"], "left")
    pair = lambda i, f, v, n: F.struct(F.lit(i).alias("indicator_id"), F.lit(f).alias("feature"), v.cast("double").alias("raw_value"), n.cast("int").alias("n_window"))
    both = F.array(pair("I10", "mismatch_rate", F.col("rate"), F.coalesce("support", F.lit(0))), pair("I11", "verified_ratio_all", F.col("ratio"), F.col("n_all")))
    return base.select("sku", "category", F.col("date").alias("window_end"), F.inline(both))


def risk_windows(reviews: DataFrame, days: int = DAYS) -> DataFrame:
    """``(sku, window_end, risk_hits, risk_distinct_users)`` of windows with a hit; needs ``risk_hit``. Null users are no user."""
    d = reviews.where("risk_hit").select("sku", "user_id", F.explode(F.sequence("date", F.date_add("date", days - 1))).alias("window_end"))
    return d.groupBy("sku", "window_end").agg(F.count("*").alias("risk_hits"), F.count_distinct("user_id").alias("risk_distinct_users"))


def aspect_windows(reviews: DataFrame, days: int = DAYS) -> DataFrame:
    """``(sku, window_end, aspect, n, ratio)``: the share of negative reviews among those of an aspect; the score of the aspect's sentences counts, else the review's."""
    d = reviews.where("aspect is not null").select("sku", "aspect", (F.coalesce("aspect_sentiment", "sentiment_score") < 0).alias("neg"), F.explode(F.sequence("date", F.date_add("date", days - 1))).alias("window_end"))
    return d.groupBy("sku", "window_end", "aspect").agg(F.count("*").alias("n"), (F.count_if("neg") / F.count("*")).alias("ratio"))


def best_cosine(vectors: DataFrame, prototypes: list[list[float]], column: str = "embedding") -> Column:
    """The greatest cosine of a vector with a few prototypes (literals in the plan), within -1 and 1; null for null or zero vectors."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sims = []
    for p in prototypes:
        size = sum(x * x for x in p) ** 0.5
        lit = F.array(*[F.lit(float(x) / size) for x in p])
        sims.append(F.aggregate(F.zip_with(column, lit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x))
    top = F.greatest(*sims) if len(sims) > 1 else sims[0]
    return F.when(norm > 0, F.greatest(F.least(top / norm, F.lit(1.0)), F.lit(-1.0)))
