"""Cleaning of reviews: exact duplicates, spam flags, dense daily panel, weekly statistics, funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import token_count

#: Limits of the spam rules.
MIN_TOKENS, USER_DAY, TEMPLATE, INSTANT = 3, 5, 5, 10
COUNTS = ("n", "n_neg", "n1", "n2", "n3", "n4", "n5", "sum_rating", "sumsq_rating", "n_verified", "n_all", "n_verified_all")


def distinct_reviews(reviews: DataFrame) -> DataFrame:
    """Repeated records once."""
    return reviews.dropDuplicates(["review_id"])


def dedup_exact(reviews: DataFrame, keep: str = "first") -> DataFrame:
    """The first or last review of each (sku, user, text) by time, then id; null users and texts are equal to each other."""
    by = [F.col("ts"), F.col("review_id")] if keep == "first" else [F.col("ts").desc(), F.col("review_id").desc()]
    w = W.partitionBy("sku", "user_id", "text_norm").orderBy(*by)
    return reviews.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def spam_flags(reviews: DataFrame) -> DataFrame:
    """``reviews`` with ``is_spam`` and ``spam_reason`` (rules in order, joined by a bar; null for none). Null keys match nothing.

    Group counts are pre-aggregated (map-side combine) and joined back, so a hot key is never sorted in one task.
    """
    r = reviews.drop("is_spam", "spam_reason")

    def counted(rows: DataFrame, keys: list[str], name: str, least: int) -> DataFrame:
        groups = reviews.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias(name)).where(F.col(name) >= least)
        return rows.join(groups, keys, "left")

    r = counted(r, ["user_id", "date"], "_user", USER_DAY + 1)
    r = counted(r, ["sku", "date", "text_norm"], "_text", TEMPLATE)
    r = counted(r, ["sku", "ts"], "_instant", INSTANT)
    reason = F.concat_ws(
        "|", F.when(token_count(F.col("text_norm")) < MIN_TOKENS, "too_short"), F.when(F.col("_user").isNotNull(), "user_day_burst"),
        F.when(F.col("_text").isNotNull(), "repeated_template"), F.when(F.col("_instant").isNotNull(), "same_second_burst"),
    )
    return r.withColumn("is_spam", reason != "").withColumn("spam_reason", F.when(reason != "", reason)).drop("_user", "_text", "_instant")


def daily_counts(reviews: DataFrame) -> DataFrame:
    """Sparse counts per (sku, category, date); spam counts only in ``n_all`` and ``n_verified_all``."""
    ok, r = ~F.coalesce("is_spam", F.lit(False)), F.col("rating").cast("int")
    yes = F.coalesce("verified_purchase", F.lit(False))
    n = lambda c: F.count_if(c).cast("int")
    return reviews.groupBy("sku", "category", "date").agg(
        n(ok).alias("n"), n(ok & (r <= 2)).alias("n_neg"), *[n(ok & (r == k)).alias(f"n{k}") for k in range(1, 6)],
        F.coalesce(F.sum(F.when(ok, r)), F.lit(0)).cast("double").alias("sum_rating"), F.coalesce(F.sum(F.when(ok, r * r)), F.lit(0)).cast("double").alias("sumsq_rating"),
        n(ok & yes).alias("n_verified"), F.count("*").cast("int").alias("n_all"), n(yes).alias("n_verified_all"),
    )


def panel(daily: DataFrame) -> DataFrame:
    """One row per (sku, category) and day from the first to the last day of the whole table; days without a row are zeros.

    Repeated rows count once. The calendar is generated per sku between two scalar subqueries; there is no join with days.
    """
    d = daily.select("sku", "category", "date", *COUNTS).groupBy("sku", "category", "date").agg(*[F.max(c).alias(c) for c in COUNTS])
    lo, hi = daily.agg(F.min("date")).scalar(), daily.agg(F.max("date")).scalar()
    grid = d.select("sku", "category").distinct().select("sku", "category", F.explode(F.sequence(lo, hi)).alias("date"))
    return grid.join(d, ["sku", "category", "date"], "left").na.fill(0, list(COUNTS))


def weekly_median(reviews: DataFrame) -> DataFrame:
    """``(sku, first_date, last_date, n_reviews, median_weekly)``: the median counts the weeks without a review between the first and the last too."""
    r = reviews.select("sku", "date", F.floor((F.unix_date("date") + 719163) / 7).cast("bigint").alias("week"))
    weeks = r.groupBy("sku", "week").agg(F.count("*").alias("k"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    s = weeks.groupBy("sku").agg(F.min("lo").alias("first_date"), F.max("hi").alias("last_date"), F.sum("k").alias("n_reviews"), F.min("week").alias("a"), F.max("week").alias("b"))
    every = s.select("sku", F.explode(F.sequence("a", "b")).alias("week")).join(weeks.select("sku", "week", "k"), ["sku", "week"], "left")
    med = every.groupBy("sku").agg(F.percentile(F.coalesce("k", F.lit(0)), 0.5).alias("median_weekly"))
    return s.join(med, "sku").select("sku", F.date_format("first_date", "yyyy-MM-dd").alias("first_date"), F.date_format("last_date", "yyyy-MM-dd").alias("last_date"), "n_reviews", "median_weekly")


def funnel(reviews: DataFrame) -> DataFrame:
    """``(step, rows_in, rows_out)`` of repeated records, exact duplicates and spam."""
    one = distinct_reviews(reviews)
    kept = dedup_exact(one)
    flagged = spam_flags(kept)
    counts = [reviews.agg(F.count("*").alias("n")), one.agg(F.count("*").alias("n")), kept.agg(F.count("*").alias("n")), flagged.where("not is_spam").agg(F.count("*").alias("n"))]
    out = None
    for step, a, b in (("repeated", 0, 1), ("duplicates", 1, 2), ("spam", 2, 3)):
        row = counts[a].select(F.lit(step).alias("step"), F.col("n").alias("rows_in"), counts[b].scalar().alias("rows_out"))
        out = row if out is None else out.unionByName(row)
    return out
