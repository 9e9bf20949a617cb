"""Totals and averages over trailing calendar periods, on sparse daily rows.

Method: one row per (entity, day) after a pre-aggregating shuffle; the days until the entity's next row are
generated from ``lead`` as rows of zeros (no calendar join); range frames over integer day numbers then sum
each period. Averages divide by the length of the period, not by the days with activity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing_totals(daily: DataFrame, entity: str = "sku", day: str = "date", values: Sequence[str] = ("n", "n_neg"), periods: Sequence[int] = (7, 30)) -> DataFrame:
    """``(entity, day, value..., <value>_<p>d, <value>_avg_<p>d ...)`` for every day from the first to the last of each entity.

    A repeated row counts once: of several rows of one entity and day the one with the greatest values, in the order
    given, is taken (equal rows are one). Null values count as zero; rows without entity or day are left out; days
    before the first count as zero. Other columns are ignored. An empty table gives an empty result.
    """
    v = [f"_v{k}" for k in range(len(values))]
    rows = daily.select(F.col(entity).alias("_k"), F.unix_date(F.col(day).cast("date")).alias("_d"), F.struct(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(x) for c, x in zip(values, v)]).alias("_v"))
    rows = rows.where("_k is not null and _d is not null").groupBy("_k", "_d").agg(F.max("_v").alias("_v"))
    w = W.partitionBy("_k").orderBy("_d")
    rows = rows.withColumn("_next", F.coalesce(F.lead("_d").over(w) - 1, F.col("_d")))
    rows = rows.select("_k", "_v", F.col("_d").alias("_at"), F.explode(F.sequence("_d", "_next")).alias("_d"))
    rows = rows.select("_k", "_d", *[F.when(F.col("_d") == F.col("_at"), F.col(f"_v.{x}")).otherwise(F.lit(0)).cast("bigint").alias(x) for x in v])
    sums = [F.sum(x).over(w.rangeBetween(-(p - 1), 0)).alias(f"{x}_{p}") for x in v for p in periods]
    rows = rows.select("_k", "_d", *v, *sums)
    out = [F.col("_k").alias(entity), F.date_from_unix_date("_d").alias("day"), *[F.col(x).alias(c) for c, x in zip(values, v)]]
    for c, x in zip(values, v):
        for p in periods:
            out += [F.col(f"{x}_{p}").alias(f"{c}_{p}d"), (F.col(f"{x}_{p}") / F.lit(float(p))).alias(f"{c}_avg_{p}d")]
    return rows.select(*out)


def surges(daily: DataFrame, min_n: int = 10) -> DataFrame:
    """Days whose negative share over 7 days is at least 0.4 and 1.25 times that over 30 days (whole-number comparisons)."""
    t = trailing_totals(daily)
    hit = (F.col("n_7d") >= min_n) & (F.col("n_neg_7d") * 5 >= F.col("n_7d") * 2) & (F.col("n_neg_7d") * F.col("n_30d") * 4 >= F.col("n_neg_30d") * F.col("n_7d") * 5)
    return t.where(hit).select("sku", F.date_format("day", "yyyy-MM-dd").alias("day"))
