"""Exact medians of groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups of up to this many rows are left to the built-in aggregate; both ways give the same.
SMALL = 2_000_000


def _bucket(x: Column) -> Column:
    """A bigint that never falls as x grows: 32 steps for each doubling of the magnitude."""
    k = (F.floor(F.log2(F.abs(x)) * 32) + 40_000).cast("bigint")
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x < 0, -k).otherwise(k)


def selected(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``(keys..., name, n)``: the median, the mean of the two middle values for an even number; null values are left out.

    Two passes: counts of coarse buckets (combined before the shuffle) tell which buckets hold the middle ranks; only the
    values of those are ranked, equal ones as one.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).where("_x is not null").withColumn("_b", _bucket(F.col("_x")))
    w = W.partitionBy(*keys)
    b = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    b = b.withColumn("_cum", F.sum("_c").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    before = F.col("_cum") - F.col("_c")
    b = b.where(((before < lo) & (F.col("_cum") >= lo)) | ((before < hi) & (F.col("_cum") >= hi))).select(*keys, "_b", "_n", before.alias("_before"))
    v = rows.join(b, [*keys, "_b"]).groupBy(*keys, "_b", "_n", "_before", "_x").agg(F.count("*").alias("_c"))
    v = v.withColumn("_cum", F.col("_before") + F.sum("_c").over(W.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)))
    first = lambda rank: F.min(F.when(F.col("_cum") >= rank, F.col("_x")))
    return v.groupBy(*keys, F.col("_n").alias("n")).agg(first(F.floor((F.col("_n") + 1) / 2)).alias("_p"), first(F.floor(F.col("_n") / 2) + 1).alias("_q")).select(*keys, ((F.col("_p") + F.col("_q")) / 2).alias(name), "n")


def median(df: DataFrame, keys: Sequence[str], value: str, name: str, small: bool) -> DataFrame:
    """``selected``, or the built-in aggregate where every group is known to be ``small``."""
    if not small:
        return selected(df, keys, value, name)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile(value, 0.5).alias(name), F.count("*").alias("n"))


def all_small(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no group has more than ``SMALL`` rows; one number comes to the driver."""
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= SMALL
