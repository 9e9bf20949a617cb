"""Percentiles of large groups from mergeable sketches: counts in signed logarithmic buckets of fixed relative width.

Bucket k > 0 of gamma = (1 + a) / (1 - a) holds the magnitudes in (gamma^(k-1), gamma^k]; the value told for it,
2 gamma^k / (gamma + 1), is off by at most a relative ``a`` (``accuracy``). Negative values mirror this, magnitudes
below ``TINY`` are zero. A sketch is a table (keys, bucket, count), so sketches of partitions, days or files are added by
one sum; nothing else is kept, and rank queries on the sum are the same as on all values at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import checkpointed

#: Relative error of a value that is told. On values of one group this is far below one percent of rank.
ACCURACY = 5e-3
#: Buckets of one block; a group's buckets are cumulated block by block, so that no task holds all of a group.
BLOCK = 256
TINY = 1e-30


def _log_gamma(accuracy: float) -> float:
    return math.log((1 + accuracy) / (1 - accuracy))


def bucket_of(x: Column, accuracy: float = ACCURACY) -> Column:
    """A bigint that orders like the values: 0 for zero, magnitudes shifted so that every index is positive; infinities lie outermost."""
    size = F.greatest(F.least(F.abs(x), F.lit(1.7976931348623157e308)), F.lit(TINY))
    k = (F.ceil(F.log(size) / F.lit(_log_gamma(accuracy))) - F.lit(math.floor(math.log(TINY) / _log_gamma(accuracy)) - 1)).cast("bigint")
    k = F.when(F.abs(x) == F.lit(float("inf")), k + 1).otherwise(k)
    return F.when(F.abs(x) < TINY, F.lit(0)).otherwise(F.when(x < 0, -k).otherwise(k)).cast("bigint")


def value_of(bucket: Column, accuracy: float = ACCURACY) -> Column:
    """The value told for a bucket."""
    g = _log_gamma(accuracy)
    k = F.abs(bucket) + F.lit(math.floor(math.log(TINY) / g) - 1)
    mid = F.exp(k * F.lit(g) + F.lit(math.log(2 / (math.exp(g) + 1))))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * mid)


def sketch(df: DataFrame, keys: Sequence[str], value: str, accuracy: float = ACCURACY, once_per: Sequence[str] = ()) -> DataFrame:
    """``(keys..., bucket, count)`` of the values; null and NaN are left out.

    With ``once_per`` the rows equal in keys, these columns and value count once (repeated records). Null keys are a
    group of their own. An empty table gives an empty sketch.
    """
    x = F.col("_x")
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(once_per)], F.col(value).cast("double").alias("_x")).where(x.isNotNull() & ~F.isnan(x))
    if once_per:
        rows = rows.distinct()
    g = [f"_k{i}" for i in range(len(keys))]
    rows = rows.groupBy(*g, bucket_of(x, accuracy).alias("bucket")).agg(F.count("*").alias("count"))
    return rows.select(*[F.col(a).alias(c) for a, c in zip(g, keys)], "bucket", "count")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sketch of both inputs' values together; both must have been made with one accuracy."""
    keys = [c for c in a.columns if c not in ("bucket", "count")]
    return a.unionByName(b).groupBy(*keys, "bucket").agg(F.sum("count").alias("count"))


def percentiles(sk: DataFrame, qs: dict[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """``(keys..., n, <name>...)``: the value at rank ceil(q * n) of each group, within the sketch's relative accuracy.

    Two stages: counts of blocks of ``BLOCK`` buckets are cumulated for a group (a group has at most some hundreds), then
    the buckets of only those blocks that hold a wanted rank, each block on its own. No task holds a group's buckets.
    """
    keys = [c for c in sk.columns if c not in ("bucket", "count")]
    k = [f"_k{i}" for i in range(len(keys))]
    s = sk.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.floor(F.col("bucket") / BLOCK).alias("_b"), "bucket", F.col("count").alias("_c"))
    blocks = s.groupBy(*k, "_b").agg(F.sum("_c").alias("_size"), F.sort_array(F.collect_list(F.struct("bucket", "_c"))).alias("_held"))
    w = W.partitionBy(*k)
    upto = blocks.withColumn("_cum", F.sum("_size").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.sum("_size").over(w))
    names = list(qs)
    picks = []
    before = F.col("_cum") - F.col("_size")

    def first(rank: Column) -> Column:
        """The first bucket of the block with which a rank is reached."""

        def step(acc: Column, x: Column) -> Column:
            now = acc["c"] + x["_c"]
            return F.struct(now.alias("c"), F.coalesce(acc["b"], F.when(before + now >= rank, x["bucket"])).alias("b"))

        return F.aggregate("_held", F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(None).cast("bigint").alias("b")), step)["b"]

    for name in names:
        rank = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(qs[name])))
        picks.append(F.max(F.when((before < rank) & (F.col("_cum") >= rank), first(rank))).alias(f"_{name}"))
    out = upto.groupBy(*k).agg(F.max("_n").alias("n"), *picks)
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], "n", *[value_of(F.col(f"_{name}"), accuracy).alias(name) for name in names])


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def heavy_tails(series: DataFrame, min_n: int = 40, factor: float = 8.0, accuracy: float = ACCURACY) -> DataFrame:
    """Groups (sku, indicator_id, feature) with p75 > p25 and p95 - p50 > ``factor`` * (p75 - p25), repeated rows counted once.

    The sketch decides where its error can't change the answer; for the groups whose margin is within the error of the
    four values, and only for these, the values themselves are ranked.
    """
    keys = ("sku", "indicator_id", "feature")
    once = distinct_values(series, keys, "raw_value", ("window_end",))
    q = checkpointed(percentiles(sketch(once, keys, "raw_value", accuracy), QUARTILES, accuracy).where(F.col("n") >= min_n))
    err = lambda c: F.abs(F.col(c)) * F.lit(1.01 * accuracy) + F.lit(2 * TINY)
    margin = F.col("p95") - F.col("p50") - factor * (F.col("p75") - F.col("p25"))
    slack = err("p95") + err("p50") + factor * (err("p75") + err("p25"))
    apart, near = F.col("p75") - F.col("p25"), err("p75") + err("p25")
    q = q.withColumn("_sure", (F.abs(margin) > slack) & (F.abs(apart) > near) | (margin < -slack))
    sure = q.where(F.col("_sure") & (margin > 0) & (apart > 0)).select(*keys)
    if q.where(~F.col("_sure")).isEmpty():
        return sure
    exact = ranked(once.join(q.where(~F.col("_sure")).select(*keys), list(keys), "left_semi"), keys, "raw_value", QUARTILES)
    return sure.unionByName(exact.where((F.col("p75") > F.col("p25")) & (F.col("p95") - F.col("p50") > factor * (F.col("p75") - F.col("p25")))).select(*keys))


def distinct_values(df: DataFrame, keys: Sequence[str], value: str, once_per: Sequence[str]) -> DataFrame:
    """``(keys..., value)`` of the rows that differ in keys, ``once_per`` or value; null and NaN left out."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, *once_per, x.alias(value)).distinct().select(*keys, value)


def ranked(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """``(keys..., <name>...)``: the exact values at ranks ceil(q * n), from counts of equal values."""
    c = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumn("_cum", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(W.partitionBy(*keys)))
    return c.groupBy(*keys).agg(*[F.min(F.when(F.col("_cum") >= F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(q))), F.col(value))).alias(name) for name, q in qs.items()])
