"""Sources and sinks of reviews: raw records, month-partitioned tables with idempotent upsert, audit records."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import review_id

RAW = "parent_asin string, timestamp bigint, rating double, text string, user_id string, verified_purchase boolean"


def read_raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """JSON-lines files by a fixed schema; columns that a file lacks are null, others are ignored."""
    return spark.read.schema(RAW).json(paths)


def load_reviews(raw: DataFrame, category: str, skus: DataFrame | None = None) -> DataFrame:
    """Raw records as clean reviews: types, UTC time from milliseconds, stable id, one row for each id.

    Ratings are cut to whole numbers; records without sku, time or a rating of 1 to 5 are left out. Missing optional columns
    are null. Of several records of one id the one with the least (rating, text, user, verified) in Spark's order is kept, since
    distributed input has no first row. ``skus`` (a column ``sku``) restricts by a semi join.
    """
    for name, kind in (("text", "string"), ("user_id", "string"), ("verified_purchase", "boolean")):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    ms = F.col("timestamp").cast("bigint")
    t = raw.select(
        review_id(F.col("parent_asin"), F.col("user_id"), ms).alias("review_id"), F.col("parent_asin").alias("sku"), F.lit(category).alias("category"), "user_id",
        F.timestamp_millis(ms).alias("ts"), F.col("rating").try_cast("tinyint").alias("rating"), F.col("text").alias("text_raw"), "verified_purchase",
    ).where("sku is not null and ts is not null and rating between 1 and 5")
    if skus is not None:
        t = t.join(skus.select("sku").distinct(), "sku", "left_semi")
    w = W.partitionBy("review_id").orderBy("rating", "text_raw", "user_id", "verified_purchase")
    t = t.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return t.withColumn("date", F.to_date("ts"))


def check_category(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name) or name in (".", ".."):
        raise ValueError(f"no usable category: {name!r}")
    return name


def read_table(spark: SparkSession, path: str, day: str, start=None, end=None, category: str | None = None, ids: DataFrame | None = None, key: str = "review_id") -> DataFrame:
    """A stored table, pruned by category and month directories and filtered by inclusive days and, by a semi join, ids."""
    t = spark.read.parquet(path)
    if category is not None:
        t = t.where(F.col("category") == check_category(category))
    if start is not None:
        t = t.where((F.col("month") >= str(start)[:7]) & (F.col(day) >= F.lit(start).cast("date")))
    if end is not None:
        t = t.where((F.col("month") <= str(end)[:7]) & (F.col(day) <= F.lit(end).cast("date")))
    if ids is not None:
        t = t.join(ids.select(key).distinct(), key, "left_semi")
    return t.drop("month")


def write_table(df: DataFrame, path: str, day: str, keys: list[str]) -> None:
    """Idempotent upsert by category and month: rows of a sku within the batch's days of that very sku are replaced.

    A table without ``sku`` replaces equal keys. Touched months are written aside first, then swapped in by dynamic overwrite.
    """
    spark = df.sparkSession
    new = df.withColumn("month", F.date_format(day, "yyyy-MM"))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    side = f"{path.rstrip('/')}__{uuid.uuid4().hex[:8]}"
    if fs.exists(fs_path):
        months = new.select("category", "month").distinct()
        old = spark.read.parquet(path).join(months, ["category", "month"], "left_semi")
        if "sku" in df.columns:
            span = new.groupBy(F.col("category").alias("_c"), F.col("sku").alias("_s")).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
            old = old.join(span, (F.col("category") == F.col("_c")) & (F.col("sku") == F.col("_s")) & F.col(day).between(F.col("_lo"), F.col("_hi")), "left_anti")
        else:
            old = old.join(new.select(*keys).distinct(), keys, "left_anti")
        new = new.unionByName(old.select(*new.columns))
    layout = lambda x: x.repartition("category", "month").sortWithinPartitions(*keys).write.option("compression", "zstd").partitionBy("category", "month")
    layout(new).parquet(side)
    layout(spark.read.parquet(side).select(*new.columns)).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(side), True)


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


class Audit:
    """Rows in and out of steps, as JSON lines."""

    def __init__(self):
        self.records: list[dict] = []

    def record(self, step: str, rows_in: int, rows_out: int, **extra) -> None:
        self.records.append({"step": step, "rows_in": rows_in, "rows_out": rows_out, "removed": rows_in - rows_out, **extra})

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r["step"], r["rows_in"], r["rows_out"], r["removed"]) for r in self.records], "step string, rows_in bigint, rows_out bigint, removed bigint")

    def write(self, path: str) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in self.records)
