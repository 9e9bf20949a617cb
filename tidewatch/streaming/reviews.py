"""Streams of reviews: daily counts, sliding windows and sessions with watermarks, levels with state, late rows aside, upserts by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import score


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(reviews: DataFrame, late: str = "30 days") -> DataFrame:
    """Each review id once, as long as its repeat comes within the watermark."""
    return reviews.withWatermark("ts", late).dropDuplicatesWithinWatermark(["review_id"])


def daily(reviews: DataFrame) -> DataFrame:
    """The counts of ``preprocess.daily_counts`` per (sku, category) and day (tumbling windows); needs a watermark for append mode."""
    ok, r = ~F.coalesce("is_spam", F.lit(False)), F.col("rating").cast("int")
    yes, n = F.coalesce("verified_purchase", F.lit(False)), lambda c: F.count_if(c).cast("int")
    g = reviews.groupBy("sku", "category", F.window("ts", "1 day").alias("w")).agg(
        n(ok).alias("n"), n(ok & (r <= 2)).alias("n_neg"), *[n(ok & (r == k)).alias(f"n{k}") for k in range(1, 6)], F.coalesce(F.sum(F.when(ok, r)), F.lit(0)).cast("double").alias("sum_rating"),
        F.coalesce(F.sum(F.when(ok, r * r)), F.lit(0)).cast("double").alias("sumsq_rating"), n(ok & yes).alias("n_verified"), F.count("*").cast("int").alias("n_all"), n(yes).alias("n_verified_all"),
    )
    return g.select("sku", "category", F.to_date("w.start").alias("date"), *[c for c in g.columns if c not in ("sku", "category", "w")])


def rolling(reviews: DataFrame, span: str = "7 days", step: str = "1 day") -> DataFrame:
    """Counts per sku over sliding windows."""
    g = reviews.groupBy("sku", F.window("ts", span, step).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("rating") <= 2).alias("n_low"))
    return g.select("sku", F.date_sub(F.to_date("w.end"), 1).alias("window_end"), "n", "n_low")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user by event time; a gap of exactly ``gap`` does not open a new one, as in ``operators.sessions``."""
    w = F.session_window("ts", f"{gap} 1 microsecond").alias("w")  # the built-in windows are half open
    g = events.where("user_id is not null").groupBy("user_id", w).agg(F.count("*").alias("n_events"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return g.drop("w")


def levels(scored: DataFrame, tau: tuple[float, float] = score.TAU) -> DataFrame:
    """``(sku, window_end, score, persist, level)`` of a stream of scores (sku, window_end, score, groups, severe), with state per sku.

    ``groups`` is the number of active groups. The state is what persistence and hysteresis carry from day to day, so the
    result is that of the batch operators for rows that arrive in order of days; within a micro-batch they are ordered, and
    a row of a day that the sku has already passed is left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        day, persist, cur, want, seen = state.get if state.exists else (-1, 0, -1, -1, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("window_end").itertuples(index=False):
            at = (pd.Timestamp(r.window_end) - pd.Timestamp("1970-01-01")).days
            if at <= day:
                continue
            day, persist = at, min(persist + 1, score.PERSIST_CAP) if r.score >= tau[0] else 0
            raw = 2 if r.score >= tau[1] and (r.groups >= 3 or r.severe) else 1 if r.score >= tau[0] and (persist >= 2 or r.groups >= 2) else 0
            if raw >= cur:
                cur, want, seen = raw, -1, 0
            else:
                seen = seen + 1 if want == raw else 1
                cur, want, seen = (raw, -1, 0) if seen >= score.HOLD else (cur, raw, seen)
            out.append((key[0], r.window_end, r.score, persist, score.LEVELS[cur]))
        state.update((day, persist, cur, want, seen))
        yield pd.DataFrame(out, columns=["sku", "window_end", "score", "persist", "level"])

    kind, held = "sku string, window_end date, score double, persist int, level string", "day int, persist int, cur int, want int, seen int"
    return scored.groupBy("sku").applyInPandasWithState(step, kind, held, "append", "NoTimeout")


def upsert(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str):
    """Starts a query that hands each micro-batch to an idempotent writer."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: write(df)).start()


def split_late(stream: DataFrame, delay_s: int, write: Callable[[DataFrame], None], late: Callable[[DataFrame], None], checkpoint: str, time: str = "ts"):
    """Starts a query that sends rows more than ``delay_s`` seconds older than the newest row of earlier batches to ``late``, others to ``write``.

    The newest time is kept beside the checkpoint for each batch, so a batch that is run again is split as before. Null times are late.
    """
    spark = stream.sparkSession

    def one(df: DataFrame, batch: int) -> None:
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/newest")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        marks = dict(tuple(map(int, s.getPath().getName().split("_"))) for s in fs.listStatus(folder))
        newest = max((t for b, t in marks.items() if b < batch), default=None)
        us = F.unix_micros(time)
        ok = us.isNotNull() if newest is None else F.coalesce(us >= newest - delay_s * 1_000_000, F.lit(False))
        df = df.persist()
        write(df.where(ok))
        late(df.where(~ok))
        top = df.agg(F.max(us)).first()[0]
        mark = max(x for x in (top, newest) if x is not None) if (top, newest) != (None, None) else None
        if mark is not None and batch not in marks:
            fs.createNewFile(jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/newest/{batch}_{mark}"))
        df.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one).start()
