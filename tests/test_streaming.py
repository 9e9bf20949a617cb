import datetime as dt

from pyspark.sql import functions as F
from tidewatch.operators import score
from tidewatch.operators.preprocess import daily_counts, distinct_reviews
from tidewatch.streaming import reviews as stream

T0 = dt.datetime(2024, 3, 1, 12, tzinfo=dt.timezone.utc)
SCHEMA = "review_id string, sku string, user_id string, ts timestamp, rating int, category string, is_spam boolean, verified_purchase boolean"


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(3):
        rows = [(f"r{k}-{j}", f"s{j % 2}", f"u{j % 3}", T0 + dt.timedelta(hours=9 * k + j), 1 + (j % 5), "c", j == 3, None if j == 4 else j % 2 == 0) for j in range(8)]
        spark.createDataFrame(rows + rows[:2], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    for name, make in (("daily", stream.daily), ("rolling", stream.rolling), ("sessions", stream.sessions)):
        q = make(stream.once(stream.read(spark, src, schema))).writeStream.format("memory").queryName(name).outputMode("append" if name == "sessions" else "complete").start()
        q.processAllAvailable()
        q.stop()
        if name != "sessions":
            want = make(distinct_reviews(spark.read.parquet(src)))
            if name == "daily":
                same = daily_counts(distinct_reviews(spark.read.parquet(src)).withColumn("date", F.to_date("ts")))
                assert sorted(map(tuple, want.collect())) == sorted(map(tuple, same.select(want.columns).collect()))
            assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, want.collect()))


def test_upsert_by_batches(spark, tmp_path):
    src, seen = str(tmp_path / "in"), []
    spark.createDataFrame([("r", "s", "u", T0, 5, "c", False, True)], SCHEMA).write.parquet(src)
    s = stream.once(stream.read(spark, src, spark.read.parquet(src).schema))
    q = stream.upsert(s, lambda df: seen.append(df.count()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 1


def test_a_gap_of_exactly_the_limit_stays_in_the_session(spark):
    at = [0, 1800, 3601]  # seconds: the second gap is one second over
    df = spark.createDataFrame([(f"r{i}", "u", T0 + dt.timedelta(seconds=x)) for i, x in enumerate(at)], "review_id string, user_id string, ts timestamp")
    assert sorted(r["n_events"] for r in stream.sessions(df).collect()) == [1, 2]


def test_levels_with_state_equal_the_batch(spark, tmp_path):
    scores = [0.1, 0.25, 0.3, 0.5, 0.1, 0.1, 0.25, 0.1, 0.1, 0.1, 0.45, 0.0]
    rows = [("a" if k % 2 else "b", dt.date(2024, 1, 1) + dt.timedelta(days=k // 2), v, 3 if v > 0.4 else 1, False) for k, v in enumerate(v for v in scores for _ in range(2))]
    schema = "sku string, window_end date, score double, groups int, severe boolean"
    src = str(tmp_path / "in")
    for lo in range(0, len(rows), 6):
        spark.createDataFrame(rows[lo : lo + 6], schema).coalesce(1).write.mode("append").parquet(src)
    import os
    import time

    for i, f in enumerate(sorted(p for p in os.listdir(src) if p.endswith(".parquet"))):
        first = spark.read.parquet(f"{src}/{f}").agg(F.min("window_end")).first()[0]
        os.utime(f"{src}/{f}", (time.time() - 1000 + first.toordinal() % 1000,) * 2)
    q = stream.levels(stream.read(spark, src, schema)).writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    m = spark.createDataFrame([(*r[:3], "c", ["x"] * r[3], r[4]) for r in rows], "sku string, window_end date, score double, category string, groups_active array<string>, severe boolean")
    s = score.with_persistence(m)
    s = score.hysteresis(s.withColumn("raw", score.level_of(F.col("score"), F.col("persist"), F.col("groups_active"), F.col("severe"))))
    want = s.select("sku", "window_end", "score", "persist", score.name_of(F.col("level")))
    assert sorted(map(tuple, spark.table("levels").collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_go_aside(spark, tmp_path):
    src, kept, late = str(tmp_path / "in"), [], []
    schema = spark.createDataFrame([], "id int, ts timestamp").schema

    def run():
        q = stream.split_late(stream.read(spark, src, schema), 3600, lambda df: kept.extend(r["id"] for r in df.collect()), lambda df: late.extend(r["id"] for r in df.collect()), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()

    for rows in ([(1, T0)], [(2, T0 - dt.timedelta(hours=2)), (3, T0 - dt.timedelta(minutes=30)), (4, T0 + dt.timedelta(hours=5)), (5, None)], [(6, T0), (7, T0 + dt.timedelta(hours=5))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        run()
    assert sorted(kept) == [1, 3, 4, 7] and sorted(late) == [2, 5, 6]
