import math
import random

from tidewatch.llm import quantiles as q


def frame(spark, rows):
    return spark.createDataFrame(rows, "sku string, indicator_id string, feature string, window_end int, raw_value double, bucket string, count string")


def test_relative_error_and_merging(spark):
    r = random.Random(5)
    vals = [r.choice([-1, 1]) * 10 ** r.uniform(-12, 12) for _ in range(3000)] + [0.0] * 50 + [1e300, -1e300, float("inf"), float("-inf")]
    rows = [("a", "I1", "f", i, v, None, None) for i, v in enumerate(vals)]
    keys = ("sku", "indicator_id", "feature")
    whole = q.sketch(frame(spark, rows), keys, "raw_value")
    parts = q.merge(q.sketch(frame(spark, rows[:1000]), keys, "raw_value"), q.sketch(frame(spark, rows[1000:]), keys, "raw_value"))
    names = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    a, b = q.percentiles(whole, names).collect()[0], q.percentiles(parts, names).collect()[0]
    assert a == b and a["n"] == len(vals)
    s = sorted(vals)
    for name, p in names.items():
        want = s[max(1, math.ceil(p * len(s))) - 1]
        assert abs(a[name] - want) <= 1.01 * q.ACCURACY * abs(want)


def test_nulls_nan_repeats_and_empty(spark, rows):
    data = [("a", "I1", "f", 1, 5.0, "x", "y")] * 3 + [("a", "I1", "f", 2, 7.0, None, None), ("a", "I1", "f", 3, None, None, None), ("a", "I1", "f", 4, float("nan"), None, None), (None, "I1", "f", 1, 1.0, None, None)]
    s = q.sketch(frame(spark, data), ("sku",), "raw_value", once_per=("window_end",))
    got = {r["sku"]: r["n"] for r in q.percentiles(s, {"p50": 0.5}).collect()}
    assert got == {"a": 2, None: 1}
    assert q.percentiles(q.sketch(frame(spark, data).limit(0), ("sku",), "raw_value"), {"p50": 0.5}).count() == 0


def test_heavy_tails(spark, rows):
    heavy = [("h", "I1", "f", i, 1.0 + 0.01 * (i % 10) + (100.0 if i % 12 == 0 else 0.0), None, None) for i in range(60)]
    even = [("e", "I1", "f", i, float(i), None, None) for i in range(60)]
    flat = [("c", "I1", "f", i, 3.0 if i % 12 else 90.0, None, None) for i in range(60)]
    few = [("t", "I1", "f", i, r[4], None, None) for i, r in enumerate(heavy[:39])]
    assert rows(q.heavy_tails(frame(spark, heavy + even + flat + few))) == [("h", "I1", "f")]


def test_answers_at_the_edge_are_exact(spark, rows):
    """Groups whose margin is smaller than the sketch's error are decided by their values."""
    r, data, want = random.Random(8), [], []
    for g in range(60):
        base = 1000.0
        vals = sorted(base + r.uniform(0, 0.5) for _ in range(56)) + [base + r.uniform(0.5, 3.5) for _ in range(8)]
        data += [(f"s{g}", "I1", "f", i, v, None, None) for i, v in enumerate(vals)]
        s = sorted(vals)
        p25, p50, p75, p95 = (s[max(1, math.ceil(p * len(s))) - 1] for p in (0.25, 0.5, 0.75, 0.95))
        if p75 > p25 and p95 - p50 > 8 * (p75 - p25):
            want.append((f"s{g}", "I1", "f"))
    assert 0 < len(want) < 60 and rows(q.heavy_tails(frame(spark, data))) == sorted(want, key=repr)


def test_blocks_give_the_same_as_all_buckets(spark):
    vals = [10 ** (i % 700 / 50 - 7) * (1 if i % 3 else -1) for i in range(2500)]
    df = spark.createDataFrame([("a", v) for v in vals], "sku string, v double")
    names = {f"q{i}": i / 20 for i in range(21)}
    got, s = q.percentiles(q.sketch(df, ("sku",), "v"), names).collect()[0], sorted(vals)
    assert all(abs(got[n] - (w := s[max(1, math.ceil(p * len(s))) - 1])) <= 1.01 * q.ACCURACY * abs(w) for n, p in names.items())
