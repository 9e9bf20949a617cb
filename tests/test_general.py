import datetime as dt
import random

import pytest
from tidewatch.operators import hotkeys, rolling, sessions

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
EVENTS = "user_id string, ts timestamp, review_id string, u string, t int, edge boolean"


def brute_sessions(events, gap=1800):
    out = []
    by = {}
    for u, t, i in {e for e in events if e[0] is not None and e[1] is not None}:
        by.setdefault(u, []).append((t, i or ""))
    for u, es in by.items():
        es.sort()
        cur = [es[0]]
        for e in es[1:]:
            if e[0] - cur[-1][0] > gap:
                out.append((u, cur[0][0], cur[-1][0], len(cur)))
                cur = []
            cur.append(e)
        out.append((u, cur[0][0], cur[-1][0], len(cur)))
    return sorted(out)


def frame(spark, events):
    return spark.createDataFrame([(u, None if t is None else T0 + dt.timedelta(seconds=t), i, "x", 1, True) for u, t, i in events], EVENTS)


def found(df):
    base = int(T0.timestamp() * 1e6)
    return sorted((r["user_id"], (r["start_us"] - base) // 10**6, (r["end_us"] - base) // 10**6, r["n_events"]) for r in df.collect())


def test_sessions_equal_brute_force_with_a_hot_user(spark):
    r = random.Random(1)
    events = [(r.choice(["hot", "hot", f"u{r.randint(0, 20)}", None]), r.randint(0, 200_000), f"r{k}") for k in range(4000)]
    events += events[::17] + [("z", None, "q"), ("n", 5, None), ("n", 5, None), ("n", 10, None)]
    got = found(sessions.sessionize(frame(spark, events).repartition(7)))
    assert got == brute_sessions(events)
    assert found(sessions.sessionize(frame(spark, events), min_events=2)) == [s for s in brute_sessions(events) if s[3] >= 2]


def test_one_session_over_all_partitions(spark):
    events = [("u", 60 * k, f"r{k}") for k in range(3000)]
    assert found(sessions.sessionize(frame(spark, events))) == [("u", 0, 60 * 2999, 3000)]


def test_gap_limits_and_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        events = [("u", 0, "a"), ("u", 1800, "b"), ("u", 3601, "c"), ("u", 3601, "d"), ("u", 3601, "d"), ("v", 0, "e")]
        assert found(sessions.sessionize(frame(spark, events))) == [("u", 0, 1800, 2), ("u", 3601, 3601, 2), ("v", 0, 0, 1)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sessions.sessionize(frame(spark, events).limit(0)).count() == 0


DAILY = "sku string, date date, n int, n_neg int, _d string, day string"


def test_trailing_totals(spark):
    d = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    data = [("a", d(0), 10, 4, "", ""), ("a", d(0), 10, 4, "", ""), ("a", d(6), 1, 1, "", ""), ("a", d(7), None, 2, "", ""), ("a", d(40), 3, 0, "", ""), ("b", d(3), 5, 5, "", ""), (None, d(1), 1, 1, "", ""), ("c", None, 1, 1, "", "")]
    got = {(r["sku"], r["day"]): r for r in rolling.trailing_totals(spark.createDataFrame(data, DAILY)).collect()}
    assert len(got) == 42
    n = {k: v for k, v in ((0, 10), (6, 1), (40, 3))}
    for k in range(41):
        r = got["a", d(k)]
        assert r["n"] == n.get(k, 0) and r["n_7d"] == sum(n.get(j, 0) for j in range(k - 6, k + 1)) and r["n_30d"] == sum(n.get(j, 0) for j in range(k - 29, k + 1))
        assert r["n_avg_7d"] == pytest.approx(r["n_7d"] / 7)
    assert rolling.trailing_totals(spark.createDataFrame(data, DAILY).limit(0)).count() == 0


def test_surges_at_their_limits(spark):
    d = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    data = [("a", d(0), 12, 4), ("a", d(20), 10, 4), ("b", d(0), 3, 0), ("b", d(20), 10, 4), ("c", d(20), 9, 9)]
    df = spark.createDataFrame(data, "sku string, date date, n int, n_neg int")
    assert sorted(r["sku"] for r in rolling.surges(df).collect()) == ["b"]


def keyed(spark, n=6000):
    r = random.Random(3)
    rows = []
    for k in range(n):
        s = r.choice(["hot"] * 3 + [f"s{r.randint(0, 9)}", None])
        rows.append((s, T0 + dt.timedelta(seconds=r.randint(0, 500)), f"r{k:05}", r.randint(1, 5), 0, "x"))
    return rows


REVIEWS = "sku string, ts timestamp, review_id string, rating int, _n int, _key string"


@pytest.mark.parametrize("chunk", [7, 100, 10**6])
def test_key_counts(spark, chunk):
    rows = keyed(spark)
    want = {}
    for x in rows:
        want[x[0]] = want.get(x[0], 0) + 1
    got = {r["sku"]: r for r in hotkeys.key_counts(spark.createDataFrame(rows, REVIEWS).repartition(5), "sku", chunk).collect()}
    assert {k: r["n"] for k, r in got.items()} == want and all(r["n_chunks"] == -(-r["n"] // chunk) for r in got.values())
    assert sum(r["share"] for r in got.values()) == pytest.approx(1)


@pytest.mark.parametrize("limit", [0, 50_000])
def test_numbers_are_dense_and_ordered(spark, monkeypatch, limit):
    monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", limit)
    rows = keyed(spark, 2000)
    df = hotkeys.numbered(spark.createDataFrame(rows, REVIEWS), "sku", ["ts", "review_id"], ["ts", "review_id"])
    by = {}
    for r in df.collect():
        by.setdefault(r["_key"], []).append((r["_n"], r["_v0"], r["_v1"]))
    for k, v in by.items():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v))) and [x[1:] for x in v] == sorted(x[1:] for x in v)
    assert sum(map(len, by.values())) == 2000


@pytest.mark.parametrize("chunk", [3, 50, 10**6])
def test_rating_runs_merge_over_chunks(spark, chunk):
    rows = keyed(spark, 1500)
    df = spark.createDataFrame(rows + rows[:40], REVIEWS)
    got = {r["sku"]: tuple(r)[1:] for r in hotkeys.rating_runs(df, chunk_rows=chunk).collect()}
    by = {}
    for x in sorted((x for x in rows if x[0]), key=lambda x: (x[1], x[2])):
        by.setdefault(x[0], []).append(x[3])
    for k, v in by.items():
        best = run = 0
        for x in v:
            run = run + 1 if x <= 2 else 0
            best = max(best, run)
        assert got[k] == (len(v), v[0], v[-1], sum(a != b for a, b in zip(v, v[1:])), best)
    assert hotkeys.rating_runs(df.limit(0)).count() == 0 and hotkeys.key_counts(df.limit(0), "sku").count() == 0
