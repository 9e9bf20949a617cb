"""Bursts of terms: against brute force across edges of blocks, with every limit of size reached, and what is exchanged."""

import datetime as dt
import random
from collections import defaultdict
from math import sqrt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidewatch.functions import text
from tidewatch.operators import bursts, features

SCHEMA = "sku string, date date, user_id string, text_norm string"
FIRST = 19_700
WORDS = ["zipper", "broke", "don't", "the", "ok", "lid", "smell", "fire"]


def some(n, days, seed):
    """Rows (sku, day, user, text): one busy product, some quiet ones, null products, users and texts."""
    r = random.Random(seed)
    skus = ["busy"] * 6 + ["a", "b", "c", "d", None]
    return [(r.choice(skus), FIRST + r.choice([r.randrange(days), r.randrange(days // 4)]), r.choice(["u", "v", "w", "x", "", None]), r.choice([None, "", " ".join(r.choices(WORDS, k=r.randrange(1, 7)))])) for _ in range(n)]


def terms(t):
    w = text.words_of(t)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(rows, days=7, min_count=5, min_users=3):
    by, lo, hi = defaultdict(list), min(r[1] for r in rows), max(r[1] for r in rows)
    for sku, day, user, t in rows:
        by[sku].append((day, user or "", terms(t)))
    out = {}
    for sku, of in by.items():
        for end in {d + k for d, _, _ in of for k in range(days) if lo + days - 1 <= d + k <= hi}:
            now, past, users, top = defaultdict(int), defaultdict(int), defaultdict(set), 0.0
            for d, u, ts in of:
                for x in ts:
                    if end - days < d <= end:
                        now[x] += 1
                        users[x].add(u)
                    elif end - 2 * days < d <= end - days:
                        past[x] += 1
            if sku is not None:
                top = max([0.0, *((c - past[x]) / sqrt(past[x] + 1) for x, c in now.items() if c >= min_count and len(users[x]) >= min_users)])
            out[sku, end] = top
    return out


def frame(spark, rows):
    return spark.createDataFrame([(s, dt.date(1970, 1, 1) + dt.timedelta(days=d), u, t) for s, d, u, t in rows], SCHEMA)


def result(df):
    rows = df.select("sku", F.unix_date("window_end"), "term_burst_score").collect()
    got = {(r[0], r[1]): r[2] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("limits", [(7, 5, 3), (3, 2, 1), (7, 9, 5)])
def test_against_brute_force(spark, limits):
    rows = some(1500, 200, 1)
    want = brute(rows, *limits)
    assert any(want.values()) and result(features.term_burst(frame(spark, rows), *limits)) == want
    assert result(features.term_burst(frame(spark, rows).limit(0))) == {}


@pytest.mark.parametrize("limits", [{}, {"TEXTS": 40, "ROWS": 60, "CELLS": 1, "OUT": 3}, {"TEXTS": 1, "ROWS": 0}, {"CELLS": 200}])
def test_limits_of_size_change_nothing(monkeypatch, limits):
    """In one process, as workers would not see the limits."""
    for name, v in limits.items():
        monkeypatch.setattr(bursts, name, v)
    rows, days = some(1200, 130, 2), 7
    size = bursts.BLOCK * days
    parts = sorted(((s, b, d, u or "", t) for s, d, u, t in rows for b in range(d // size, (d + 2 * days - 1) // size + 1)), key=lambda x: (x[0] or "", x[1], x[2]))
    columns = list(zip(*parts))
    types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 100], t) for c, t in zip(columns, types)], names=list("sbdut")) for k in range(0, len(parts), 100)]
    got = {(s, e): x for b in bursts._scan(days, 5, 3)(iter(batches)) for s, e, x in zip(*(c.to_pylist() for c in b.columns))}
    want = brute(rows)
    assert {k: got[k] for k in want} == want and any(want.values())


def test_words_are_those_of_ngrams(spark):
    texts = ["The zipper broke and the zipper isn't ok", "don''t o'neill's 'tis x'y", "café naïve İstanbul Kelvin", "a1b2 33 444 don't-stop", "zipper\nbroke\tlid", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t"), text.ngrams(F.col("t"))).collect()
    assert [terms(t) for t, _ in got] == [list(n) for _, n in got]


def _shuffled(spark):
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_terms_are_not_exchanged(spark):
    """What is exchanged stays under twice the texts; with the terms it was many times that."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=7)) for _ in range(2000)]
    rows = [(f"s{r.randrange(9)}", FIRST + r.randrange(60), f"u{r.randrange(500)}", " ".join(r.choices(words, k=40))) for _ in range(2000)]
    df, before = frame(spark, rows), _shuffled(spark)
    features.term_burst(df).collect()
    assert 0 < _shuffled(spark) - before < 2 * sum(len(x[3]) for x in rows)
