"""Queries over all eleven indicators, which no SQL follows, by brute force over the matrix."""

import datetime as dt
import random

import pytest
from tidewatch.operators import detect, medians, score
from tidewatch.operators.features import VOCABULARY
from tidewatch.plans import reviews as plan

DAY = dt.date(2024, 1, 1)
SERIES = "sku string, category string, window_end date, indicator_id string, feature string, raw_value double, n_window int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A product whose negative share rises (I3 alone), one whose ratings turn volatile (I5 alone), one with a calm volume."""
    d = str(tmp_path_factory.mktemp("sf"))
    series = [
        ("trend", "I3", "neg_ratio_shrunk", [0.1 + 0.01 * (k % 3) for k in range(60)] + [0.1 + k / 50 + (k % 3) / 100 for k in range(30)]),
        ("wild", "I5", "rating_rolling_variance", [1 + 0.05 * (k % 4) for k in range(80)] + [3.0] * 10), ("calm", "I1", "log1p_daily_count", [2 + 0.1 * (k % 7) for k in range(90)]),
    ]
    rows = [(sku, "c", DAY + dt.timedelta(days=k), i, f, float(v), 9) for sku, i, f, vals in series for k, v in enumerate(vals)]
    spark.createDataFrame(rows, SERIES).write.parquet(f"{d}/feature_series.parquet")
    return d


def brute(matrix):
    """(sku, day) to score, persistence, level, groups and ids of every alert, row by row."""
    hits, out = {}, {}
    for r in matrix:
        hits.setdefault((r["sku"], r["window_end"]), set()).update([(r["indicator_id"], r["strength"])] if r["triggered"] else [])
    for sku in {k[0] for k in hits}:
        persist, cur, want, seen = 0, None, None, 0
        for key in sorted(k for k in hits if k[0] == sku):
            ids = sorted((i for i, _ in hits[key]), key=lambda i: int(i[1:]))
            points = sum(score.POINTS.get(i, 0) for i in ids) / 21
            groups = sorted(g for g, members in score.GROUPS.items() if set(members) & set(ids))
            persist = persist + 1 if points >= plan.ALERT_TAU[0] else 0
            raw = 2 if points >= plan.ALERT_TAU[1] and (len(groups) == 3 or ("I8", 1.0) in hits[key]) else 1 if points >= plan.ALERT_TAU[0] and (persist >= 2 or len(groups) >= 2) else 0
            seen = 0 if cur is None or raw >= cur else seen + 1 if want == raw else 1
            cur, want, seen = (raw, None, 0) if seen == 0 or seen >= 3 else (cur, raw, seen)
            if cur:
                out[key] = (round(points, 6), persist, score.LEVELS[cur], ",".join(groups), ",".join(i[1:] for i in ids))
    return out


def test_alerts_of_all_indicators(spark, folder):
    want = brute(plan.QUERIES["indicator_matrix"](spark, folder).collect())
    got = {(r["sku"], r["window_end"]): (r["score"], r["persist"], r["level"], r["groups_active"], r["ids"]) for r in plan.QUERIES["alerts"](spark, folder).collect()}
    assert got == want
    assert {k[0] for k in got} == {"trend", "wild"} and {v[4] for v in got.values()} >= {"3", "5"}
    assert {r["sku"] for r in plan.QUERIES["latest_alert"](spark, folder).collect()} == {"trend", "wild"}
    assert {r["indicator_id"] for r in plan.QUERIES["indicator_breakdown"](spark, folder).collect()} == {"I1", "I3", "I5"}


def test_ablation_keeps_the_alerts_and_their_thresholds(spark, folder):
    want = brute(plan.QUERIES["indicator_matrix"](spark, folder).collect())
    got = {r["config"]: (r["n_alerts"], r["n_high"], r["n_skus"]) for r in plan.QUERIES["ablation"](spark, folder).collect()}
    assert got["full"] == (len(want), 0, 2)
    # the first alert of a run has no alert before it; rows held up by hysteresis score too little
    again = sum(1 for (sku, day), v in want.items() if v[0] >= plan.ALERT_TAU[0] and (sku, before(day)) in want and want[sku, before(day)][0] >= plan.ALERT_TAU[0])
    assert again > 0 and got["without_volume"] == got["only_rating"] == (again, 0, 2) and got["without_rating"] == (0, 0, 0)


def before(day):
    return str(dt.date.fromisoformat(day) - dt.timedelta(days=1))


def test_crises_reach_all_indicators(spark, folder):
    fired = {(r["sku"], r["indicator_id"]): r["fired"] for r in plan.QUERIES["synthetic_alerts"](spark, folder).collect()}
    assert fired["volume", "I1"] > 0 and fired["rating", "I5"] > 0 and ("rating", "I3") in fired
    assert fired["control", "I1"] == 0


def test_each_query_over_the_alerts_has_a_plain_form():
    short = {n for n, q in plan.SQL.items() if "mx AS" in q}
    assert short and short == {n for n in plan.QUERIES if n.endswith("_plain")} and all(n.removesuffix("_plain") in plan.QUERIES for n in short)


def test_one_pass_gives_what_each_indicator_gives(spark):
    """Series with gaps, nulls, few values and several categories, through both ways."""
    r, rows = random.Random(3), []
    names = [(i, f) for i, fs in VOCABULARY.items() for f in fs]
    for sku in range(6):
        for i, f in names:
            if r.random() < 0.2:
                continue
            start, level = r.randrange(5), r.uniform(0.1, 2)
            for k in range(start, r.choice([12, 70, 110])):
                if r.random() < 0.85:
                    v = None if r.random() < 0.05 else level * (1 + 0.2 * r.random()) * (4 if k % 50 > 44 else 1)
                    rows.append((f"s{sku}", f"c{sku % 2}", DAY + dt.timedelta(days=k), i, f, v if v is None or "share" not in f else min(v, 0.9), r.randrange(0, 40)))
    f = spark.createDataFrame(rows, SERIES)
    show = lambda m: sorted((x["sku"], x["window_end"], x["indicator_id"], x["triggered"], round(x["strength"], 9)) for x in m.collect())
    one = show(detect.indicator_matrix(f))
    each = None
    for k in detect.INDICATORS:
        each = detect.INDICATORS[k](f) if each is None else each.unionByName(detect.INDICATORS[k](f))
    assert one == show(each) and len({x[2] for x in one}) == 11 and sum(x[3] for x in one) > 20
    assert detect.indicator_matrix(f.limit(0)).count() == 0


def test_medians_of_large_groups_are_exact(spark):
    r = random.Random(4)
    rows = [("a", float(r.choice([0, 0, 0, 1, -3]))) for _ in range(301)] + [("b", r.gauss(0, 5)) for _ in range(400)] + [("c", 2.5), ("d", None), ("e", -1e300), ("e", 1e-300)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert sorted(map(tuple, medians.selected(df, ["k"], "v", "m").collect())) == sorted(map(tuple, medians.median(df, ["k"], "v", "m", True).collect()))
