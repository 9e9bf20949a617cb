"""Calibration, packs, reports, stored tables and settings on small fixtures."""

import datetime as dt
import json
import math

import pytest
from tidewatch import config
from tidewatch.functions import series as S
from tidewatch.operators import calibrate, evaluate, packs, reports
from tidewatch.sources import stored as st

DAY = dt.date(2024, 1, 1)


def test_hash_is_that_of_sorted_json():
    a = {"b": 1.5, "a": ["ü", None], "c": True}
    assert packs.canonical_json(a) == '{"a":["ü",null],"b":1.5,"c":true}' and packs.evidence_hash(a) == packs.evidence_hash(dict(reversed(a.items())))
    with pytest.raises(ValueError):
        packs.canonical_json({"a": math.nan})
    assert packs.cache_path("/x/", "ab" * 32) == f"/x/ab/{'ab' * 32}.json"
    with pytest.raises(ValueError):
        packs.cache_path("/x", "../etc")


def alerts(spark):
    rows = [("s1", "c", DAY + dt.timedelta(days=9), 0.42857, "HIGH", ["rating", "content"], 3, False, ["I4", "I8"]), ("s2", "c", DAY + dt.timedelta(days=9), 0.2, "MEDIUM", ["rating"], 2, True, ["I4", "I10"])]
    a = spark.createDataFrame(rows, "sku string, category string, window_end date, score double, level string, groups_active array<string>, persist int, verify_flag boolean, triggered_ids array<string>")
    m = spark.createDataFrame([(r[0], "c", r[2], i, True, 0.5) for r in rows for i in r[8]] + [("s1", "c", rows[0][2], "I10", False, 0.0)], "sku string, category string, window_end date, indicator_id string, triggered boolean, strength double")
    return a, m


def test_packs(spark, tmp_path):
    a, m = alerts(spark)
    text = "it smokes and smells, write to me at x@y.org"
    data = [(f"r{k}", "s1", DAY + dt.timedelta(days=3 + k), 1 + k % 5, k == 2, f"{k} {text}", k == 6, None) for k in range(7)] + [("late", "s1", DAY + dt.timedelta(days=20), 1, True, text, False, True), ("null", "s1", DAY + dt.timedelta(days=5), 1, None, None, None, None)]
    r = spark.createDataFrame(data, "review_id string, sku string, date date, rating int, risk_hit boolean, text_raw string, is_spam boolean, verified_purchase boolean")
    p = {x["sku"]: x for x in packs.pack(a, r, m, k=3).collect()}
    one = p["s1"]
    assert [x["review_id"] for x in one["reviews"]] == ["r2", "r5", "r0"] and one["n_reviews"] == 6 and [i["indicator_id"] for i in one["indicators"]] == ["I4", "I8"]
    assert "x@y.org" not in one["reviews"][0]["text"] and list(p["s2"]["reviews"]) == [] and [i["indicator_id"] for i in p["s2"]["indicators"]] == ["I4", "I10"]
    assert packs.pack(a, r, m, level="HIGH").count() == 1 and packs.pack(a.limit(0), r, m).count() == 0
    h = packs.hashed(packs.pack(a, r, m)).collect()
    got = {x["sku"]: x for x in h}["s1"]
    e = got["evidence"].asDict(True)
    assert got["hash"] == packs.evidence_hash(e) and e["risk_score"] == 0.4286 and e["groups_active"] == ["content", "rating"] and e["triggered_indicators"] == ["I4", "I8"] and e["window_end"] == "2024-01-10"
    cache = spark.createDataFrame([(got["hash"], "old")], "hash string, answer string")
    from pyspark.sql import functions as F

    res = packs.cached_or_new(packs.pack(a, r, m), cache, lambda new: new.select("hash", F.lit("new").alias("answer")))
    assert sorted((x["answer"], x["cached"]) for x in res.collect()) == [("new", False), ("old", True)]
    ans = spark.createDataFrame([(got["hash"], ["r2", "zz"]), ("none", None)], "hash string, cited array<string>")
    assert {x["hash"]: list(x["unknown"]) for x in packs.cited(ans, packs.pack(a, r, m)).collect()} == {got["hash"]: ["zz"], "none": []}
    fenced = spark.createDataFrame([('```json\n{"a": 1}\n```',), (' {"b": 2} ',)], "t string").select(packs.unfenced(F.col("t"))).collect()
    assert [json.loads(x[0]) for x in fenced] == [{"a": 1}, {"b": 2}]
    path = packs.cache_path(str(tmp_path), got["hash"])
    assert packs.read_json(path) is None
    packs.write_json(path, {"a": "ü"})
    assert packs.read_json(path) == {"a": "ü"}


def test_reports(spark):
    days = [DAY + dt.timedelta(days=k) for k in range(0, 210, 3)]
    rows = [(f"{s}{i}-{j}", s, d, "c", j) for s, per in (("big", 4), ("rare", 1)) for i, d in enumerate(days) for j in range(per)] + [("x", "a.b", DAY, "k", None)]
    r = spark.createDataFrame(rows, "review_id string, sku string, date date, category string, v int")
    sel = reports.with_history(r, 180, 200, 5.0)
    assert [x["sku"] for x in sel.collect()] == ["big"] and reports.of_products(r, sel).count() == 280
    assert sorted(map(tuple, reports.removed(r, reports.of_products(r, sel)).collect())) == [("a.b", 1), ("rare", 70)]
    assert reports.find_sku(r, "A.").count() == 1 and reports.find_sku(r, "%").count() == 0
    assert sorted(map(tuple, reports.categories(r).collect())) == [("c", 2, 350), ("k", 1, 1)]
    q = {(x["field"], x["value"]): x["rows"] for x in reports.quality(r, ["category", "v"], ["v"]).collect()}
    assert q["v", "null"] == q["v", "is null"] == 1 and q["category", "k"] == 1
    layers = spark.createDataFrame([("a", True, ["x"], 0.1), ("b", False, None, 0.6), ("c", False, None, None), ("d", True, ["y"], 0.9)], "review_id string, risk_hit boolean, risk_terms array<string>, risk_sim double")
    hits = {m: [x["risk_hit"] for x in reports.risk_combined(layers, m).orderBy("review_id").collect()] for m in ("layer1", "layer2", "combined")}
    assert hits == {"layer1": [True, False, False, True], "layer2": [False, True, False, True], "combined": [True, True, False, True]}
    assert reports.label_order(["NEGATIVE", "neutral", "positive"]) == (2, 0, 1) and reports.label_order(["a", "b"]) == (1, 0, None) and reports.label_order(["LABEL_0", "LABEL_1", "LABEL_2"]) == (2, 0, 1)
    for bad in (0, -1, True, 1.5, "7"):
        with pytest.raises(ValueError):
            reports.window_days(bad)


def test_injected_scorer(spark):
    class Fixed:
        labels = ["negative", "positive"]

        def load(self):
            return lambda texts: [[0.9, 0.1] if "bad" in t else [0.2, 0.8] for t in texts]

    r = spark.createDataFrame([("a", "bad lid"), ("b", "fine"), ("c", " "), ("d", None)], "review_id string, text_norm string")
    s = reports.scored_by(r, Fixed())
    got = {x["review_id"]: x["sentiment_score"] for x in s.collect()}
    assert got["a"] == pytest.approx(-0.8) and got["b"] == pytest.approx(0.6) and got["c"] is None and got["d"] is None
    assert reports.with_scores(r, s, ["sentiment_score"]).count() == 4


def test_calibration_finds_injected_crises(spark):
    import random

    r, rows = random.Random(1), []
    vocabulary = {"I1": ["log1p_daily_count"], "I2": ["growth_rate"], "I3": ["neg_ratio_shrunk"], "I4": ["low_star_ratio_shrunk"], "I5": ["rating_rolling_variance"], "I8": ["risk_hits", "risk_distinct_users"]}
    for sku in range(4):
        for i, fs in vocabulary.items():
            for f in fs:
                for k in range(90):
                    rows.append((f"s{sku}", "c", DAY + dt.timedelta(days=k), i, f, 0.0 if i == "I8" else 0.3 + 0.05 * r.random(), 9))
    f = spark.createDataFrame(rows, "sku string, category string, window_end date, indicator_id string, feature string, raw_value double, n_window int")
    s = calibrate.sweep(f).collect()
    by = {}
    for x in s:
        by.setdefault(x["indicator_id"], []).append(x)
    assert len(by["I1"]) == 9 and len(by["I5"]) == 27 and len(by["I8"]) == 8 and len(by["I2"]) == 12
    best = {x["indicator_id"]: x for x in calibrate.chosen(calibrate.sweep(f)).collect()}
    assert all(best[i]["recall"] == 1.0 and best[i]["false_alarms"] <= 0.05 and best[i]["within"] for i in ("I2", "I4", "I8"))
    rep = {x["case"]: x for x in calibrate.report(f, overrides={"c": (0.09, 0.2)}).collect()}
    assert set(rep) == set(evaluate.CRISES) and rep["control"]["detected"] == 0 and rep["safety"]["detected"] == 1 and rep["safety"]["origin"] == "override"
    assert calibrate.sweep(f.limit(0)).count() == 0


def test_thresholds_and_changepoint_windows(spark):
    m = spark.createDataFrame([("s", "c", DAY, "I5", True, 1.0), ("s", "c", DAY, "I4", True, 1.0), ("s", "c", DAY + dt.timedelta(days=1), "I4", True, 1.0)], "sku string, category string, window_end date, indicator_id string, triggered boolean, strength double")
    assert calibrate.reference_scores(m).count() == 1 and calibrate.reference_scores(m, False).count() == 2
    t = calibrate.thresholds(calibrate.reference_scores(m)).collect()
    assert [(x["tau1"], x["tau2"], x["origin"]) for x in t] == [(0.2, 0.4, "fallback")]


def test_series_helpers():
    import numpy as np

    assert list(S.shrunk_ratio([1, 0], [10, 0], 0.1)) == pytest.approx([3 / 30, 0.1])
    counts = np.r_[np.tile([5, 6, 7, 5, 4, 8, 3], 16), [200] * 7]
    z = S.volume_surge_z(counts, np.arange(len(counts)) % 7)
    assert z[-1] > 5 and np.isnan(z[:7]).all() and np.isnan(S.stl_residual(np.arange(5.0))).all() and np.abs(S.stl_residual(np.tile([0, 1, 2, -1, -2, 3, -3.0], 6))).max() < 0.5
    v = np.array([3.0, np.nan, 3.0, 1.0, 4.0])
    fired, strength = S.fire(v, 2.0, 2, 3, 2)
    assert list(fired) == [False, False, True, False, True] and strength[-1] == 1.0 and strength[2] == 0.5


def test_stored_tables_follow_their_files(spark, tmp_path):
    p, built = str(tmp_path / "t"), []
    spark.range(3).write.parquet(p)
    make = lambda: built.append(1) or spark.read.parquet(p)
    assert st.stored(spark, "t", [p], make).count() == st.stored(spark, "t", [p], make).count() == 3 and len(built) == 1
    spark.range(2).write.mode("append").parquet(p)
    assert st.stored(spark, "t", [p], make).count() == 5 and len(built) == 2
    assert st.read_or_empty(spark, str(tmp_path / "no"), "id bigint").count() == 0 and st.read_or_empty(spark, p, "id bigint").count() == 5


def test_settings(tmp_path):
    good = {"root": "/r", "category": "Toys", "tau": [0.1, 0.3], "aliases": {"dev": ["Toys", "Baby"]}}
    f = tmp_path / "s.json"
    f.write_text(json.dumps(good))
    s = config.settings(config.read(str(f)))
    assert s.tau == (0.1, 0.3) and config.categories_of("dev", good) == ["Toys", "Baby"] and config.categories_of("x", good) == ["x"]
    for bad in ({"colour": 1}, {"tau": [0.4, 0.2]}, {"category": "../x"}, {"start": "2024-02-01", "end": "2024-01-01"}, {"overrides": {"c": [0.5, 0.5]}}):
        with pytest.raises(ValueError):
            config.settings(good | bad)
