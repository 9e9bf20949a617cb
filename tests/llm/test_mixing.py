import math

import pytest
from tidewatch.llm import mixing, tokens


def test_cut_mean_and_thresholds():
    for lam, most in ((0.3, 1), (1.2, 2), (3.0, 4)):
        p = [math.exp(-lam) * lam**k / math.factorial(k) for k in range(40)]
        assert mixing.cut_mean(lam, most) == pytest.approx(sum(min(k, most) * x for k, x in enumerate(p)))
    c = mixing.thresholds(0.7, 2)
    assert sum(1 - x for x in c) == pytest.approx(0.7, abs=1e-6)
    assert mixing.thresholds(5, 2) == [0.0, 0.0] and all(x > 1 for x in mixing.thresholds(0, 2))


def test_any_mean_is_reached():
    for rate, most in ((1000, 3000), (800, 1600), (0.001, 5), (99.9, 100)):
        c = mixing.thresholds(rate, most)
        assert len(c) == most and sum(1 - x for x in c) == pytest.approx(rate, rel=1e-6)


def tables(spark, n=400):
    docs = [(i, "one two three four five" if i % 4 else "a longer text of another source, indeed", "a" if i % 4 else "b", "?") for i in range(n)]
    docs += [(10_001, None, "a", "?"), (10_002, "", "b", "?"), (10_003, "left out", None, "?"), (10_004, "no target", "z", "?"), (None, "without an id", "a", "?")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, copy string")
    t = spark.createDataFrame([("a", 0.3, 2, 1), ("b", 0.6, 2, 1), ("gone", 0.1, 3, 1), (None, 0.0, 1, 1)], "source string, target_share double, max_repeats int, tokens int")
    return d, t


def test_shares_caps_and_order(spark):
    d, t = tables(spark)
    r = {x["source"]: x for x in mixing.mix_report(d, t, seed=3).collect()}
    e = tokens.encoder()
    want = sum(len(e.encode(x["text"] or "")) for x in d.collect() if x["source"] == "b")
    assert r["b"]["tokens"] == want and r["gone"]["capped"] and r["gone"]["tokens"] == 0
    total = r["a"]["tokens"] + r["b"]["tokens"]
    assert r["b"]["capped"] == (want * 2 < 0.6 * total)
    assert r["a"]["mixed_tokens"] == pytest.approx(0.3 * total, rel=0.15)
    assert [x[0] for x in mixing.short_sources(d, t, seed=3).collect()] == [s for s, x in r.items() if x["capped"]]
    m = mixing.mix(d, t, seed=3).collect()
    copies = {}
    for x in m:
        copies[x["doc_id"], x["text"]] = copies.get((x["doc_id"], x["text"]), 0) + 1
    assert max(copies.values()) <= 2 and {x["source"] for x in m} == {"a", "b"}
    for s in ("a", "b"):  # the report is the mixture's
        assert sum(len(e.encode(x["text"] or "")) for x in m if x["source"] == s) == sum(x["n_tokens"] for x in m if x["source"] == s) == r[s]["mixed_tokens"]
    assert [x["doc_id"] for x in m] == [x["doc_id"] for x in mixing.mix(d, t, seed=3).collect()]


def test_empty_tables(spark):
    d, t = tables(spark, 8)
    assert mixing.mix(d.limit(0), t).count() == 0
    assert mixing.mix(d, t.limit(0)).count() == 0
    assert mixing.short_sources(d, t.limit(0)).count() == 0 and mixing.short_sources(d.limit(0), t).count() == 0
    assert mixing.mix_report(d.limit(0), t).where("mixed_tokens > 0").count() == 0
