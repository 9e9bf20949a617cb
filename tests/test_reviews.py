import datetime as dt

import pytest
from pyspark.sql import functions as F
from tidewatch.functions import lexicon, text
from tidewatch.operators import contracts, detect, evaluate, features, preprocess, score, serve
from tidewatch.sources import reviews as source

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


@pytest.mark.parametrize(
    "raw, norm",
    [("<b>GREATTTTT product 👍</b>", "greattt product emoji_thumbs_up"), ("é&amp;  X\n", "é& x"), ("", ""), (None, None), ("🚀", "emoji"), ("aaaa", "aaa"), ("aaa", "aaa")],
)
def test_normalize(spark, raw, norm):
    assert spark.createDataFrame([(raw,)], "t string").select(text.normalize(F.col("t"))).first()[0] == norm


def test_review_id(spark):
    df = spark.createDataFrame([("B1", None, 5), ("B1", "u", 5)], "a string, u string, t bigint")
    import hashlib

    assert [r[0] for r in df.select(text.review_id(F.col("a"), F.col("u"), F.col("t"))).collect()] == [hashlib.sha1(x).hexdigest()[:16] for x in (b"B1||5", b"B1|u|5")]


def test_ngrams(spark):
    df = spark.createDataFrame([("The zipper broke and the zipper isn't ok",), (None,), ("the",)], "t string")
    assert [list(r[0]) for r in df.select(text.ngrams(F.col("t"))).collect()] == [["zipper", "broke", "zipper", "zipper broke", "broke zipper"], [], []]


@pytest.mark.parametrize(
    "words, terms",
    [
        ("it caught fire at night", ["caught fire"]), ("not a fire hazard", []), ("no smell but it exploded", ["exploded"]), ("fire tv stick is fine", []), ("never overheated. burning smell", ["burning smell"]),
        ("rash and toxic, no rash", ["rash", "toxic"]), ("it didn't overheat", []), ("caught fire hazard", ["caught fire", "fire hazard"]), ("crash", []), ("", []), (None, []),
    ],
)
def test_risk_terms(words, terms):
    assert lexicon.risk_terms(words) == terms


@pytest.mark.parametrize(
    "words, aspect",
    [("Poor quality. Late delivery. Delivery was slow.", "delivery"), ("return label", "refund"), ("The battery caused a rash.", "safety"), ("fire tv", None), (None, None), ("  ", None), ("nothing", None)],
)
def test_aspects(words, aspect):
    assert lexicon.dominant_aspect(words)[0] == aspect


def test_mask(spark):
    df = spark.createDataFrame([("mail a.b@c.de or 202-555-0146, see https://x.y/z ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.mask(F.col("t"))).collect()] == ["mail [EMAIL] or [PHONE], see [URL]", ""]


def test_load_reviews(spark):
    rows = [("A", 1700000000000, 4.7, "x", None, True), ("A", 1700000000000, 4.7, "x", None, True), ("A", 1700000000001, 9.0, "y", "u", None), ("A", 1700000000002, None, "y", "u", None), ("B", 1700000000003, 5.0, None, "u", None), (None, 1, 5.0, "", "", None)]
    df = spark.createDataFrame(rows, source.RAW)
    got = source.load_reviews(df, "C").collect()
    assert sorted((r["sku"], r["rating"]) for r in got) == [("A", 4), ("B", 5)]
    contracts.validate("clean_reviews", source.load_reviews(df, "C").withColumn("text_norm", F.lit(None).cast("string")).withColumn("is_spam", F.lit(False)).withColumn("spam_reason", F.lit(None).cast("string")))
    assert source.load_reviews(df.drop("text", "verified_purchase"), "C").count() == 2
    assert source.load_reviews(df, "C", spark.createDataFrame([("B",)], "sku string")).count() == 1


def test_upsert_replaces_each_sku_in_its_own_range(spark, tmp_path):
    path = str(tmp_path / "t")
    cols = "sku string, category string, date date, n int"
    first = spark.createDataFrame([("a", "c", day(k), 1) for k in range(40)] + [("b", "c", day(k), 1) for k in range(40)], cols)
    source.write_table(first, path, "date", ["sku", "date"])
    again = spark.createDataFrame([("a", "c", day(5), 2), ("a", "c", day(7), 2), ("b", "c", day(35), 2)], cols)
    for _ in range(2):
        source.write_table(again, path, "date", ["sku", "date"])
        spark.catalog.refreshByPath(path)
        got = {(r["sku"], r["date"]): r["n"] for r in source.read_table(spark, path, "date").collect()}
        assert len(got) == 79 and got["a", day(5)] == 2 and ("a", day(6)) not in got and got["b", day(6)] == 1 and got["b", day(35)] == 2
    some = source.read_table(spark, path, "date", start=day(38), category="c", ids=spark.createDataFrame([("a",)], "sku string"), key="sku")
    assert sorted(r["date"] for r in some.collect()) == [day(38), day(39)]
    with pytest.raises(ValueError):
        source.check_category("../x")


def test_audit(spark, tmp_path):
    a = source.Audit()
    a.record("dedup", 5, 3, note="x")
    a.write(str(tmp_path / "a.jsonl"))
    assert a.frame(spark).first()["removed"] == 2 and (tmp_path / "a.jsonl").read_text().count("\n") == 1


def test_m_of_n_vector(spark):
    z = [0, 4, 0, 0, 4, 4, 0, None, 4, None]
    df = spark.createDataFrame([("s", "c", "f", day(k), None if v is None else float(v)) for k, v in enumerate(z)], "sku string, category string, feature string, window_end date, z double")
    got = [r["triggered"] for r in detect.m_of_n(df, detect.Rule(3, 2, 3)).orderBy("window_end").collect()]
    assert got == [False, False, False, False, False, True, True, False, False, False]


def feature_rows(spark, series):
    rows = [("s", "c", day(k), i, f, float(v), n) for i, f, vals, n in series for k, v in enumerate(vals)]
    return detect.clean_features(spark.createDataFrame(rows, "sku string, category string, window_end date, indicator_id string, feature string, raw_value double, n_window int"))


def last(df, n):
    r = df.orderBy("window_end").collect()[-n:]
    return [x["triggered"] for x in r], [round(x["strength"], 3) for x in r]


def test_indicators(spark):
    assert last(detect.INDICATORS["I7"](feature_rows(spark, [("I7", "term_burst_score", [0] * 40 + [5, 5, 5], 9)])), 3)[0] == [False, True, True]
    assert last(detect.INDICATORS["I8"](feature_rows(spark, [("I8", "risk_hits", [1, 2, 3, 4], 9), ("I8", "risk_distinct_users", [3, 1, 3, 2], 9)])), 4) == ([False, False, True, True], [0, 0, 1, 0.5])
    assert last(detect.INDICATORS["I9"](feature_rows(spark, [("I9", "aspect_neg_safety", [0.05] * 40 + [0.9] * 3, 9)])), 3)[0] == [False, True, True]
    assert not any(last(detect.INDICATORS["I9"](feature_rows(spark, [("I9", "aspect_neg_safety", [0.05] * 40 + [0.9] * 3, 4)])), 43)[0])
    assert last(detect.INDICATORS["I10"](feature_rows(spark, [("I10", "mismatch_rate", [0.05] * 40 + [0.9] * 3, 9)])), 3)[0] == [False, True, True]
    verified = ("I11", "verified_ratio_all", [0.9] * 100 + [0.1] * 3, 9)
    assert last(detect.INDICATORS["I11"](feature_rows(spark, [verified, ("I1", "log1p_daily_count", [1] * 100 + [5] * 3, 9)])), 3)[0] == [False, True, True]
    assert not any(last(detect.INDICATORS["I11"](feature_rows(spark, [verified, ("I1", "log1p_daily_count", [1] * 103, 9)])), 3)[0])
    assert last(detect.INDICATORS["I6"](feature_rows(spark, [("I6", "share_1star", [0.3] * 4, 30), ("I6", "share_5star", [0.6] * 4, 30)])), 4) == ([False, False, True, True], [0, 0, 1, 1])
    assert last(detect.INDICATORS["I3"](feature_rows(spark, [("I3", "neg_ratio_shrunk", [k / 50 + (k % 3) / 100 for k in range(30)], 9)])), 1)[0] == [True]


def test_volume_and_volatility_surges(spark):
    week = [2.0, 2.1, 1.9, 2.0, 2.2, 2.4, 2.3]
    calm = [week[k % 7] + 0.01 * (k * 7 % 5) for k in range(120)]
    assert last(detect.INDICATORS["I1"](feature_rows(spark, [("I1", "log1p_daily_count", calm + [x + 2 for x in calm[:12]], 9)])), 2)[0] == [True, True]
    assert not any(last(detect.INDICATORS["I1"](feature_rows(spark, [("I1", "log1p_daily_count", calm, 9)])), 60)[0])
    wobble = [1 + 0.05 * (k % 4) for k in range(60)]
    assert last(detect.INDICATORS["I5"](feature_rows(spark, [("I5", "rating_rolling_variance", wobble + [3.0] * 10, 9)])), 1)[0] == [True]


MATRIX = "sku string, category string, window_end date, indicator_id string, triggered boolean, strength double"


def matrix(spark, windows, severe=()):
    ids = [f"I{k}" for k in range(1, 12)]
    return spark.createDataFrame([("s", "c", day(k), i, i in hit, 1.0 if (k, i) in severe else 0.5 if i in hit else 0.0) for k, hit in enumerate(windows) for i in ids], MATRIX)


def test_scoring_with_rows_held_up(spark):
    a = score.alerts(matrix(spark, [{"I4", "I5", "I10"}, {"I4", "I5"}, set(), set(), set()])).orderBy("window_end").collect()
    got = [(round(r["score"], 6), r["persist"], r["level"], r["triggered_ids"]) for r in a]
    assert [x[:3] for x in got[:1]] == [(round(5 / 21, 6), 1, "LOW")] or len(got) == 3
    assert got[-1][0] == 0.0 and all(x[2] == "MEDIUM" for x in got)


def test_tiers(spark):
    lv = lambda w, s=(): [r["level"] for r in score.alerts(matrix(spark, w, s)).orderBy("window_end").collect()]
    assert lv([{"I1", "I4", "I5", "I7"}]) == ["HIGH"]
    assert lv([{"I4", "I5", "I8"}], {(0, "I8")}) == ["HIGH"] and lv([{"I4", "I5", "I8"}]) == ["MEDIUM"]


def test_hysteresis_vector(spark):
    df = spark.createDataFrame([("s", "c", day(k), v) for k, v in enumerate([2, 0, 0, 0, 2])], "sku string, category string, window_end date, raw int")
    assert [r["level"] for r in score.hysteresis(df).orderBy("window_end").collect()] == [2, 2, 2, 0, 2]


def test_calibration(spark):
    df = spark.createDataFrame([("c", 0.1)] * 200 + [("few", 0.9)] * 3, "category string, score double")
    assert sorted(tuple(r) for r in score.calibrate(df).collect()) == [("c", 0.15, 0.35, 200), ("few", 0.2, 0.4, 3)]


ALERTS = "sku string, category string, window_end date, score double, level string, groups_active array<string>, persist int, verify_flag boolean, triggered_ids array<string>"


def alert(sku, k, level="MEDIUM", ids=("I4",), groups=("rating",)):
    return (sku, "c", day(k), 0.3, level, list(groups), 1, False, list(ids))


def test_recalls(spark):
    a = spark.createDataFrame([alert("s", 0), alert("s", 7), alert("s", 11), alert("t", 7)], ALERTS)
    labels = spark.createDataFrame([(" S ", "c", "r", day(9), 1.0), (" S ", "c", "r", day(9), 1.0), ("none", "c", "q", day(9), 1.0)], "sku string, category string, recall_id string, recall_date date, match_confidence double")
    m = evaluate.match_labels(labels, spark.createDataFrame([("s",), ("t",)], "sku string"))
    r = evaluate.match_alerts(a, m, 9).collect()
    assert len(r) == 1 and (r[0]["detected"], r[0]["first_alert"], r[0]["alert_count"], r[0]["lead_time_days"]) == (1, "2024-01-01", 2, 9)
    s = evaluate.summary(evaluate.match_alerts(a, m, 9)).first()
    assert (s["events"], s["detected"], s["missed"], s["recall"], s["alerts"]) == (1, 1, 0, 1.0, 2)
    p = {x["policy"]: x["detected"] for x in evaluate.policy_summary(a, m, 9).collect()}
    assert p == {"medium_or_high": 1, "high_only": 0, "rating": 1, "volume": 0, "keyword": 0}
    assert evaluate.summary(evaluate.match_alerts(a, m.limit(0))).first()["events"] == 0


def test_ablation_drops_a_group(spark):
    a = spark.createDataFrame([alert("s1", 0, "HIGH", ("I1", "I4", "I5", "I8"), ("content", "rating", "volume")), alert("s3", 0, "MEDIUM", ("I1", "I8"), ("content", "volume"))], ALERTS)
    got = {r["sku"]: r["level"] for r in evaluate.reclassify(a, ("content",)).collect()}
    assert got == {"s1": "MEDIUM"}
    assert "| a |" in evaluate.markdown(spark.createDataFrame([(1,)], "a int"), "t")


def test_views(spark):
    a = spark.createDataFrame([alert("s", k, lv) for k, lv in ((0, "MEDIUM"), (1, "HIGH"), (2, "HIGH"))] + [alert("t", k, "HIGH") for k in range(0, 3)] + [alert("t", -20, "HIGH")], ALERTS)
    assert {r["sku"]: (r["level"], r["since"], r["windows"]) for r in serve.level_since(a).collect()} == {"s": ("HIGH", "2024-01-02", 2), "t": ("HIGH", "2024-01-01", 3)}
    assert [r["sku"] for r in serve.new_high(a).collect()] == ["s"]
    assert [r["sku"] for r in serve.priority_table(a, 1).collect()] == ["s"] and serve.latest(a, day(0)).where("sku = 's'").first()["level"] == "MEDIUM"
    assert serve.top_alerts(a, 2, "HIGH").count() == 2 and serve.level_rollup(a).where("category is null").first()["n_alerts"] == 7


def test_evidence(spark):
    long = "the same opening words of a review that goes on and on until fifteen words are over "
    r = [("s", day(0), "r1", long + "x", False, 1, True, True), ("s", day(1), "r2", long + "y", False, 1, True, True), ("s", day(1), "r3", "fine", False, 5, False, False), ("s", day(1), "r4", "spam spam", True, 1, True, True), ("s", day(-9), "r5", "old", False, 1, True, True), ("s", day(1), "r6", None, False, 1, True, True)]
    df = spark.createDataFrame(r, "sku string, date date, review_id string, text_raw string, is_spam boolean, rating int, verified_purchase boolean, risk_hit boolean")
    got = [(x["rank"], x["review_id"], x["priority"]) for x in serve.evidence(spark.createDataFrame([alert("s", 2)], ALERTS), df).orderBy("rank").collect()]
    assert got == [(1, "r2", 16.5), (2, "r3", 0.0)]


def test_burst(spark):
    rows = [("s", day(k), f"u{k}{j}", "defect issue") for k in range(10, 13) for j in range(2)] + [("s", day(0), "u", "something else")]
    df = spark.createDataFrame(rows, "sku string, date date, user_id string, text_norm string")
    top = {r["window_end"]: r["term_burst_score"] for r in features.term_burst(df).collect()}
    assert top[day(12)] == 6.0 and top[day(6)] == 0.0
    before = [("s", day(k), f"v{k}{j}", "defect issue") for k in range(3, 6) for j in range(4)]
    assert {r["window_end"]: r["term_burst_score"] for r in features.term_burst(spark.createDataFrame(rows + before, df.schema)).collect()}[day(12)] == 0.0


def test_windows_of_risk_and_aspect(spark):
    df = spark.createDataFrame([("s", day(0), "u", True, "safety", -1.0, 0.5)] * 4 + [("s", day(0), None, True, "safety", None, 0.5)], "sku string, date date, user_id string, risk_hit boolean, aspect string, aspect_sentiment double, sentiment_score double")
    r = features.risk_windows(df).where(F.col("window_end") == F.lit(day(6))).first()
    assert (r["risk_hits"], r["risk_distinct_users"]) == (5, 1)
    assert features.aspect_windows(df).where(F.col("window_end") == F.lit(day(0))).first()["ratio"] == 0.8


def test_contracts(spark):
    good = ("s", "c", day(0), "I1", "log1p_daily_count", 1.0, 3)
    schema = "sku string, category string, window_end date, indicator_id string, feature string, raw_value double, n_window int"
    contracts.validate("feature_series", spark.createDataFrame([good], schema))
    for bad in ([good, good], [(*good[:5], float("nan"), 3)], [(*good[:4], "other", 1.0, 3)], [(None, *good[1:])], [(*good[:6], -1)]):
        with pytest.raises(ValueError):
            contracts.validate("feature_series", spark.createDataFrame(bad, schema))
    with pytest.raises(ValueError):
        contracts.conform("feature_series", spark.createDataFrame([(*good, 1)], schema + ", more int"))


def test_spam_and_dedup(spark):
    at = dt.datetime(2024, 1, 1, 5, tzinfo=dt.timezone.utc)
    rows = [(f"r{k}", "s", "c", None if k < 5 else f"u{k}", at + dt.timedelta(seconds=k), DAY, 5, "one two three") for k in range(6)] + [(f"x{k}", "t", "c", "busy", at + dt.timedelta(minutes=k), DAY, 5, None if k == 0 else f"text number {k}") for k in range(6)]
    df = spark.createDataFrame(rows, "review_id string, sku string, category string, user_id string, ts timestamp, date date, rating int, text_norm string")
    got = {r["review_id"]: r["spam_reason"] for r in preprocess.spam_flags(df).collect()}
    assert got["r0"] == "repeated_template" and got["x0"] == "too_short|user_day_burst" and got["x1"] == "user_day_burst"
    kept = {r["review_id"] for r in preprocess.dedup_exact(df).collect()}
    assert {"r0", "r5"} <= kept and not kept & {"r1", "r2", "r3", "r4"}
    assert "r4" in {r["review_id"] for r in preprocess.dedup_exact(df, "last").collect()}
