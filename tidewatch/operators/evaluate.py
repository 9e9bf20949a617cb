"""Alerts against recalls, policies, ablation, threshold sensitivity, synthetic crises, confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.operators.score import GROUPS, TAU, groups_of, level_of, name_of, points_of, with_persistence

LOOKBACK = 90
#: Indicators of the policies that are compared with the levels.
POLICIES = {"rating": ("I3", "I4", "I5", "I6"), "volume": ("I1", "I2"), "keyword": ("I7", "I8")}
TAUS = ((0.15, 0.35), (0.20, 0.40), (0.25, 0.45), (0.30, 0.50), (0.35, 0.60))


def match_labels(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Recall labels whose sku, upper case and trimmed, has reviews; ``sku`` as the reviews spell it, repeated labels once."""
    skus = reviews.select("sku").distinct().select(F.col("sku").alias("_s"), F.upper(F.trim("sku")).alias("_k"))
    return labels.distinct().withColumn("_k", F.upper(F.trim("sku"))).join(skus, "_k").select(F.col("_s").alias("sku"), "category", "recall_id", "recall_date", "match_confidence")


def match_alerts(alerts: DataFrame, labels: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """``(sku, recall_id, recall_date, detected, first_alert, alert_count, lead_time_days)`` for every label.

    An equi join on sku and category with the range of days as a residual condition.
    """
    l = labels.select("sku", "category", "recall_id", "recall_date")
    a = alerts.select(F.col("sku").alias("_s"), F.col("category").alias("_c"), "window_end")
    near = (F.col("sku") == F.col("_s")) & (F.col("category") == F.col("_c")) & F.col("window_end").between(F.date_sub("recall_date", lookback), F.col("recall_date"))
    g = l.join(a, near, "left").groupBy("sku", "category", "recall_id", "recall_date").agg(F.min("window_end").alias("first_alert"), F.count("window_end").alias("alert_count"))
    return g.select("sku", "recall_id", F.date_format("recall_date", "yyyy-MM-dd").alias("recall_date"), (F.col("alert_count") > 0).cast("int").alias("detected"), F.date_format("first_alert", "yyyy-MM-dd").alias("first_alert"), "alert_count", F.datediff("recall_date", "first_alert").alias("lead_time_days"))


def summary(matched: DataFrame) -> DataFrame:
    n, d = F.count("*"), F.sum("detected")
    return matched.agg(n.alias("events"), d.cast("bigint").alias("detected"), (n - d).alias("missed"), F.when(n > 0, d / n).alias("recall"), F.avg("lead_time_days").alias("mean_lead"), F.percentile("lead_time_days", 0.5).alias("median_lead"), F.sum("alert_count").alias("alerts"))


def policy_alerts(alerts: DataFrame) -> DataFrame:
    """``alerts`` once for each policy that keeps them, with ``policy``."""
    keep = [F.when(F.lit(True), F.lit("medium_or_high")), F.when(F.col("level") == "HIGH", F.lit("high_only"))]
    keep += [F.when(F.arrays_overlap("triggered_ids", F.array(*[F.lit(i) for i in ids])), F.lit(name)) for name, ids in POLICIES.items()]
    return alerts.withColumn("policy", F.explode(F.filter(F.array(*keep), lambda x: x.isNotNull())))


def policy_summary(alerts: DataFrame, labels: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """``(policy, events, detected, recall, alerts)`` of all policies in one plan."""
    names = ["medium_or_high", "high_only", *POLICIES]
    l = labels.select("sku", "category", "recall_id", "recall_date").withColumn("policy", F.explode(F.array(*[F.lit(n) for n in names])))
    a = policy_alerts(alerts).select("policy", "sku", "category", "window_end")
    hit = l.join(a, ["policy", "sku", "category"], "left").withColumn("ok", F.col("window_end").between(F.date_sub("recall_date", lookback), F.col("recall_date")))
    g = hit.groupBy("policy", "sku", "recall_id").agg(F.count_if("ok").alias("k"))
    return g.groupBy("policy").agg(F.count("*").alias("events"), F.count_if(F.col("k") > 0).alias("detected"), (F.count_if(F.col("k") > 0) / F.count("*")).alias("recall"), F.sum("k").alias("alerts"))


def reclassify(alerts: DataFrame, dropped: tuple[str, ...] = (), tau: tuple[float, float] = TAU) -> DataFrame:
    """Alerts rescored without the indicators of ``dropped`` groups and tiered anew, without hysteresis; LOW rows are dropped.

    An alert that was HIGH with fewer than three groups counts as severe. Persistence runs over alert rows only.
    Dropping ``flag`` clears ``verify_flag``.
    """
    gone = [i for g in dropped for i in GROUPS.get(g, ("I10", "I11") if g == "flag" else ())]
    ids = F.filter("triggered_ids", lambda x: ~x.isin(*gone)) if gone else F.col("triggered_ids")
    a = alerts.withColumn("_sev", (F.col("level") == "HIGH") & (F.size("groups_active") < 3)).withColumn("triggered_ids", ids)
    a = a.withColumn("groups_active", groups_of(F.col("triggered_ids"), dropped)).withColumn("score", points_of(F.col("triggered_ids")))
    if "content" in dropped:
        a = a.withColumn("_sev", F.lit(False))
    if "flag" in dropped:
        a = a.withColumn("verify_flag", F.lit(False))
    a = with_persistence(a.drop("persist"), tau[0])
    a = a.withColumn("_lv", level_of(F.col("score"), F.col("persist"), F.col("groups_active"), F.col("_sev"), *tau)).where("_lv > 0")
    return a.withColumn("level", name_of(F.col("_lv"))).drop("_lv", "_sev")


def ablation(alerts: DataFrame, tau: tuple[float, float] = TAU) -> DataFrame:
    """``(config, n_alerts, n_high, n_skus)`` of all groups (the alerts as they are), without each, and with each alone.

    ``tau`` are the thresholds that the alerts were scored with.
    """
    names, out = sorted(GROUPS), None
    configs = {"full": ()} | {f"without_{g}": (g,) for g in names} | {f"only_{g}": tuple(x for x in names if x != g) for g in names}
    for name, dropped in configs.items():
        part = (reclassify(alerts, dropped, tau) if dropped else alerts).agg(F.count("*").alias("n_alerts"), F.count_if(F.col("level") == "HIGH").alias("n_high"), F.count_distinct("sku").alias("n_skus")).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("config", "n_alerts", "n_high", "n_skus")


def tau_sensitivity(alerts: DataFrame, taus: tuple[tuple[float, float], ...] = TAUS) -> DataFrame:
    """``(tau1, tau2, n_alerts, n_high)`` of pairs of thresholds."""
    out = None
    for t in taus:
        part = reclassify(alerts, (), t).agg(F.count("*").alias("n_alerts"), F.count_if(F.col("level") == "HIGH").alias("n_high")).select(F.lit(t[0]).alias("tau1"), F.lit(t[1]).alias("tau2"), "n_alerts", "n_high")
        out = part if out is None else out.unionByName(part)
    return out


def median_template(features: DataFrame) -> DataFrame:
    """``(category, indicator_id, feature, value, support)``: the median over time of the daily medians over products."""
    day = features.where("raw_value is not null").groupBy("category", "indicator_id", "feature", "window_end").agg(F.percentile("raw_value", 0.5).alias("v"), F.percentile("n_window", 0.5).alias("k"))
    return day.groupBy("category", "indicator_id", "feature").agg(F.percentile("v", 0.5).alias("value"), F.percentile("k", 0.5).alias("support"))


#: What the last days of each synthetic product are overwritten with.
CRISES = {
    "control": {}, "volume": {"log1p_daily_count": 5.0, "growth_rate": 4.0}, "rating": {"low_star_ratio_shrunk": 0.7, "neg_ratio_shrunk": 0.7, "rating_rolling_variance": 3.5},
    "safety": {"risk_hits": 6.0, "risk_distinct_users": 5.0, "aspect_neg_safety": 0.9}, "bombing": {"share_1star": 0.5, "share_5star": 0.4, "extreme_share": 0.9, "verified_ratio_all": 0.1},
}


def inject_crises(features: DataFrame, days: int = 14) -> DataFrame:
    """Synthetic products: each category's daily median product five times, the last ``days`` overwritten by the kind of crisis."""
    f = features.where("raw_value is not null").groupBy("category", "indicator_id", "feature", "window_end").agg(F.percentile("raw_value", 0.5).alias("raw_value"), F.percentile("n_window", 0.5).cast("int").alias("n_window"))
    ends = f.groupBy("category").agg(F.max("window_end").alias("_end"))
    f = f.join(ends, "category").withColumn("sku", F.explode(F.array(*[F.lit(k) for k in CRISES])))
    value = F.col("raw_value")
    for kind, change in CRISES.items():
        for name, v in change.items():
            value = F.when((F.col("sku") == kind) & (F.col("feature") == name) & (F.col("window_end") > F.date_sub("_end", days)), F.lit(v)).otherwise(value)
    return f.select("sku", "category", "window_end", "indicator_id", "feature", value.alias("raw_value"), "n_window")


def sweep(z: DataFrame, ks: tuple[float, ...], mns: tuple[tuple[int, int], ...], keys: tuple[str, ...] = ("sku", "category", "feature")) -> DataFrame:
    """``(k, m, n, rows, fired)``: how often each candidate rule fires on series of z that are computed once."""
    n_max = max(n for _, n in mns)
    w = W.partitionBy(*keys).orderBy("window_end").rowsBetween(-(n_max - 1), 0)
    r = z.withColumn("_last", F.reverse(F.collect_list(F.coalesce("z", F.lit(float("-inf")))).over(w)))

    def above(n: int, k: float) -> Column:
        return F.size(F.filter(F.slice("_last", 1, n), lambda x: x > k))

    out = [F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), F.lit(n).alias("n"), ((above(n, k) >= m) & (above(n, float("-inf")) >= m)).alias("hit")) for k in ks for m, n in mns]
    r = r.select(F.inline(F.array(*out)))
    return r.groupBy("k", "m", "n").agg(F.count("*").alias("rows"), F.count_if("hit").alias("fired"))


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """``(tp, fp, fn, tn, precision, recall, f1)`` of two boolean columns; null counts as false, ratios without cases are 0."""
    e, p = F.coalesce(expected, F.lit(False)), F.coalesce(predicted, F.lit(False))
    c = rows.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn)).withColumn("f1", share(2 * tp, 2 * tp + fp + fn))


def markdown(df: DataFrame, title: str) -> str:
    """A small result as a Markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *[["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in df.collect()]]
    return f"## {title}\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"
