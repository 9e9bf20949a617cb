"""Calibration on injected crises: thresholds for each category, the choice of triggers by recall under false alarms, a report.

All categories are handled in one plan; the candidates of a trigger are columns over series that are scored once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import series as S
from tidewatch.operators import detect, score
from tidewatch.operators.evaluate import CRISES, inject_crises
from tidewatch.session import checkpointed

EVENT_DAYS, FALSE_ALARMS = 14, 0.05
SCALES = (0.75, 1.0, 1.25)
#: Which kind of crisis each swept indicator has to find.
TARGET = {"I1": "volume", "I2": "volume", "I3": "rating", "I4": "rating", "I5": "rating", "I8": "safety", "I11": "bombing"}


def candidates(indicator: str) -> list[tuple[float, int, int, float]]:
    """(k, m, n, penalty factor) of every rule that is tried: three factors of k, four pairs of m and n, for I5 also three of the penalty."""
    rule = detect.RULES[indicator][0]
    pairs = list(dict.fromkeys([(1, 3), (2, 3), (3, 5), (rule.m, rule.n)]))
    penalties = SCALES if indicator == "I5" else (1.0,)
    return [(rule.k * f, m, n, p) for f in SCALES for m, n in pairs for p in penalties]


def reference_scores(matrix: DataFrame, drop_changepoints: bool = True) -> DataFrame:
    """Scores of the windows that thresholds are taken from; those in which I5 fired are left out by an anti join."""
    s = score.scores(matrix)
    if not drop_changepoints:
        return s
    gone = matrix.where((F.col("indicator_id") == "I5") & F.col("triggered")).select("sku", "category", "window_end").distinct()
    return s.join(gone, ["sku", "category", "window_end"], "left_anti")


def thresholds(scored: DataFrame, overrides: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``(category, tau1, tau2, origin)``: a category's own values if given, else those of its scores, else the general ones."""
    c = score.calibrate(scored).withColumn("origin", F.when(F.col("n") < 200, "fallback").otherwise("calibrated"))
    tau1, tau2, origin = F.col("tau1"), F.col("tau2"), F.col("origin")
    for name, (a, b) in (overrides or {}).items():
        mine = F.col("category") == name
        tau1, tau2, origin = F.when(mine, a).otherwise(tau1), F.when(mine, b).otherwise(tau2), F.when(mine, "override").otherwise(origin)
    return c.select("category", tau1.cast("double").alias("tau1"), tau2.cast("double").alias("tau2"), origin.alias("origin"))


def _event(matrix: DataFrame, days: int) -> DataFrame:
    """``matrix`` of injected crises with ``event``: whether a row lies in the last ``days`` days."""
    end = matrix.groupBy("category").agg(F.max("window_end").alias("_end"))
    return matrix.join(end, "category").withColumn("event", F.col("window_end") > F.date_sub("_end", days)).drop("_end")


def indicator_metrics(matrix: DataFrame, days: int = EVENT_DAYS) -> DataFrame:
    """``(category, sku, indicator_id, before_rate, event_rate, control_rate)``: how often an indicator fires on a crisis before and
    during the event, and on the control product throughout."""
    m = _event(matrix, days).withColumn("_t", F.col("triggered").cast("double"))
    control = m.where("sku = 'control'").groupBy("category", "indicator_id").agg(F.avg("_t").alias("control_rate"))
    g = m.where("sku <> 'control'").groupBy("category", "sku", "indicator_id").agg(F.avg(F.when(~F.col("event"), F.col("_t"))).alias("before_rate"), F.avg(F.when(F.col("event"), F.col("_t"))).alias("event_rate"))
    return g.join(control, ["category", "indicator_id"], "left").select("category", "sku", "indicator_id", "before_rate", "event_rate", "control_rate")


def sweep(features: DataFrame, days: int = EVENT_DAYS) -> DataFrame:
    """``(category, indicator_id, k, m, n, penalty, recall, false_alarms)`` of every candidate on injected crises.

    Recall is 1 where the event of the target crisis has a firing; false alarms are the share of fired rows outside of events,
    of the control product and of the target before its event. Rules over z come from one pass over products; each product's
    series are scored once and all candidates read them. I8 has no k: ``k`` and ``m`` are its numbers of hits and of severe hits.
    """
    f = checkpointed(inject_crises(features, days))
    floors = {detect.RULES[i][2]: detect.RULES[i][1] for i in ("I2", "I4", "I5")} | {"derived_volume": detect.RULES["I1"][1]}
    derived = detect.derived_volume(f).select("sku", "category", F.lit("I1").alias("indicator_id"), F.lit("derived_volume").alias("feature"), "window_end", "raw_value", "n_window")
    every = f.unionByName(derived)
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), F.col("feature"))
    base = detect.industry_baseline(every.where(F.col("feature").isin(*floors)), floor).select("category", "feature", "i_median", "i_scale")
    end = f.groupBy("category").agg(F.max("window_end").alias("_end"))
    rows = every.where(F.col("sku").isin("control", *set(TARGET.values()))).join(base, ["category", "feature"], "left").join(end, "category")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sku, out = pdf["sku"].iloc[0], []
        start = pd.Timestamp(pdf["_end"].iloc[0]).to_datetime64().astype("datetime64[D]").astype(int) - days
        series = {}
        for name, part in pdf.sort_values("window_end").groupby("feature"):
            at = pd.to_datetime(part["window_end"]).to_numpy().astype("datetime64[D]").astype(int)
            x = np.full(at[-1] - at[0] + 1, np.nan)
            x[at - at[0]] = part["raw_value"].to_numpy(float)
            m, s = part["i_median"].iloc[0], part["i_scale"].iloc[0]
            series[name] = np.arange(at[0], at[-1] + 1), x, None if pd.isna(m) else (m, s)

        def add(i: str, k: float, m: int, n: int, p: float, day: np.ndarray, fired: np.ndarray) -> None:
            event = (day > start) & (sku != "control")
            out.append((pdf["category"].iloc[0], i, k, m, n, p, sku, int(fired[event].any()) if event.any() else 0, int(fired[~event].sum()), int((~event).sum())))

        for i, target in TARGET.items():
            if sku not in (target, "control"):
                continue
            if i == "I8":
                if "risk_hits" in series and "risk_distinct_users" in series:
                    day, a, _ = series["risk_hits"]
                    day2, b, _ = series["risk_distinct_users"]
                    both, ia, ib = np.intersect1d(day, day2, return_indices=True)
                    low = np.minimum(np.nan_to_num(a[ia]), np.nan_to_num(b[ib]))
                    for hits in (1, 2, 3):
                        for severe in (2, 3, 4):
                            if severe >= hits:
                                add(i, float(hits), severe, 1, 1.0, both, low >= hits)
                continue
            name = "derived_volume" if i == "I1" else detect.RULES[i][2]
            if name not in series:
                continue
            day, x, industry = series[name]
            rule, floor_i = detect.RULES[i][0], detect.RULES[i][1]
            if i == "I3":
                v = S.trend_z(x)
            elif i == "I11":
                v = -S.robust_z(x, None, floor_i)
            else:
                v = S.robust_z(x, industry, floor_i)
            checked: dict[tuple[int, float], bool] = {}
            fits = S.trailing_fits(x) if i == "I5" else None
            for k, m, n, p in candidates(i):
                fired, _ = S.fire(v, k, m, n, m)
                if i == "I5":
                    for t in np.flatnonzero(fired):
                        if (t, p) not in checked:
                            checked[t, p] = bool(S.changepoints(x[: t + 1], max(fits[1][t], floor_i) if fits[2][t] >= 14 else None, scale=2.5 * p))
                        fired[t] = checked[t, p]
                add(i, k, m, n, p, day, fired)
        return pd.DataFrame(out, columns=["category", "indicator_id", "k", "m", "n", "penalty", "sku", "hit", "false", "quiet"])

    schema = "category string, indicator_id string, k double, m int, n int, penalty double, sku string, hit int, false bigint, quiet bigint"
    each = rows.groupBy("sku", "category").applyInPandas(one, schema)
    g = each.groupBy("category", "indicator_id", "k", "m", "n", "penalty").agg(F.max(F.when(F.col("sku") != "control", F.col("hit"))).alias("recall"), F.try_divide(F.sum("false"), F.sum("quiet")).alias("false_alarms"))
    return g.select("category", "indicator_id", "k", "m", "n", "penalty", F.coalesce("recall", F.lit(0)).cast("double").alias("recall"), "false_alarms")


def chosen(swept: DataFrame, most: float = FALSE_ALARMS) -> DataFrame:
    """The candidate of each category and indicator with the best recall among those of at most ``most`` false alarms, then the fewest
    of these, then the largest k, m and n; where none keeps the bound, the one with the fewest false alarms."""
    ok = F.coalesce(F.col("false_alarms") <= most, F.lit(False))
    order = F.struct(ok.cast("int").alias("ok"), F.when(ok, F.col("recall")).otherwise(0.0).alias("r"), (-F.coalesce("false_alarms", F.lit(1.0))).alias("f"), "k", "m", "n", "penalty")
    cols = [c for c in swept.columns if c not in ("category", "indicator_id")]
    return swept.groupBy("category", "indicator_id").agg(F.max_by(F.struct(*cols), order).alias("_r"), F.max(ok).alias("within")).select("category", "indicator_id", "_r.*", "within")


def crisis_matrix(features: DataFrame, days: int = EVENT_DAYS) -> DataFrame:
    """The matrix of the injected crises."""
    return detect.indicator_matrix(detect.clean_features(inject_crises(features, days)))


def report(features: DataFrame, days: int = EVENT_DAYS, overrides: dict[str, tuple[float, float]] | None = None, real: DataFrame | None = None, crises: DataFrame | None = None) -> DataFrame:
    """``(category, case, tau1, tau2, origin, score_before, score_event, alerts, detected)`` for each crisis of each category.

    Thresholds come from the products as they are, without windows of change points; crises are injected into median
    products, detected, scored with these thresholds and counted within the event. ``real`` and ``crises`` are the matrices of the
    features and of the injected crises where they are at hand.
    """
    real = real if real is not None else checkpointed(detect.indicator_matrix(features))
    tau = checkpointed(thresholds(reference_scores(real), overrides))
    m = crises if crises is not None else checkpointed(crisis_matrix(features, days))
    s = score.scores(m).join(tau.select("category", "tau1", "tau2"), "category", "left")
    s = score.with_persistence(s, F.col("tau1"))
    s = s.withColumn("raw", score.level_of(F.col("score"), F.col("persist"), F.col("groups_active"), F.col("severe"), F.col("tau1"), F.col("tau2")))
    s = _event(score.hysteresis(s), days)
    g = s.groupBy("category", F.col("sku").alias("case")).agg(F.avg(F.when(~F.col("event"), F.col("score"))).alias("score_before"), F.avg(F.when(F.col("event"), F.col("score"))).alias("score_event"), F.count_if(F.col("event") & (F.col("level") > 0)).alias("alerts"))
    out = g.join(tau, "category", "left").withColumn("detected", (F.col("alerts") > 0).cast("int"))
    return out.where(F.col("case").isin(*CRISES)).select("category", "case", "tau1", "tau2", "origin", "score_before", "score_event", "alerts", "detected")
