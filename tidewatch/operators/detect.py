"""Indicators I1 to I11 over the long feature table: robust z-scores against own and industry history, m-of-n triggers.

A series (sku, indicator, feature) has at most one point a day, so a group is bounded by the calendar, not by the number of
reviews; the grouped NumPy step runs once for all series of an indicator. Triggers and combinations are Catalyst windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions import series as S
from tidewatch.operators.medians import all_small, median
from tidewatch.session import checkpointed

KEYS = ("sku", "category", "window_end", "indicator_id", "triggered", "strength")


@dataclass(frozen=True)
class Rule:
    k: float
    m: int
    n: int
    direction: str = "up"
    min_valid: int | None = None


#: Rule, scale floor and feature of each indicator that is a z-score with a trigger.
RULES = {
    "I1": (Rule(2.5, 2, 3), 0.05, "log1p_daily_count"), "I2": (Rule(2.5, 3, 3), 0.05, "growth_rate"), "I3": (Rule(1.645, 1, 1), 0.0, "neg_ratio_shrunk"),
    "I4": (Rule(3.0, 3, 5), 0.05 / 3.0, "low_star_ratio_shrunk"), "I5": (Rule(2.5, 3, 5), 0.05, "rating_rolling_variance"), "I7": (Rule(3.0, 2, 3), 0.05, "term_burst_score"),
    "I9": (Rule(2.5, 2, 3), 0.05, ""), "I10": (Rule(2.5, 2, 3), 0.05, "mismatch_rate"), "I11": (Rule(2.5, 2, 3, "down"), 0.02, "verified_ratio_all"),
}
I6_SHARE, I6_N, I8_HITS, I8_SEVERE, I9_SUPPORT, I11_VOLUME, I11_FLOOR = 0.15, 20, 2, 3, 5, 2.5, 0.05


def clean_features(features: DataFrame) -> DataFrame:
    """Repeated rows once; NaN and infinite values as null. Of several values of one key the greatest counts."""
    x = F.col("raw_value")
    ok = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return features.groupBy("sku", "category", "indicator_id", "feature", "window_end").agg(F.max(ok).alias("raw_value"), F.max("n_window").alias("n_window"))


def industry_baseline(features: DataFrame, floor: Column, first: int = 60, min_n: int = 14) -> DataFrame:
    """``(category, feature, i_median, i_scale, i_n)`` of the first ``first`` calendar days of every series of the category.

    Medians of categories too large for one task are selected in two passes; the early values are written once for all passes.
    """
    keys = ["category", "feature"]
    lo = features.groupBy("sku", "feature").agg(F.min("window_end").alias("_lo"))
    early = features.join(lo, ["sku", "feature"]).where(F.datediff("window_end", "_lo") < first).where("raw_value is not null").select(*keys, "raw_value")
    early = checkpointed(early)
    small = all_small(early, keys)
    mid = median(early, keys, "raw_value", "i_median", small)
    dev = early.join(mid, keys).withColumn("_d", F.abs(F.col("raw_value") - F.col("i_median")))
    fit = mid.join(median(dev, keys, "_d", "_mad", small).drop("n"), keys).where(F.col("n") >= min_n)
    return fit.select(*keys, "i_median", F.greatest(F.col("_mad") * S.MAD, floor).alias("i_scale"), F.col("n").alias("i_n"))


def per_series(features: DataFrame, compute: Callable[[np.ndarray, np.ndarray, tuple[float, float] | None], np.ndarray], industry: DataFrame | None, dense: bool = True) -> DataFrame:
    """``(sku, category, window_end, feature, x, n_window, z)``: ``compute(values, weekdays, industry)`` on each ordered series.

    ``dense`` fills missing days with NaN; filled rows have n_window 0.
    """
    f = features.select("sku", "category", "feature", "window_end", "raw_value", "n_window")
    if industry is not None:
        f = f.join(industry.select("category", "feature", "i_median", "i_scale"), ["category", "feature"], "left")
    else:
        f = f.withColumn("i_median", F.lit(None).cast("double")).withColumn("i_scale", F.lit(None).cast("double"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window_end")
        days = pd.to_datetime(pdf["window_end"]).to_numpy().astype("datetime64[D]")
        x, n = pdf["raw_value"].to_numpy(float), pdf["n_window"].fillna(0).to_numpy(int)
        if dense:
            at = (days - days[0]).astype(int)
            full = np.arange(days[0], days[-1] + 1)
            xs, ns = np.full(len(full), np.nan), np.zeros(len(full), int)
            xs[at], ns[at] = x, n
            days, x, n = full, xs, ns
        m, s = pdf["i_median"].iloc[0], pdf["i_scale"].iloc[0]
        z = compute(x, (days.astype(int) + 3) % 7, None if pd.isna(m) else (float(m), float(s)))
        return pd.DataFrame({"sku": pdf["sku"].iloc[0], "category": pdf["category"].iloc[0], "window_end": days.astype("datetime64[s]"), "feature": pdf["feature"].iloc[0], "x": x, "n_window": n, "z": z}).assign(window_end=lambda d: d["window_end"].dt.date)

    out = f.groupBy("sku", "category", "feature").applyInPandas(one, "sku string, category string, window_end date, feature string, x double, n_window int, z double")
    return out.withColumn("z", F.when(~F.isnan("z"), F.col("z"))).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def m_of_n(rows: DataFrame, rule: Rule, value: str = "z", keys: tuple[str, ...] = ("sku", "category", "feature"), order: str = "window_end") -> DataFrame:
    """``rows`` with ``triggered`` and ``strength``: at least m of the last n rows exceed k and min_valid (m by default) are not null."""
    v = {"up": F.col(value), "down": -F.col(value), "both": F.abs(value)}[rule.direction]
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(rule.n - 1), 0)
    fired = (F.sum((F.coalesce(v, F.lit(float("-inf"))) > rule.k).cast("int")).over(w) >= rule.m) & (F.count(v).over(w) >= (rule.min_valid or rule.m))
    rise = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.max(v).over(w) - rule.k) / rule.k))
    return rows.withColumn("_fired", fired).withColumn("_rise", rise).withColumn("triggered", F.col("_fired")).withColumn("strength", F.when(F.col("_fired"), F.col("_rise")).otherwise(0.0)).drop("_fired", "_rise")


def _finish(rows: DataFrame, indicator: str) -> DataFrame:
    return rows.withColumn("indicator_id", F.lit(indicator)).select(*KEYS)


def _of(features: DataFrame, *names: str) -> DataFrame:
    return features.where(F.col("feature").isin(*names))


def zscores(features: DataFrame, floor: float = 0.05, industry: bool = True, dense: bool = True) -> DataFrame:
    """Robust z of every series of ``features`` against its own lagged history and, if wanted, the category's."""
    ind = industry_baseline(features, F.lit(floor)) if industry else None
    return per_series(features, lambda x, dow, i: S.robust_z(x, i, floor), ind, dense)


def simple_indicator(features: DataFrame, indicator: str) -> DataFrame:
    """I2, I4, I7 and I10: z-score of one feature with a trigger."""
    rule, floor, name = RULES[indicator]
    return _finish(m_of_n(zscores(_of(features, name), floor), rule), indicator)


def derived_volume(features: DataFrame) -> DataFrame:
    """Log counts less a weekday profile, their 7-day mean: the series that I1 looks at; written once, as z-scores and industry read it."""
    derive = lambda x, dow, i: S.trailing_mean(S.deseasonalize(x, dow))
    s = per_series(_of(features, RULES["I1"][2]), derive, None)
    return checkpointed(s.select("sku", "category", "feature", "window_end", F.col("z").alias("raw_value"), "n_window"))


def indicator_1(features: DataFrame) -> DataFrame:
    """Volume surge: z of the derived volume. The industry pools these derived series."""
    rule, floor, _ = RULES["I1"]
    return _finish(m_of_n(zscores(derived_volume(features), floor), rule), "I1")


def indicator_3(features: DataFrame) -> DataFrame:
    """Rising negative share by the corrected Mann-Kendall test on 28 days."""
    rule, _, name = RULES["I3"]
    return _finish(m_of_n(per_series(_of(features, name), lambda x, dow, i: S.trend_z(x), None), rule), "I3")


def indicator_5(features: DataFrame) -> DataFrame:
    """Rating volatility: z with a trigger, kept only where a change point of the variance series confirms it."""
    rule, floor, name = RULES["I5"]
    fired = m_of_n(zscores(_of(features, name), floor), rule)

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window_end").reset_index(drop=True)
        ok, strength = S.confirmed(pdf["x"].to_numpy(float), pdf["triggered"].to_numpy(bool), pdf["strength"].to_numpy(float), floor)
        return pdf.assign(triggered=ok, strength=strength)

    return _finish(fired.groupBy("sku", "category", "feature").applyInPandas(confirm, fired.schema), "I5")


def indicator_6(features: DataFrame) -> DataFrame:
    """Polarised ratings: many one-star and many five-star ratings together."""
    p = _of(features, "share_1star", "share_5star").groupBy("sku", "category", "window_end").pivot("feature", ["share_1star", "share_5star"]).agg(F.max("raw_value"))
    n = _of(features, "share_1star", "share_5star").groupBy("sku", "category", "window_end").agg(F.max("n_window").alias("n_window"))
    p = p.join(n, ["sku", "category", "window_end"])
    both = F.least("share_1star", "share_5star")
    known = F.col("share_1star").isNotNull() & F.col("share_5star").isNotNull()
    p = p.withColumn("hit", F.when(known, ((both >= I6_SHARE) & (F.col("n_window") >= I6_N)).cast("double"))).withColumn("feature", F.lit("i6")).withColumn("_low", both)
    p = m_of_n(p, Rule(0.5, 3, 5, min_valid=1), "hit")
    return _finish(p.withColumn("strength", F.when(F.col("triggered"), F.least(F.lit(1.0), F.coalesce(F.when(known, F.col("_low")), F.lit(0.0)) / (2 * I6_SHARE))).otherwise(0.0)), "I6")


def indicator_8(features: DataFrame) -> DataFrame:
    """Risk terms by several users; strength 1 is severe."""
    p = _of(features, "risk_hits", "risk_distinct_users").groupBy("sku", "category", "window_end").pivot("feature", ["risk_hits", "risk_distinct_users"]).agg(F.max("raw_value"))
    low = F.least(F.coalesce("risk_hits", F.lit(0.0)), F.coalesce("risk_distinct_users", F.lit(0.0)))
    return _finish(p.withColumn("triggered", low >= I8_HITS).withColumn("strength", F.when(low >= I8_SEVERE, 1.0).when(low >= I8_HITS, 0.5).otherwise(0.0)), "I8")


def indicator_9(features: DataFrame) -> DataFrame:
    """Any aspect whose negative share is high for itself, with enough reviews of the aspect."""
    rule, floor, _ = RULES["I9"]
    f = features.where(F.col("indicator_id") == "I9")
    z = zscores(f, floor, industry=False, dense=False).withColumn("z", F.when(F.col("n_window") >= I9_SUPPORT, F.col("z")))
    r = m_of_n(z, rule).groupBy("sku", "category", "window_end").agg(F.bool_or("triggered").alias("triggered"), F.max("strength").alias("strength"))
    return _finish(r, "I9")


def indicator_11(features: DataFrame) -> DataFrame:
    """Falling verified share while volume is unusual; both series have the days on which there is a verified share."""
    rule, floor, name = RULES["I11"]
    keys = ["sku", "category", "window_end"]
    share = _of(features, name).select(*keys, F.lit("share").alias("feature"), "raw_value", "n_window")
    volume = _of(features, "log1p_daily_count").select(*keys, F.col("raw_value").alias("_volume"))
    volume = share.join(volume, keys, "left").select(*keys, F.lit("volume").alias("feature"), F.col("_volume").alias("raw_value"), "n_window")
    z = zscores(share, floor, industry=False, dense=False)
    v = zscores(volume, I11_FLOOR, industry=False, dense=False).select(*keys, F.col("z").alias("_v"))
    z = z.join(v, keys, "left").withColumn("z", F.when(F.col("_v") > I11_VOLUME, F.col("z"))).drop("_v")
    return _finish(m_of_n(z, rule), "I11")


INDICATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "I1": indicator_1, "I2": lambda f: simple_indicator(f, "I2"), "I3": indicator_3, "I4": lambda f: simple_indicator(f, "I4"), "I5": indicator_5, "I6": indicator_6,
    "I7": lambda f: simple_indicator(f, "I7"), "I8": indicator_8, "I9": indicator_9, "I10": lambda f: simple_indicator(f, "I10"), "I11": indicator_11,
}


_BUILT_IN = dict(INDICATORS)


def register(indicator: str, build: Callable[[DataFrame], DataFrame] | None = None):
    """A further indicator, or another way to build one; also as a decorator. Ids must look like those of the contract."""
    if not re.fullmatch(r"I\d{1,2}", indicator):
        raise ValueError(f"no indicator id: {indicator!r}")
    if build is None:
        return lambda f: register(indicator, f) or f
    INDICATORS[indicator] = build


_Z = ("I2", "I4", "I5", "I7", "I10")  # z-scores of a stored feature


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    """All built-in indicators of one product from its rows of all features."""
    pdf = pdf.sort_values("window_end", kind="stable")
    days_all = pd.to_datetime(pdf["window_end"]).to_numpy().astype("datetime64[D]").astype(int)
    by = {name: np.asarray(at) for name, at in pdf.groupby("feature", sort=False).indices.items()}
    x_all, n_all = pdf["raw_value"].to_numpy(float), pdf["n_window"].fillna(0).to_numpy(int)
    m_all, s_all, owner = pdf["i_median"].to_numpy(float), pdf["i_scale"].to_numpy(float), pdf["indicator_id"].to_numpy()
    out = []

    def of(name: str, dense: bool = True):
        at = by[name]
        days, x, n = days_all[at], x_all[at], n_all[at]
        if dense:
            full = np.arange(days[0], days[-1] + 1)
            xs, ns = np.full(len(full), np.nan), np.zeros(len(full), int)
            xs[days - days[0]], ns[days - days[0]] = x, n
            days, x, n = full, xs, ns
        i = None if np.isnan(m_all[at[0]]) else (m_all[at[0]], s_all[at[0]])
        return days, x, n, i

    def add(k: str, days: np.ndarray, fired: np.ndarray, strength: np.ndarray) -> None:
        out.append((days, np.full(len(days), k), fired, strength))

    def rule(k: str, v: np.ndarray, r: Rule | None = None):
        r = r or RULES[k][0]
        return S.fire({"up": v, "down": -v, "both": np.abs(v)}[r.direction], r.k, r.m, r.n, r.min_valid or r.m)

    for k in ("I1", *_Z):
        name = _DERIVED if k == "I1" else RULES[k][2]
        if name in by:
            days, x, _, i = of(name)
            fired, strength = rule(k, S.robust_z(x, i, RULES[k][1]))
            if k == "I5" and fired.any():
                fired, strength = S.confirmed(x, fired, strength, RULES[k][1])
            add(k, days, fired, strength)
    if RULES["I3"][2] in by:
        days, x, _, _ = of(RULES["I3"][2])
        add("I3", days, *rule("I3", S.trend_z(x)))
    shares = [of(f, False) for f in ("share_1star", "share_5star") if f in by]
    if shares:
        days = np.unique(np.concatenate([d for d, *_ in shares]))
        v, n = np.full((2, len(days)), np.nan), np.zeros(len(days), int)
        for f, row in (("share_1star", 0), ("share_5star", 1)):
            if f in by:
                d, x, k, _ = of(f, False)
                at = np.searchsorted(days, d)
                v[row, at] = x
                n[at] = np.maximum(n[at], k)
        low = v.min(0)  # NaN where one is missing
        hit = np.where(np.isnan(low), np.nan, ((low >= I6_SHARE) & (n >= I6_N)).astype(float))
        fired, _ = rule("I6", hit, Rule(0.5, 3, 5, min_valid=1))
        add("I6", days, fired, np.where(fired, np.minimum(1.0, np.nan_to_num(low) / (2 * I6_SHARE)), 0.0))
    risks = [f for f in ("risk_hits", "risk_distinct_users") if f in by]
    if risks:
        days = np.unique(np.concatenate([of(f, False)[0] for f in risks]))
        low = np.zeros((2, len(days)))
        for row, f in enumerate(("risk_hits", "risk_distinct_users")):
            if f in by:
                d, x, _, _ = of(f, False)
                low[row, np.searchsorted(days, d)] = np.nan_to_num(x)
        low = low.min(0)
        add("I8", days, low >= I8_HITS, np.where(low >= I8_SEVERE, 1.0, np.where(low >= I8_HITS, 0.5, 0.0)))
    aspects = [f for f, at in by.items() if owner[at[0]] == "I9"]
    if aspects:
        parts = []
        for f in aspects:
            d, x, n, _ = of(f, False)
            z = S.robust_z(x, None, RULES["I9"][1])
            parts.append((d, *rule("I9", np.where(n >= I9_SUPPORT, z, np.nan))))
        days = np.unique(np.concatenate([d for d, *_ in parts]))
        fired, strength = np.zeros(len(days), bool), np.zeros(len(days))
        for d, a, b in parts:
            at = np.searchsorted(days, d)
            fired[at] |= a
            strength[at] = np.maximum(strength[at], b)
        add("I9", days, fired, strength)
    if RULES["I11"][2] in by:
        days, x, _, _ = of(RULES["I11"][2], False)
        volume = np.full(len(days), np.nan)
        if "log1p_daily_count" in by:
            d, w, _, _ = of("log1p_daily_count", False)
            both, i, j = np.intersect1d(days, d, return_indices=True)
            volume[i] = w[j]
        z = np.where(S.robust_z(volume, None, I11_FLOOR) > I11_VOLUME, S.robust_z(x, None, RULES["I11"][1]), np.nan)
        add("I11", days, *rule("I11", z))
    if not out:
        return pd.DataFrame({k: [] for k in KEYS})
    days, ids, fired, strength = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"sku": pdf["sku"].iloc[0], "category": pdf["category"].iloc[0], "window_end": days.astype("datetime64[D]").astype("datetime64[s]"), "indicator_id": ids, "triggered": fired, "strength": strength}).assign(window_end=lambda d: d["window_end"].dt.date)


_DERIVED = "derived_volume"


def one_pass(features: DataFrame) -> DataFrame:
    """The matrix of all built-in indicators: one pass for the derived volume, one for the industry's baselines, one over products.

    A product's rows are bounded by days times features. Each indicator by itself (``INDICATORS``) gives the same rows.
    """
    f = checkpointed(features.select("sku", "category", "indicator_id", "feature", "window_end", "raw_value", "n_window"))
    derived = derived_volume(f).select("sku", "category", F.lit("I1").alias("indicator_id"), F.lit(_DERIVED).alias("feature"), "window_end", "raw_value", "n_window")
    floors = {_DERIVED: RULES["I1"][1]} | {RULES[k][2]: RULES[k][1] for k in _Z}
    floor = F.element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), F.col("feature"))
    every = f.unionByName(derived)
    base = checkpointed(industry_baseline(every.where(F.col("feature").isin(*floors)), floor).select("category", "feature", "i_median", "i_scale"))
    rows = every.join(base, ["category", "feature"], "left")
    return rows.groupBy("sku", "category").applyInPandas(_product, "sku string, category string, window_end date, indicator_id string, triggered boolean, strength double")


def indicator_matrix(features: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """All indicators of a cleaned feature table, one row per (sku, day, indicator)."""
    names = only or tuple(INDICATORS)
    built_in = [k for k in names if INDICATORS[k] is _BUILT_IN.get(k)]
    out = None
    if only is None and set(built_in) == set(_BUILT_IN):
        out = one_pass(features)
        names = tuple(k for k in names if k not in built_in)
    for k in names:
        part = INDICATORS[k](features)
        out = part if out is None else out.unionByName(part)
    return out
