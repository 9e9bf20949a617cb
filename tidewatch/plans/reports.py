"""Queries of selection, calibration, packs and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import lexicon
from tidewatch.operators import calibrate, packs, reports, score
from tidewatch.plans.reviews import FEATS, C, _alerts, _crises, _day, _features, _matrix, _reviews
from tidewatch.session import table
from tidewatch.sources.stored import stored

QUERIES, SQL = {}, {}
#: History that a product must have in the query; the operator takes any numbers.
HISTORY = (180, 200, 5.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WEEKLY = f"""{C}, w AS (SELECT sku, date, CAST(floor((datediff('day', DATE '1970-01-01', date) + 719163) / 7.0) AS BIGINT) AS week FROM clean), k AS (SELECT sku, week, count(*) AS k FROM w GROUP BY sku, week),
b AS (SELECT sku, min(date) AS lo, max(date) AS hi, count(*) AS n, min(week) AS a, max(week) AS b FROM w GROUP BY sku), e AS (SELECT sku, unnest(generate_series(a, b)) AS week FROM b),
m AS (SELECT e.sku, median(coalesce(k.k, 0)) AS med FROM e LEFT JOIN k ON e.sku = k.sku AND e.week = k.week GROUP BY e.sku),
el AS (SELECT b.sku, datediff('day', lo, hi) + 1 AS days, n, med FROM b JOIN m ON b.sku = m.sku WHERE datediff('day', lo, hi) + 1 >= {HISTORY[0]} AND n >= {HISTORY[1]} AND med >= {HISTORY[2]})"""


@query(f"WITH {_WEEKLY} SELECT sku, days AS history_days, n AS n_reviews, CAST(med AS DOUBLE) AS median_weekly FROM el")
def eligible_skus(s, d):
    return reports.with_history(_reviews(s, d), *HISTORY).select("sku", F.col("history_days").cast("bigint").alias("history_days"), "n_reviews", "median_weekly")


@query(f"WITH {_WEEKLY} SELECT sku, count(*) AS reviews FROM clean WHERE sku NOT IN (SELECT sku FROM el) GROUP BY sku")
def removed_skus(s, d):
    r = _reviews(s, d)
    return reports.removed(r, reports.of_products(r, reports.with_history(r, *HISTORY)))


@query(f"WITH {C} SELECT category, count(DISTINCT sku) AS skus, count(*) AS reviews FROM clean GROUP BY category")
def available_categories(s, d):
    return reports.categories(_reviews(s, d))


@query(f"WITH {C} SELECT sku, count(*) AS reviews FROM clean WHERE contains(lower(sku), lower('0A')) GROUP BY sku")
def sku_search(s, d):
    return reports.find_sku(_reviews(s, d), "0A").groupBy("sku").agg(F.count("*").alias("reviews"))


@query("SELECT strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day FROM daily_agg")
def date_bounds(s, d):
    return reports.date_bounds(_alerts(s, d).where("false"), table(s, d, "daily_agg")).select(_day("first_day"), _day("last_day"))


@query(f"""WITH {C} SELECT 'category' AS field, category AS value, count(*) AS "rows" FROM clean GROUP BY category UNION ALL SELECT 'verified_purchase', coalesce(CAST(verified_purchase AS VARCHAR), 'null'), count(*) FROM clean GROUP BY verified_purchase
UNION ALL SELECT 'user_id', 'is null', count(*) FROM clean WHERE user_id IS NULL HAVING count(*) > 0 UNION ALL SELECT 'text_norm', 'is null', count(*) FROM clean WHERE text_norm IS NULL HAVING count(*) > 0""")
def quality_report(s, d):
    return reports.quality(_reviews(s, d), ["category", "verified_purchase"], ["user_id", "text_norm"])


@query(f"""WITH {FEATS} SELECT coalesce(indicator_id, 'all') AS indicator_id, count(*) AS "rows", count(DISTINCT sku) AS skus, count(*) FILTER (x IS NULL) AS nulls, CAST(coalesce(sum(x) FILTER (feature = 'risk_hits'), 0) AS DOUBLE) AS risk_hits
FROM fs GROUP BY ROLLUP (indicator_id)""")
def feature_run_report(s, d):
    return reports.feature_run(_features(s, d))


def _layers(s, d):
    """Word lists on reviews; as similarity, for want of review vectors in the tables, a number from the rating: what counts is the join of the layers."""
    r = _reviews(s, d).withColumn("risk_terms", lexicon.risk_terms_of("text_norm"))
    return r.select("review_id", (F.size("risk_terms") > 0).alias("risk_hit"), F.when(F.size("risk_terms") > 0, F.col("risk_terms")).alias("risk_terms"), F.when(F.col("user_id").isNotNull(), (6 - F.col("rating")) / 8.0).alias("risk_sim"))


_RISKY = "regexp_matches(lower(coalesce(text_norm, '')), '\\b(?:" + "|".join(p for ps in lexicon.RISK.values() for p in ps) + ")\\b')"


@query()
def risk_combined(s, d):
    return reports.risk_combined(_layers(s, d))


@query(f"WITH {C} SELECT review_id, CAST(user_id IS NOT NULL AND (6 - rating) / 8.0 >= 0.6 AS INTEGER) AS risk_hit FROM clean")
def risk_by_similarity(s, d):
    return reports.risk_combined(_layers(s, d), "layer2").select("review_id", F.col("risk_hit").cast("int").alias("risk_hit"))


# ---- calibration


@query()
def calibration_thresholds(s, d):
    return calibrate.thresholds(calibrate.reference_scores(_matrix(s, d)))


@query()
def calibration_sweep(s, d):
    return stored(s, "sweep", [f"{d}/feature_series.parquet"], lambda: calibrate.sweep(_features(s, d)))


@query()
def calibration_choice(s, d):
    return calibrate.chosen(calibration_sweep(s, d))


@query()
def calibration_report(s, d):
    return calibrate.report(_features(s, d), real=_matrix(s, d), crises=_crises(s, d))


@query()
def calibration_metrics(s, d):
    return calibrate.indicator_metrics(_crises(s, d))


@query()
def scores_off_changepoints(s, d):
    r = calibrate.reference_scores(_matrix(s, d))
    return r.select("sku", _day("window_end"), F.round("score", 6).alias("score"))


# ---- packs


def _packs(s, d):
    r = _reviews(s, d).withColumn("risk_hit", F.size(lexicon.risk_terms_of("text_norm")) > 0)
    return packs.pack(_alerts(s, d), r, _matrix(s, d))


@query()
def evidence_packs(s, d):
    return _packs(s, d).withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd"))


@query()
def evidence_packs_high(s, d):
    return _packs(s, d).where("level = 'HIGH'").withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd"))


@query()
def evidence_hashes(s, d):
    return packs.hashed(_packs(s, d)).select("sku", _day("window_end"), "hash")


@query()
def indicator_levels(s, d):
    """How often each indicator stands behind an alert of each level."""
    a = _alerts(s, d).select("level", F.explode("triggered_ids").alias("indicator_id"))
    return a.groupBy("indicator_id", "level").agg(F.count("*").alias("alerts"), F.lit(len(score.POINTS)).alias("scored"))
