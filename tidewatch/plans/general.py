"""Queries of the general training-data operators (hot keys, sessions, rolling totals) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.hotkeys import key_counts, rating_runs
from tidewatch.operators.rolling import surges, trailing_totals
from tidewatch.operators.sessions import sessionize
from tidewatch.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for tab in ("clean_reviews", "daily_agg"):
        part = key_counts(table(spark, d, tab), "sku").where("share >= 0.03").select(F.lit(tab).alias("tab"), "sku")
        out = part if out is None else out.unionByName(part)
    return out


def p4_rating_runs(spark: SparkSession, d: str) -> DataFrame:
    return rating_runs(table(spark, d, "clean_reviews"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(table(spark, d, "clean_reviews"), min_events=2).select("user_id", "start_us", "end_us")


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(table(spark, d, "clean_reviews"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return surges(table(spark, d, "daily_agg"))


def p7_trailing(spark: SparkSession, d: str) -> DataFrame:
    t = trailing_totals(table(spark, d, "daily_agg"))
    t = t.withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return t.select(*[F.round(c, 6).alias(c) if "_avg_" in c else F.col(c) for c in t.columns])


QUERIES = {f.__name__: f for f in (p4_found, p4_rating_runs, p5_found, p5_sessions, p7_found, p7_trailing)}

_SESSIONS = """
WITH e AS (SELECT DISTINCT user_id, review_id, epoch_us(ts) AS t FROM clean_reviews WHERE user_id IS NOT NULL),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, review_id) <= 1800000000 THEN 0 ELSE 1 END AS o FROM e),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t, review_id) AS k FROM g),
x AS (SELECT user_id, k, min(t) AS start_us, max(t) AS end_us, max(t) - min(t) AS duration_us, count(*) AS n_events FROM s GROUP BY user_id, k)
"""
_DAYS = """
WITH u AS (SELECT DISTINCT sku, date, n, n_neg FROM daily_agg),
b AS (SELECT sku, min(date) AS lo, max(date) AS hi FROM u GROUP BY sku),
c AS (SELECT sku, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b),
f AS (SELECT c.sku, c.day, CAST(coalesce(u.n, 0) AS BIGINT) AS n, CAST(coalesce(u.n_neg, 0) AS BIGINT) AS n_neg FROM c LEFT JOIN u ON u.sku = c.sku AND u.date = c.day),
t AS (SELECT sku, day, n, n_neg,
  CAST(sum(n) OVER w7 AS BIGINT) AS n_7d, CAST(sum(n) OVER w30 AS BIGINT) AS n_30d,
  CAST(sum(n_neg) OVER w7 AS BIGINT) AS n_neg_7d, CAST(sum(n_neg) OVER w30 AS BIGINT) AS n_neg_30d FROM f
  WINDOW w7 AS (PARTITION BY sku ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY sku ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

SQL = {
    "p4_found": """
WITH a AS (SELECT 'clean_reviews' AS tab, sku, count(*) AS n FROM clean_reviews GROUP BY sku UNION ALL SELECT 'daily_agg', sku, count(*) FROM daily_agg GROUP BY sku),
t AS (SELECT tab, sum(n) AS total FROM a GROUP BY tab)
SELECT a.tab, a.sku FROM a JOIN t ON a.tab = t.tab WHERE a.n >= 0.03 * t.total""",
    "p4_rating_runs": """
WITH e AS (SELECT DISTINCT sku, ts, review_id, CAST(rating AS INTEGER) AS v FROM clean_reviews),
n AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY ts, review_id) AS k, lag(v) OVER (PARTITION BY sku ORDER BY ts, review_id) AS p FROM e),
g AS (SELECT *, sum(CASE WHEN v <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY sku ORDER BY k) AS isl FROM n),
r AS (SELECT sku, isl, sum(CASE WHEN v <= 2 THEN 1 ELSE 0 END) AS run FROM g GROUP BY sku, isl),
m AS (SELECT sku, max(run) AS longest FROM r GROUP BY sku)
SELECT g.sku, count(*) AS n, arg_min(v, k) AS first_value, arg_max(v, k) AS last_value, count(*) FILTER (WHERE v <> p) AS changes, CAST(max(m.longest) AS BIGINT) AS longest_low_run
FROM g JOIN m ON g.sku = m.sku GROUP BY g.sku""",
    "p5_found": _SESSIONS + "SELECT user_id, start_us, end_us FROM x WHERE n_events >= 2",
    "p5_sessions": _SESSIONS + "SELECT user_id, start_us, end_us, duration_us, n_events FROM x",
    "p7_found": _DAYS + "SELECT sku, strftime(day, '%Y-%m-%d') AS day FROM t WHERE n_7d >= 10 AND n_neg_7d * 5 >= n_7d * 2 AND n_neg_7d * n_30d * 4 >= n_neg_30d * n_7d * 5",
    "p7_trailing": _DAYS + """SELECT sku, strftime(day, '%Y-%m-%d') AS day, n, n_neg, n_7d, round(n_7d / 7.0, 6) AS n_avg_7d, n_30d, round(n_30d / 30.0, 6) AS n_avg_30d,
n_neg_7d, round(n_neg_7d / 7.0, 6) AS n_neg_avg_7d, n_neg_30d, round(n_neg_30d / 30.0, 6) AS n_neg_avg_30d FROM t""",
}
