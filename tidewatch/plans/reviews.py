"""Queries of the review operators on the given tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import lexicon, text
from tidewatch.operators import calibrate, contracts, detect, evaluate, features, preprocess, score, serve
from tidewatch.session import table
from tidewatch.sources import reviews as source
from tidewatch.sources.stored import stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def whole(sql: str):
    """A query over all eleven indicators, and once more as ``NAME_plain`` over those that SQL can follow, with that SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda s, d: f(s, d, None)
        QUERIES[f"{f.__name__}_plain"] = lambda s, d: f(s, d, PLAIN)
        SQL[f"{f.__name__}_plain"] = sql
        return f

    return add


def _day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _reviews(s: SparkSession, d: str) -> DataFrame:
    return preprocess.distinct_reviews(table(s, d, "clean_reviews"))


def _panel(s: SparkSession, d: str) -> DataFrame:
    return preprocess.panel(table(s, d, "daily_agg"))


def _features(s: SparkSession, d: str) -> DataFrame:
    return stored(s, "features", [f"{d}/feature_series.parquet"], lambda: detect.clean_features(table(s, d, "feature_series")))


#: Indicators whose every step SQL can express; only the queries named ``_plain`` stop at these.
PLAIN = ("I2", "I4", "I6", "I7", "I8", "I9", "I10", "I11")


def _matrix(s: SparkSession, d: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """Kept in the checkpoint folder for all queries of a session, until the table it is made from changes."""
    return stored(s, f"matrix {only}", [f"{d}/feature_series.parquet"], lambda: detect.indicator_matrix(_features(s, d), only))


def _alerts(s: SparkSession, d: str, only: tuple[str, ...] | None = None) -> DataFrame:
    return stored(s, f"alerts {only}", [f"{d}/feature_series.parquet"], lambda: score.alerts(_matrix(s, d, only), ALERT_TAU))


def _crises(s: SparkSession, d: str) -> DataFrame:
    return stored(s, "crises", [f"{d}/feature_series.parquet"], lambda: calibrate.crisis_matrix(_features(s, d)))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return evaluate.match_labels(table(s, d, "recall_labels"), table(s, d, "clean_reviews"))


#: The series of the tables hold few indicators of one product at a time, so alerts begin at two points of 21.
ALERT_TAU = (0.09, 0.22)

C = "clean AS (SELECT DISTINCT * FROM clean_reviews)"

# ---- preprocessing


@query("SELECT left(sha1(parent_asin || '|' || coalesce(user_id, '') || '|' || CAST(timestamp AS VARCHAR)), 16) AS review_id, parent_asin AS sku, count(*) AS records FROM raw_reviews GROUP BY 1, 2")
def review_ids(s, d):
    r = table(s, d, "raw_reviews")
    return r.select(text.review_id(F.col("parent_asin"), F.col("user_id"), F.col("timestamp")).alias("review_id"), F.col("parent_asin").alias("sku")).groupBy("review_id", "sku").agg(F.count("*").alias("records"))


@query("""WITH r AS (SELECT left(sha1(parent_asin || '|' || coalesce(user_id, '') || '|' || CAST(timestamp AS VARCHAR)), 16) AS review_id, parent_asin AS sku, user_id, CAST(timestamp * 1000 AS BIGINT) AS ts_us,
  CASE WHEN rating IS NULL OR isnan(rating) OR abs(rating) >= 128 THEN NULL ELSE CAST(trunc(rating) AS INTEGER) END AS rating, text AS text_raw, verified_purchase FROM raw_reviews)
SELECT review_id, sku, user_id, ts_us, rating, text_raw FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY rating NULLS FIRST, text_raw NULLS FIRST, user_id NULLS FIRST, verified_purchase NULLS FIRST) AS k
  FROM r WHERE rating BETWEEN 1 AND 5) WHERE k = 1""")
def load_reviews(s, d):
    r = source.load_reviews(table(s, d, "raw_reviews"), "all")
    return r.select("review_id", "sku", "user_id", F.unix_micros("ts").alias("ts_us"), F.col("rating").cast("int").alias("rating"), "text_raw")


@query()
def text_normalized(s, d):
    return _reviews(s, d).select("review_id", text.normalize(F.col("text_raw")).alias("text_norm"))


@query(f"WITH {C} SELECT review_id, len(regexp_extract_all(coalesce(text_norm, ''), '\\S+')) AS tokens, lower(text_raw) AS low FROM clean")
def tokens_of_reviews(s, d):
    return _reviews(s, d).select("review_id", text.token_count(F.col("text_norm")).cast("bigint").alias("tokens"), F.lower("text_raw").alias("low"))


@query(f"""WITH {C} SELECT review_id FROM (SELECT review_id, row_number() OVER (PARTITION BY sku, user_id, text_norm ORDER BY ts, review_id) AS k FROM clean) WHERE k = 1""")
def dedup_exact(s, d):
    return preprocess.dedup_exact(_reviews(s, d)).select("review_id")


SPAM = C + r""", w AS (SELECT review_id, text_norm,
  CASE WHEN user_id IS NOT NULL THEN count(*) OVER (PARTITION BY user_id, date) ELSE 0 END AS a,
  CASE WHEN text_norm IS NOT NULL THEN count(*) OVER (PARTITION BY sku, date, text_norm) ELSE 0 END AS b, count(*) OVER (PARTITION BY sku, ts) AS c FROM clean),
f AS (SELECT review_id, concat_ws('|', CASE WHEN len(regexp_extract_all(coalesce(text_norm, ''), '\S+')) < 3 THEN 'too_short' END, CASE WHEN a > 5 THEN 'user_day_burst' END,
  CASE WHEN b >= 5 THEN 'repeated_template' END, CASE WHEN c >= 10 THEN 'same_second_burst' END) AS r FROM w)"""


@query(f"WITH {SPAM} SELECT review_id, CAST(r <> '' AS INTEGER) AS is_spam, CASE WHEN r <> '' THEN r END AS spam_reason FROM f")
def spam_flags(s, d):
    return preprocess.spam_flags(_reviews(s, d)).select("review_id", F.col("is_spam").cast("int").alias("is_spam"), "spam_reason")


@query(f"WITH {SPAM}, x AS (SELECT unnest(string_split(r, '|')) AS rule FROM f WHERE r <> '') SELECT rule, count(*) AS reviews FROM x GROUP BY rule")
def spam_rule_counts(s, d):
    r = preprocess.spam_flags(_reviews(s, d)).where("is_spam").select(F.explode(F.split("spam_reason", r"\|")).alias("rule"))
    return r.groupBy("rule").agg(F.count("*").alias("reviews"))


AGG = f"""{C}, a AS (SELECT sku, category, date, count(*) FILTER (NOT is_spam) AS n, count(*) FILTER (NOT is_spam AND rating <= 2) AS n_neg, count(*) FILTER (NOT is_spam AND rating = 1) AS n1, count(*) FILTER (NOT is_spam AND rating = 2) AS n2,
  count(*) FILTER (NOT is_spam AND rating = 3) AS n3, count(*) FILTER (NOT is_spam AND rating = 4) AS n4, count(*) FILTER (NOT is_spam AND rating = 5) AS n5,
  CAST(coalesce(sum(CAST(rating AS INTEGER)) FILTER (NOT is_spam), 0) AS DOUBLE) AS sum_rating, CAST(coalesce(sum(CAST(rating AS INTEGER) * rating) FILTER (NOT is_spam), 0) AS DOUBLE) AS sumsq_rating,
  count(*) FILTER (NOT is_spam AND coalesce(verified_purchase, false)) AS n_verified, count(*) AS n_all, count(*) FILTER (coalesce(verified_purchase, false)) AS n_verified_all FROM clean GROUP BY sku, category, date)"""


def dense(source_cte: str, name: str, cols=preprocess.COUNTS) -> str:
    """CTEs of a dense panel ``p`` over the sparse relation ``name``."""
    return f"""{source_cte}, e AS (SELECT min(date) AS lo, max(date) AS hi FROM {name}), k AS (SELECT DISTINCT sku, category FROM {name}),
g AS (SELECT sku, category, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM k, e),
p AS (SELECT g.sku, g.category, g.date, {', '.join(f'coalesce(x.{c}, 0) AS {c}' for c in cols)} FROM g LEFT JOIN {name} x ON g.sku = x.sku AND g.category = x.category AND g.date = x.date)"""


PANEL = dense("u AS (SELECT DISTINCT * FROM daily_agg)", "u")


@query(f"WITH {dense(AGG, 'a')} SELECT sku, category, strftime(date, '%Y-%m-%d') AS date, {', '.join(preprocess.COUNTS)} FROM p")
def daily_agg_built(s, d):
    p = preprocess.panel(preprocess.daily_counts(_reviews(s, d)))
    return p.select("sku", "category", _day("date"), *[F.col(c).cast("bigint").alias(c) if "rating" not in c else F.col(c) for c in preprocess.COUNTS])


@query(f"""WITH {C}, w AS (SELECT sku, date, CAST(floor((datediff('day', DATE '1970-01-01', date) + 719163) / 7.0) AS BIGINT) AS week FROM clean),
k AS (SELECT sku, week, count(*) AS k, min(date) AS lo, max(date) AS hi FROM w GROUP BY sku, week), s AS (SELECT sku, min(lo) AS lo, max(hi) AS hi, sum(k) AS n, min(week) AS a, max(week) AS b FROM k GROUP BY sku),
e AS (SELECT sku, unnest(generate_series(a, b)) AS week FROM s), m AS (SELECT e.sku, median(coalesce(k.k, 0)) AS med FROM e LEFT JOIN k ON e.sku = k.sku AND e.week = k.week GROUP BY e.sku)
SELECT s.sku, strftime(lo, '%Y-%m-%d') AS first_date, strftime(hi, '%Y-%m-%d') AS last_date, CAST(n AS BIGINT) AS n_reviews, CAST(med AS DOUBLE) AS median_weekly FROM s JOIN m ON s.sku = m.sku""")
def weekly_median(s, d):
    return preprocess.weekly_median(_reviews(s, d))


@query(f"""WITH {C}, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku, user_id, text_norm ORDER BY ts, review_id) AS k FROM clean) WHERE k = 1),
{SPAM[len(C) + 2:].replace('FROM clean)', 'FROM dd)')}
SELECT 'repeated' AS step, (SELECT count(*) FROM clean_reviews) AS rows_in, (SELECT count(*) FROM clean) AS rows_out
UNION ALL SELECT 'duplicates', (SELECT count(*) FROM clean), (SELECT count(*) FROM dd) UNION ALL SELECT 'spam', (SELECT count(*) FROM dd), (SELECT count(*) FROM f WHERE r = '')""")
def audit_funnel(s, d):
    return preprocess.funnel(table(s, d, "clean_reviews"))


def contract_sql(name: str, rules: dict[str, str]) -> str:
    """``(rule, rows)`` of a table's contract, its rules as SQL conditions that every row must meet."""
    rules = {f"null_{c}": f"{c} IS NOT NULL" for c in contracts.required(name)} | rules
    parts = [f"SELECT '{k}' AS rule, count(*) FILTER (NOT coalesce({v}, true)) AS \"rows\" FROM {name}" for k, v in rules.items()]
    keys = ", ".join(contracts.KEYS[name])
    return " UNION ALL ".join([*parts, f"SELECT 'duplicate_key', count(*) FROM (SELECT {keys} FROM {name} GROUP BY {keys} HAVING count(*) > 1)"])


@query(contract_sql("daily_agg", {
    "histogram": "n = n1 + n2 + n3 + n4 + n5", "negative": "n_neg = n1 + n2", "sum": "abs(sum_rating - (n1 + 2 * n2 + 3 * n3 + 4 * n4 + 5 * n5)) <= 1e-6", "sumsq": "abs(sumsq_rating - (n1 + 4 * n2 + 9 * n3 + 16 * n4 + 25 * n5)) <= 1e-6",
    "verified": "n_verified <= n", "all": "n <= n_all", "verified_all": "n_verified_all <= n_all", "not_negative": "least(n1, n2, n3, n4, n5, n, n_neg) >= 0",
}))
def contract_daily_agg(s, d):
    return contracts.violations("daily_agg", table(s, d, "daily_agg"))


@query(contract_sql("clean_reviews", {"date_of_ts": "date = CAST(ts AS DATE)", "rating_range": "rating BETWEEN 1 AND 5"}))
def contract_reviews(s, d):
    return contracts.violations("clean_reviews", table(s, d, "clean_reviews"))


# ---- features

VOLUME = f"""{PANEL}, r AS (SELECT sku, category, date, n, row_number() OVER o AS i, sum(n) OVER w AS wn, sum(n_neg) OVER w AS wneg, sum(n1) OVER w AS w1, sum(n3) OVER w AS w3, sum(n5) OVER w AS w5,
  sum(sum_rating) OVER w AS ws, sum(sumsq_rating) OVER w AS wq FROM p WINDOW o AS (PARTITION BY sku, category ORDER BY date), w AS (PARTITION BY sku, category ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
v AS (SELECT *, CASE WHEN i >= 14 THEN lag(wn, 7) OVER (PARTITION BY sku, category ORDER BY date) END AS before FROM r),
f AS (SELECT sku, category, strftime(date, '%Y-%m-%d') AS window_end, CAST(wn AS BIGINT) AS n_window, round(ln(1 + n), 6) AS log1p_daily_count, round((wn - before) / (before + 1.0), 6) AS growth_rate,
  round((wneg + 0.5 * w3 + 2) / (wn + 20), 6) AS neg_ratio_shrunk, round((wneg + 2.0) / (wn + 20), 6) AS low_star_ratio_shrunk,
  CASE WHEN wn >= 2 THEN round(wq / wn - (ws / wn) * (ws / wn), 6) END AS rating_rolling_variance, CASE WHEN wn > 0 THEN round((w1 + w5) / wn, 6) END AS extreme_share,
  CASE WHEN wn > 0 THEN round(w1 / wn, 6) END AS share_1star, CASE WHEN wn > 0 THEN round(w5 / wn, 6) END AS share_5star FROM v WHERE i >= 7)"""
_VR = ["log1p_daily_count", "growth_rate", "neg_ratio_shrunk"], ["low_star_ratio_shrunk", "rating_rolling_variance", "extreme_share", "share_1star", "share_5star"]


def _wide(s, d, names):
    w = features.volume_rating_wide(_panel(s, d))
    # a sum of -0.0 stays apart from 0.0 in some comparisons, so zero is added
    return w.select("sku", "category", _day("window_end"), F.col("n_window").cast("bigint").alias("n_window"), *[(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names])


@query(f"WITH {VOLUME} SELECT sku, category, window_end, n_window, {', '.join(_VR[0])} FROM f")
def feat_volume(s, d):
    return _wide(s, d, _VR[0])


@query(f"WITH {VOLUME} SELECT sku, category, window_end, n_window, low_star_ratio_shrunk, rating_rolling_variance + 0.0 AS rating_rolling_variance, extreme_share, share_1star, share_5star FROM f")
def feat_rating(s, d):
    return _wide(s, d, _VR[1])


@query(f"""WITH {VOLUME}, l AS (UNPIVOT f ON {', '.join(_VR[0] + _VR[1])} INTO NAME feature VALUE x) SELECT feature, count(*) AS points, round(sum(x), 2) AS total FROM l GROUP BY feature""")
def feat_long(s, d):
    w = _wide(s, d, _VR[0] + _VR[1]).withColumn("window_end", F.to_date("window_end"))
    return features.to_long(w, _VR[0] + _VR[1]).where("raw_value is not null").groupBy("feature").agg(F.count("*").alias("points"), F.round(F.sum("raw_value"), 2).alias("total"))


_COUNT = lambda words: f"len(regexp_extract_all(lower(text_norm), '\\b(?:{'|'.join(words)})\\b'))"
MISMATCH = f"""{C}, q AS (SELECT *, {_COUNT(lexicon.POSITIVE)} AS pos, {_COUNT(lexicon.NEGATIVE)} AS neg FROM clean),
m AS (SELECT review_id, sku, category, date, rating, CASE WHEN length(trim(text_norm)) > 0 THEN CASE WHEN rating >= 4 AND neg / (pos + neg + 0.25) >= 0.8 OR rating <= 2 AND pos / (pos + neg + 0.25) >= 0.8 THEN 1 ELSE 0 END END AS mismatch,
  CASE WHEN length(trim(text_norm)) > 0 THEN round((pos - neg) / (pos + neg + 0.25), 6) END AS score FROM q)"""


@query(f"WITH {MISMATCH} SELECT review_id, CAST(mismatch AS DOUBLE) AS mismatch, score FROM m")
def mismatch_flag(s, d):
    sc = lexicon.sentiment(F.col("text_norm"))
    return _reviews(s, d).select("review_id", lexicon.mismatch(F.col("rating"), sc["p_pos"], sc["p_neg"]).cast("double").alias("mismatch"), F.round(sc["score"], 6).alias("score"))


@query(f"""WITH {PANEL}, {MISMATCH}, t AS (SELECT sku, category, date, avg(mismatch) AS rate, count(mismatch) AS k FROM m WHERE mismatch IS NOT NULL GROUP BY sku, category, date)
SELECT p.sku, strftime(p.date, '%Y-%m-%d') AS window_end, round(t.rate, 6) AS mismatch_rate, coalesce(t.k, 0) AS support, CASE WHEN n_all > 0 THEN round(n_verified_all / n_all, 6) END AS verified_ratio_all
FROM p LEFT JOIN t ON p.sku = t.sku AND p.category = t.category AND p.date = t.date""")
def feat_reliability(s, d):
    sc = lexicon.sentiment(F.col("text_norm"))
    r = _reviews(s, d).withColumn("mismatch", lexicon.mismatch(F.col("rating"), sc["p_pos"], sc["p_neg"]))
    long = features.reliability(_panel(s, d), r)
    g = long.groupBy("sku", "window_end").agg(*[F.max(F.when(F.col("feature") == f, F.round(v, 6))).alias(a) for f, v, a in (("mismatch_rate", "raw_value", "mismatch_rate"), ("verified_ratio_all", "raw_value", "verified_ratio_all"))], F.max(F.when(F.col("feature") == "mismatch_rate", F.col("n_window"))).cast("bigint").alias("support"))
    return g.select("sku", _day("window_end"), "mismatch_rate", "support", "verified_ratio_all")


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS) + "]"
TERMS = f"""{C}, w AS (SELECT review_id, sku, date, coalesce(user_id, '') AS u, list_filter(regexp_extract_all(lower(text_norm), '[a-z0-9]+(?:''[a-z]+)?'), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)) AS ws FROM clean WHERE text_norm IS NOT NULL),
t AS (SELECT review_id, sku, date, u, unnest(ws) AS term FROM w UNION ALL SELECT review_id, sku, date, u, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM w WHERE len(ws) >= 2)"""


@query(f"WITH {TERMS} SELECT term, count(*) AS occurrences, count(DISTINCT sku) AS skus FROM t GROUP BY term")
def ngram_counts(s, d):
    t = _reviews(s, d).select("sku", F.explode(text.ngrams(F.col("text_norm"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("occurrences"), F.count_distinct("sku").alias("skus"))


@query(f"""WITH {TERMS}, e AS (SELECT min(date) AS lo, max(date) AS hi FROM clean),
x AS (SELECT sku, term, u, CAST(date + INTERVAL (k) DAY AS DATE) AS we, k < 7 AS now FROM t, (SELECT unnest(range(0, 14)) AS k)),
g AS (SELECT sku, we, term, count(*) FILTER (now) AS c, count(*) FILTER (NOT now) AS p, count(DISTINCT u) FILTER (now) AS us FROM x GROUP BY sku, we, term),
b AS (SELECT sku, we, max((c - p) / sqrt(p + 1.0)) AS top FROM g WHERE c >= 5 AND us >= 3 GROUP BY sku, we),
w2 AS (SELECT DISTINCT sku, CAST(date + INTERVAL (k) DAY AS DATE) AS we FROM (SELECT DISTINCT sku, date FROM clean), (SELECT unnest(range(0, 7)) AS k)),
w3 AS (SELECT sku, we FROM w2, e WHERE we >= lo + 6 AND we <= hi)
SELECT w3.sku, strftime(w3.we, '%Y-%m-%d') AS window_end, round(greatest(coalesce(b.top, 0), 0), 6) AS term_burst_score FROM w3 LEFT JOIN b ON w3.sku = b.sku AND w3.we = b.we""")
def term_burst(s, d):
    return features.term_burst(_reviews(s, d)).select("sku", _day("window_end"), F.round("term_burst_score", 6).alias("term_burst_score"))


@query()
def risk_windows(s, d):
    r = _reviews(s, d).withColumn("risk_hit", F.size(lexicon.risk_terms_of("text_norm")) > 0)
    return features.risk_windows(r).withColumn("window_end", _day("window_end"))


@query()
def aspect_windows(s, d):
    return features.aspect_windows(features.scored(_reviews(s, d))).withColumn("window_end", _day("window_end"))


@query("""WITH p AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 4))
SELECT e.vec_id, round(max(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))), 5) AS best FROM embeddings e, p GROUP BY e.vec_id""")
def embedding_max_cosine(s, d):
    e = table(s, d, "embeddings")
    first = [r["embedding"] for r in e.orderBy("vec_id").limit(4).collect()]
    return e.select("vec_id", F.round(features.best_cosine(e, first), 5).alias("best"))


# ---- detection

FEATS = """fs AS (SELECT sku, category, indicator_id, feature, window_end, max(CASE WHEN isnan(raw_value) OR isinf(raw_value) THEN NULL ELSE raw_value END) AS x, max(n_window) AS n_window FROM feature_series GROUP BY ALL)"""


def zsql(name: str, where: str, floor: float, industry: bool = True, dense: bool = True, rows: str = "SELECT * FROM fs WHERE") -> str:
    """CTEs ending in ``name`` (sku, category, feature, window_end, x, n_window, z)."""
    n = name
    rows = f"{n}_f AS ({rows} {where})"
    if dense:
        rows += f""", {n}_b AS (SELECT sku, category, feature, min(window_end) AS lo, max(window_end) AS hi FROM {n}_f GROUP BY ALL),
{n}_g AS (SELECT sku, category, feature, lo, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS window_end FROM {n}_b),
{n}_d AS (SELECT g.sku, g.category, g.feature, g.lo, g.window_end, f.x, coalesce(f.n_window, 0) AS n_window FROM {n}_g g LEFT JOIN {n}_f f ON g.sku = f.sku AND g.category = f.category AND g.feature = f.feature AND g.window_end = f.window_end)"""
    else:
        rows += f", {n}_d AS (SELECT sku, category, feature, min(window_end) OVER (PARTITION BY sku, feature) AS lo, window_end, x, n_window FROM {n}_f)"
    rows += f""", {n}_w AS (SELECT *, median(x) OVER w AS med, greatest(mad(x) OVER w * 1.4826, {floor}) AS sc, count(x) OVER w AS k, row_number() OVER (PARTITION BY sku, category, feature ORDER BY window_end) AS i FROM {n}_d
  WINDOW w AS (PARTITION BY sku, category, feature ORDER BY window_end ROWS BETWEEN 96 PRECEDING AND 7 PRECEDING))"""
    if industry:
        return rows + f""", {n}_i AS (SELECT category, feature, median(x) AS im, greatest(mad(x) * 1.4826, {floor}) AS isc FROM {n}_d WHERE datediff('day', lo, window_end) < 60 AND x IS NOT NULL GROUP BY category, feature HAVING count(x) >= 14),
{n}_j AS (SELECT w.*, im, isc FROM {n}_w w LEFT JOIN {n}_i i ON w.category = i.category AND w.feature = i.feature),
{n} AS (SELECT sku, category, feature, window_end, x, n_window, CASE WHEN i <= 7 THEN NULL WHEN k >= 14 AND im IS NOT NULL THEN (x - (k / (k + 30.0) * med + (1 - k / (k + 30.0)) * im)) / (k / (k + 30.0) * sc + (1 - k / (k + 30.0)) * isc)
  WHEN k >= 14 THEN (x - med) / sc WHEN im IS NOT NULL THEN (x - im) / isc END AS z FROM {n}_j)"""
    return rows + f", {n} AS (SELECT sku, category, feature, window_end, x, n_window, CASE WHEN i > 7 AND k >= 14 THEN (x - med) / sc END AS z FROM {n}_w)"


def msql(name: str, source_name: str, rule: detect.Rule, value: str = "z") -> str:
    """CTEs ending in ``name`` (sku, category, feature, window_end, fired, strength)."""
    v = {"up": value, "down": f"-{value}", "both": f"abs({value})"}[rule.direction]
    return f"""{name}_o AS (SELECT *, {v} AS v FROM {source_name}),
{name}_r AS (SELECT *, sum(CASE WHEN v > {rule.k} THEN 1 ELSE 0 END) OVER w AS hits, count(v) OVER w AS valid, max(v) OVER w AS peak FROM {name}_o WINDOW w AS (PARTITION BY sku, category, feature ORDER BY window_end ROWS BETWEEN {rule.n - 1} PRECEDING AND CURRENT ROW)),
{name} AS (SELECT *, hits >= {rule.m} AND valid >= {rule.min_valid or rule.m} AS fired, CASE WHEN hits >= {rule.m} AND valid >= {rule.min_valid or rule.m} THEN greatest(0, least(1, (peak - {rule.k}) / {rule.k})) ELSE 0 END AS strength FROM {name}_r)"""


def _simple(i: str) -> str:
    rule, floor, name = detect.RULES[i]
    return f"{zsql('z' + i, chr(39).join(['feature = ', name, '']), floor)}, {msql('m' + i, 'z' + i, rule)}, {i} AS (SELECT sku, category, window_end, fired, strength FROM m{i})"


INDICATOR_SQL = {i: _simple(i) for i in ("I2", "I4", "I7", "I10")}
INDICATOR_SQL["I6"] = f"""p6 AS (SELECT sku, category, window_end, 'i6' AS feature, max(x) FILTER (feature = 'share_1star') AS s1, max(x) FILTER (feature = 'share_5star') AS s5, max(n_window) AS n FROM fs WHERE feature IN ('share_1star', 'share_5star') GROUP BY sku, category, window_end),
h6 AS (SELECT *, CASE WHEN s1 IS NOT NULL AND s5 IS NOT NULL THEN CASE WHEN s1 >= 0.15 AND s5 >= 0.15 AND n >= 20 THEN 1.0 ELSE 0.0 END END AS hit FROM p6), {msql('m6', 'h6', detect.Rule(0.5, 3, 5, min_valid=1), 'hit')},
I6 AS (SELECT sku, category, window_end, fired, CASE WHEN fired THEN least(1, coalesce(CASE WHEN hit IS NOT NULL THEN least(s1, s5) END, 0) / 0.3) ELSE 0 END AS strength FROM m6)"""
INDICATOR_SQL["I8"] = """p8 AS (SELECT sku, category, window_end, least(coalesce(max(x) FILTER (feature = 'risk_hits'), 0), coalesce(max(x) FILTER (feature = 'risk_distinct_users'), 0)) AS low FROM fs WHERE feature IN ('risk_hits', 'risk_distinct_users') GROUP BY sku, category, window_end),
I8 AS (SELECT sku, category, window_end, low >= 2 AS fired, CASE WHEN low >= 3 THEN 1.0 WHEN low >= 2 THEN 0.5 ELSE 0.0 END AS strength FROM p8)"""
INDICATOR_SQL["I9"] = f"""{zsql('z9', "indicator_id = 'I9'", 0.05, False, False)}, y9 AS (SELECT * EXCLUDE (z), CASE WHEN n_window >= 5 THEN z END AS z FROM z9), {msql('m9', 'y9', detect.RULES['I9'][0])},
I9 AS (SELECT sku, category, window_end, bool_or(fired) AS fired, max(strength) AS strength FROM m9 GROUP BY sku, category, window_end)"""
_VOLUME_OF_SHARE = """SELECT y.sku, y.category, y.indicator_id, 'volume' AS feature, y.window_end, v.x, y.n_window FROM fs y LEFT JOIN (SELECT * FROM fs WHERE feature = 'log1p_daily_count') v
  ON y.sku = v.sku AND y.category = v.category AND y.window_end = v.window_end WHERE"""
INDICATOR_SQL["I11"] = f"""{zsql('z11', "feature = 'verified_ratio_all'", 0.02, False, False)}, {zsql('v11', "y.feature = 'verified_ratio_all'", 0.05, False, False, _VOLUME_OF_SHARE)},
y11 AS (SELECT z11.* EXCLUDE (z), CASE WHEN v11.z > 2.5 THEN z11.z END AS z FROM z11 LEFT JOIN v11 ON z11.sku = v11.sku AND z11.category = v11.category AND z11.window_end = v11.window_end), {msql('m11', 'y11', detect.RULES['I11'][0])},
I11 AS (SELECT sku, category, window_end, fired, strength FROM m11)"""
MATRIX = FEATS + ", " + ", ".join(INDICATOR_SQL[i] for i in PLAIN) + ", mx AS (" + " UNION ALL ".join(f"SELECT sku, category, window_end, '{i}' AS indicator_id, fired AS triggered, CAST(strength AS DOUBLE) AS strength FROM {i}" for i in PLAIN) + ")"


def _shown(m: DataFrame) -> DataFrame:
    return m.select("sku", "category", _day("window_end"), "indicator_id", F.col("triggered").cast("int").alias("triggered"), F.round("strength", 6).alias("strength"))


def _indicator(i: str):
    def run(s, d):
        return _shown(detect.INDICATORS[i](_features(s, d)))

    run.__name__ = f"ind_{i.lower()}"
    sql = f"WITH {FEATS}, {INDICATOR_SQL[i]} SELECT sku, category, strftime(window_end, '%Y-%m-%d') AS window_end, '{i}' AS indicator_id, CAST(fired AS INTEGER) AS triggered, round(CAST(strength AS DOUBLE), 6) AS strength FROM {i}" if i in INDICATOR_SQL else None
    return query(sql)(run)


for _i in detect.INDICATORS:
    _indicator(_i)


@query(f"""WITH {FEATS}, b AS (SELECT *, min(window_end) OVER (PARTITION BY sku, feature) AS lo FROM fs)
SELECT category, feature, round(median(x), 6) AS i_median, round(greatest(mad(x) * 1.4826, 0.05), 6) AS i_scale, count(x) AS i_n FROM b WHERE datediff('day', lo, window_end) < 60 AND x IS NOT NULL GROUP BY category, feature HAVING count(x) >= 14""")
def industry_baseline(s, d):
    b = detect.industry_baseline(_features(s, d), F.lit(0.05))
    return b.select("category", "feature", F.round("i_median", 6).alias("i_median"), F.round("i_scale", 6).alias("i_scale"), "i_n")


@query(f"WITH {FEATS}, {zsql('zz', 'true', 0.05)} SELECT sku, feature, strftime(window_end, '%Y-%m-%d') AS window_end, round(z, 5) AS z FROM zz")
def robust_z(s, d):
    return detect.zscores(_features(s, d), 0.05).select("sku", "feature", _day("window_end"), F.round("z", 5).alias("z"))


@query(f"WITH {FEATS}, {zsql('zz', 'true', 0.05)}, {msql('mm', 'zz', detect.Rule(2.0, 2, 4, 'both'))} SELECT sku, feature, strftime(window_end, '%Y-%m-%d') AS window_end, CAST(fired AS INTEGER) AS triggered, round(CAST(strength AS DOUBLE), 5) AS strength FROM mm")
def m_of_n(s, d):
    m = detect.m_of_n(detect.zscores(_features(s, d), 0.05), detect.Rule(2.0, 2, 4, "both"))
    return m.select("sku", "feature", _day("window_end"), F.col("triggered").cast("int").alias("triggered"), F.round("strength", 5).alias("strength"))


@query()
def indicator_matrix(s, d):
    return _shown(detect.indicator_matrix(_features(s, d)))


# ---- scoring

_POINTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in score.POINTS.items())
_GROUP = " ".join(f"WHEN '{i}' THEN '{g}'" for g, ids in score.GROUPS.items() for i in ids)
SCORES = f"""{MATRIX}, sc AS (SELECT sku, category, window_end, coalesce(sum(CASE indicator_id {_POINTS} ELSE 0 END) FILTER (triggered), 0) / {float(score.TOTAL)} AS score,
  coalesce(list_sort(list(DISTINCT CASE indicator_id {_GROUP} END) FILTER (triggered AND indicator_id NOT IN ('I10', 'I11'))), []) AS groups_active,
  coalesce(list_sort(list(CAST(substr(indicator_id, 2) AS INTEGER)) FILTER (triggered)), []) AS nums, coalesce(bool_or(triggered AND indicator_id = 'I8' AND strength >= 1), false) AS severe, bool_or(triggered AND indicator_id IN ('I10', 'I11')) AS verify_flag
  FROM mx GROUP BY sku, category, window_end)"""


@whole(f"WITH {SCORES} SELECT sku, strftime(window_end, '%Y-%m-%d') AS window_end, round(score, 6) AS score, array_to_string(groups_active, ',') AS groups_active, array_to_string(nums, ',') AS ids, CAST(severe AS INTEGER) AS severe, CAST(verify_flag AS INTEGER) AS verify_flag FROM sc")
def risk_score(s, d, only):
    r = score.scores(_matrix(s, d, only))
    return r.select("sku", _day("window_end"), F.round("score", 6).alias("score"), F.array_join("groups_active", ",").alias("groups_active"), F.replace(F.array_join("triggered_ids", ","), F.lit("I"), F.lit("")).alias("ids"), F.col("severe").cast("int").alias("severe"), F.col("verify_flag").cast("int").alias("verify_flag"))


PERSIST = f"""{SCORES}, pr AS (SELECT *, sum(CASE WHEN score < {ALERT_TAU[0]} THEN 1 ELSE 0 END) OVER (PARTITION BY sku, category ORDER BY window_end) AS run FROM sc),
ps AS (SELECT *, least(sum(CASE WHEN score >= {ALERT_TAU[0]} THEN 1 ELSE 0 END) OVER (PARTITION BY sku, category, run ORDER BY window_end), 127) AS persist FROM pr),
lv AS (SELECT *, CASE WHEN score >= {ALERT_TAU[1]} AND (len(groups_active) >= 3 OR severe) THEN 2 WHEN score >= {ALERT_TAU[0]} AND (persist >= 2 OR len(groups_active) >= 2) THEN 1 ELSE 0 END AS raw,
  row_number() OVER (PARTITION BY sku, category ORDER BY window_end) AS i FROM ps)"""


@whole(f"WITH {PERSIST} SELECT sku, strftime(window_end, '%Y-%m-%d') AS window_end, CAST(persist AS INTEGER) AS persist, raw FROM lv")
def persistence(s, d, only):
    p = score.with_persistence(score.scores(_matrix(s, d, only)), ALERT_TAU[0])
    return p.select("sku", _day("window_end"), "persist", score.level_of(F.col("score"), F.col("persist"), F.col("groups_active"), F.col("severe"), *ALERT_TAU).alias("raw"))


def hysteresis_sql(ctes: str, end: str) -> str:
    return f"""WITH RECURSIVE {ctes}, hy AS (
SELECT sku, category, window_end, i, raw AS cur, -1 AS want, 0 AS seen FROM lv WHERE i = 1
UNION ALL SELECT l.sku, l.category, l.window_end, l.i, CASE WHEN l.raw >= h.cur OR (CASE WHEN h.want = l.raw THEN h.seen + 1 ELSE 1 END) >= 3 THEN l.raw ELSE h.cur END,
  CASE WHEN l.raw >= h.cur OR (CASE WHEN h.want = l.raw THEN h.seen + 1 ELSE 1 END) >= 3 THEN -1 ELSE l.raw END,
  CASE WHEN l.raw >= h.cur OR (CASE WHEN h.want = l.raw THEN h.seen + 1 ELSE 1 END) >= 3 THEN 0 WHEN h.want = l.raw THEN h.seen + 1 ELSE 1 END
  FROM hy h JOIN lv l ON l.sku = h.sku AND l.category = h.category AND l.i = h.i + 1),
al AS (SELECT l.sku, l.category, l.window_end, l.score, CASE h.cur WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS level, l.groups_active, l.persist, l.verify_flag, l.nums FROM lv l JOIN hy h ON l.sku = h.sku AND l.category = h.category AND l.i = h.i WHERE h.cur > 0) {end}"""


@whole(hysteresis_sql(PERSIST, "SELECT sku, strftime(window_end, '%Y-%m-%d') AS window_end, round(score, 6) AS score, level, array_to_string(groups_active, ',') AS groups_active, CAST(persist AS INTEGER) AS persist, CAST(verify_flag AS INTEGER) AS verify_flag, array_to_string(nums, ',') AS ids FROM al"))
def alerts(s, d, only):
    a = score.alerts(_matrix(s, d, only), ALERT_TAU)
    return a.select("sku", _day("window_end"), F.round("score", 6).alias("score"), "level", F.array_join("groups_active", ",").alias("groups_active"), "persist", F.col("verify_flag").cast("int").alias("verify_flag"), F.replace(F.array_join("triggered_ids", ","), F.lit("I"), F.lit("")).alias("ids"))


@whole(f"""WITH {SCORES} SELECT category, CASE WHEN count(*) < 200 THEN 0.2 ELSE round(greatest(quantile_cont(score, 0.9), 0.15), 6) END AS tau1, CASE WHEN count(*) < 200 THEN 0.4 ELSE round(greatest(quantile_cont(score, 0.97), 0.35), 6) END AS tau2, count(*) AS n FROM sc GROUP BY category""")
def tau_percentiles(s, d, only):
    return score.calibrate(score.scores(_matrix(s, d, only))).select("category", F.round("tau1", 6).alias("tau1"), F.round("tau2", 6).alias("tau2"), "n")


# ---- evaluation

LABELS = """sk AS (SELECT DISTINCT sku FROM clean_reviews), lb AS (SELECT sk.sku, l.category, l.recall_id, l.recall_date FROM (SELECT DISTINCT * FROM recall_labels) l JOIN sk ON upper(trim(l.sku)) = upper(trim(sk.sku)))"""


@query(f"WITH {LABELS} SELECT sku, recall_id, strftime(recall_date, '%Y-%m-%d') AS recall_date FROM lb")
def recall_match(s, d):
    return _labels(s, d).select("sku", "recall_id", _day("recall_date"))


MATCHED = """mt AS (SELECT lb.sku, lb.category, lb.recall_id, lb.recall_date, min(al.window_end) AS first_alert, count(al.window_end) AS k FROM lb LEFT JOIN al ON lb.sku = al.sku AND lb.category = al.category AND al.window_end BETWEEN lb.recall_date - 90 AND lb.recall_date GROUP BY ALL)"""


@whole(hysteresis_sql(f"{PERSIST}, {LABELS}", f", {MATCHED} SELECT sku, recall_id, strftime(recall_date, '%Y-%m-%d') AS recall_date, CAST(k > 0 AS INTEGER) AS detected, strftime(first_alert, '%Y-%m-%d') AS first_alert, k AS alert_count, CAST(datediff('day', first_alert, recall_date) AS DOUBLE) AS lead_time_days FROM mt"))
def alerts_vs_recalls(s, d, only):
    return evaluate.match_alerts(_alerts(s, d, only), _labels(s, d)).withColumn("lead_time_days", F.col("lead_time_days").cast("double"))


@whole(hysteresis_sql(f"{PERSIST}, {LABELS}", f""", {MATCHED} SELECT count(*) AS events, count(*) FILTER (k > 0) AS detected, count(*) FILTER (k = 0) AS missed, round(count(*) FILTER (k > 0) / count(*), 6) AS recall,
round(avg(datediff('day', first_alert, recall_date)), 6) AS mean_lead, CAST(median(datediff('day', first_alert, recall_date)) AS DOUBLE) AS median_lead, CAST(sum(k) AS BIGINT) AS alerts FROM mt"""))
def eval_summary(s, d, only):
    r = evaluate.summary(evaluate.match_alerts(_alerts(s, d, only), _labels(s, d)))
    return r.withColumn("recall", F.round("recall", 6)).withColumn("mean_lead", F.round("mean_lead", 6))


@whole(hysteresis_sql(f"{PERSIST}, {LABELS}", """, po AS (SELECT unnest(['medium_or_high', 'high_only', 'rating', 'volume', 'keyword']) AS policy),
ev AS (SELECT po.policy, lb.sku, lb.recall_id, count(al.window_end) AS k FROM po CROSS JOIN lb LEFT JOIN al ON lb.sku = al.sku AND lb.category = al.category AND al.window_end BETWEEN lb.recall_date - 90 AND lb.recall_date
  AND CASE po.policy WHEN 'medium_or_high' THEN true WHEN 'high_only' THEN al.level = 'HIGH' WHEN 'rating' THEN list_has_any(al.nums, [3, 4, 5, 6]) WHEN 'volume' THEN list_has_any(al.nums, [1, 2]) ELSE list_has_any(al.nums, [7, 8]) END GROUP BY ALL)
SELECT policy, count(*) AS events, count(*) FILTER (k > 0) AS detected, round(count(*) FILTER (k > 0) / count(*), 6) AS recall, CAST(sum(k) AS BIGINT) AS alerts FROM ev GROUP BY policy"""))
def policy_baselines(s, d, only):
    return evaluate.policy_summary(_alerts(s, d, only), _labels(s, d)).withColumn("recall", F.round("recall", 6))


@query()
def ablation(s, d):
    return evaluate.ablation(_alerts(s, d), ALERT_TAU)


@query()
def tau_sensitivity(s, d):
    return evaluate.tau_sensitivity(_alerts(s, d))


@query(f"""WITH {FEATS}, dy AS (SELECT category, indicator_id, feature, window_end, median(x) AS v, median(n_window) FILTER (x IS NOT NULL) AS k FROM fs WHERE x IS NOT NULL GROUP BY ALL)
SELECT category, indicator_id, feature, round(median(v), 6) AS value, round(median(k), 6) AS support FROM dy GROUP BY ALL""")
def synthetic_template(s, d):
    t = evaluate.median_template(_features(s, d))
    return t.select("category", "indicator_id", "feature", F.round("value", 6).alias("value"), F.round("support", 6).alias("support"))


@query()
def synthetic_alerts(s, d):
    """Crises injected into median products, and which indicators fire on them."""
    m = _crises(s, d)
    return m.groupBy("category", "sku", "indicator_id").agg(F.count("*").alias("windows"), F.count_if("triggered").alias("fired"))


_GRID = [(k, m, n) for k in (1.875, 2.5, 3.125) for m, n in ((1, 3), (2, 3), (3, 5))]


@query(f"WITH {FEATS}, {zsql('zz', chr(39).join(['feature = ', 'low_star_ratio_shrunk', '']), 0.05)}, c AS (SELECT * FROM (VALUES {', '.join(str(g) for g in _GRID)}) t(k, m, n)), "
       "x AS (SELECT c.k, c.m, c.n, zz.sku, zz.window_end, list(zz.z) OVER (PARTITION BY c.k, c.m, c.n, zz.sku, zz.category ORDER BY zz.window_end ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l FROM zz, c), "
       "u AS (SELECT k, m, n, sku, window_end, unnest(l[greatest(1, len(l) - n + 1):]) AS v FROM x), y AS (SELECT k, m, n, sku, window_end, count(*) FILTER (v > k) AS hits, count(v) AS valid FROM u GROUP BY ALL) "
       "SELECT CAST(k AS DOUBLE) AS k, m, n, count(*) AS \"rows\", count(*) FILTER (hits >= m AND valid >= m) AS fired FROM y GROUP BY k, m, n")  # fmt: skip
def trigger_sweep(s, d):
    z = detect.zscores(_features(s, d).where("feature = 'low_star_ratio_shrunk'"), 0.05)
    return evaluate.sweep(z, (1.875, 2.5, 3.125), ((1, 3), (2, 3), (3, 5)))


@query(f"""WITH {MISMATCH}, x AS (SELECT rating <= 2 AS e, coalesce(score < 0, false) AS p FROM m), c AS (SELECT count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn FROM x)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def confusion_matrix(s, d):
    r = _reviews(s, d).select((F.col("rating") <= 2).alias("e"), (lexicon.sentiment(F.col("text_norm"))["score"] < 0).alias("p"))
    c = evaluate.confusion(r, "e", "p")
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


# ---- serving


@query()
def evidence_topk(s, d):
    r = _reviews(s, d).withColumn("risk_hit", F.size(lexicon.risk_terms_of("text_norm")) > 0)
    return serve.evidence(_alerts(s, d), r)


@query()
def pii_mask(s, d):
    return _reviews(s, d).select("review_id", text.mask(F.col("text_raw")).alias("masked"), text.short_key(F.col("text_raw")).alias("opening"))


@whole(hysteresis_sql(PERSIST, "SELECT sku, strftime(window_end, '%Y-%m-%d') AS window_end, CASE WHEN verify_flag THEN 'Victim' WHEN list_contains(nums, 8) THEN 'Preventable' ELSE 'Accidental' END AS cluster, CASE WHEN verify_flag THEN 0.75 WHEN list_contains(nums, 8) THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM al WHERE level = 'HIGH'"))
def rule_explanation(s, d, only):
    return serve.explanation(_alerts(s, d, only))


@whole(hysteresis_sql(PERSIST, ", ll AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY window_end DESC) AS r FROM al) SELECT sku, strftime(window_end, '%Y-%m-%d') AS window_end, level, round(score, 6) AS score FROM ll WHERE r = 1"))
def latest_alert(s, d, only):
    return serve.latest(_alerts(s, d, only)).select("sku", _day("window_end"), "level", F.round("score", 6).alias("score"))


_SINCE = """a1 AS (SELECT sku, window_end, level, CASE WHEN lag(level) OVER w = level AND datediff('day', lag(window_end) OVER w, window_end) = 1 THEN 0 ELSE 1 END AS o FROM al WINDOW w AS (PARTITION BY sku ORDER BY window_end)),
a2 AS (SELECT *, sum(o) OVER (PARTITION BY sku ORDER BY window_end) AS run FROM a1), a3 AS (SELECT sku, run, any_value(level) AS level, min(window_end) AS since, count(*) AS windows, row_number() OVER (PARTITION BY sku ORDER BY run DESC) AS r FROM a2 GROUP BY sku, run)"""


@whole(hysteresis_sql(PERSIST, f", {_SINCE} SELECT sku, level, strftime(since, '%Y-%m-%d') AS since, windows FROM a3 WHERE r = 1"))
def level_since(s, d, only):
    return serve.level_since(_alerts(s, d, only))


@whole(hysteresis_sql(PERSIST, """, e AS (SELECT max(window_end) AS hi FROM al), n1 AS (SELECT sku, window_end, level, lag(level) OVER (PARTITION BY sku ORDER BY window_end) AS before, level = 'HIGH' AND window_end > hi - 7 AS recent FROM al, e),
n2 AS (SELECT sku, arg_max(level, window_end) AS now, arg_min(coalesce(before, ''), window_end) FILTER (recent) AS b, count(*) FILTER (recent) AS k FROM n1 GROUP BY sku) SELECT sku FROM n2 WHERE now = 'HIGH' AND k > 0 AND b <> 'HIGH'"""))
def new_high_7d(s, d, only):
    return serve.new_high(_alerts(s, d, only))


@whole(hysteresis_sql(PERSIST, f""", {_SINCE}, ll AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY window_end DESC) AS r FROM al)
SELECT ll.sku, ll.level, round(ll.score, 6) AS score, CAST(list_contains(nums, 8) AS INTEGER) AS has_i8, strftime(a3.since, '%Y-%m-%d') AS since, a3.windows FROM ll JOIN a3 ON ll.sku = a3.sku WHERE ll.r = 1 AND a3.r = 1
ORDER BY ll.level = 'HIGH' DESC, ll.score DESC, has_i8 DESC, ll.sku LIMIT 50"""))
def priority_table(s, d, only):
    return serve.priority_table(_alerts(s, d, only)).withColumn("score", F.round("score", 6))


@query(f"""WITH {C}, e AS (SELECT max(date) AS hi FROM clean), r AS (SELECT sku, rating, CASE WHEN rating <= 2 THEN 1.0 ELSE 0.0 END AS low, datediff('day', date, hi) AS ago FROM clean, e WHERE datediff('day', date, hi) < 14)
SELECT sku, count(*) FILTER (ago < 7) AS reviews, count(*) FILTER (ago >= 7) AS reviews_before, round(avg(rating) FILTER (ago < 7), 6) AS avg_rating, round(avg(low) FILTER (ago < 7), 6) AS low_share, round(avg(low) FILTER (ago < 7) - avg(low) FILTER (ago >= 7), 6) AS low_share_change FROM r GROUP BY sku""")
def overview_7v14(s, d):
    o = serve.overview(_reviews(s, d))
    return o.select("sku", "reviews", "reviews_before", *[F.round(c, 6).alias(c) for c in ("avg_rating", "low_share", "low_share_change")])


@whole(hysteresis_sql(PERSIST, "SELECT strftime(window_end, '%Y-%m-%d') AS day, level, count(DISTINCT sku) AS skus FROM al GROUP BY ALL"))
def level_trend(s, d, only):
    return serve.level_trend(_alerts(s, d, only))


@whole(hysteresis_sql(PERSIST, "SELECT category, level, count(*) AS n_alerts, count(DISTINCT sku) AS skus FROM al GROUP BY ROLLUP (category, level)"))
def rollup_alerts(s, d, only):
    return serve.level_rollup(_alerts(s, d, only))


@whole(f"WITH {MATRIX} SELECT sku, strftime(window_end, '%Y-%m-%d') AS window_end, indicator_id, CAST(triggered AS INTEGER) AS triggered, round(strength, 6) AS strength, round(CASE WHEN triggered THEN CASE indicator_id {_POINTS} ELSE 0 END / 21.0 ELSE 0.0 END, 6) AS contribution FROM mx")
def indicator_breakdown(s, d, only):
    b = serve.breakdown(_matrix(s, d, only))
    return b.withColumn("strength", F.round("strength", 6)).withColumn("contribution", F.round("contribution", 6))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """The strongest deviations of the shrunk low-star share of a product from its own lagged history."""
    f = features.volume_rating_long(_panel(s, d)).where("feature = 'low_star_ratio_shrunk'")
    z = detect.zscores(f, detect.RULES["I4"][1])
    return z.where("z is not null").orderBy(F.col("z").desc(), "sku", "window_end").limit(20)
