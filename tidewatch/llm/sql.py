"""SQL of those llm queries that SQL can express on whole tables."""

import math

from tidewatch.llm.quantiles import ACCURACY, TINY

_VALUES = """
WITH v AS (SELECT DISTINCT sku, indicator_id, feature, window_end, raw_value AS x FROM feature_series WHERE raw_value IS NOT NULL AND NOT isnan(raw_value)),
r AS (SELECT sku, indicator_id, feature, x, row_number() OVER (PARTITION BY sku, indicator_id, feature ORDER BY x) AS k, count(*) OVER (PARTITION BY sku, indicator_id, feature) AS n FROM v),
q AS (SELECT sku, indicator_id, feature, count(*) AS n,
  min(x) FILTER (WHERE k >= greatest(1, ceil(n * 0.25))) AS p25, min(x) FILTER (WHERE k >= greatest(1, ceil(n * 0.5))) AS p50,
  min(x) FILTER (WHERE k >= greatest(1, ceil(n * 0.75))) AS p75, min(x) FILTER (WHERE k >= greatest(1, ceil(n * 0.95))) AS p95
  FROM r GROUP BY sku, indicator_id, feature)
"""

_STEP = math.log((1 + ACCURACY) / (1 - ACCURACY))
_BUCKETS = f"""
WITH v AS (SELECT DISTINCT sku, indicator_id, feature, window_end, raw_value AS x FROM feature_series WHERE raw_value IS NOT NULL AND NOT isnan(raw_value)),
k AS (SELECT sku, indicator_id, feature, x, CAST(ceil(ln(greatest(least(abs(x), 1.7976931348623157e308), {TINY!r})) / {_STEP!r}) AS BIGINT) - ({math.floor(math.log(TINY) / _STEP) - 1}) + CASE WHEN isinf(x) THEN 1 ELSE 0 END AS k FROM v)
SELECT sku, indicator_id, feature, CASE WHEN abs(x) < {TINY!r} THEN 0 WHEN x < 0 THEN -k ELSE k END AS bucket, count(*) AS count FROM k GROUP BY ALL"""

SQL = {
    "p3_sketch": _BUCKETS,
    "p2_found": """
WITH r AS (SELECT DISTINCT review_id, sku, list_distinct(string_split(text_norm, ' ')) AS w FROM clean_reviews WHERE text_norm IS NOT NULL), e AS (SELECT * FROM r WHERE len(w) >= 30),
p AS (SELECT a.review_id AS review_id_a, b.review_id AS review_id_b, len(a.w) + len(b.w) AS n, len(list_intersect(a.w, b.w)) AS i FROM e a JOIN e b ON a.sku = b.sku AND a.review_id < b.review_id)
SELECT review_id_a, review_id_b FROM p WHERE 10 * i >= 7 * (n - i)""",
    "p3_found": _VALUES + "SELECT sku, indicator_id, feature FROM q WHERE n >= 40 AND p75 > p25 AND p95 - p50 > 8 * (p75 - p25)",
}
