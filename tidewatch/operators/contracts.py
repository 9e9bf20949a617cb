"""Contract checks: types, nulls, ranges, keys and rules across columns; one aggregation and one key count for a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.features import VOCABULARY

KEYS = {
    "clean_reviews": ["review_id"], "daily_agg": ["sku", "date"], "nlp_features": ["review_id"], "feature_series": ["sku", "window_end", "indicator_id", "feature"],
    "indicator_matrix": ["sku", "window_end", "indicator_id"], "alerts": ["sku", "window_end"], "recall_labels": ["sku", "recall_id"],
}
_DDL = {
    "clean_reviews": "review_id string not null, sku string not null, category string not null, user_id string, ts timestamp not null, date date not null, rating tinyint not null, text_raw string, text_norm string, verified_purchase boolean, is_spam boolean not null, spam_reason string",
    "daily_agg": "sku string not null, category string not null, date date not null, n int not null, n_neg int not null, n1 int not null, n2 int not null, n3 int not null, n4 int not null, n5 int not null, sum_rating double not null, sumsq_rating double not null, n_verified int not null, n_all int not null, n_verified_all int not null",
    "nlp_features": "review_id string not null, category string not null, date date not null, sentiment_score float, risk_hit boolean not null, risk_terms array<string>, risk_sim float, aspect string, aspect_sentiment float, mismatch boolean",
    "feature_series": "sku string not null, category string not null, window_end date not null, indicator_id string not null, feature string not null, raw_value double, n_window int not null",
    "indicator_matrix": "sku string not null, category string not null, window_end date not null, indicator_id string not null, triggered boolean not null, strength double",
    "alerts": "sku string not null, category string not null, window_end date not null, score double not null, level string not null, groups_active array<string> not null, persist tinyint not null, verify_flag boolean not null, triggered_ids array<string> not null",
    "recall_labels": "sku string not null, category string not null, recall_id string not null, recall_date date not null, source string not null, source_url string not null, product_name string not null, match_type string not null, match_confidence double not null",
}


def required(table: str) -> list[str]:
    """The columns that must not be null; needs no session."""
    return [c.split()[0] for c in _DDL[table].split(", ") if c.endswith("not null")]


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[table])


def conform(table: str, df: DataFrame) -> DataFrame:
    """The contract's columns in order and type; missing or further columns are an error."""
    s = schema_of(table)
    if set(df.columns) != set(s.names):
        raise ValueError(f"{table}: columns differ: {sorted(set(df.columns) ^ set(s.names))}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in s])


def _finite(c: str) -> Column:
    return F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < float("inf")))


def rules(table: str) -> dict[str, Column]:
    """Named conditions that every row must meet; null counts as met."""
    c, near = F.col, lambda a, b: F.abs(a - b) <= 1e-6
    found = {f"null_{f.name}": c(f.name).isNotNull() for f in schema_of(table) if not f.nullable}
    if table == "clean_reviews":
        found |= {"date_of_ts": c("date") == F.to_date("ts"), "rating_range": c("rating").between(1, 5)}
    elif table == "daily_agg":
        hist = sum(c(f"n{k}") for k in range(2, 6)) + c("n1")
        found |= {
            "histogram": c("n") == hist, "negative": c("n_neg") == c("n1") + c("n2"), "sum": near(c("sum_rating"), sum(c(f"n{k}") * k for k in range(2, 6)) + c("n1")),
            "sumsq": near(c("sumsq_rating"), sum(c(f"n{k}") * k * k for k in range(2, 6)) + c("n1")), "verified": c("n_verified") <= c("n"), "all": c("n") <= c("n_all"),
            "verified_all": c("n_verified_all") <= c("n_all"), "not_negative": F.least(*[c(f"n{k}") for k in range(1, 6)], c("n"), c("n_neg")) >= 0,
        }
    elif table == "nlp_features":
        found |= {"aspect": c("aspect").isNotNull() | c("aspect_sentiment").isNull(), "terms": c("risk_hit") | (F.coalesce(F.size("risk_terms"), F.lit(0)) <= 0), "score": F.abs("sentiment_score") <= 1}
    elif table == "feature_series":
        known = F.array(*[F.lit(f"{i}/{f}") for i, fs in VOCABULARY.items() for f in fs])
        found |= {"vocabulary": F.array_contains(known, F.concat_ws("/", "indicator_id", "feature")), "finite": _finite("raw_value"), "n_window": c("n_window") >= 0}
    elif table == "indicator_matrix":
        found |= {"finite": _finite("strength"), "indicator": c("indicator_id").isin(*VOCABULARY)}
    elif table == "alerts":
        found |= {"level": c("level").isin("MEDIUM", "HIGH"), "groups": F.forall("groups_active", lambda g: g.isin("volume", "rating", "content")), "ids": F.forall("triggered_ids", lambda i: i.isin(*VOCABULARY)), "score": c("score").between(0, 1), "persist": c("persist") >= 0}
    elif table == "recall_labels":
        found |= {"url": c("source_url").startswith("https://"), "named": F.length(F.trim("product_name")) > 0, "match_type": c("match_type") == "exact_asin", "confidence": c("match_confidence").between(0, 1)}
    return found


def violations(table: str, df: DataFrame) -> DataFrame:
    """``(rule, rows)`` for every rule, ``duplicate_key`` among them (keys that occur more than once)."""
    checks = rules(table)
    one = df.agg(*[F.count_if(~F.coalesce(x, F.lit(True))).alias(k) for k, x in checks.items()])
    out = one.unpivot([], list(checks), "rule", "rows")
    return out.unionByName(df.groupBy(*KEYS[table]).count().where("count > 1").agg(F.lit("duplicate_key").alias("rule"), F.count("*").alias("rows")))


def validate(table: str, df: DataFrame) -> DataFrame:
    """``df`` conformed; raises with the counts of broken rules."""
    df = conform(table, df)
    bad = {r["rule"]: r["rows"] for r in violations(table, df).where("rows > 0").collect()}
    if bad:
        raise ValueError(f"{table}: {bad}")
    return df
