"""Reports and look-ups over the tables: selection of products by history, quality of scored reviews, runs of features, bounds, search."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.preprocess import weekly_median


def with_history(reviews: DataFrame, days: int, count: int, weekly: float) -> DataFrame:
    """``weekly_median`` of the products whose reviews span at least ``days`` days, are at least ``count`` and have a weekly median of at least ``weekly``."""
    m = weekly_median(reviews).withColumn("history_days", F.datediff("last_date", "first_date") + 1)
    return m.where((F.col("history_days") >= days) & (F.col("n_reviews") >= count) & (F.col("median_weekly") >= weekly))


def of_products(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """The reviews of the selected products, in one pass by a semi join."""
    return reviews.join(products.select("sku"), "sku", "left_semi")


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(sku, reviews)`` of the products that a step took away altogether."""
    return before.groupBy("sku").agg(F.count("*").alias("reviews")).join(after.select("sku").distinct(), "sku", "left_anti")


def categories(reviews: DataFrame) -> DataFrame:
    """``(category, skus, reviews)`` of the stored categories."""
    return reviews.groupBy("category").agg(F.count_distinct("sku").alias("skus"), F.count("*").alias("reviews"))


def find_sku(rows: DataFrame, part: str) -> DataFrame:
    """Rows whose sku holds ``part`` literally, whatever its case; signs have no special meaning."""
    return rows.where(F.contains(F.lower("sku"), F.lit(part.lower())))


def date_bounds(alerts: DataFrame, daily: DataFrame) -> DataFrame:
    """``(first_day, last_day)`` of the alerts, or of the daily table where there are none."""
    a = alerts.agg(F.min("window_end").alias("a"), F.max("window_end").alias("b"))
    d = daily.agg(F.min("date").alias("c"), F.max("date").alias("d"))
    return a.select(F.coalesce("a", d.select("c").scalar()).alias("first_day"), F.coalesce("b", d.select("d").scalar()).alias("last_day"))


def quality(rows: DataFrame, values: list[str], nulls: list[str]) -> DataFrame:
    """``(field, value, rows)``: counts of each value of ``values`` (null as a value) and of the nulls of ``nulls``, in one aggregation."""
    parts = [F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("value")) for c in values]
    parts += [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("field"), F.lit("is null").alias("value"))) for c in nulls]
    x = rows.select(F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("x"))
    return x.groupBy("x.field", "x.value").agg(F.count("*").alias("rows"))


def feature_run(features: DataFrame) -> DataFrame:
    """``(indicator_id, rows, skus, nulls, risk_hits)`` for each indicator and, as ``all``, for the table."""
    known = F.col("raw_value").isNotNull() & ~F.isnan("raw_value")
    hits = F.sum(F.when((F.col("feature") == "risk_hits") & known, F.col("raw_value")))
    return features.rollup("indicator_id").agg(F.count("*").alias("rows"), F.count_distinct("sku").alias("skus"), F.count_if(~known).alias("nulls"), F.coalesce(hits, F.lit(0.0)).alias("risk_hits")).withColumn("indicator_id", F.coalesce("indicator_id", F.lit("all")))


def risk_combined(layers: DataFrame, mode: str = "combined", threshold: float = 0.60) -> DataFrame:
    """``(review_id, risk_hit, risk_terms, risk_sim)`` from word lists (``risk_hit``, ``risk_terms``) and similarity (``risk_sim``).

    ``layer1``: the words alone; ``layer2``: a similarity of at least ``threshold`` alone, without terms; ``combined``: either, terms
    only where there is a hit.
    """
    near = F.coalesce(F.col("risk_sim") >= threshold, F.lit(False))
    hit = {"layer1": F.col("risk_hit"), "layer2": near, "combined": F.col("risk_hit") | near}[mode]
    none = F.lit(None).cast("array<string>")
    terms = F.col("risk_terms") if mode == "layer1" else none if mode == "layer2" else F.when(hit, F.col("risk_terms"))
    return layers.select("review_id", hit.alias("risk_hit"), terms.alias("risk_terms"), "risk_sim")


class Scorer(Protocol):
    """Anything that gives texts the probabilities of labels: a model is loaded by ``load`` once in a worker."""

    labels: list[str]

    def load(self) -> Callable[[list[str]], list[list[float]]]: ...


def label_order(labels: list[str]) -> tuple[int, int, int | None]:
    """Positions of the positive, negative and neutral label, whatever they are called; without names the usual order counts."""
    low = [x.lower() for x in labels]
    at = lambda *names: next((i for i, x in enumerate(low) if any(x.startswith(n) for n in names)), None)
    pos, neg, neu = at("pos", "label_2"), at("neg", "label_0"), at("neu", "label_1")
    if pos is None or neg is None:
        pos, neg, neu = len(labels) - 1, 0, 1 if len(labels) > 2 else None
    return pos, neg, neu


def scored_by(reviews: DataFrame, scorer: Scorer, text: str = "text_norm", batch: int = 64, chars: int = 2_000) -> DataFrame:
    """``(review_id, p_pos, p_neg, sentiment_score)`` by an injected scorer; blank and null texts have nulls and are not shown to it.

    Texts are handed over in batches of ``batch``; the scorer sees at most ``chars`` characters of one, as models read a bounded number of tokens.
    """
    import pandas as pd

    pos, neg, _ = label_order(scorer.labels)

    def run(frames):
        model = scorer.load()
        for f in frames:
            texts = f[text].fillna("").str.strip()
            keep = texts[texts != ""]
            probs: list[list[float]] = []
            for lo in range(0, len(keep), batch):
                probs += model([t[:chars] for t in keep.iloc[lo : lo + batch]])
            p = pd.DataFrame([(x[pos], x[neg]) for x in probs], index=keep.index, columns=["p_pos", "p_neg"]).reindex(f.index)
            yield pd.DataFrame({"review_id": f["review_id"], "p_pos": p["p_pos"], "p_neg": p["p_neg"], "sentiment_score": (p["p_pos"] - p["p_neg"]).clip(-1, 1)})

    return reviews.select("review_id", text).mapInPandas(run, "review_id string, p_pos double, p_neg double, sentiment_score double")


def with_scores(rows: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of their scores, null where a review has none; of several scores of one id one counts."""
    return rows.drop(*columns).join(scores.select("review_id", *columns).dropDuplicates(["review_id"]), "review_id", "left")


def window_days(days) -> int:
    """A number of days, checked: a positive whole number, no truth value."""
    if isinstance(days, bool) or not isinstance(days, int) or days <= 0:
        raise ValueError(f"no number of days: {days!r}")
    return days


def negative_ratio(part: Column, whole: Column, prior: Column | float, strength: float = 20.0) -> Column:
    """(part + strength * prior) / (whole + strength)."""
    return (part + strength * prior) / (whole + strength)
