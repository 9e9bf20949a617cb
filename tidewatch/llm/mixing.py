"""Mixing sources to target shares of the tokens by Poisson replication.

The total T is the tokens of all documents of the targeted sources. A source with n tokens needs each of its documents
r = share * T / n times on average. A document's count is a Poisson variable, inverted from a hash of its id and a seed
and cut at the source's ``max_repeats``; its mean is chosen so that the cut count has mean r. Sources with r beyond
``max_repeats`` use every document that often and stay below their share. Counts depend on nothing but id, seed and
the source's rate, so any executor draws them alike. The copies are put in a global order of their own hash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidewatch.llm.tokens import FOLDER, VOCABULARY, token_counts
from tidewatch.session import checkpointed

#: A target table of up to this many rows is broadcast.
TARGETS = 10_000


def cut_mean(lam: float, most: int) -> float:
    """The mean of a Poisson count cut at ``most``: the sum of P(count > k) for k below it."""
    return sum(1 - b for b in _below(lam, most))


def _below(lam: float, most: int) -> list[float]:
    """P(count <= k) for k = 0 .. most - 1; each term from its logarithm, so that any mean has them."""
    out, total, log_lam = [], 0.0, math.log(lam) if lam > 0 else -math.inf
    for k in range(most):
        total += math.exp(k * log_lam - lam - math.lgamma(k + 1)) if lam > 0 else float(k == 0)
        out.append(min(total, 1.0))
    return out


def thresholds(rate: float, most: int) -> list[float]:
    """Ascending values c_0 .. c_(most-1); the count for a uniform u is how many are at most u."""
    if not rate > 0 or most <= 0:
        return [2.0] * max(0, most)
    if rate >= most:
        return [0.0] * most
    lo, hi = 0.0, 1.0
    while cut_mean(hi, most) < rate * (1 - 1e-12) and hi < 1e12:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cut_mean(mid, most) < rate else (lo, mid)
    return _below((lo + hi) / 2, most)


@F.pandas_udf(ArrayType(DoubleType()))
def _thresholds(rate: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([thresholds(float(r), int(m)) for r, m in zip(rate, most)])


def mix_plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, tokens, wanted_tokens, rate, capped, cuts)``, one row for each source of ``targets``.

    ``counts`` has ``source`` and ``n_tokens``. A source without documents has 0 tokens and is capped if its share is above
    0. Of several rows of one source the one with the greatest share counts; null shares and repeats count as 0; null
    sources of either side belong to no target. Extra columns are ignored.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.struct(F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(0)).alias("max_repeats"))).alias("t")).select("source", "t.*")
    sums = counts.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    plan = t.join(sums, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = plan.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    plan = plan.withColumn("wanted_tokens", F.col("target_share") * total)
    plan = plan.withColumn("rate", F.when(F.col("tokens") > 0, F.col("wanted_tokens") / F.col("tokens")).otherwise(F.lit(0.0)))
    plan = plan.withColumn("capped", F.col("tokens") * F.col("max_repeats") < F.col("wanted_tokens"))
    return plan.withColumn("cuts", _thresholds("rate", "max_repeats"))


def _copies(rows: DataFrame, plan: DataFrame, identity: list[str], seed: int) -> DataFrame:
    """``rows`` of targeted sources with ``_copies``."""
    side = plan.select(F.col("source").alias("_source"), F.col("cuts").alias("_cuts"))
    if plan.limit(TARGETS + 1).count() <= TARGETS:
        side = F.broadcast(side)
    u = F.xxhash64(F.lit(seed), *identity).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    rows = rows.withColumn("_u", u).join(side, F.col("source") == F.col("_source"))
    return rows.withColumn("_copies", F.size(F.filter("_cuts", lambda c: c <= F.col("_u")))).drop("_u", "_cuts", "_source")


def row_hash(documents: DataFrame):
    """What a document is told by: its id and text."""
    return F.xxhash64("doc_id", "text")


def count_tokens(documents: DataFrame, targets: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, row, n_tokens)`` of the documents whose source has a target, kept in the checkpoint folder."""
    wanted = documents.join(targets.select("source").where("source is not null").distinct(), "source", "left_semi").withColumn("row", row_hash(documents))
    return checkpointed(token_counts(wanted, keep=("doc_id", "source", "row"), folder=folder, vocabulary=vocabulary))


def _drawn(counts: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``(doc_id, source, n_tokens, row, _copies)``: what each document of a targeted source is drawn for."""
    return _copies(counts, plan, ["row"], seed)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 0, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, text, n_tokens, copy)``: the mixture, each chosen document once for every copy, in a global order by hash.

    Documents without a source or of a source without target are not in it. Draws go by id and text, so those of repeated
    rows are alike and a document without id draws by its text. Empty tables give an empty mixture.
    """
    counts = count_tokens(documents, targets, folder, vocabulary)
    plan = checkpointed(mix_plan(counts, targets))
    docs = documents.select("doc_id", "source", "text").withColumn("row", row_hash(documents)).where("source is not null")
    docs = _copies(docs, plan, ["row"], seed).where("_copies > 0")
    n = counts.select("row", F.col("source").alias("_s"), "n_tokens").distinct()
    docs = docs.join(n, (docs["row"] == n["row"]) & (docs["source"] == n["_s"])).select("doc_id", "source", "text", "n_tokens", docs["row"], "_copies")
    docs = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return docs.orderBy(F.xxhash64(F.lit(seed + 1), "row", "copy")).select("doc_id", "source", "text", "n_tokens", "copy")


def replicated(documents: DataFrame, targets: DataFrame, seed: int = 0, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(source, target_share, max_repeats, tokens, rate, capped, documents, copies, full, mixed_tokens)``: the plan beside what was drawn.

    Every document of a targeted source is drawn for, by the same counts as in ``mix``: ``copies`` are those drawn in all,
    ``full`` the documents drawn ``max_repeats`` times, ``mixed_tokens`` the tokens of all copies.
    """
    counts = count_tokens(documents, targets, folder, vocabulary)
    plan = checkpointed(mix_plan(counts, targets))
    most = plan.select("source", F.col("max_repeats").alias("_most"))
    docs = _drawn(counts, plan, seed).join(F.broadcast(most) if plan.limit(TARGETS + 1).count() <= TARGETS else most, "source")
    used = docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("_copies").alias("copies"), F.count_if(F.col("_copies") >= F.col("_most")).alias("full"), F.sum(F.col("n_tokens") * F.col("_copies")).alias("mixed_tokens"))
    out = plan.drop("cuts", "wanted_tokens").join(used, "source", "left")
    return checkpointed(out.select(*plan.drop("cuts", "wanted_tokens").columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "full", "mixed_tokens")]))


def short_sources(documents: DataFrame, targets: DataFrame, seed: int = 0, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(source)`` of the targets that can't reach their share: each of their documents is drawn ``max_repeats`` times and
    all copies together still have less than the share of T. Sources without documents have none."""
    r = replicated(documents, targets, seed, folder, vocabulary)
    total = r.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    return r.where((F.col("full") == F.col("documents")) & (F.col("mixed_tokens") < F.col("target_share") * total)).select("source")


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 0, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(source, target_share, max_repeats, tokens, rate, capped, mixed_tokens, actual_share)`` of the mixture with this seed."""
    out = replicated(documents, targets, seed, folder, vocabulary)
    total = out.agg(F.sum("mixed_tokens")).scalar()
    share = F.coalesce(F.try_divide(F.col("mixed_tokens"), total), F.lit(0.0))
    return out.select("source", "target_share", "max_repeats", "tokens", "rate", "capped", "mixed_tokens", share.alias("actual_share"))
