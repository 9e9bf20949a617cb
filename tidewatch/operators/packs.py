"""Evidence packs of alerts: the reviews and indicators behind each, a canonical form of it, its hash, and checks of texts about it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewatch.functions.text import mask, short_key
from tidewatch.operators.serve import priority_score

#: What the indicators are called in a pack.
NAMES = {
    "I1": "volume surge", "I2": "growth", "I3": "negative trend", "I4": "low stars", "I5": "rating volatility", "I6": "polarised ratings",
    "I7": "term burst", "I8": "risk terms", "I9": "aspect", "I10": "rating and text disagree", "I11": "verified share",
}
PACK = "struct<rank:int,review_id:string,rating:int,risk_hit:boolean,text:string>"


def pack(alerts: DataFrame, reviews: DataFrame, matrix: DataFrame, k: int = 5, days: int = 7, level: str | None = None) -> DataFrame:
    """``(sku, category, window_end, score, level, groups_active, persist, verify_flag, indicators, reviews, n_reviews, avg_rating)``.

    One row for each alert (of one ``level`` only, if given). ``indicators`` are those that fired, with name and strength, in numeric order;
    ``reviews`` the ``k`` most telling of the window, one for each opening, masked; spam counts only where a window has nothing
    else. An alert without reviews has an empty list. All alerts are joined at once. ``reviews`` need ``risk_hit``.
    """
    a = alerts if level is None else alerts.where(F.col("level") == level)
    keys = ["sku", "category", "window_end"]
    r = reviews.where("text_raw is not null").select(
        F.col("sku").alias("_s"), "date", "review_id", F.col("rating").cast("int").alias("rating"), F.coalesce("risk_hit", F.lit(False)).alias("risk_hit"), F.coalesce("is_spam", F.lit(False)).alias("_spam"), "text_raw",
        priority_score(F.col("risk_hit"), F.col("rating"), F.col("text_raw"), F.col("verified_purchase")).alias("_p"),
    )
    j = a.select(*keys).join(r, (F.col("sku") == F.col("_s")) & F.col("date").between(F.date_sub("window_end", days - 1), F.col("window_end")))
    w = W.partitionBy(*keys)
    stats = j.where(~F.col("_spam")).groupBy(*keys).agg(F.count("*").alias("n_reviews"), F.avg("rating").alias("avg_rating"))
    j = j.withColumn("_least", F.min(F.col("_spam").cast("int")).over(w)).where((F.col("_least") == 1) | ~F.col("_spam"))
    order = [F.col("_p").desc(), F.col("date").desc(), F.col("review_id")]
    j = j.withColumn("_n", F.row_number().over(W.partitionBy(*keys, short_key(F.col("text_raw"))).orderBy(*order))).where("_n = 1")
    j = j.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= k)
    top = j.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "review_id", "rating", "risk_hit", mask(F.col("text_raw")).alias("text")))).alias("reviews"))
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    fired = matrix.where("triggered").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.substring("indicator_id", 2, 2).cast("int").alias("number"), "indicator_id", F.element_at(names, F.col("indicator_id")).alias("name"), "strength"))).alias("indicators"))
    out = a.join(fired, keys, "left").join(top, keys, "left").join(stats, keys, "left")
    return out.select(*keys, "score", "level", "groups_active", "persist", "verify_flag", "indicators", F.coalesce("reviews", F.from_json(F.lit("[]"), f"array<{PACK}>")).alias("reviews"), F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"), "avg_rating")


def canonical(packs: DataFrame) -> DataFrame:
    """``packs`` reduced to the stable part, as a struct ``evidence``: days as text, score to four places, sorted groups, no strengths."""
    return packs.select("sku", "window_end", F.struct(
        "category", F.array_sort("groups_active").alias("groups_active"), F.col("persist").cast("int").alias("persist"),
        F.transform("reviews", lambda r: F.struct(r["review_id"].alias("id"), r["rating"].alias("rating"), r["risk_hit"].alias("risk_hit"), r["text"].alias("text"))).alias("reviews"),
        F.col("level").alias("risk_level"), F.round("score", 4).alias("risk_score"), "sku", F.transform("indicators", lambda i: i["indicator_id"]).alias("triggered_indicators"), "verify_flag", F.date_format("window_end", "yyyy-MM-dd").alias("window_end"),
    ).alias("evidence"))


def canonical_json(value: dict) -> str:
    """JSON with sorted keys and no spaces; NaN and infinities are an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def evidence_hash(value: dict) -> str:
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()


@F.pandas_udf(StringType())
def _hash_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else evidence_hash(json.loads(t)))


def hashed(packs: DataFrame) -> DataFrame:
    """``(sku, window_end, evidence, hash)``. The hash is that of the canonical JSON, whose numbers are written as Python writes them."""
    c = canonical(packs)
    return c.withColumn("hash", _hash_of(F.to_json("evidence", {"ignoreNullFields": "false"})))


def cached_or_new(packs: DataFrame, cache: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(hash, answer, cached)``: stored answers by evidence hash, and those of ``answer`` (hash, answer) for packs without one.

    Equal evidence is asked for once. ``answer`` sees only the packs that the cache lacks.
    """
    h = hashed(packs)
    known = cache.select("hash", "answer").dropDuplicates(["hash"])
    new = answer(h.join(known.select("hash"), "hash", "left_anti").dropDuplicates(["hash"]))
    old = known.join(h.select("hash").distinct(), "hash", "left_semi")
    return old.withColumn("cached", F.lit(True)).unionByName(new.select("hash", "answer").withColumn("cached", F.lit(False)))


def cache_path(folder: str, digest: str) -> str:
    """Where the answer to a hash is kept; anything but 64 hexadecimal digits is an error."""
    if not re.fullmatch(r"[0-9a-f]{64}", digest):
        raise ValueError(f"no SHA-256: {digest!r}")
    return f"{folder.rstrip('/')}/{digest[:2]}/{digest}.json"


def write_json(path: str, value: dict) -> None:
    """A small document in UTF-8; the folder is made."""
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False), encoding="utf-8")


def read_json(path: str) -> dict | None:
    """The document, or null where there is none."""
    from pathlib import Path

    return json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else None


def unfenced(text: Column) -> Column:
    """The JSON of an answer that may stand in a Markdown code fence."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(F.length(inner) > 0, inner).otherwise(text))


def cited(answers: DataFrame, packs: DataFrame) -> DataFrame:
    """``(hash, unknown)``: the review ids that an answer cites and its pack does not hold; ``answers`` have ``hash`` and ``cited array<string>``."""
    ids = hashed(packs).select("hash", F.transform("evidence.reviews", lambda r: r["id"]).alias("_ids")).dropDuplicates(["hash"])
    return answers.join(ids, "hash", "left").select("hash", F.array_except(F.coalesce("cited", F.array().cast("array<string>")), F.coalesce("_ids", F.array().cast("array<string>"))).alias("unknown"))
