"""Risk score, persistence and levels of products from the indicator matrix; calibration of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points and group of each scored indicator; the flag indicators; thresholds.
POINTS = {"I1": 1, "I2": 1, "I3": 2, "I4": 3, "I5": 2, "I6": 2, "I7": 3, "I8": 5, "I9": 2}
GROUPS = {"volume": ("I1", "I2"), "rating": ("I3", "I4", "I5", "I6"), "content": ("I7", "I8", "I9")}
FLAGS = ("I10", "I11")
TAU = (0.20, 0.40)
TOTAL = sum(POINTS.values())
LEVELS = ("LOW", "MEDIUM", "HIGH")
HOLD, PERSIST_CAP = 3, 127


def points_of(ids: Column) -> Column:
    """Sum of the points of an array of indicator ids, as a share of all points."""
    return sum(F.array_contains(ids, k).cast("int") * p for k, p in POINTS.items()) / F.lit(float(TOTAL))


def groups_of(ids: Column, dropped: tuple[str, ...] = ()) -> Column:
    """The groups with a triggered indicator, alphabetical."""
    return F.filter(F.array(*[F.when(F.arrays_overlap(ids, F.array(*[F.lit(i) for i in GROUPS[g]])), F.lit(g)) for g in sorted(GROUPS) if g not in dropped]), lambda x: x.isNotNull())


def scores(matrix: DataFrame) -> DataFrame:
    """``(sku, category, window_end, score, triggered_ids, groups_active, severe, verify_flag)``; ids in numeric order."""
    hit = F.col("triggered")
    ids = F.transform(F.array_sort(F.collect_list(F.when(hit, F.substring("indicator_id", 2, 2).cast("int")))), lambda x: F.concat(F.lit("I"), x.cast("string")))
    s = matrix.groupBy("sku", "category", "window_end").agg(ids.alias("_all"), F.coalesce(F.max(F.when(hit & (F.col("indicator_id") == "I8"), F.col("strength"))) >= 1.0, F.lit(False)).alias("severe"))
    scored = F.filter("_all", lambda x: x.isin(*POINTS))
    return s.select("sku", "category", "window_end", points_of(scored).alias("score"), F.col("_all").alias("triggered_ids"), groups_of(scored).alias("groups_active"), "severe", F.arrays_overlap("_all", F.array(*[F.lit(i) for i in FLAGS])).alias("verify_flag"))


def with_persistence(rows: DataFrame, tau1: Column | float = TAU[0]) -> DataFrame:
    """``rows`` with ``persist``: consecutive rows of the sku with a score of at least ``tau1``, 0 below it, at most 127."""
    low = (F.col("score") < tau1).cast("int")
    w = W.partitionBy("sku", "category").orderBy("window_end")
    r = rows.withColumn("_low", low).withColumn("_run", F.sum("_low").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("sku", "category", "_run").orderBy("window_end").rowsBetween(W.unboundedPreceding, 0)
    return r.withColumn("persist", F.least(F.sum(1 - F.col("_low")).over(run), F.lit(PERSIST_CAP)).cast("int")).drop("_low", "_run")


def level_of(score: Column, persist: Column, groups: Column, severe: Column, tau1: Column | float = TAU[0], tau2: Column | float = TAU[1]) -> Column:
    """0, 1 or 2 for LOW, MEDIUM or HIGH before hysteresis."""
    high = (score >= tau2) & ((F.size(groups) >= 3) | severe)
    return F.when(high, 2).when((score >= tau1) & ((persist >= 2) | (F.size(groups) >= 2)), 1).otherwise(0)


def name_of(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1)


def hysteresis(rows: DataFrame) -> DataFrame:
    """``rows`` (sku, category, window_end, raw) with ``level``: up at once, down only after ``HOLD`` equal rows in a row.

    An ordered fold over a sku's rows, of which there is one a day; each row goes along, so that there is one exchange.
    """
    zero = F.struct(F.lit(None).cast("int").alias("cur"), F.lit(None).cast("int").alias("want"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        lv = x["raw"]
        up = a["cur"].isNull() | (lv >= a["cur"])
        seen = F.when(up, 0).when(a["want"] == lv, a["seen"] + 1).otherwise(1)
        cur = F.when(up | (seen >= HOLD), lv).otherwise(a["cur"])
        want = F.when(~up & (seen < HOLD), lv)
        return F.struct(cur.alias("cur"), want.alias("want"), F.when(want.isNull(), 0).otherwise(seen).alias("seen"), F.concat(a["out"], F.array(cur)).alias("out"))

    rest = [c for c in rows.columns if c not in ("sku", "category", "window_end", "raw")]
    g = rows.select("sku", "category", F.struct("window_end", F.col("raw").cast("int").alias("raw"), *rest).alias("_x")).groupBy("sku", "category").agg(F.array_sort(F.collect_list("_x")).alias("_r"))
    g = g.select("sku", "category", F.explode(F.arrays_zip(F.col("_r").alias("row"), F.aggregate("_r", zero, step)["out"].alias("level"))).alias("_x"))
    return g.select("sku", "category", "_x.row.*", "_x.level")


def alerts(matrix: DataFrame, tau: tuple[float, float] = TAU) -> DataFrame:
    """Scored rows of level MEDIUM or HIGH after hysteresis; rows held up by it keep their low score."""
    s = with_persistence(scores(matrix), tau[0])
    s = hysteresis(s.withColumn("raw", level_of(F.col("score"), F.col("persist"), F.col("groups_active"), F.col("severe"), *tau)))
    return s.where("level > 0").select("sku", "category", "window_end", "score", name_of(F.col("level")).alias("level"), "groups_active", F.col("persist").cast("int").alias("persist"), "verify_flag", "triggered_ids")


def calibrate(scored: DataFrame, floors: tuple[float, float] = (0.15, 0.35), min_rows: int = 200, fallback: tuple[float, float] = TAU) -> DataFrame:
    """``(category, tau1, tau2, n)``: the 90th and 97th percentile of the scores, at least the floors and apart; fallback for few rows."""
    p = scored.groupBy("category").agg(F.count("*").alias("n"), F.percentile("score", F.array(F.lit(0.9), F.lit(0.97))).alias("_p"))
    t1, t2 = F.greatest(F.col("_p")[0], F.lit(floors[0])), F.greatest(F.col("_p")[1], F.lit(floors[1]))
    t2 = F.when(t2 <= t1, t1 + 1e-9).otherwise(t2)
    few = F.col("n") < min_rows
    return p.select("category", F.when(few, fallback[0]).otherwise(t1).alias("tau1"), F.when(few, fallback[1]).otherwise(t2).alias("tau2"), "n")
