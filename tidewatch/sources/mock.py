"""Raw reviews of a few products with a known crisis, for tests and demonstrations; small by construction."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidewatch.sources.reviews import RAW

#: Weekday factors of the volume and mixes of ratings.
WEEKDAYS = (1.0, 1.0, 1.0, 1.0, 1.15, 1.3, 1.2)
NORMAL, CRISIS = (0.05, 0.05, 0.10, 0.25, 0.55), (0.35, 0.20, 0.10, 0.10, 0.25)


def raw_reviews(spark: SparkSession, n_skus: int = 5, days: int = 120, seed: int = 42, crisis_days: int = 14, start: dt.date = dt.date(2023, 1, 2)) -> DataFrame:
    """Product 0 has a crisis in the last days (twice the volume, bad ratings, unsafe); the others are normal."""
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n_skus):
        base = r.uniform(8, 20)
        for d in range(days):
            bad = k == 0 and d >= days - crisis_days
            day = dt.datetime.combine(start + dt.timedelta(days=d), dt.time(), dt.timezone.utc)
            for _ in range(r.poisson(base * WEEKDAYS[d % 7] * (2 if bad else 1))):
                rating = int(r.choice(5, p=CRISIS if bad else NORMAL)) + 1
                words = "it caught fire and the battery was broken" if bad and rating <= 2 else "the handle is good and works fine" if rating >= 4 else "the cable is flimsy and broke"
                ms = int(day.timestamp() * 1000) + int(r.integers(0, 86_400_000))
                rows.append((f"SKU{k}", ms, float(rating), f"{words} {r.integers(0, 10**6)}", f"U{r.integers(0, 10**5)}", bool(r.random() < 0.85)))
    return spark.createDataFrame(rows, RAW)
