"""Results per key when a few keys hold most rows: exact offset chunking.

1. Count the keys of every input partition (a map-side combine makes this one small row per partition and key).
2. Prefix sums over the partitions of a key give the number of its first row in each partition.
3. Number the rows: offset plus the row's place among its key's rows in the partition.
4. Rows ``c * chunk_rows .. (c + 1) * chunk_rows - 1`` of a key are its chunk c, so every chunk but the last of a
   key has the same size however hot the key is; chunks are aggregated on their own.
5. The chunk states of a key are few (rows / chunk_rows) and are merged in order.

For results that depend on order the input partitions are ranges of (key, order), so numbers follow the order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import checkpointed

CHUNK_ROWS = 100_000
#: Offsets are broadcast up to this many rows (about 60 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 50_000


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and each row's place among the rows of its key there; state: one counter a key."""
    pid, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        enc = b.column(0).dictionary_encode()
        words = enc.dictionary.to_pylist()
        codes = np.asarray(enc.indices.fill_null(len(words)), dtype=np.int64)
        words.append(None)
        order = np.argsort(codes, kind="stable")
        counts = np.bincount(codes, minlength=len(words))
        starts = np.cumsum(counts) - counts
        place = np.empty(len(codes), np.int64)
        place[order] = np.arange(len(codes)) - starts[codes[order]]
        place += np.array([seen.get(x, 0) for x in words], np.int64)[codes]
        for x, c in zip(words, counts):
            if c:
                seen[x] = seen.get(x, 0) + int(c)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(codes), pid, np.int32)), pa.array(place)], names=[*b.schema.names, "_pid", "_place"])


def numbered(df: DataFrame, key: str, columns: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """``(_key, columns..., _n)``: the rows of each key numbered from 0, by ``order`` if given, else by input place.

    Null keys are numbered as one key of their own. With ``order`` (names among ``columns``) name enough columns to make
    it total; equal rows are interchangeable. The placed rows are written to the checkpoint folder, because numbers
    and offsets must come from one and the same partitioning even if an executor is lost between the passes.
    """
    columns = list(columns)
    rows = df.select(F.col(key).cast("string").alias("_key"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)])
    if order:
        by = [F.col("_key"), *[F.col(f"_c{columns.index(c)}") for c in order]]
        rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = checkpointed(rows.mapInArrow(_place, f"{kinds}, _pid int, _place bigint"))
    sizes = placed.groupBy("_key", "_pid").agg((F.max("_place") + 1).alias("_size"))
    w = W.partitionBy("_key").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = checkpointed(sizes.select(F.col("_key").alias("_ok"), F.col("_pid").alias("_op"), F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_offset")))
    small = offsets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    offsets = F.broadcast(offsets) if small else offsets.hint("merge")
    placed = placed.join(offsets, F.col("_key").eqNullSafe(F.col("_ok")) & (F.col("_pid") == F.col("_op")))
    return placed.select("_key", *[F.col(f"_c{k}").alias(f"_v{k}") for k in range(len(columns))], (F.col("_offset") + F.col("_place")).alias("_n"))


def key_counts(df: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key, n, share, n_chunks)``: rows of each key as stored and their share of all rows; null keys are one key.

    Counted chunk by chunk. An empty table gives no row.
    """
    rows = numbered(df, key).withColumn("_chunk", F.floor(F.col("_n") / chunk_rows))
    chunks = rows.groupBy("_key", "_chunk").agg(F.count("*").alias("_rows"))
    keys = chunks.groupBy("_key").agg(F.sum("_rows").alias("n"), F.count("*").alias("n_chunks"))
    return keys.select(F.col("_key").alias(key), "n", (F.col("n") / keys.agg(F.sum("n")).scalar()).alias("share"), "n_chunks")


def _merge(acc: Column, x: Column) -> Column:
    """The state of two neighbouring stretches of a key's rows, from the states of both."""
    join = acc["last"].isNotNull() & (acc["last"] != x["first"])
    low = F.when(acc["n"] == acc["prefix"], acc["n"] + x["prefix"]).otherwise(acc["prefix"])
    return F.struct(
        F.when(acc["n"] == 0, x["first"]).otherwise(acc["first"]).alias("first"), x["last"].alias("last"), (acc["n"] + x["n"]).alias("n"),
        (acc["changes"] + x["changes"] + F.when(join, 1).otherwise(0)).alias("changes"), low.alias("prefix"),
        F.when(x["n"] == x["suffix"], acc["suffix"] + x["n"]).otherwise(x["suffix"]).alias("suffix"),
        F.greatest(acc["best"], x["best"], acc["suffix"] + x["prefix"]).alias("best"),
    )


def rating_runs(df: DataFrame, key: str = "sku", order: Sequence[str] = ("ts", "review_id"), value: str = "rating", low: int = 2, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key, n, first_value, last_value, changes, longest_low_run)`` over the rows of each key in order.

    ``changes`` counts neighbours whose values differ; ``longest_low_run`` is the longest stretch of values of at most
    ``low``. Rows with a null key, order or value are left out, rows equal in key, order and value count once.
    The states of equal chunks (value at both ends, changes inside, low runs at both ends and longest) are merged in order.
    """
    rows = df.select(F.col(key).alias("_rk"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(value).cast("int").alias("_val")).dropna().distinct()
    names = [f"_o{k}" for k in range(len(order))]
    rows = numbered(rows, "_rk", [*names, "_val"], names).select("_key", F.col(f"_v{len(names)}").alias("v"), "_n").withColumn("_chunk", F.floor(F.col("_n") / chunk_rows))
    w = W.partitionBy("_key", "_chunk").orderBy("_n")
    rows = rows.withColumn("_low", (F.col("v") <= low).cast("int")).withColumn("_prev", F.lag("v").over(w))
    rows = rows.withColumn("_island", F.sum(1 - F.col("_low")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("_key", "_chunk", "_island").agg(
        F.min_by("v", "_n").alias("first"), F.max_by("v", "_n").alias("last"), F.min("_n").alias("lo"), F.count("*").alias("n"), F.sum("_low").alias("run"),
        F.sum((F.col("v") != F.col("_prev")).cast("int")).alias("changes"),
    )
    chunks = runs.groupBy("_key", "_chunk").agg(
        F.min_by("first", "lo").alias("first"), F.max_by("last", "lo").alias("last"), F.sum("n").alias("n"), F.coalesce(F.sum("changes"), F.lit(0)).alias("changes"),
        F.coalesce(F.max(F.when(F.col("_island") == 0, F.col("run"))), F.lit(0)).alias("prefix"), F.max_by("run", "lo").alias("suffix"), F.max("run").alias("best"),
    )
    state = F.struct(F.col("_chunk"), F.col("first"), F.col("last"), F.col("n"), F.col("changes"), F.col("prefix"), F.col("suffix"), F.col("best"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), zero.alias("n"), zero.alias("changes"), zero.alias("prefix"), zero.alias("suffix"), zero.alias("best"))
    keys = chunks.groupBy("_key").agg(F.array_sort(F.collect_list(state)).alias("_states")).select("_key", F.aggregate("_states", start, _merge).alias("s"))
    return keys.select(F.col("_key").alias(key), F.col("s.n").alias("n"), F.col("s.first").alias("first_value"), F.col("s.last").alias("last_value"), F.col("s.changes").alias("changes"), F.col("s.best").alias("longest_low_run"))
