"""Sessions of activity: events of a user that follow each other within a gap.

Method: rows are range-partitioned by (user, time, id), so a user with a third of all rows is spread over
many tasks; each task sorts its rows (Spark's spilling sort) and one linear scan closes sessions as it goes,
holding one open session. Only the first and the last session of a task can continue in a neighbouring
task; these at most two fragments a task are merged afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_US = 30 * 60 * 1_000_000


def _scan(gap_us: int, min_events: int):
    schema = pa.schema([("u", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("n", pa.int64()), ("edge", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the open session: user, start, end, events, whether it is the task's first
        last_id, began = None, False
        for b in batches:
            if not b.num_rows:
                continue
            u, t, i = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            n = len(t)
            new_user = np.ones(n, bool)
            same_id = np.zeros(n, bool)
            if n > 1:
                new_user[1:] = pc.not_equal(u.slice(1), u.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                eq = pc.fill_null(pc.equal(i.slice(1), i.slice(0, n - 1)), False)
                both = pc.and_(pc.is_null(i.slice(1)), pc.is_null(i.slice(0, n - 1)))
                same_id[1:] = pc.or_(eq, both).to_numpy(zero_copy_only=False)
            step = np.zeros(n, np.int64)
            step[1:] = np.diff(t)
            if held is not None and held[0] == u[0].as_py():
                new_user[0] = False
                step[0] = t[0] - held[2]
                same_id[0] = last_id == i[0].as_py()
            opens = new_user | (step > gap_us)
            repeat = ~opens & same_id & (step == 0)
            at = np.flatnonzero(opens)
            counted = np.concatenate([[0], np.cumsum(~repeat)])
            bounds = np.append(at, n)
            if held is not None:
                if not opens[0]:
                    stop = bounds[0]
                    held = (held[0], held[1], int(t[stop - 1]), held[3] + int(counted[stop]), held[4])
                if len(at):
                    if held[3] >= min_events or held[4]:
                        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(held, schema)], schema=schema)
                    held = None
            if len(at):
                s, e = bounds[:-1], bounds[1:]
                size = counted[e] - counted[s]
                done = slice(0, len(at) - 1)
                edge = np.zeros(len(at), bool)
                edge[0] = not began
                keep = np.flatnonzero((size[done] >= min_events) | edge[done])
                if len(keep):
                    yield pa.RecordBatch.from_arrays([u.take(pa.array(s[keep])), pa.array(t[s[keep]]), pa.array(t[e[keep] - 1]), pa.array(size[keep]), pa.array(edge[keep])], schema=schema)
                held = (u[int(s[-1])].as_py(), int(t[s[-1]]), int(t[-1]), int(size[-1]), bool(edge[-1]))
            last_id, began = i[n - 1].as_py(), True
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*held[:4], True), schema)], schema=schema)

    return scan


def sessionize(events: DataFrame, user: str = "user_id", ts: str = "ts", event_id: str = "review_id", gap_us: int = GAP_US, min_events: int = 1) -> DataFrame:
    """Sessions ``(user_id, start_us, end_us, duration_us, n_events)`` of at least ``min_events`` events.

    A gap of more than ``gap_us`` opens a session, one of exactly ``gap_us`` does not. Rows without a user or a
    time belong to no session. Rows equal in user, time and id (null ids are equal) are one event. Other columns,
    whatever their names, are ignored. An empty table gives no session.
    """
    rows = events.select(F.col(user).cast("string").alias("u"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event_id).cast("string").alias("i"))
    rows = rows.where("u is not null and t is not null").repartitionByRange("u", "t", "i").sortWithinPartitions("u", "t", "i")
    parts = rows.mapInArrow(_scan(gap_us, min_events), "u string, s bigint, e bigint, n bigint, edge boolean")
    w = W.partitionBy("u").orderBy("s", "e")
    edges = parts.where("edge").withColumn("_o", F.coalesce(F.col("s") - F.lag("e").over(w) > gap_us, F.lit(True)))
    edges = edges.withColumn("_g", F.sum(F.col("_o").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    edges = edges.groupBy("u", "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n")).select("u", "s", "e", "n")
    whole = parts.where("not edge").select("u", "s", "e", "n").unionByName(edges).where(F.col("n") >= min_events)
    return whole.select(F.col("u").alias("user_id"), F.col("s").alias("start_us"), F.col("e").alias("end_us"), (F.col("e") - F.col("s")).alias("duration_us"), F.col("n").alias("n_events"))
