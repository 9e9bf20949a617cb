"""Bursts of terms: words and word pairs that a product's reviews suddenly share.

Method: n-grams are never exchanged. A review's text goes once (days at the edge of two blocks: twice) to the block of days of its
product, sorted by day, and one linear scan splits it into words. A block holds the rows (term, user, day, count) of about two
windows, with at most ``min_users`` users of a term and day, as more decide nothing; texts that no window of enough users reaches are
not split at all. Windows are differences of sums along the days, for all terms at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import words_of
from tidewatch.session import checkpointed

#: Windows of a block; texts split at once; rows held before windows are closed; cells (term, day) summed at once; rows of an output batch.
BLOCK, TEXTS, ROWS, CELLS, OUT = 8, 10_000, 2_000_000, 1_000_000, 20_000
SCHEMA = pa.schema([("sku", pa.string()), ("end", pa.int32()), ("top", pa.float64())])


class _Ids(dict):
    """Numbers names in the order in which they are first asked for."""

    def __missing__(self, name: str) -> int:
        self[name] = n = len(self)
        return n


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any key."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first


def _reduced(code: np.ndarray, user: np.ndarray, day: np.ndarray, min_users: int) -> tuple[np.ndarray, ...]:
    """Rows (code, user, day, count); of a code and day only the first ``min_users`` users, the last with the counts of the rest."""
    names, term = np.unique(code, return_inverse=True)
    lo, days, users = int(day.min()), int(day.max() - day.min()) + 1, int(user.max()) + 1
    if len(names) * days * users < 1 << 62:
        key, count = np.unique((term * days + (day - lo)) * users + user, return_counts=True)
        cell, user = np.divmod(key, users)
        term, day = np.divmod(cell, days)
        day = day + lo
    else:
        order = np.lexsort((user, day, term))
        term, user, day = term[order], user[order], day[order]
        at = np.flatnonzero(_runs(term, day, user))
        count = np.diff(np.append(at, len(term)))
        term, user, day = term[at], user[at], day[at]
    start = np.flatnonzero(_runs(term, day))
    rank = np.arange(len(term)) - np.repeat(start, np.diff(np.append(start, len(term))))
    at = np.flatnonzero(rank < max(min_users, 1))
    return names[term[at]], user[at].astype(np.int32), day[at].astype(np.int32), np.add.reduceat(count, at)


def _tops(rows: tuple[np.ndarray, ...], first: int, last: int, days: int, min_count: int, min_users: int) -> np.ndarray:
    """The greatest score of each window that ends from ``first`` to ``last``, 0 at least."""
    code, user, day, count = rows
    n = last - first + 1
    width, base = n + 2 * days - 1, first - (2 * days - 1)
    top = np.zeros(n)
    inside = (day >= base) & (day <= last)
    names, term = np.unique(code[inside], return_inverse=True)
    user, x, count = user[inside], day[inside] - base, count[inside]
    often = np.bincount(term, count, len(names)) >= min_count
    keep = often[term]
    term, user, x, count = (np.cumsum(often) - 1)[term[keep]], user[keep], x[keep], count[keep]
    order = np.lexsort((x, user, term))
    term, user, x, count = term[order], user[order], x[order], count[order]
    step = max(CELLS // (width + 1), 1)
    for lo in range(0, int(often.sum()), step):
        a, b = np.searchsorted(term, [lo, lo + step])
        t, d, c = term[a:b] - lo, x[a:b], count[a:b]
        high = int(t[-1]) + 1
        total = np.zeros((high, width + 1))
        np.cumsum(np.bincount(t * width + d, c, high * width).reshape(high, width), axis=1, out=total[:, 1:])
        mid = total[:, days : days + n]
        now, past = total[:, 2 * days : 2 * days + n] - mid, mid - total[:, :n]
        # a user counts from the day of a term up to the user's next day with it, or to the end of the last window
        until = np.minimum(d + days, width)
        again = ~_runs(t, user[a:b])[1:]
        until[:-1][again] = np.minimum(until[:-1], d[1:])[again]
        size = high * (width + 1)
        users = np.cumsum((np.bincount(t * (width + 1) + d, minlength=size) - np.bincount(t * (width + 1) + until, minlength=size)).reshape(high, -1), axis=1)[:, 2 * days - 1 : 2 * days - 1 + n]
        score = np.where((now >= min_count) & (users >= min_users), (now - past) / np.sqrt(past + 1), 0.0)
        np.maximum(top, score.max(axis=0), out=top)
    return top


def _reached(rows: list[tuple], days: int, min_users: int) -> Iterator[tuple]:
    """Those of the rows (day, user, text), by day, that lie in a window with enough users or in the window before it."""
    inside, a, done, i = Counter(), 0, 0, 0
    while i < len(rows):
        now = rows[i][0]
        while i < len(rows) and rows[i][0] == now:
            inside[rows[i][1]] += 1
            i += 1
        while rows[a][0] <= now - days:
            inside[rows[a][1]] -= 1
            if not inside[rows[a][1]]:
                del inside[rows[a][1]]
            a += 1
        if len(inside) >= min_users:
            while rows[done][0] <= now - 2 * days:
                done += 1
            yield from rows[done:i]
            done = i


class _Block:
    """A block of days of a product."""

    def __init__(self, first: int, last: int, days: int, min_count: int, min_users: int):
        self.next, self.last, self.limits = first, last, (days, min_count, min_users)
        self.words, self.users = _Ids(), _Ids()
        self.rows = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64))
        self.full, self.tops = ROWS, {}

    def add(self, texts: list[tuple]) -> None:
        word, user, day, size = [], [], [], []
        for d, u, t in texts:
            ws = words_of(t)
            if ws:
                word.extend(map(self.words.__getitem__, ws))
                user.append(self.users[u])
                day.append(d)
                size.append(len(ws))
        if not word:
            return
        w = np.array(word, np.int64)
        review = np.repeat(np.arange(len(size)), size)
        pair = np.flatnonzero(review[1:] == review[:-1])
        review = np.concatenate([review, review[pair]])
        code = np.concatenate([w, (w[pair] + 1 << 32) | w[pair + 1]])
        new = _reduced(code, np.array(user, np.int32)[review], np.array(day, np.int32)[review], self.limits[2])
        self.rows = tuple(np.concatenate(x) for x in zip(self.rows, new))

    def close(self, last: int) -> None:
        """Scores of the windows that end up to ``last``; keeps the rows that later windows need."""
        if not len(self.rows[0]):
            return
        last, days = min(last, self.last), self.limits[0]
        if last >= self.next:
            tops = _tops(self.rows, self.next, last, *self.limits)
            self.tops.update((self.next + int(k), float(tops[k])) for k in np.flatnonzero(tops))
            self.next = last + 1
        late = self.rows[2] > self.next - 2 * days
        code, user, day, count = (x[late] for x in self.rows)
        used, user = np.unique(user, return_inverse=True)
        names = list(self.users)
        self.users = _Ids((names[k], i) for i, k in enumerate(used))
        self.rows, self.full = (code, user.astype(np.int32), day, count), ROWS + len(code)


def _scan(days: int, min_count: int, min_users: int):
    def block_tops(block: int, rows: Iterator[tuple]) -> Iterator[tuple[int, float]]:
        first = block * BLOCK * days
        b, held, ends, split = _Block(first, first + BLOCK * days - 1, days, min_count, min_users), [], set(), False
        for _, _, day, user, text in rows:
            ends.add(day)
            if len(held) >= TEXTS:
                b.add(held)
                held, split = [], True
                if len(b.rows[0]) >= b.full:
                    b.close(day - 1)
            held.append((day, user, text))
        b.add(held if split else list(_reached(held, days, min_users)))
        b.close(b.last)
        for e in {d + k for d in ends for k in range(days)}:
            if first <= e <= b.last:
                yield e, b.tops.get(e, 0.0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for (sku, block), group in groupby(rows, itemgetter(0, 1)):
            out += [(sku, e, top if sku is not None else 0.0) for e, top in block_tops(block, group)]
            if len(out) >= OUT:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)

    return scan


def term_burst(reviews: DataFrame, days: int = 7, min_count: int = 5, min_users: int = 3) -> DataFrame:
    """``(sku, window_end, term_burst_score)`` for every window with a review: the greatest (c - p) / sqrt(p + 1) over the terms with
    at least ``min_count`` occurrences by ``min_users`` users in the window, p being the window before; 0 without such a term.

    Windows begin with the first full one of the whole table and end with its last day. A null user is one user, the empty one; a
    null product has no terms. The scores are written once, as the table's first and last day are read off them.
    """
    day = F.unix_date("date")
    of = lambda d: F.floor(d / (BLOCK * days)).cast("int")
    rows = reviews.where("date is not null").select("sku", day.alias("day"), F.coalesce("user_id", F.lit("")).alias("u"), F.lower("text_norm").alias("text"))
    rows = rows.select("sku", F.explode(F.sequence(of(F.col("day")), of(F.col("day") + 2 * days - 1))).alias("block"), "day", "u", "text")
    rows = rows.repartition("sku", "block").sortWithinPartitions("sku", "block", "day")
    tops = checkpointed(rows.mapInArrow(_scan(days, min_count, min_users), "sku string, end int, top double"))
    bounds = tops.agg((F.min("end") + days - 1).alias("lo"), (F.max("end") - days + 1).alias("hi")).first()
    return tops.where(F.col("end").between(bounds["lo"], bounds["hi"])).select("sku", F.date_from_unix_date("end").alias("window_end"), F.col("top").alias("term_burst_score"))
