"""Near-duplicate records by circulant MinHash, banding and exact Jaccard verification.

Records of one group (sku) with the same text are one class; only classes are compared. A class's words are hashed to
positions of a universe (the first permutation); the second permutation, shifted circularly by k, gives the k-th signature
coordinate as its least value over the words. Two permutations thus serve all coordinates: a word contributes a
contiguous slice of the second one. Some coordinates make a band and classes that share a band are candidates.

The width r of a band follows the size of the group, one more for every fivefold size, and the number of bands follows r so
that a pair at the threshold 0.7 shares one with 0.997: candidates of unlike texts, which fall fivefold with every further
coordinate at the usual overlap of 0.2, then grow in proportion to the records and not with the square of a large group.
``BITS`` further coordinates give one bit each; a pair whose bits differ in more than ``DIFFER`` places, or whose numbers of
words are too far apart for the threshold, is dropped within the join. What remains is verified exactly on the words.

Reach at the threshold 0.7: 0.997 by bands and 0.9995 by bits; at 0.75 both are above 0.9999.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import checkpointed, partitions_of

BITS, DIFFER = 120, 31
UNIVERSE = 1 << 20
MIN_WORDS, NUMERATOR, DENOMINATOR = 30, 7, 10
#: Groups of up to this many records get bands of the first width; every fivefold size one coordinate more.
SMALL, FIRST, LAST = 2000, 3, 9
#: Classes of up to this many copies come out as all their pairs (``None``: all do); beyond it each copy is linked to the class's first record.
COPIES = 200
#: A table of group sizes of up to this many rows is broadcast, a larger one joined by a shuffle.
BROADCAST_ROWS = 200_000
_STEP, _BLOCK = 256, 1 << 14


def bands_of(rows: int, reach: float = 0.997) -> int:
    """The number of bands of ``rows`` coordinates of which a pair at the threshold shares one with probability ``reach``."""
    return math.ceil(math.log(1 - reach) / math.log(1 - (NUMERATOR / DENOMINATOR) ** rows))


COORDINATES = BITS + LAST * bands_of(LAST)


def slices(seed: int = 20) -> np.ndarray:
    """Row p: the values of the second permutation at positions p .. p + COORDINATES - 1, going round."""
    perm = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([perm, perm[: COORDINATES - 1]]), COORDINATES)


def signatures(texts: list[str], rows: np.ndarray, places: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x coordinates) of the sets of words at single spaces, and the sizes of the sets."""
    flat: list[int] = []
    starts = []
    for t in texts:
        starts.append(len(flat))
        for w in set(t.split(" ")):
            p = places.get(w)
            if p is None:
                if len(places) > 2_000_000:
                    places.clear()
                p = places[w] = xxhash.xxh64_intdigest(w) % UNIVERSE
            flat.append(p)
    at, first = np.array(flat), np.array(starts)
    out = np.full((len(texts), rows.shape[1]), UNIVERSE, np.uint32)
    for lo in range(0, len(at), _BLOCK):  # memory stays the same for texts of any length
        hi = min(lo + _BLOCK, len(at))
        a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left")
        part = np.minimum.reduceat(rows[at[lo:hi]], np.maximum(first[a:b] - lo, 0), axis=0)
        np.minimum(out[a:b], part, out=out[a:b])
    return out, np.diff(np.append(first, len(at)))


#: Steps of a group size per e-fold, in the eight bits that tell the number of words.
_SIZE_STEPS = 20


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, places = slices(), {}
    mult = np.random.default_rng(21).integers(1, 1 << 63, LAST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = np.random.default_rng(22).integers(1, 1 << 63, bands_of(LAST), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in batches:
            ids, group, widths, all_texts = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(), b.column(3)
            for r in np.unique(widths):
                mine = np.flatnonzero(widths == r)
                n_bands = bands_of(int(r))
                texts = all_texts.take(pa.array(mine)).to_pylist()
                for lo in range(0, len(texts), _STEP):
                    sig, size = signatures(texts[lo : lo + _STEP], rows[:, : BITS + r * n_bands], places)
                    part, n = mine[lo : lo + _STEP], len(sig)
                    v = sig[:, BITS:].reshape(n, n_bands, r).astype(np.uint64) + np.uint64(1)
                    key = (v * mult[:r]).sum(axis=2, dtype=np.uint64) + salt[:n_bands] + group[part, None]
                    key ^= key >> np.uint64(31)
                    key *= np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                    key *= np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(32)
                    steps = np.minimum(_SIZE_STEPS * np.log(size), 255).astype(np.uint8)
                    bits = np.concatenate([np.packbits((sig[:, :BITS] & 1).astype(np.uint8), axis=1), steps[:, None]], axis=1).view(np.int64)
                    out = [pa.array(key.view(np.int64).ravel()), *[pa.array(np.repeat(x, n_bands)) for x in (ids[part], bits[:, 0], bits[:, 1])]]
                    yield pa.RecordBatch.from_arrays(out, names=["key", "c", "s", "t"])


def _words(c: str):
    return F.array_distinct(F.split(c, " ", -1))


def classes(df: DataFrame, rid: str = "review_id", group: str = "sku", text: str = "text_norm") -> DataFrame:
    """``(rid, sku, text, c, c2)`` of the records with at least ``MIN_WORDS`` distinct words; c, c2: two hashes of (sku, text)."""
    t = df.select(F.col(rid).cast("string").alias("rid"), F.col(group).cast("string").alias("sku"), F.col(text).alias("text"))
    t = t.where(F.col("rid").isNotNull() & F.col("sku").isNotNull() & (F.length("text") >= 2 * MIN_WORDS - 2)).where(F.size(_words("text")) >= MIN_WORDS)
    return t.withColumn("c", F.xxhash64("sku", "text")).withColumn("c2", F.xxhash64(F.lit(1), "text", "sku"))


def widths(cls: DataFrame) -> DataFrame:
    """``(sku, r)``: the band width of each group, by its number of records; groups of the first width are left out."""
    n = cls.groupBy("sku").agg(F.count("*").alias("n")).where(F.col("n") > SMALL)
    return n.select("sku", F.least(F.lit(LAST), F.lit(FIRST) + F.ceil(F.log(F.col("n") / SMALL) / math.log(5))).cast("int").alias("r"))


def representatives(cls: DataFrame) -> DataFrame:
    """``(c, c2, sku, text, r)``: each class once with its band width, kept in the checkpoint folder in partitions by ``c``."""
    w = checkpointed(widths(cls))
    w = F.broadcast(w) if w.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else w
    wide = cls.select("c", "c2", "sku", "text").join(w, "sku", "left").withColumn("r", F.coalesce("r", F.lit(FIRST)))
    parts = max(int(cls.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions_of(cls))
    return checkpointed(wide.repartition(parts, "c").dropDuplicates(["c", "c2"]).select("c", "c2", "sku", "text", "r"))


def class_links(cls: DataFrame) -> DataFrame:
    """``(ca, ca2, cb, cb2)``: pairs of classes of one sku whose words overlap by at least the threshold."""
    reps = representatives(cls)
    keys = reps.select("c", F.xxhash64("sku").alias("g"), "r", "text").mapInArrow(_bands, "key bigint, c bigint, s bigint, t bigint")
    a, b = (keys.select("key", F.col("c").alias(f"c{x}"), F.col("s").alias(f"s{x}"), F.col("t").alias(f"t{x}")) for x in "ab")
    # the last byte in memory, the size of the set, is the highest of the number
    far = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) + F.bit_count(F.shiftleft(F.col("ta").bitwiseXOR(F.col("tb")), 8))
    apart = F.abs(F.shiftrightunsigned("ta", 56) - F.shiftrightunsigned("tb", 56))
    alike = (far <= DIFFER) & (apart <= math.ceil(_SIZE_STEPS * math.log(DENOMINATOR / NUMERATOR)) + 1)
    pairs = a.join(b.hint("merge"), "key").where((F.col("ca") < F.col("cb")) & alike).select("ca", "cb").distinct()
    ta = reps.select(F.col("c").alias("ca"), F.col("c2").alias("ca2"), F.col("sku").alias("sa"), F.col("text").alias("ta"))
    tb = reps.select(F.col("c").alias("cb"), F.col("c2").alias("cb2"), F.col("sku").alias("sb"), F.col("text").alias("tb"))
    both = pairs.join(ta, "ca").join(tb, "cb")
    both = both.withColumn("wa", _words("ta")).withColumn("wb", _words("tb"))
    # as part of a value, the comparison of skus can't become a join key that would shuffle the texts once more
    both = both.withColumn("i", F.when(F.col("sa") == F.col("sb"), F.size(F.array_intersect("wa", "wb"))).otherwise(0))
    return both.where(F.col("i") * DENOMINATOR >= NUMERATOR * (F.size("wa") + F.size("wb") - F.col("i"))).select("ca", "ca2", "cb", "cb2")


def _members(cls: DataFrame) -> DataFrame:
    """``(c, c2, rid, first, n)``: each record once for its class, with the class's first record and number of records."""
    m = cls.select("c", "c2", "rid").distinct()
    return m.join(m.groupBy("c", "c2").agg(F.count("*").alias("n"), F.min("rid").alias("first")), ["c", "c2"])


def near_pairs(df: DataFrame, rid: str = "review_id", group: str = "sku", text: str = "text_norm", copies: int | None = COPIES) -> DataFrame:
    """``(review_id_a, review_id_b)``, a < b: records of one sku whose sets of words are similar enough, each pair once.

    Records with a null id, sku or text and those of fewer than ``MIN_WORDS`` distinct words have no pair; repeated rows
    are one record. A class of more than ``copies`` copies of one text comes out as its first record with each of the
    others, and the first record alone carries its links to other texts; ``near_groups`` tells the class of every record,
    and ``copies=None`` writes all pairs. Extra columns are ignored; empty gives empty.
    """
    cls = classes(df, rid, group, text)
    links = class_links(cls)
    m = checkpointed(_members(cls))
    few = F.lit(True) if copies is None else F.col("n") <= copies
    speak = m.where(few | (F.col("rid") == F.col("first")))
    ma, mb = (speak.select(F.col("c").alias(f"c{x}"), F.col("c2").alias(f"c{x}2"), F.col("rid").alias(f"r{x}")) for x in "ab")
    across = links.join(ma, ["ca", "ca2"]).join(mb, ["cb", "cb2"]).select("ra", "rb")
    more = m.where("n > 1")
    x, y = more.select("c", "c2", "n", "first", F.col("rid").alias("ra")), more.select("c", "c2", F.col("rid").alias("rb"))
    same = x.where(few | (F.col("ra") == F.col("first"))).join(y, ["c", "c2"]).where("ra < rb").select("ra", "rb")
    pairs = across.select(F.least("ra", "rb").alias("review_id_a"), F.greatest("ra", "rb").alias("review_id_b")).where("review_id_a < review_id_b")
    return pairs.unionByName(same.select(F.col("ra").alias("review_id_a"), F.col("rb").alias("review_id_b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of undirected ``edges`` (u, v): the least node that each is connected with.

    Alternates large-star and small-star rounds, each written to the checkpoint folder, until nothing changes.
    """
    e = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = big.where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = checkpointed(small)
        if after.exceptAll(e).isEmpty() and e.exceptAll(after).isEmpty():
            break
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(df: DataFrame, rid: str = "review_id", group: str = "sku", text: str = "text_norm") -> DataFrame:
    """``(review_id, class_id, group_id, copies, links)``: one row for each record of enough words.

    ``class_id`` stands for sku and very text, ``copies`` counts its records and ``links`` the classes it is similar to; groups
    are the connected classes and ``group_id`` is the least class of the group. Nulls and repeated rows as in ``near_pairs``.
    """
    cls = classes(df, rid, group, text)
    node = lambda c, d: F.format_string("%016x%016x", F.col(c), F.col(d))
    links = checkpointed(class_links(cls).select(node("ca", "ca2").alias("u"), node("cb", "cb2").alias("v")))
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    known = components(links).join(degree, "node")
    m = _members(cls).select("rid", node("c", "c2").alias("node"), F.col("n").alias("copies"))
    out = m.join(known, "node", "left")
    return out.select(F.col("rid").alias("review_id"), F.col("node").alias("class_id"), F.coalesce("root", "node").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
