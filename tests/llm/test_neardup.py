import itertools
import random

import numpy as np
from tidewatch.llm import neardup as nd

SCHEMA = "review_id string, sku string, text_norm string, c string, key string, rid string"


def near(a, b):
    a, b = set(a.split(" ")), set(b.split(" "))
    return len(a) >= 30 and len(b) >= 30 and len(a & b) * 10 >= 7 * len(a | b)


def records(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        base = r.sample(words, r.randint(28, 60))
        for j in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.3:
                r.shuffle(w)
            out.append((f"r{i:03}-{j}", f"s{i % 3}", " ".join(w)))
    return out + [(f"{i}-copy", s, t) for i, s, t in out[::9]]


def frame(spark, recs):
    return spark.createDataFrame([(*x, "?", "?", "?") for x in recs], SCHEMA)


def brute(recs):
    recs = sorted(set(recs))
    return sorted((min(a[0], b[0]), max(a[0], b[0])) for a, b in itertools.combinations(recs, 2) if a[1] == b[1] and a[0] != b[0] and near(a[2], b[2]))


def test_pairs_equal_brute_force(spark, rows):
    recs = records()
    assert rows(nd.near_pairs(frame(spark, recs + recs[:20]))) == brute(recs)


def test_wider_bands_for_larger_groups_keep_the_reach(spark, monkeypatch, rows):
    recs = records(2) + [(f"q{i}", "s9", t) for i, (_, s, t) in enumerate(records(3, 8))]
    for small in (1, 10):
        monkeypatch.setattr(nd, "SMALL", small)
        r = {x["sku"]: x["r"] for x in nd.widths(nd.classes(frame(spark, recs))).collect()}
        assert len(set(r.values())) > 1 or small == 10
        got, want = set(rows(nd.near_pairs(frame(spark, recs)))), set(brute(recs))
        word_sets = {i: set(t.split(" ")) for i, _, t in recs}
        alike = lambda p: len(word_sets[p[0]] & word_sets[p[1]]) / len(word_sets[p[0]] | word_sets[p[1]])
        # the reach at the threshold itself is 0.997; above it nothing may be lost
        assert got <= want and not [p for p in want - got if alike(p) >= 0.75] and len(got) >= 0.98 * len(want)


def test_reach_of_the_bands():
    for r in range(nd.FIRST, nd.LAST + 1):
        assert 1 - (1 - 0.7**r) ** nd.bands_of(r) >= 0.997


def test_odd_records(spark, rows):
    t = " ".join(f"v{i}" for i in range(40))
    recs = [("a", "s", t), ("b", "s", t), ("c", None, t), ("d", "s", None), (None, "s", t), ("e", "s", ""), ("f", "s", "short one"), ("g", "s", t + " "), ("h", "s", "  ".join(t.split()))]
    assert rows(nd.near_pairs(frame(spark, recs))) == brute([x for x in recs if None not in x])
    assert nd.near_pairs(frame(spark, recs).limit(0)).count() == 0


def test_very_long_text(spark, rows):
    t = " ".join(f"v{i}" for i in range(60_000))
    recs = [("a", "s", t), ("b", "s", t + " more words"), ("c", "s", "other " + " ".join(f"u{i}" for i in range(50)))]
    assert rows(nd.near_pairs(frame(spark, recs))) == [("a", "b")]


def test_many_copies_become_a_star_without_losing_links(spark, rows):
    t = " ".join(f"v{i}" for i in range(40))
    recs = [(f"a{i}", "s", t) for i in range(8)] + [("b", "s", t + " x")]
    assert rows(nd.near_pairs(frame(spark, recs), copies=5)) == sorted([("a0", f"a{i}") for i in range(1, 8)] + [("a0", "b")])
    assert rows(nd.near_pairs(frame(spark, recs), copies=None)) == brute(recs) == rows(nd.near_pairs(frame(spark, recs)))
    g = {r["review_id"]: r for r in nd.near_groups(frame(spark, recs)).collect()}
    assert len(g) == 9 and len({r["group_id"] for r in g.values()}) == 1 and len({r["class_id"] for r in g.values()}) == 2
    assert {(r["copies"], r["links"]) for r in g.values()} == {(8, 1), (1, 1)}


def test_groups(spark):
    t = " ".join(f"v{i}" for i in range(40))
    chain = [("a", "s", t), ("b", "s", t + " x1 x2 x3 x4 x5 x6 x7 x8 x9 y1"), ("c", "s", t + " x1 x2 x3 x4 x5 x6 x7 x8 x9 y1 z1 z2 z3 z4 z5 z6 z7 z8 z9 z0 k1 k2"), ("d", "s2", t), ("e", "s", t)]
    g = {r["review_id"]: (r["group_id"], r["copies"]) for r in nd.near_groups(frame(spark, chain)).collect()}
    assert len(g) == 5 and g["a"] == g["e"] and g["a"][1] == 2 and g["a"][0] == g["b"][0] == g["c"][0] != g["d"][0]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2")], "u string, v string")
    got = {r["node"]: r["root"] for r in nd.components(e).collect()}
    assert set(got.values()) == {"n000", "z1"} and len(got) == 63


def test_signatures_are_minima_over_shifted_values():
    rows = nd.slices()
    places = {}
    sig, size = nd.signatures(["a b c", "c a b", "a a"], rows, places)
    assert list(size) == [3, 3, 1]
    assert (sig[0] == sig[1]).all()
    assert (sig[0] == np.min([rows[places[w]] for w in "abc"], axis=0)).all()
    assert (rows[5][1:] == rows[6][:-1]).all()
