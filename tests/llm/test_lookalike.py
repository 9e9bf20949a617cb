import itertools
import random
import unicodedata

import pytest
from tidewatch.llm import lookalike as la


@pytest.fixture(scope="module")
def reader(spark):
    return la.reader(spark)


@pytest.mark.parametrize(
    "text, form",
    [
        ("The \u200blid\xad", "The lid"), ("Ｔｈｅ　ｌｉｄ", "The lid"), ("cafe\u0301", "café"), ("сhаrger", "charger"), ("ΑΘΗΝΑ", "ΑΘΗΝΑ"), ("AΘHNA", "ΑΘΗΝΑ"), ("Іѕland", "Island"), ("Ꭺpple", "Apple"), ("ɑpple", "apple"),
        ("коляскa", "коляска"), ("a    b\n", "a b"), ("", ""), (" \t", ""), ("Ж", "Ж"), ("хор", "xop"), ("Хорошо, хор поёт", "Хорошо, хор поёт"), ("x\ufe0f", "x"), ("ı", "ı"), ("OK", "OK"), ("ОК", "OK"),
    ],
)
def test_forms(reader, text, form):
    assert la.Former(reader).form(text) == form


def test_search_finds_the_best_path(reader):
    for main in ("Latin", "Cyrillic"):
        for w in ("кoлягa", "AΘHNAx", "oнoп", "Мocквa", "noя", "aиeи", "Іѕland", "сор"):
            sk = unicodedata.normalize("NFKD", w)
            best = max(reader.path_score(sk, "".join(p), main) for p in itertools.product(*[reader.readings(c) for c in sk]))
            assert reader.path_score(sk, reader.resolve(sk, main), main) == pytest.approx(best)


def test_the_scores_decide(reader):
    """One look, two readings: a table of letters can't tell them apart."""
    assert reader.resolve("І") != reader.resolve("І", "Cyrillic")
    assert reader.resolve("хор") == "xop" and reader.resolve("xop", "Cyrillic") == "хор"
    assert reader.resolve("Іѕland") == "Island" and reader.resolve("ӏеmon") == "lemon"


def test_what_looks_the_same_comes_out_the_same(reader):
    f, rng = la.Former(reader), random.Random(5)
    latin = {}
    for c in reader.twins:
        t = la.latin_table(reader).get(ord(c))
        if t and la.script(c) in ("Cyrillic", "Greek"):
            latin.setdefault(t, []).append(c)
    for text in ("Plain words, as they are, and OK at 5 p.m.", "Zoe has a copy of the TOP CASE", "una coperta poco cara", "SEHR GUT, ABER ZU TEUER"):
        for _ in range(20):
            other = "".join(rng.choice(latin[c]) if c in latin and rng.random() < 0.3 else c for c in text)
            assert f.form(other) == f.form(text) == text


def test_latin_words_stay_and_differences_stay(reader):
    f = la.Former(reader)
    for w in ("Plain words, as they are.", "naïve", "Straße", "coração"):
        assert f.form(w) == w
    for a, b in (("resume", "résumé"), ("Lid", "lid"), ("a.", "a!"), ("<b>a", "a"), ("Ill", "lIl")):
        assert f.form(a) != f.form(b)


def test_form_is_stable(reader):
    f = la.Former(reader)
    for w in ("AΘHNA", "коляскa", "Ｔ\xadhе", "ẹ́", "日本о"):
        assert f.form(f.form(w)) == f.form(w)


SCHEMA = "review_id string, sku string, text_raw string, text_norm string, f string, raw string"
LONG = "a sentence that is long enough to count"


def test_pairs(spark, rows):
    data = [
        ("r1", "s", LONG, "short", "", ""), ("r2", "s", LONG.replace("e", "е"), "short", "", ""), ("r3", "s", f" {LONG}​ ", None, "", ""), ("r4", "s", LONG, None, "", ""), ("r5", "t", LONG.replace("o", "о"), None, "", ""),
        ("r6", "s", LONG.upper(), LONG, "", ""), ("r2", "s", LONG.replace("e", "е"), "short", "", ""), ("r7", "s", None, None, "", ""), ("r8", None, LONG, LONG, "", ""), ("r9", "s", "", LONG.replace(" ", " "), "", ""), (None, "s", LONG, LONG, "", ""),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(la.alike_pairs(df)) == [("text_norm", "r6", "r9"), ("text_raw", "r1", "r2"), ("text_raw", "r1", "r3"), ("text_raw", "r2", "r3"), ("text_raw", "r2", "r4"), ("text_raw", "r3", "r4")]
    assert la.alike_pairs(df.limit(0)).count() == 0


def test_many_copies_keep_every_text_linked(spark):
    data = [(f"a{i}", "s", LONG, None, "", "") for i in range(5)] + [(f"b{i}", "s", LONG.replace("e", "е"), None, "", "") for i in range(3)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r[1], r[2]) for r in la.alike_pairs(df, most=4).collect()}
    assert got == {(f"a{i}", "b0") for i in range(5)} | {("a0", f"b{i}") for i in range(3)}
    every = {(f"a{i}", f"b{j}") for i in range(5) for j in range(3)}
    assert {(r[1], r[2]) for r in la.alike_pairs(df, most=None).collect()} == every == {(r[1], r[2]) for r in la.alike_pairs(df).collect()}
    groups = la.alike_groups(df).collect()
    assert len(groups) == 8 and len({r["class_id"] for r in groups}) == 1 and {(r["review_id"][0], r["copies"], r["variants"]) for r in groups} == {("a", 5, 2), ("b", 3, 2)}
    assert la.alike_groups(df.limit(0)).count() == 0


def test_unify_keeps_rows(spark, rows):
    df = spark.createDataFrame([("r", "s", "сat ", None), ("r", "s", "сat ", None), (None, None, "", "x" * 50_000)], "review_id string, sku string, text_raw string, text_norm string")
    assert rows(la.unify(df)) == sorted([("r", "s", "cat", None)] * 2 + [(None, None, "", "x" * 50_000)], key=repr)
