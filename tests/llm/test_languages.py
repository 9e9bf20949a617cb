import random
from pathlib import Path

import numpy as np
import pytest
from tidewatch.llm import languages as lg

EN = "The handle broke after two days and we wrote to the shop. It was not what they had said about it. "
DE = "Der Griff ist nach zwei Tagen gebrochen und wir haben an den Laden geschrieben. Das war nicht gut für uns. "
FR = "La poignée s'est cassée après deux jours et nous avons écrit au magasin. Ce n'est pas très bien pour nous. "


@pytest.fixture(scope="module")
def model():
    return lg.fit([(EN, "en"), (DE, "de"), (FR, "fr"), (DE, "en")])


def langs(model, text):
    segs = lg.infer([lg.clean(text)], model)[0]
    return [lg.LANGUAGES[k] for k in lg.languages_of(segs)] if segs else []


def test_single_mixed_and_scraps(model):
    assert langs(model, EN) == ["en"] and langs(model, DE.upper()) == ["de"]
    assert sorted(langs(model, EN + DE)) == ["de", "en"]
    assert langs(model, EN + "«La poignée s'est cassée après deux jours.» " + EN) == ["en"]
    assert langs(model, EN + FR.split(". ")[0] + ". " + EN) == ["en"]
    assert langs(model, "") == langs(model, "12 34") == langs(model, "спасибо") == []


def test_mixture_against_brute_force():
    r = np.random.default_rng(1)
    for _ in range(20):
        true = r.integers(0, 3, 8)
        ll = np.full((8, 7), -40.0)
        ll[np.arange(8), true] = 0.0
        chosen, post = lg.mixtures(ll, np.full(8, 10), np.array([0]))
        assert set(np.flatnonzero(chosen[0])) == set(true) and (post.argmax(1) == true).all()


def test_segments_cover_the_text(model):
    t = lg.clean("Hm. " + EN + DE + "ok")
    segs = lg.infer([t], model)[0]
    assert segs[0][0] == 0 and segs[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(segs, segs[1:])) and [lg.LANGUAGES[s[2]] for s in segs] == ["en", "de"]


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en", " EN ", "en_GB", "de-AT", "deu", "German", "", None, "xx", "??", "unknown")], "lang string")
    assert [r[0] for r in df.select(lg.label_of(df["lang"])).collect()] == ["en", "en", "en", "de", "de", "de", None, None, None, None, None]


def test_frames(spark, model, rows):
    data = [(1, EN, "en", 0), (1, EN, "en", 0), (2, DE, "en", 0), (3, EN + FR, "en", 0), (4, None, "en", 0), (5, "", None, 0), (6, "ja so", None, 0), (7, DE, None, 0), (8, EN * 2000, "English", 0)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, label int")
    assert rows(lg.mislabelled(df, model)) == [(2, "de"), (3, "en"), (3, "fr"), (7, "de")]
    assert lg.identify(df, model).count() == len(data)
    s = rows(lg.segment(df.where("doc_id = 3"), model))
    assert [(x[1], x[2], x[4]) for x in s] == [(0, "en", 2), (1, "fr", 2)] and "".join(x[5] for x in s) == lg.clean(EN + FR) and all(0.5 < x[3] <= 1 for x in s)
    empty = df.limit(0)
    assert lg.mislabelled(empty).count() == 0 and lg.segment(empty).count() == 0


def test_fit_forgives_wrong_labels(spark):
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr"), (FR, "de"), (EN, None)])], "doc_id bigint, text string, lang string")
    assert rows_of(lg.mislabelled(df)) == {(3, "fr"), (4, "en")}


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_unknown_languages_and_letters_have_none(spark):
    table = "/root/testdata/sf0.01/documents.parquet"
    if not Path(table).exists():
        pytest.skip("needs the test tables")
    m = lg.trained(spark.read.parquet(table))
    for t in ("Это русский текст о погоде и о чае. Сегодня хорошо.", "これは日本語の文章です。今日はいい天気。", "Tämä on suomenkielinen lause joka kertoo säästä ja teestä.", "zzzz qqqq xkcd wwww", "Ez egy magyar mondat a teáról és az időjárásról."):
        assert langs(m, t) == [], t
    got = lg.segment(spark.createDataFrame([(1, "Это русский текст о погоде и о чае.")], "doc_id bigint, text string"), m).collect()
    assert [(r["lang"], r["confidence"] > 0.9) for r in got] == [(None, True)]
    # short pieces: the mean confidence is about the share that is right, judged by what the whole text is in
    r, pieces = random.Random(1), {1: [], 2: [], 4: []}
    for row in spark.read.parquet(table).where("length(text) > 200").orderBy("doc_id").collect():
        whole = langs(m, row["text"])
        words = [w for s in lg.sentences(lg.clean(row["text"])) for w in s[2]]
        if len(whole) == 1 and len(words) > 20:
            for k, out in pieces.items():
                i = r.randrange(len(words) - k)
                out.append((words[i : i + k], whole[0]))
    for k, out in pieces.items():
        c = lg.confidence(m.scores([w for w, _ in out]))
        right = np.mean([x != lg.OTHER and lg.LANGUAGES[x] == t for x, (_, t) in zip(c.argmax(1), out)])
        assert abs(right - c.max(1).mean()) < 0.12 and (k > 1 or c.max(1).min() < 0.6), (k, right, c.max(1).mean())
