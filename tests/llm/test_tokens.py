import random

import pytest
from tidewatch.llm import tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder()


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/{tokens.VOCABULARY}.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts(n=400, seed=1):
    r = random.Random(seed)
    letters = "aaabT 'és  \n\t12,.-!ll've　\U0001f600édon<|endoftext|>"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_public_tokenizer(enc, public):
    for t in texts():
        assert enc.encode(t) == public(t), t


def test_pieces_of_any_size_give_the_same_ids_and_decode_back(enc):
    r = random.Random(2)
    for t in texts(200, 3):
        cuts = sorted(r.randint(0, len(t)) for _ in range(r.choice([1, 5, 40])))
        pieces = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])]
        assert list(enc.stream(pieces)) == enc.encode(t)
        assert "".join(enc.decode(enc.encode(t))) == t


@pytest.mark.parametrize("t", ["a" * 70_000, " " * 70_000 + "x", "ab" * 40_000, "\n" * 70_000, "1234567890" * 7_000, "x" * 65_535 + " y" + "z" * 10, "!?" * 35_000])
def test_long_pretokens(enc, public, t):
    assert enc.encode(t) == public(t)


def test_transducer_memory_is_bounded(enc):
    run = tokens.Transducer(enc)
    for _ in range(200):
        list(run.feed(b"thequickbrownfox" * 16))
        assert len(run.data) <= 4 * 4 * enc.longest


def test_frame_with_nulls_empties_repeats_and_further_columns(spark, enc):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (3, " ", "x"), (4, "hello <|endoftext|>", None)], "doc_id bigint, text string, ids string")
    got = sorted((r[0], list(r[1])) for r in tokens.encode(df).collect())
    assert got == [(1, []), (2, []), (3, enc.encode(" ")), (3, enc.encode(" ")), (4, enc.encode("hello <|endoftext|>"))]
    assert 50256 not in got[-1][1]
    assert {r[0]: r[1] for r in tokens.token_counts(df).collect()}[1] == 0
    assert tokens.encode(df.limit(0)).count() == 0


def test_lookahead_is_that_of_the_merge_list(enc):
    """By the definition: the entries that the merge list makes of their own bytes."""
    want = [1] * 256
    for w in random.Random(4).sample(sorted(enc.ids), 4000) + [w for w in enc.ids if len(w) > 24]:
        if enc.merged(w) == [enc.ids[w]]:
            want[w[0]] = max(want[w[0]], len(w))
    assert all(a <= b for a, b in zip(want, enc.reach)) and max(enc.reach) <= enc.longest
    assert [b for b in range(256) if want[b] > 24 and enc.reach[b] != want[b]] == []


def test_decoding_over_frames(spark, enc):
    df = spark.createDataFrame([(1, "naïve 漢字\n\u200b x"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id bigint, text string")
    back = tokens.decode(tokens.encode(df, keep=("doc_id", "text")), keep=("doc_id", "text")).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back) and len(back) == 4
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**6])], "doc_id int, ids array<int>")
    assert sorted((r[0], r[1]) for r in tokens.decode(odd).collect()) == [(1, ""), (2, ""), (3, "\ufffd")]
