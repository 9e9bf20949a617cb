"""Text functions: review ids, normalisation, tokens, n-grams, masking."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Emoji with a name of their own; any other is ``emoji``.
EMOJI = {"👍": "emoji_thumbs_up", "👎": "emoji_thumbs_down", "🔥": "emoji_fire", "😊": "emoji_smile", "😡": "emoji_angry"}
#: Words that no n-gram contains.
STOP_WORDS = """a about above after again against all am an and any are aren't as at be because been before being below between both but by can cannot could couldn't
did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself
him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself just let's me more most mustn't my myself no nor not of off on once only or other
ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there
there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's
where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves""".split()
#: What is masked in quoted evidence, in this order.
MASKS = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "[PHONE]"),
    (r"https?://\S+|www\.\S+", "[URL]"),
)


def review_id(sku: Column, user: Column, ts_ms: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-1 over ``sku|user|milliseconds``; a null user is empty."""
    return F.left(F.sha1(F.concat_ws("|", sku, F.coalesce(user, F.lit("")), ts_ms.cast("string"))), F.lit(16))


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    tag = re.compile(r"<[^>]+>")

    def one(t):
        if t is None or (t.isascii() and "<" not in t and "&" not in t):
            return t
        return html.unescape(tag.sub(" ", unicodedata.normalize("NFC", t)))

    return text.map(one, na_action="ignore")


def normalize(text: Column, repeats: int = 3) -> Column:
    """Composed, without markup, entities resolved, emoji as words, lower case, runs of four or more equal characters
    cut to ``repeats``, white space squeezed. Null stays null. Only composing and entities need Python."""
    t = _composed(text)
    for e, name in EMOJI.items():
        t = F.replace(t, F.lit(e), F.lit(f" {name} "))
    t = F.lower(F.regexp_replace(t, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]", " emoji "))
    t = F.regexp_replace(t, r"(?s)(.)\1{3,}", "$1" * repeats)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def token_count(text: Column) -> Column:
    """Runs of non-blank characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def ngrams(text: Column, min_len: int = 3) -> Column:
    """Words and pairs of neighbouring words of the lower-case text, without stop words and words shorter than ``min_len``."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:'[a-z]+)?)"), F.lit(1)), lambda w: (F.length(w) >= min_len) & ~w.isin(*STOP_WORDS))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.coalesce(F.concat(words, pairs), F.array().cast("array<string>"))


_WORD, _STOP = re.compile(r"[a-z0-9]+(?:'[a-z]+)?"), frozenset(STOP_WORDS)


def words_of(lower: str | None, min_len: int = 3) -> list[str]:
    """The words that `ngrams` joins, of one text in lower case."""
    return [w for w in _WORD.findall(lower) if len(w) >= min_len and w not in _STOP] if lower else []


def mask(text: Column) -> Column:
    """E-mail addresses, phone numbers and links replaced by placeholders, trimmed; null gives an empty text."""
    t = F.coalesce(text, F.lit(""))
    for pattern, name in MASKS:
        t = F.regexp_replace(t, pattern, name.replace("[", "\\[").replace("]", "\\]"))
    return F.trim(t)


def short_key(text: Column) -> Column:
    """The first 15 words in lower case, which stand for a text when evidence is deduplicated."""
    return F.array_join(F.slice(F.split(F.trim(F.lower(text)), r"\s+"), 1, 15), " ")
