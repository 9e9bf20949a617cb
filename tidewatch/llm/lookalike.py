"""One consistent form for text that looks the same.

Compatibility decomposition, deletion of ignorable characters and one space for any run of white space come first.
Then each word is a lattice: at every letter stand all letters that look like it, by the public table of confusable
characters (Unicode TS 39, read from the ICU library of the session). Viterbi search takes the path with the best score:
character trigrams of each script, counted over the words of public vocabularies; a change of script within a word costs
``SWITCH``, a letter that changes its case ``CASE``, and a script other than the main one of the text ``PRIOR`` a word. The
main script is that of the letters which look like those of no other. Lattice and main script depend only on what the text
looks like, so texts that look the same come out the same, and texts that don't, don't. The result is composed.

An ASCII word is its own best path unless all of its letters have twins in one other script; only such words are searched.
"""

from __future__ import annotations

import base64
import math
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.tokens import FOLDER
from tidewatch.session import checkpointed, spread

#: Scripts with trigrams; letters of other scripts are read in one of these where they look like it, and stay otherwise.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")
#: Pairs that look the same in most fonts and that the table has elsewhere.
FURTHER = (("ӏ", "l"),)
SWITCH, CASE, PRIOR, FLOOR = 60.0, 6.0, 14.0, -11.0
MIN_CHARS = 25
#: Variants whose copies make at most this many pairs come out as all of them (``None``: always).
PAIRS = 40_000

_IGNORED = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\p{Cc}--\t\n\v\f\r\x1c-\x1f\x85]+", regex.V1)
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_FOREIGN = regex.compile(r"[\p{L}--\p{Latin}]", regex.V1)
_NAMED = {s: regex.compile(rf"\p{{{s}}}") for s in SCRIPTS}


def script(ch: str) -> str:
    return next((s for s, p in _NAMED.items() if p.match(ch)), "other")


def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Each letter of the scripts' blocks, and of others, with the skeleton of the public table where it is one letter's."""
    letters = [c for c in map(chr, range(0x41, 0x1E950)) if not 0x3400 <= ord(c) <= 0xABFF and not 0xAC00 <= ord(c) <= 0xDFFF and not 0xE000 <= ord(c) <= 0xFAFF and c.isalpha() and unicodedata.normalize("NFKD", c) == c]
    icu = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = icu.getSkeleton("\n".join(letters)).split("\n")
    return {c: s for c, s in zip(letters, skeletons) if len(s) == 1}


def twins(skeletons: dict[str, str]) -> dict[str, tuple[str, ...]]:
    """For each letter the letters of ``SCRIPTS`` that it may be read as, itself first.

    A Latin letter of ASCII is never read as another Latin one: case and accent are differences. Dotless and barred
    forms of Latin letters stay as they are.
    """
    groups: dict[str, list[str]] = {}
    for c, s in skeletons.items():
        groups.setdefault(s, []).append(c)
    for a, b in FURTHER:
        groups.setdefault(skeletons.get(b, b), []).append(a)
        groups[f"{a}{b}"] = [a, b]
    out = {}
    for members in groups.values():
        members = list(dict.fromkeys(members))
        read = [m for m in members if script(m) != "other" and (script(m) != "Latin" or m.isascii())]
        for c in members:
            own = c.isascii() or script(c) != "Latin" or c in "ɑɡ"
            others = [m for m in read if m != c and not (script(c) == script(m) == "Latin" and c not in "ɑɡ") and own]
            keep = [c] if script(c) in SCRIPTS and c not in "ɑɡ" or not others else []
            if others:
                out[c] = tuple(dict.fromkeys((*keep, *out.get(c, ()), *sorted(others, key=lambda m: (SCRIPTS.index(script(m)), m)))))
    return out


def trigrams(folder: str = FOLDER, vocabularies: tuple[str, ...] = ("byte_bpe_50k", "byte_bpe_multi_50k")) -> dict[str, dict[str, float]]:
    """Log-probabilities of a letter after two others (``^`` before a word), by script, from words weighted by their rank."""
    counts: dict[str, dict[str, float]] = {s: {} for s in SCRIPTS}
    whole = {s: regex.compile(rf"\p{{{s}}}+") for s in SCRIPTS}
    for v in vocabularies:
        with open(f"{folder}/{v}.tiktoken", "rb") as f:
            for line in f:
                code, rank = line.split()
                w = base64.b64decode(code).decode("utf-8", "ignore")
                if w[:1] == " ":
                    start, w = "^^", w[1:]
                else:
                    start = "  "
                w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).lower()
                s = next((s for s in SCRIPTS if whole[s].fullmatch(w)), None)
                if s:
                    x = start + w
                    for i in range(2 if start == "^^" else 4, len(x)):
                        counts[s][x[i - 2 : i + 1]] = counts[s].get(x[i - 2 : i + 1], 0.0) + 1e4 / (1e3 + int(rank))
    out = {}
    for s, got in counts.items():
        heads: dict[str, float] = {}
        letters: dict[str, float] = {}
        for t, n in got.items():
            heads[t[:2]] = heads.get(t[:2], 0.0) + n
            letters[t[2]] = letters.get(t[2], 0.0) + n
        total = sum(letters.values()) or 1.0
        out[s] = {t: math.log(0.9 * n / heads[t[:2]] + 0.1 * letters[t[2]] / total) for t, n in got.items()} | {c: math.log(0.1 * n / total) for c, n in letters.items()}
    return out


class Reader:
    """The lattice search, with twins and trigrams at hand; it holds plain dictionaries, so that it can be sent to workers."""

    def __init__(self, alike: dict[str, tuple[str, ...]], scores: dict[str, dict[str, float]]):
        self.twins, self.scores, self.key = alike, scores, hash((len(alike), tuple(sorted(alike)), tuple(len(x) for x in scores.values())))
        self.scripts = {c: script(c) for c in {x for c, t in alike.items() for x in (c, *t)}}
        lone = "".join(regex.escape(c) for c in alike if c.isascii() and any(self.scripts[t] != "Latin" for t in alike[c]))
        #: words of ASCII letters that all have twins elsewhere, and letters that have none
        self.doubtful = regex.compile(rf"(?<!\p{{L}})[{lone}]+(?!\p{{L}})") if lone else None
        self.sure = {s: regex.compile(rf"[\p{{{s}}}--[{''.join(regex.escape(c) for c, t in alike.items() if self.scripts[c] == s)}]]" if any(self.scripts[c] == s for c in alike) else rf"\p{{{s}}}", regex.V1) for s in SCRIPTS}

    def readings(self, letter: str) -> tuple[str, ...]:
        """All letters that look like a letter, in an order that is the same for all of them."""
        t = self.twins.get(letter)
        return tuple(sorted({letter, *t} if letter in t else t, key=lambda c: (SCRIPTS.index(self.scripts[c]), c))) if t else (letter,)

    def _of(self, c: str) -> str:
        return self.scripts.get(c) or script(c)

    def letter_score(self, before: str, c: str, s: str) -> float:
        p = self.scores.get(s)
        if p is None:
            return FLOOR
        c = c.lower()
        got = p.get(before + c)
        return got if got is not None else p.get(c, FLOOR)

    def path_score(self, seen: str, path: str, main: str) -> float:
        """What the search maximises over the paths of a lattice (base letters only); ``seen`` is the word as it is stored."""
        total, prev, before = 0.0, None, "^^"
        for a, c in zip(seen, path):
            s = self._of(c)
            total += self.letter_score(before, c, s) - (SWITCH if prev not in (None, s) else 0.0) - (PRIOR if prev is None and s != main else 0.0) - self.case_cost(a, c)
            before, prev = before[1] + c.lower(), s
        return total

    @staticmethod
    def case_cost(a: str, c: str) -> float:
        return CASE if a.isupper() != c.isupper() else 0.0

    def resolve(self, word: str, main: str = "Latin") -> str:
        """The best reading of a decomposed word of letters and marks. Ties go to the reading that comes first."""
        best: dict[tuple[str, str], tuple[float, str]] = {("^^", ""): (0.0, "")}
        for a in word:
            if unicodedata.combining(a):
                best = {k: (v, p + a) for k, (v, p) in best.items()}
                continue
            step: dict[tuple[str, str], tuple[float, str]] = {}
            for c in self.readings(a):
                s = self._of(c)
                for (before, prev), (v, p) in best.items():
                    v += self.letter_score(before, c, s) - (SWITCH if prev and prev != s else 0.0) - (PRIOR if not prev and s != main else 0.0) - self.case_cost(a, c)
                    k = (before[1] + c.lower(), s)
                    if k not in step or v > step[k][0]:
                        step[k] = (v, p + c)
            best = step
        return max(best.values(), key=lambda x: x[0])[1]


_READERS: dict[str, Reader] = {}


def reader(spark: SparkSession | None = None, folder: str = FOLDER) -> Reader:
    """The reader of a process, made once on the driver."""
    if folder not in _READERS:
        _READERS[folder] = Reader(twins(confusable_letters(spark or SparkSession.active())), trigrams(folder))
    return _READERS[folder]


def latin_table(read: Reader | None = None) -> dict[int, str]:
    """For ``str.translate``: letters of other scripts to the Latin letter of their case that they look like."""
    read = read or reader()
    to = {c: next((t for t in ts if t.isascii() and t.isupper() == c.isupper()), None) for c, ts in read.twins.items() if not c.isascii()}
    return {ord(c): t for c, t in to.items() if t}


class Former:
    """``form(text)``, with the stretches between white space met so far remembered, for each main script."""

    def __init__(self, read: Reader | None = None, most: int = 400_000):
        self.read, self.most = read or reader(), most
        self.known: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}

    def main(self, text: str) -> str:
        """The script of most letters that have no twin elsewhere; Latin where there are none or as many."""
        if not _FOREIGN.search(text):
            return "Latin"
        text = _bare(text)
        n = {s: len(p.findall(text)) for s, p in self.read.sure.items()}
        return max(SCRIPTS, key=lambda s: (n[s], s == "Latin"))

    def _stretch(self, w: str, main: str) -> str:
        known = self.known[main]
        if len(known) >= self.most:
            known.clear()
        x = w if w.isascii() and w.isprintable() else _bare(w)
        if not x.isascii() or main != "Latin":
            x = unicodedata.normalize("NFC", _LETTERS.sub(lambda m: self.read.resolve(m.group(), main), x))
        elif self.read.doubtful:
            x = self.read.doubtful.sub(lambda m: self.read.resolve(m.group()), x)
        known[w] = x
        return x

    def form(self, text: str) -> str:
        plain = text.isascii()
        main = "Latin" if plain else self.main(text)
        known, new = self.known[main], self._stretch
        out = " ".join([known.get(w) or new(w, main) for w in text.split()])
        return out if plain and text.isprintable() else " ".join(out.split())


_FORMERS: dict[int, Former] = {}


def former(read: Reader) -> Former:
    """The process's former, whose memory serves all tasks of a worker."""
    if read.key not in _FORMERS:
        _FORMERS[read.key] = Former(read)
    return _FORMERS[read.key]


def _bare(text: str) -> str:
    """The text decomposed by compatibility, without ignorable characters."""
    return _IGNORED.sub("", unicodedata.normalize("NFKD", _IGNORED.sub("", text)))


def unify(df: DataFrame, columns: tuple[str, ...] = ("text_raw", "text_norm"), keep: tuple[str, ...] = ("review_id", "sku")) -> DataFrame:
    """``(keep..., columns...)`` with each of ``columns`` in its consistent form.

    Null stays null; empty and blank texts become empty. Rows are neither merged nor dropped; other columns are ignored.
    """
    rows = df.select(*keep, *columns)
    k, read = len(keep), reader(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = former(read)
        for b in batches:
            done = [pa.array([None if t is None else f.form(t) for t in c.to_pylist()], pa.string()) for c in b.columns[k:]]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *done], names=b.schema.names)

    return spread(rows).mapInArrow(run, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema))


def _keys(fields: tuple[str, ...], read: Reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f_, cut = former(read), lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            ids, skus = b.column(0), b.column(1).to_pylist()
            for f in range(len(fields)):
                at, h1, h2, raw = [], [], [], []
                for i, t in enumerate(b.column(2 + f).to_pylist()):
                    if t and len(form := f_.form(t)) >= MIN_CHARS:
                        h = xxhash.xxh3_128_intdigest(f"{f}\0{skus[i]}\0{form}".encode("utf-8", "replace"))
                        at.append(i)
                        h1.append(cut(h & 0xFFFFFFFFFFFFFFFF))
                        h2.append(cut(h >> 64))
                        raw.append(cut(xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace"))))
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(at), pa.int8()), ids.take(pa.array(at, pa.int32())), *[pa.array(x, pa.int64()) for x in (h1, h2, raw)]], names=["f", "rid", "h1", "h2", "raw"])

    return run


_H = ["f", "h1", "h2"]


def hashed(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``(f, rid, h1, h2, raw)``: a row for each record and field of enough characters; h1, h2: hash of sku and form, raw: of the code points.

    Kept in the checkpoint folder, so that the forms are made once.
    """
    rows = df.select(F.col("review_id").cast("string").alias("rid"), F.col("sku").cast("string").alias("sku"), *fields).where("rid is not null and sku is not null")
    return checkpointed(spread(rows).mapInArrow(_keys(fields, reader(df.sparkSession)), "f tinyint, rid string, h1 bigint, h2 bigint, raw bigint"))


def _field(fields: tuple[str, ...]):
    return F.element_at(F.array(*[F.lit(x) for x in fields]), F.col("f").cast("int") + 1)


def alike_pairs(df: DataFrame, fields: tuple[str, ...] = ("text_raw", "text_norm"), most: int | None = PAIRS) -> DataFrame:
    """``(field, review_id_a, review_id_b)``, a < b: reviews of one sku whose field differs in code points but looks the same.

    Only texts of at least ``MIN_CHARS`` characters in their form count; rows with a null id, sku or text have no pair;
    repeated rows are one. Texts are compared by hashes (128 bits of sku and form, 64 of the code points). Two variants with
    more than ``most`` pairs of copies come out as all copies of each with the first of the other, and ``alike_groups`` tells
    the copies of each; ``most=None`` writes every pair.
    """
    rows = hashed(df, fields)
    varied = rows.groupBy(*_H).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*_H)
    m = checkpointed(rows.join(varied, _H, "left_semi").distinct())
    v = m.groupBy(*_H, "raw").agg(F.count("*").alias("n"), F.min("rid").alias("first"))
    va, vb = (v.select(*_H, F.col("raw").alias(f"raw{x}"), F.col("n").alias(f"n{x}"), F.col("first").alias(f"first{x}")) for x in "ab")
    links = va.join(vb, _H).where("rawa < rawb")
    ma, mb = (m.select(*_H, F.col("raw").alias(f"raw{x}"), F.col("rid").alias(f"r{x}")) for x in "ab")
    few = F.lit(True) if most is None else F.col("na") * F.col("nb") <= most
    pairs = links.where(few).select(*_H, "rawa", "rawb").join(ma, [*_H, "rawa"]).join(mb, [*_H, "rawb"]).select("f", "ra", "rb")
    if most is not None:
        many = links.where(~few)
        left = many.join(ma, [*_H, "rawa"]).select("f", "ra", F.col("firstb").alias("rb"))
        right = many.join(mb, [*_H, "rawb"]).select("f", F.col("firsta").alias("ra"), "rb")
        pairs = pairs.unionByName(left).unionByName(right)
    pairs = pairs.where("ra <> rb")
    return pairs.select(_field(fields).alias("field"), F.least("ra", "rb").alias("review_id_a"), F.greatest("ra", "rb").alias("review_id_b")).distinct()


def alike_groups(df: DataFrame, fields: tuple[str, ...] = ("text_raw", "text_norm")) -> DataFrame:
    """``(field, review_id, class_id, variant_id, copies, variants)``: one row for each review and field of enough characters.

    ``class_id`` stands for sku and form, ``variant_id`` for the very code points; ``copies`` counts the reviews with this
    variant and ``variants`` the links of the class to other variants plus one. Nulls and repeated rows as in ``alike_pairs``.
    """
    m = hashed(df, fields).distinct()
    v = m.groupBy(*_H, "raw").agg(F.count("*").alias("copies"))
    n = v.groupBy(*_H).agg(F.count("*").alias("variants"))
    out = m.join(v.join(n, _H), [*_H, "raw"])
    return out.select(_field(fields).alias("field"), F.col("rid").alias("review_id"), F.format_string("%016x%016x", "h1", "h2").alias("class_id"), F.format_string("%016x", "raw").alias("variant_id"), "copies", "variants")
