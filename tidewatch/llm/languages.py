"""Languages of documents and of their parts by multilingual mixture inference.

A character n-gram model per language gives each sentence its likelihood under each language; a pooled letter model that
knows no language (``OTHER``) stands for everything else. A document is a mixture: expectation-maximisation estimates the
proportions of all languages from its sentences. Languages then enter its set one by one, the one that raises the likelihood
most first, while the rise exceeds ``PENALTY`` plus half the logarithm of the number of words; the proportions of the set are
then estimated anew. Sentences go to the most probable language of the set; neighbours of one language form a segment. Its
confidence is the posterior of its language among all languages and ``OTHER``, likelihoods tempered by ``TEMPERATURE``, since
neighbouring letters are not independent.

The models are fitted on a bounded sample of documents with a usable label (``SAMPLE`` for each language, chosen by hash) and
refitted on those sentences that the first fit finds in the labelled language, since some labels are wrong. A few
common words of each language are counted besides, for languages that the sample lacks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.lookalike import _IGNORED
from tidewatch.session import spread

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl")
#: Other spellings of the languages, lower case.
NAMES = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish", "it": "it ita italian", "pt": "pt por portuguese", "nl": "nl nld dut dutch",
}
#: Common words of each language.
COMMON = {
    "en": "the of and to in is was for that it with as on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our even most me after also did many",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine uhr viel",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la ou avec mais comme on tout nous sa fait été aussi leur bien peut ces y cette à son entre deux sans je elle très même après être avait encore dont était avoir moins ils aux donc car quand notre nos vous mon faire",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora",
    "it": "di e il la che a in un per è una sono con non del si da le dei al come più i nel della ma lo ha alla gli anche delle ci mi se o questo quando molto cui era suo dalla tra essere sua dopo prima ai due loro fatto stato così poi tutti dal quella senza ancora solo anni noi ho quello perché su già bene",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm",
    "nl": "de van een het en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit nog worden door naar heeft tot ze wordt over hij werd was meer deze kan al geen ik had wel moet zou dit je zich haar hun zo toch zal mensen veel mijn ons onze wat nu kunnen onder twee na geen men weer gaat goed hebben",
}
SAMPLE, SAMPLE_CHARS = 150, 20_000
ORDER, PENALTY, ROUNDS = 4, 8.0, 12
#: The column of texts in no known language, and what an n-gram likelihood counts for as evidence.
OTHER, TEMPERATURE = len(LANGUAGES), 2.5
#: What a word of ``OTHER`` costs besides its letters: rare words of a language are still its words.
STRANGE = 3.0
MIN_WORDS, MIN_SENTENCE_WORDS = 4, 2
_TYPES = 200_000

_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\s*[\r\n]+\s*|\s+/\s+")
_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r"«[^«»]*»|„[^„“”]*[“”]|“[^“”]*”|(?<!\w)\"[^\"\n]*\"(?!\w)|<[^<>]*>|&[a-z]+;")


def clean(text: str) -> str:
    return text if text.isascii() else _IGNORED.sub("", unicodedata.normalize("NFC", text))


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences; words in quotes, markup and those with digits are left out."""
    out, at = [], 0
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        s = text[at:end]
        if s.strip():
            if "«" in s or '"' in s or "„" in s or "“" in s or "<" in s or "&" in s:
                s = _QUOTED.sub(" ", s)
            words = [w for w in _WORD.findall(s.lower()) if w.isalpha()]
            out.append((at, end, words))
        at = m.end() if m else end
    return out


class Model:
    """Interpolated (Witten-Bell) character n-grams of all languages and a pooled letter model, as vectors over both.

    The score of a letter depends on itself and the three before it, so it is computed once for each such stretch.
    """

    def __init__(self, texts: list[tuple[list[str], int]]):
        k = len(LANGUAGES)
        counts: dict[str, np.ndarray] = {}
        for words, lang in texts:
            for w in words:
                w = f"^{w}$"
                for i in range(1, len(w)):
                    for n in range(min(ORDER, i + 1)):
                        g = w[i - n : i + 1]
                        v = counts.get(g)
                        if v is None:
                            v = counts[g] = np.zeros(k)
                        v[lang] += 1
        heads: dict[str, list[np.ndarray]] = {}
        for g, v in counts.items():
            c = heads.setdefault(g[:-1], [np.zeros(k), np.zeros(k)])
            c[0] += v
            c[1] += v > 0
        # dictionaries of numbers and two tables are quickly sent to workers
        self.grams = {g: i for i, g in enumerate(counts)}
        self.heads = {h: i for i, h in enumerate(heads)}
        self.counts = np.array(list(counts.values())) if counts else np.zeros((0, k))
        self.totals = np.array([c[0] for c in heads.values()]) if heads else np.zeros((0, k))
        self.kinds = np.array([c[1] for c in heads.values()]) if heads else np.zeros((0, k))
        letters = {g: v.sum() for g, v in counts.items() if len(g) == 1}
        total = sum(letters.values()) or 1.0
        self.pooled = {g: 0.9 * n / total + 0.1 / 200 for g, n in letters.items()}
        self.key = hash((len(counts), float(self.counts.sum()), len(texts)))
        self._forget()

    def _forget(self) -> None:
        self.stretches: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.letter_rows = np.zeros((4096, OTHER + 1))
        self.word_rows = np.zeros((4096, OTHER + 1))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("stretches", "words", "letter_rows", "word_rows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _stretch(self, g: str) -> int:
        i = len(self.stretches)
        if i == len(self.letter_rows):
            self.letter_rows = np.concatenate([self.letter_rows, np.zeros_like(self.letter_rows)])
        p = np.full(OTHER, 1 / 200)
        for n in range(len(g)):
            h = self.heads.get(g[len(g) - 1 - n : -1])
            if h is None:
                continue
            c = self.grams.get(g[len(g) - 1 - n :])
            t, d = self.totals[h], self.kinds[h]
            p = np.where(t > 0, ((self.counts[c] if c is not None else 0.0) + d * p) / np.maximum(t + d, 1), p)
        self.letter_rows[i, :OTHER] = np.log(np.maximum(p, 1e-9))
        self.letter_rows[i, OTHER] = np.log(self.pooled.get(g[-1], 0.1 / 200) if g[-1] != "$" else 0.2)
        self.stretches[g] = i
        return i

    def _add(self, new: list[str]) -> None:
        """Rows of words not met before."""
        get, make = self.stretches.get, self._stretch
        flat, starts = [], []
        for w in new:
            starts.append(len(flat))
            x = f"^{w}$"
            for i in range(1, len(x)):
                g = x[max(0, i - ORDER + 1) : i + 1]
                k = get(g)
                flat.append(make(g) if k is None else k)
        sums = np.add.reduceat(self.letter_rows[np.array(flat)], np.array(starts), axis=0)
        at = len(self.words)
        while at + len(new) > len(self.word_rows):
            self.word_rows = np.concatenate([self.word_rows, np.zeros_like(self.word_rows)])
        sums[:, OTHER] -= STRANGE
        self.word_rows[at : at + len(new)] = sums
        self.words.update(zip(new, range(at, at + len(new))))

    def scores(self, sents: list[list[str]]) -> np.ndarray:
        """Log-likelihood (sentences x languages and other)."""
        if len(self.words) > _TYPES or len(self.stretches) > _TYPES:
            self._forget()
        new = list(dict.fromkeys(w for s in sents for w in s if w not in self.words))
        if new:
            self._add(new)
        at = self.words
        flat = np.array([at[w] for s in sents for w in s], dtype=np.int64)
        lens = np.array([len(s) for s in sents])
        out = np.zeros((len(sents), OTHER + 1))
        full = lens > 0
        if full.any():
            out[full] = np.add.reduceat(self.word_rows[flat], (np.cumsum(lens) - lens)[full], axis=0)
        return out


_MODELS: dict[int, Model] = {}


def _shared(m: Model) -> Model:
    """The process's copy of a model, whose rows serve all tasks of a worker."""
    if m.key not in _MODELS:
        _MODELS.clear()
        _MODELS[m.key] = m
    return _MODELS[m.key]


def fit(texts: list[tuple[str, str]]) -> Model:
    """From (text, language) pairs: fitted twice, the second time on the sentences that agree with their label."""
    seeds = [(c.split(), LANGUAGES.index(lang)) for lang, c in COMMON.items()]
    data = [(s[2], LANGUAGES.index(lang)) for t, lang in texts for s in sentences(clean(t)) if len(s[2]) >= MIN_SENTENCE_WORDS]
    if not data:
        return Model(seeds)
    first = Model(seeds + data)
    best = first.scores([w for w, _ in data])[:, :OTHER].argmax(1)
    return Model(seeds + [x for x, b in zip(data, best) if x[1] == b])


def _lse(x: np.ndarray) -> np.ndarray:
    m = x.max(1)
    return m + np.log(np.exp(x - m[:, None]).sum(1))


def _proportions(ll: np.ndarray, sizes: np.ndarray, starts: np.ndarray, doc: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Proportions of the member languages by expectation-maximisation, sentences weighted by their words."""
    words = np.maximum(np.add.reduceat(sizes, starts), 1)[:, None]
    pi = member / member.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        a = np.where(member, np.log(np.maximum(pi, 1e-300)), -1e9)[doc] + ll
        r = np.exp(a - _lse(a)[:, None])
        pi = np.where(member, np.maximum(np.add.reduceat(r * sizes[:, None], starts, axis=0) / words, 1e-4), 0.0)
        pi /= pi.sum(1, keepdims=True)
    return pi


def mixtures(ll: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language sets (documents x columns, bool) and sentence posteriors, from sentence likelihoods and word counts.

    ``starts`` are the first sentences of the documents, each of which has at least one.
    """
    lens = np.diff(np.append(starts, len(ll)))
    doc = np.repeat(np.arange(len(starts)), lens)
    ll = ll - ll.max(1, keepdims=True)
    every = np.ones((len(starts), ll.shape[1]), bool)
    pi = _proportions(ll, sizes, starts, doc, every)
    chosen = np.zeros_like(every)
    chosen[np.arange(len(starts)), np.add.reduceat(ll, starts, axis=0).argmax(1)] = True
    # only documents in which a further language has mass can gain by one
    live = np.flatnonzero(np.where(chosen, 0, pi).max(1) > 5e-4)
    while len(live):
        keep = np.isin(doc, live)
        sub_ll, sub_lens = ll[keep], lens[live]
        first = np.cumsum(sub_lens) - sub_lens
        sub_doc = np.repeat(np.arange(len(live)), sub_lens)
        words = np.add.reduceat(sizes[keep], first)
        p, have = pi[live], chosen[live]

        def total(member: np.ndarray) -> np.ndarray:
            q = np.where(member, p, 0)
            q = q / q.sum(1, keepdims=True)
            a = np.where(member, np.log(np.maximum(q, 1e-300)), -1e9)[sub_doc] + sub_ll
            return np.add.reduceat(_lse(a), first)

        now = total(have)
        gain = np.full_like(p, -np.inf)
        for k in np.flatnonzero((np.where(have, 0, p) > 5e-4).any(0)):
            more = have.copy()
            more[:, k] = True
            gain[:, k] = np.where(have[:, k], -np.inf, total(more) - now)
        best = gain.argmax(1)
        add = gain[np.arange(len(live)), best] > PENALTY + 0.5 * np.log(np.maximum(words, 1))
        chosen[live[add], best[add]] = True
        live = live[add]
    p = _proportions(ll, sizes, starts, doc, chosen)
    a = np.where(chosen, np.log(np.maximum(p, 1e-300)), -1e9)[doc] + ll
    return chosen, np.exp(a - _lse(a)[:, None])


def confidence(ll: np.ndarray) -> np.ndarray:
    """Posterior over all columns of tempered likelihoods, each column as probable beforehand."""
    a = (ll - ll.max(-1, keepdims=True)) / TEMPERATURE
    e = np.exp(a)
    return e / e.sum(-1, keepdims=True)


def infer(texts: list[str], model: Model) -> list[list[tuple[int, int, int, float, int, int]]]:
    """Segments (start, end, column, confidence, sentences, words) of each text, offsets in its cleaned form.

    A sentence of fewer than ``MIN_SENTENCE_WORDS`` words has no language of its own and belongs to the segment before it,
    or after it at the start of a text. A text without any other sentence has no segment. The column ``OTHER`` is no language.
    """
    sents = [sentences(t) for t in texts]
    flat = [(i, s) for i, x in enumerate(sents) for s in x if len(s[2]) >= MIN_SENTENCE_WORDS]
    out: list[list] = [[] for _ in texts]
    if not flat:
        return out
    owner = np.array([i for i, _ in flat])
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.array([len(s[2]) for _, s in flat])
    ll = model.scores([s[2] for _, s in flat])
    _, post = mixtures(ll, sizes, starts)
    lang = post.argmax(1)
    # a segment begins at every document and every change of language
    heads = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (lang[1:] != lang[:-1])])
    sure = confidence(np.add.reduceat(ll, heads, axis=0))[np.arange(len(heads)), lang[heads]]
    words, tails = np.add.reduceat(sizes, heads), np.append(heads[1:], len(flat))
    for h, e, c, w in zip(heads, tails, sure, words):
        segs = out[owner[h]]
        segs.append((flat[h][1][0] if segs else 0, 0, int(lang[h]), float(c), int(e - h), int(w)))
    for i, segs in enumerate(out):
        for j, (lo, _, x, c, n, w) in enumerate(segs):
            segs[j] = (lo, segs[j + 1][0] if j + 1 < len(segs) else len(texts[i]), x, c, n, w)
    return out


def languages_of(segs: list[tuple[int, int, int, float, int, int]]) -> dict[int, float]:
    """The languages that count in a text, with their share of its words weighted by confidence.

    One that is alone counts from one sentence on; of several, those with two neighbouring sentences count, or if none has
    them, the one with most words. What is in no known language doesn't count.
    """
    known = [s for s in segs if s[2] != OTHER]
    held = {s[2] for s in known}
    if len(held) > 1:
        held = {s[2] for s in known if s[4] >= 2} or {max(known, key=lambda s: s[5])[2]}
    total = sum(s[5] for s in segs)
    return {x: sum(s[3] * s[5] for s in segs if s[2] == x) / total for x in sorted(held)}


def label_of(lang: Column) -> Column:
    """The two letters that a label names, whatever its case, region or spelling; null where it names none of them."""
    base = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]+)(?:[-_][A-Za-z0-9]+)*$", 1))
    names = [F.lit(x) for two, s in NAMES.items() for n in s.split() for x in (n, two)]
    return F.try_element_at(F.create_map(*names), base)


def trained(documents: DataFrame) -> Model:
    """The model of a documents table; at most ``SAMPLE`` labelled texts of each language come to the driver."""
    rows = documents.select("doc_id", "text", label_of(F.col("lang")).alias("label")).where(F.col("label").isNotNull() & F.length("text").between(20, SAMPLE_CHARS))
    w = W.partitionBy("label").orderBy(F.xxhash64("doc_id", "text"), "doc_id")
    rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SAMPLE).select("text", "label")
    return fit(sorted((r["text"], r["label"]) for r in rows.collect()))


def _portions(texts: list[str | None], chars: int = 300_000) -> Iterator[tuple[int, list[str]]]:
    part, size, at = [], 0, 0
    for i, t in enumerate(texts):
        part.append(clean(t or ""))
        size += len(part[-1])
        if size >= chars:
            yield at, part
            part, size, at = [], 0, i + 1
    if part:
        yield at, part


def segment(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, segment, lang, confidence, sentences, text)``: the parts of each document in one language, in order from 0.

    ``text`` is the part in composed form without ignorable characters; ``lang`` is null for a part in no known language. Null, empty and blank texts and those without a
    sentence of at least two words have no segment. Repeated rows give repeated segments; extra columns are ignored.
    """
    m = model or trained(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _shared(m)
        for b in batches:
            for at, part in _portions(b.column(1).to_pylist()):
                rows = [(at + i, j, LANGUAGES[s[2]] if s[2] != OTHER else None, s[3], s[4], part[i][s[0] : s[1]]) for i, segs in enumerate(infer(part, own)) for j, s in enumerate(segs)]
                cols = list(zip(*rows)) or [()] * 6
                kinds = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int32())), *[pa.array(c, k) for c, k in zip(cols[1:], kinds)]], names=["doc_id", "segment", "lang", "confidence", "sentences", "text"])

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, "doc_id bigint, segment int, lang string, confidence double, sentences int, text string")


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, label, n_words, languages array<string>, confidences array<double>)``: one row for each row that goes in.

    ``label`` is what ``lang`` names (null for none). ``languages`` are those that count in the text, alphabetically; empty for
    null, empty and blank texts, those without words and those in no known language.
    """
    m = model or trained(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _shared(m)
        for b in batches:
            langs, conf, words = [], [], []
            for _, part in _portions(b.column(2).to_pylist()):
                for t, segs in zip(part, infer(part, own)):
                    found = sorted((LANGUAGES[x], c) for x, c in languages_of(segs).items()) if segs else []
                    langs.append([x for x, _ in found])
                    conf.append([c for _, c in found])
                    words.append(len(_WORD.findall(t)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.int32()), pa.array(langs, pa.list_(pa.string())), pa.array(conf, pa.list_(pa.float64()))], names=["doc_id", "label", "n_words", "languages", "confidences"])

    rows = documents.select(F.col("doc_id").cast("bigint"), label_of(F.col("lang")).alias("label"), "text")
    return spread(rows).mapInArrow(run, "doc_id bigint, label string, n_words int, languages array<string>, confidences array<double>")


def mislabelled(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, lang_found)``: the languages of documents that hold several or whose label does not name theirs.

    Texts of fewer than four words are no case. Repeated rows count once.
    """
    d = identify(documents, model).where(F.col("n_words") >= MIN_WORDS)
    wrong = (F.size("languages") > 1) | (F.col("languages")[0] != F.coalesce("label", F.lit("")))
    return d.where((F.size("languages") > 0) & wrong).select("doc_id", F.explode("languages").alias("lang_found")).distinct()
