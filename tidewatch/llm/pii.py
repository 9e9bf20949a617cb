"""Personal information in free text: found by a linear-chain conditional random field, replaced by typed placeholders.

A text is cut into words and single marks. Each token has features of its own shape, spelling, ends and neighbours within
two places; weights of features and of label pairs are fitted by maximum likelihood (Adagrad on forward-backward
gradients) to the small labelled table of ``pii_labels``. Since every feature belongs to one token at one offset, the
emission of a place is the sum of five rows, one for each token around it, and a token's rows are computed once in a worker.
Viterbi runs over all texts of a batch at once, step by step, on the texts still long enough.

Tokens are compared in compatibility form without ignorable characters and look-alike letters; the text itself stays as it is.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.lookalike import _IGNORED, latin_table
from tidewatch.llm.pii_labels import CALLES, KINDS, ROADS, STREETS, WAYS, examples
from tidewatch.llm.tokens import FOLDER
from tidewatch.session import spread

LABELS = ["O", *[f"{b}-{k}" for k in KINDS for b in "BI"]]
N = len(LABELS)
OFFSETS = (-2, -1, 0, 1, 2)
#: A number with its single separators is one token, as is a word or a single mark.
_ASCII = re.compile(r"\s*(?:\+?(?:\(\d+\)[ -]?)?\d+(?:(?:[ \-./]|-? ?\(0\) ?)\d+)*(?![^\W_])|\w+|[^\w\s])", re.ASCII)
_ANY = regex.compile(r"\s*(?:\p{Cf}*[+＋]?(?:[(（][\p{Nd}\p{Cf}]+[)）][  　-]?)?\p{Nd}[\p{Nd}\p{Cf}]*(?:\p{Cf}*(?:[\s\-./－．／‐‑–]|-? ?\(0\) ?)\p{Cf}*\p{Nd}[\p{Nd}\p{Cf}]*)*(?![\p{L}\p{M}])|[\w\p{M}\p{Cf}]+|[^\w\s])")
_TYPES = 200_000
_CHARS = 400_000
_RARE = 4
#: What a token outside of any kind is worth less in decoding: a missed name does more harm than a masked word.
LEAN = 0.6


def cut(text: str) -> list[str]:
    """Tokens, each with the white space before it, so that their lengths add up to offsets."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


def lexicon(folder: str = FOLDER, vocabularies: tuple[str, ...] = ("byte_bpe_50k", "byte_bpe_multi_50k")) -> dict[str, str]:
    """How common a word is in small and with a capital letter, from its place in public vocabularies; what neither holds is not in it."""
    at: dict[str, list[int]] = {}
    for v in vocabularies:
        with open(f"{folder}/{v}.tiktoken", "rb") as f:
            for line in f:
                code, rank = line.split()
                w = base64.b64decode(code).decode("utf-8", "ignore")
                if len(w) > 2 and w[0] == " " and w[1:].isalpha() and (w[1:].islower() or w[1:].istitle()):
                    both = at.setdefault(w[1:].lower(), [1 << 20, 1 << 20])
                    k = 0 if w[1:].islower() else 1
                    both[k] = min(both[k], int(rank))
    step = lambda r: "abcd-"[0 if r < 2000 else 1 if r < 8000 else 2 if r < 22000 else 3 if r < 1 << 19 else 4]
    return {w: step(a) + step(b) for w, (a, b) in at.items()}


def shape(word: str) -> str:
    s = re.sub(r"[^\W\d_]+", lambda m: "X" if m.group().isupper() and len(m.group()) > 1 else "x" if m.group().islower() else "I" if len(m.group()) == 1 else "Xx", word)
    return re.sub(r"\d+", lambda m: f"9{min(len(m.group()), 13)}", s[:64] if s is word or len(s) > 64 else s)[:40]


class Words:
    """What is known of words: ``lex`` (see ``lexicon``) and ``table``, from look-alike letters to Latin ones."""

    def __init__(self, lex: dict[str, str], table: dict[int, str]):
        self.lex, self.table = lex, table

    def folded(self, token: str) -> str:
        """The token without white space, in compatibility form."""
        w = token.strip()
        return w if w.isascii() else _IGNORED.sub("", unicodedata.normalize("NFKC", _IGNORED.sub("", w)).translate(self.table)) or w

    def common(self, word: str) -> bool:
        """Whether a word is known in small letters and not better known with a capital one."""
        k = self.lex.get(word.lower(), "--")
        return k[0] != "-" and (k[1] == "-" or k[0] <= k[1])


def features(token: str, words: Words) -> tuple[list[str], list[str]]:
    """A token's features for its own place and those for its neighbours."""
    glued = not token[:1].isspace()
    w = words.folded(token)
    low, s = w.lower(), shape(w)
    known = words.lex.get(low, "--")
    low = re.sub(r"\d", "9", low)
    has = any(c.isdigit() for c in w)
    near = [f"w={low}", f"s={s}", f"g={glued}{s}", f"n={sum(map(str.isdigit, w)) if has else ''}"]
    if not has and w[:1].isalpha():
        near += [f"k={known}", f"ks={known}{s}"]
    own = [*near, "bias", f"gw={glued}{low[:1] if not low.isalnum() else ''}"]
    if len(w) > 3 and not has:
        own += [f"p3={low[:3]}", f"e3={low[-3:]}", f"e4={low[-4:]}", f"se={s}{low[-3:]}", f"ke={known}{low[-2:]}", f"len={min(len(w), 14)}{s}"]
        near += [f"e4={low[-4:]}"]
    if has:
        own.append(f"head={low[:2] if low[:1].isalpha() else w[:1]}{s}")
        own.append(f"sep={''.join(sorted(set(re.sub(r'[0-9a-z]', '', low))))}{sum(map(str.isdigit, w))}")
    return own, near


def barred(token: str, words: Words) -> np.ndarray:
    """What a token can't be: a name with digits, a telephone number with letters other than an extension's."""
    out = np.zeros(N, np.float32)
    w = words.folded(token)
    if any(c.isdigit() for c in w):
        out[[LABELS.index("B-name"), LABELS.index("I-name")]] = -1e3
    if any(c.isalpha() for c in w) and w.lower() not in ("x", "ext"):
        out[[LABELS.index("B-phone"), LABELS.index("I-phone")]] = -1e3
    return out


def _token_features(token: str, words: Words) -> list[tuple[int, str]]:
    own, near = features(token, words)
    return [(o, f"{o}:{f}") for o in OFFSETS for f in (own if o == 0 else near)]


class Field:
    """Weights: ``emit`` for (feature, label), ``move`` for (label, next label), ``start`` and ``stop``."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray, words: Words):
        self.names, self.emit, self.move, self.start, self.words = names, emit, move, start, words

    @classmethod
    def fit(cls, texts: list[list[tuple[str, str]]], words: Words, epochs: int = 6, batch: int = 96, rate: float = 0.4, decay: float = 2e-6, seed: int = 1) -> Field:
        """Maximum likelihood on labelled texts (lists of stretches with their kinds). Features of fewer than ``_RARE`` tokens are left out."""
        names: dict[str, int] = {}
        rows, seen = [], {}
        for parts in texts:
            text, at, spans = "".join(a for a, _ in parts), 0, []
            for a, k in parts:
                if k:
                    spans.append((at, at + len(a), k))
                at += len(a)
            tokens, y, pos = cut(text), [], 0
            for t in tokens:
                lo = pos + len(t) - len(t.lstrip())
                pos += len(t)
                k = next(((a, k) for a, b, k in spans if a <= lo < b), None)
                first = k and not (y and y[-1][1] == k)
                y.append((0 if not k else 1 + 2 * KINDS.index(k[1]) + (0 if first else 1), k))
            feats = [[] for _ in tokens]
            for i, t in enumerate(tokens):
                got = seen.get(t)
                if got is None:
                    got = seen[t] = [(o, names.setdefault(f, len(names))) for o, f in _token_features(t, words)]
                for o, f in got:
                    # a token at offset o from place p is at p + o
                    if 0 <= i - o < len(tokens):
                        feats[i - o].append(f)
            rows.append((feats, [a for a, _ in y]))
        often = np.bincount(np.array([f for fs, _ in rows for x in fs for f in x]), minlength=len(names)) >= _RARE
        index = np.cumsum(often) - 1
        names = {k: int(index[i]) for k, i in names.items() if often[i]}
        rows = [([[int(index[f]) for f in x if often[f]] for x in fs], y) for fs, y in rows]
        emit, move, start = np.zeros((len(names), N)), np.zeros((N, N)), np.zeros(N)
        se, sm, ss = np.full(len(names), 1e-6), np.full((N, N), 1e-6), np.full(N, 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            big = 16 * batch  # texts of like length go together
            order = [i for lo in range(0, len(order), big) for i in sorted(order[lo : lo + big], key=lambda i: -len(rows[i][1]))]
            for lo in rng.permutation(range(0, len(order), batch)):
                part = [rows[i] for i in order[lo : lo + batch]]
                part = [p for p in part if p[1]]
                if not part:
                    continue
                n, size = len(part), len(part[0][1])
                lens = np.array([len(p[1]) for p in part])
                flat = np.array([f for p in part for fs in p[0] for f in fs])
                count = np.array([len(fs) for p in part for fs in p[0]])
                tok = np.repeat(np.arange(len(count)), count)
                e_flat = np.add.reduceat(emit[flat], np.cumsum(count) - count, axis=0)
                base = np.cumsum(lens) - lens
                mask = np.arange(size)[None] < lens[:, None]
                at = np.where(mask, base[:, None] + np.arange(size)[None], 0)
                e, y = e_flat[at], np.zeros((n, size), int)
                y[mask] = np.concatenate([p[1] for p in part])
                # forward and backward in probabilities, rescaled at every place
                step = np.exp(move)
                e = np.exp(e - e.max(axis=2, keepdims=True)).transpose(1, 0, 2) + 1e-30
                fwd, scale = np.empty((size, n, N)), np.ones((size, n, 1))
                now = np.exp(start) * e[0]
                for t in range(size):
                    if t:
                        now = np.where(mask[:, t, None], (fwd[t - 1] @ step) * e[t], fwd[t - 1])
                    scale[t] = now.sum(1, keepdims=True)
                    fwd[t] = now / scale[t]
                bwd, gm = np.ones((n, N)), np.zeros((N, N))
                prob = np.empty((n, size, N))
                for t in range(size - 1, -1, -1):
                    prob[:, t] = fwd[t] * bwd
                    prob[:, t] /= prob[:, t].sum(1, keepdims=True)
                    if t:
                        inner = np.where(mask[:, t, None], e[t] * bwd / scale[t], 0.0)
                        gm += (fwd[t - 1].T @ inner) * step
                        bwd = np.where(mask[:, t, None], inner @ step.T, bwd)
                gs = prob[:, 0].sum(0) - np.bincount(y[:, 0], minlength=N)
                both = mask[:, 1:]
                np.subtract.at(gm, (y[:, :-1][both], y[:, 1:][both]), 1)
                d = prob[mask]
                d[np.arange(len(d)), y[mask]] -= 1
                order_f = np.argsort(flat, kind="stable")
                f_sorted = flat[order_f]
                first = np.flatnonzero(np.r_[True, f_sorted[1:] != f_sorted[:-1]])
                g, used = np.add.reduceat(d[tok[order_f]], first, axis=0), f_sorted[first]
                g += decay * n * emit[used]
                se[used] += (g**2).sum(1)
                emit[used] -= rate * g / np.sqrt(se[used])[:, None]
                sm += gm**2
                move -= rate * gm / np.sqrt(sm)
                ss += gs**2
                start -= rate * gs / np.sqrt(ss)
        keep = np.abs(emit).max(1) > 1e-3
        index = np.cumsum(keep) - 1
        names = {k: int(index[i]) for k, i in names.items() if keep[i]}
        move = move.copy()
        for a, la in enumerate(LABELS):  # an I label follows only B or I of its kind
            for b, lb in enumerate(LABELS):
                if lb[0] == "I" and la[1:] != lb[1:]:
                    move[a, b] = -1e4
        start = np.where([x[0] == "I" for x in LABELS], -1e4, start)
        return cls(names, emit[keep].astype(np.float32), move.astype(np.float32), start.astype(np.float32), words)


class Tagger:
    """Decoding by one field, with the rows of the tokens met so far."""

    def __init__(self, field: Field):
        self.f = field
        self._reset()

    def _reset(self) -> None:
        self.types: dict[str, int] = {}
        self.table = np.zeros((1024, len(OFFSETS), N), np.float32)

    def _add(self, token: str) -> int:
        i = len(self.types)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for o, f in _token_features(token, self.f.words):
            k = self.f.names.get(f)
            if k is not None:
                self.table[i, o + 2] += self.f.emit[k]
        self.table[i, 2] += barred(token, self.f.words)
        self.table[i, 2, 0] -= LEAN
        self.types[token] = i
        return i

    def labels(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The best label sequence of each token list."""
        if len(self.types) > _TYPES:
            self._reset()
        get, add = self.types.get, self._add
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        if not order:
            return out
        ids = []
        for i in order:
            for t in texts[i]:
                k = get(t)
                ids.append(add(t) if k is None else k)
        ids = np.array(ids)
        lens = np.array([len(texts[i]) for i in order])
        base = np.cumsum(lens) - lens
        e = self.table[ids, 2].copy()
        head = np.zeros(len(ids), np.int64)
        head[base] = 1
        place = np.arange(len(ids)) - np.repeat(base, lens)
        left = np.repeat(lens, lens) - place - 1
        for o in (1, 2):
            ok = left[:-o] >= o if len(ids) > o else np.zeros(0, bool)
            e[:-o][ok] += self.table[ids[o:][ok], 2 + o]
            e[o:][ok] += self.table[ids[:-o][ok], 2 - o]
        size, n = int(lens[0]), len(lens)
        active = np.searchsorted(-lens, -np.arange(size), side="left")  # texts longer than t come first
        move = self.f.move.T.copy()  # [next, previous]
        score = self.f.start + e[base]
        back = [None] * size
        for t in range(1, size):
            k = active[t]
            s = score[:k, None, :] + move[None]
            b = s.argmax(axis=2)
            back[t] = b.astype(np.int8)
            score[:k] = np.take_along_axis(s, b[:, :, None], 2)[:, :, 0] + e[base[:k] + t]
        y = score.argmax(axis=1).astype(np.int8)
        flat = np.zeros(len(ids), np.int8)
        for t in range(size - 1, -1, -1):
            k = active[t]
            flat[base[:k] + t] = y[:k]
            if t:
                y[:k] = back[t][np.arange(k), y[:k]]
        for j, i in enumerate(order):
            out[i] = flat[base[j] : base[j] + lens[j]]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of what is found in each text."""
        tokens = [cut(t) for t in texts]
        out = []
        for text, toks, y in zip(texts, tokens, self.labels(tokens)):
            found: list[tuple[int, int, str]] = []
            if y.any():
                pos = np.concatenate([[0], np.cumsum([len(t) for t in toks])])
                for i in np.flatnonzero(y):
                    kind, begins = KINDS[(y[i] - 1) // 2], y[i] % 2
                    lo, hi = int(pos[i + 1] - len(toks[i].lstrip())), int(pos[i + 1])
                    if not begins and found and found[-1][2] == kind:
                        found[-1] = (found[-1][0], hi, kind)
                    else:
                        found.append((lo, hi, kind))
                found = [s for s in found if plausible(text[s[0] : s[1]], s[2], self.f.words)]
            out.append(found)
        return out


_AT = re.compile(r"@|\bat\b|[(\[{]\s*(?:at|a|ät)\s*[)\]}]", re.I)


def _kinds_of(words: list[str]) -> str:
    return "|".join(re.escape(w.rstrip(".")) for w in sorted(set(words)))


#: Number, name and kind of a street in the orders of the languages.
_STREET = re.compile(
    rf"\d\w?\W+(?:[\w'’-]+\W+){{0,3}}(?:{_kinds_of(ROADS)})(?!\w)|\d\w?\W+(?:bis\W+|ter\W+)?(?:{_kinds_of(STREETS)})\W+\w|(?<!\w)(?:{_kinds_of(CALLES)})\W+(?:[\w'’.-]+\W+){{1,4}}\d|(?:{_kinds_of(WAYS)})\W+\d", re.I
)
_PARTICLES = set("van von der den de del della di da dos das du la le zu ten ter el al bin and y e".split())


def plausible(span: str, kind: str, words: Words) -> bool:
    """What any span of a kind must have."""
    s = words.folded(span)
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        return bool(_AT.search(s)) and bool(re.search(r"\.|\bdot\b", s, re.I))
    if kind == "phone":
        return 7 <= digits <= 15
    if kind == "id_number":
        return digits >= 6
    if kind == "address":
        return digits >= 1 and bool(_STREET.search(s))
    parts = [w for w in re.findall(r"[^\W\d_]{2,}", s) if w.lower() not in _PARTICLES]
    # written with capitals throughout or nowhere, and if not just the first letters are large, no plain words throughout
    even = len(parts) >= 2 and digits == 0 and len({w[0].isupper() for w in parts}) == 1
    return even and (all(w[0].isupper() and w[1:2].islower() for w in parts) or not all(map(words.common, parts)))


_FIELDS: dict[tuple[int, str], Field] = {}


def field(n_examples: int = 6000, folder: str = FOLDER) -> Field:
    """The field fitted to the labelled table, once in a process; ``folder`` holds the public vocabularies that tell common words."""
    key = (n_examples, folder)
    if key not in _FIELDS:
        _FIELDS[key] = Field.fit(examples(n_examples), Words(lexicon(folder), latin_table()))
    return _FIELDS[key]


_TAGGERS: dict[tuple[int, float], Tagger] = {}


def _tagger(m: Field) -> Tagger:
    """The process's tagger, whose token rows serve all tasks of a worker."""
    key = (len(m.names), float(m.emit.sum()))
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(m)
    return _TAGGERS[key]


def _tagged(texts: list[str | None], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """Spans of each text, decoded in portions of about ``_CHARS`` characters; a text is never split."""
    out: list[list[tuple[int, int, str]]] = []
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= _CHARS:
            out += tagger.spans(part)
            part, size = [], 0
    return out + tagger.spans(part)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    for lo, hi, kind in reversed(spans):
        text = f"{text[:lo]}[{kind.upper()}]{text[hi:]}"
    return text


def replace_pii(df: DataFrame, text: str = "text_raw", keep: tuple[str, ...] = ("review_id",), model: Field | None = None) -> DataFrame:
    """``(keep..., text_masked, kinds array<string>)``: each text with personal information replaced by ``[EMAIL]``, ``[PHONE]``,
    ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[NAME]``, everything else unchanged, and the sorted kinds that were found.

    Null stays null with no kinds; empty and blank texts stay as they are. One row for each row that goes in, repeated rows
    too; texts of any length are decoded whole; other columns are ignored.
    """
    m = model or field()
    rows = df.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(m)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            spans = _tagged(texts, tagger)
            masked = pa.array([None if t is None else mask(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
            kinds = pa.array([sorted({k for _, _, k in s}) for s in spans], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], masked, kinds], names=[*b.schema.names[:-1], "text_masked", "kinds"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return spread(rows).mapInArrow(run, f"{kinds}, text_masked string, kinds array<string>")


def kinds_found(df: DataFrame, text: str = "text_raw", rid: str = "review_id", model: Field | None = None) -> DataFrame:
    """``(review_id, kind)``: one row for each record and kind that occurs in it; repeated records count once, null texts have none."""
    m = model or field()
    rows = df.select(F.col(rid).alias("review_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(m)
        for b in batches:
            spans = _tagged(b.column(1).to_pylist(), tagger)
            at = [(i, k) for i, s in enumerate(spans) for k in {k for _, _, k in s}]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in at], pa.int32())), pa.array([k for _, k in at], pa.string())], names=["review_id", "kind"])

    return spread(rows).mapInArrow(run, "review_id string, kind string").distinct()
