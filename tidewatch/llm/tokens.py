"""Encoding with a public byte-level BPE vocabulary by a streaming transducer with bounded lookahead.

Inside a pretoken (a run that the vocabulary's split pattern yields) the transducer keeps, for every end position,
the last token of the encoding of the bytes up to there. A token t may end at a position if its neighbour before it,
the last token at t's start, is compatible: the merge list encodes the two tokens' bytes as just these two tokens.
Encodings of byte-level BPE are exactly the chains of pairwise compatible tokens, so one token qualifies at each position.

Sufficient lookahead: ``reach`` computes it from the merge list. A token of a final encoding is an entry that the merges
build from its bytes (``merged`` of the entry gives the entry alone); L is the greatest length of these, over the entries
that begin with the byte at hand: a token that begins at a byte b ends within L(b) bytes. Whatever follows, the final
chain passes from some position into the unread, and that token began at most L(b) before; so only the positions whose
byte's L reaches the end of what is read can be its start. The tokens shared by the chains of all of these are stable and
are emitted; only what lies behind them is kept. A pretoken without an end (a text of one letter a million times) is thus
encoded in constant memory.

Split points need at most three further characters, so texts of any length are read in pieces.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import spread

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 16
#: Characters that a split point may depend on behind its match.
AHEAD = 3
#: Pretokens up to this length are remembered, at most this many of them in a worker.
REMEMBER_CHARS, REMEMBER = 48, 200_000


class Encoder:
    """Encoding and decoding by one vocabulary; ``encode`` of an empty text is ``[]``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: w for w, i in self.ids.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.lengths: dict[int, tuple[int, ...]] = {}
        ends: dict[int, set[int]] = {}
        for w in self.ids:
            ends.setdefault(w[-1], set()).add(len(w))
        for b, n in ends.items():
            self.lengths[b] = tuple(sorted(n, reverse=True))
        self.reach = self._reach()
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(PATTERN)
        self._kinds = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")]

    def _reach(self) -> list[int]:
        """For each first byte the most bytes of a token that the merge list builds.

        An entry is built if two shorter built entries join to it; entries are met in order of rank, in which a merge's
        parts come before it.
        """
        built, reach = {bytes([b]) for b in range(256)}, [1] * 256
        for w in self.ids:  # in order of rank
            if len(w) > 1 and any(w[:i] in built and w[i:] in built for i in range(1, len(w))):
                built.add(w)
                reach[w[0]] = max(reach[w[0]], len(w))
        return reach

    def merged(self, data: bytes) -> list[int]:
        """The merge list applied to ``data`` in order of rank: what defines an encoding."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ids.get(parts[i] + parts[i + 1], 1 << 30)), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b, next to each other, stay as they are."""
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            got = self._fits[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def word(self, word: str) -> tuple[int, ...]:
        got = self._known.get(word)
        if got is None:
            got = tuple(Transducer(self).run([word.encode("utf-8", "replace")]))
            if len(word) <= REMEMBER_CHARS:
                if len(self._known) >= REMEMBER:
                    self._known.clear()
                self._known[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        if len(text) > PIECE:
            return list(self.stream(text[i : i + PIECE] for i in range(0, len(text), PIECE)))
        out: list[int] = []
        known, word = self._known, self.word
        for w in self._split.findall(text):
            out += known.get(w) or word(w)
        return out

    def stream(self, pieces: Iterable[str]) -> Iterator[int]:
        """Ids of the pieces' concatenation; holds about one piece, whatever the text."""
        held, run, kind = "", None, None  # run: the transducer of a pretoken that goes on; kind: its character class
        for piece in self._ended(pieces):
            last, held = piece is None, held + (piece or "")
            while held:
                if run is not None:
                    end = kind.match(held)
                    end = end.end() if end else 0
                    going_on = end == len(held) and not last
                    space = kind is self._kinds[2]
                    if space and end and (going_on or end < len(held)):
                        end -= 1  # the last white space of a run belongs to what follows
                    yield from run.feed(held[:end].encode("utf-8", "replace"))
                    held = held[end:]
                    if going_on:
                        break
                    yield from run.finish()
                    run = None
                    continue
                at = 0
                for m in self._split.finditer(held):
                    if m.end() + AHEAD > len(held) and not last:
                        break
                    yield from self.word(m.group())
                    at = m.end()
                held = held[at:]
                if last or len(held) <= 2 * AHEAD + 2:
                    break
                body = held[1:] if held[0] == " " and not held[1].isspace() else held
                kind = next(k for k in self._kinds if k.match(body))
                if kind.match(body).end() < len(body) - AHEAD:
                    continue
                run = Transducer(self)
                yield from run.feed(held[: len(held) - len(body)].encode())
                held = body
        if run is not None:
            yield from run.finish()

    @staticmethod
    def _ended(pieces: Iterable[str]) -> Iterator[str | None]:
        yield from pieces
        yield None

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids as it becomes certain: a byte-to-text state machine holds up to three bytes of a character."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := state.decode(self.bytes_of.get(i, b"\xff")):
                yield text
        if text := state.decode(b"", True):
            yield text


class Transducer:
    """One pretoken, fed in pieces."""

    def __init__(self, encoder: Encoder):
        self.e, self.data, self.last, self.back = encoder, bytearray(), [-1], [0]

    def run(self, pieces: Iterable[bytes]) -> Iterator[int]:
        for p in pieces:
            yield from self.feed(p)
        yield from self.finish()

    def feed(self, piece: bytes) -> Iterator[int]:
        e, step = self.e, max(256, 4 * self.e.longest)
        for lo in range(0, len(piece), step):
            for b in piece[lo : lo + step]:
                self.data.append(b)
                self._advance()
            if len(self.data) > 2 * e.longest:
                yield from self._emit()

    def _advance(self) -> None:
        e, data, last = self.e, self.data, self.last
        i = len(data)
        for n in e.lengths.get(data[-1], ()):
            if n > i:
                continue
            t = e.ids.get(bytes(data[i - n : i]))
            if t is None:
                continue
            before = last[i - n]
            if before == -1 or e.fits(before, t):
                last.append(t)
                self.back.append(i - n)
                return
        raise ValueError("no encoding ends here")

    def _emit(self) -> Iterator[int]:
        """The tokens shared by the chains of all positions within the lookahead."""
        n, back, reach = len(self.data), self.back, self.e.reach
        # the chain ends here, or its next token begins at a position whose byte reaches beyond the end
        heads = {n, *(i for i in range(max(1, n - self.e.longest + 1), n) if i + reach[self.data[i]] > n)}
        while len(heads) > 1:  # the latest position steps back until one is left
            at = max(heads)
            heads.discard(at)
            heads.add(back[at])
        cut = heads.pop()
        if cut:
            yield from self._chain(cut)
            left = self.last[cut]
            # the last stable token stays as the neighbour of what follows, at position 0
            self.data = self.data[cut:]
            self.last = [left, *self.last[cut + 1 :]]
            self.back = [0, *(b - cut for b in self.back[cut + 1 :])]

    def _chain(self, at: int) -> list[int]:
        out = []
        while at:
            out.append(self.last[at])
            at = self.back[at]
        return out[::-1]

    def finish(self) -> Iterator[int]:
        yield from self._chain(len(self.data))


_ENCODERS: dict[str, Encoder] = {}


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Encoder:
    """The vocabulary, loaded once in a process."""
    path = f"{folder}/{vocabulary}.tiktoken"
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(keep..., ids array<int>)``: the ids of every text, without special tokens; their strings are ordinary text.

    The ids of a null text are the empty list, as are those of an empty text; a blank text has the ids of its white space.
    One row comes out for each row that goes in, repeated rows too; other columns are ignored. Every executor reads the
    vocabulary from ``folder``.
    """
    rows = df.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for b in batches:
            ids = pa.array([e.encode(t) if t else [] for t in b.column(b.num_columns - 1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=[*b.schema.names[:-1], "ids"])

    return spread(rows).mapInArrow(run, f"{kinds}, ids array<int>")


def token_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(keep..., n_tokens int)`` by the same transducer; 0 for null and empty texts."""
    rows = df.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for b in batches:
            n = pa.array([len(e.encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return spread(rows).mapInArrow(run, f"{kinds}, n_tokens int")


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(keep..., decoded string)``: the text of every list of ids, by the incremental byte-to-text machine; empty for null and empty lists.

    Bytes that are no text come out as replacement characters, as do ids that the vocabulary lacks.
    """
    rows = df.select(*keep, F.col(ids).alias("_ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, vocabulary)
        for b in batches:
            texts = pa.array(["".join(e.decode(x)) if x else "" for x in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*b.schema.names[:-1], "decoded"])

    return spread(rows).mapInArrow(run, f"{kinds}, decoded string")
