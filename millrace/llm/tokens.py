"""Byte-level BPE as a lazily determinised transducer.

The last token of the encoding of a prefix fixes the encoding: it is the only token that ends the
prefix and fits behind the last token of what precedes it. Two tokens fit if merging their bytes
gives just them. A state keeps the bytes where some token may still begin or end, with the last
token at each such place; tokens that all continuations share are emitted, so the lookahead is
bounded by the longest token. States and transitions come to be when a text first needs them.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import session

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_NAME = "byte_bpe_50k"
#: How byte-level BPE of this kind parts a text before merging (fixed value of the public vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds of the tables a worker keeps; beyond them they start anew.
MAX_STATES = 400_000
MAX_WORDS = 400_000
NONE = -1


def load_ranks(folder: str = DEFAULT_FOLDER, name: str = DEFAULT_NAME) -> dict[bytes, int]:
    """Token bytes to id of a .tiktoken vocabulary file."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _State:
    __slots__ = ("pending", "lasts", "step", "rest")

    def __init__(self, pending: bytes, lasts: tuple[int | None, ...]):
        self.pending, self.lasts = pending, lasts
        self.step: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.rest: tuple[int, ...] | None = None


class Transducer:
    """Encodes byte strings of one pre-token; ids are the ranks of the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.spines: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._renew()

    def _renew(self) -> None:
        self.start = _State(b"", (NONE,))
        self.states: dict[tuple, _State] = {(b"", (NONE,)): self.start}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one."""
        text = self.tokens[token]
        if len(text) == 1:
            return None
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            best = min(((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(token, 0))
            if best[0] >= token:
                return None  # no merges lead to it
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """(part, rank at which it is merged away) along one edge of a token's merge tree, the token itself first."""
        key = (token, right)
        if key not in self.spines:
            out, now, gone = [], token, 1 << 60
            while True:
                out.append((now, gone))
                halves = self._halves(now)
                if halves is None:
                    break
                gone, now = now, halves[1 if right else 0]
            self.spines[key] = out
        return self.spines[key]

    def fit(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges within the two tokens."""
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            known = True
            ranks, tokens = self.ranks, self.tokens
            for a, a_gone in self._spine(left, True):
                for b, b_gone in self._spine(right, False):
                    merged = ranks.get(tokens[a] + tokens[b])
                    if merged is not None and merged < a_gone and merged <= b_gone:
                        known = False
                        break
                if not known:
                    break
            if len(self.fits) > 2 * MAX_STATES:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _move(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        text = state.pending + bytes((byte,))
        end = len(text)
        lasts: list[int | None] = list(state.lasts)
        for i in range(end):
            before = lasts[i]
            token = self.ranks.get(text[i:]) if before is not None else None
            if token is not None and (before == NONE or self.fit(before, token)):
                lasts.append(token)
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        size = lambda j: len(self.tokens[lasts[j]])
        needed: set[int] = set()
        shared: set[int] | None = None
        for j in (end, *(i for i in range(end) if lasts[i] is not None and text[i:] in self.prefixes)):
            chain = [j]
            while chain[-1] > 0:
                chain.append(chain[-1] - size(chain[-1]))
            needed.update(chain)
            shared = set(chain) if shared is None else shared & set(chain)
        base = max(shared)
        emitted, j = [], base
        while j > 0:
            emitted.append(lasts[j])
            j -= size(j)
        key = (text[base:], tuple(lasts[j] if j in needed else None for j in range(base, end + 1)))
        following = self.states.get(key)
        if following is None:
            following = self.states[key] = _State(*key)
        move = state.step[byte] = (following, tuple(reversed(emitted)))
        return move

    def _finish(self, state: _State) -> tuple[int, ...]:
        if state.rest is None:
            out, j = [], len(state.pending)
            while j > 0:
                out.append(state.lasts[j])
                j -= len(self.tokens[state.lasts[j]])
            state.rest = tuple(reversed(out))
        return state.rest

    def encode(self, text: bytes) -> list[int]:
        if len(self.states) > MAX_STATES:
            self._renew()
        out: list[int] = []
        state = self.start
        for byte in text:
            move = state.step.get(byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self._finish(state))
        return out


class Encoder:
    """Splits texts and encodes the parts; words met before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.transducer = Transducer(ranks)
        self.parts = regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        words, extend = self.words, out.extend
        for word in self.parts(text):
            ids = words.get(word)
            if ids is None:
                ids = self.transducer.encode(word.encode("utf-8"))
                if len(word) <= 64:
                    if len(words) > MAX_WORDS:
                        words.clear()
                    words[word] = ids
            extend(ids)
        return out

    def decode_stream(self, ids: Iterable[int], errors: str = "replace") -> Iterator[str]:
        """Text of ids as they come; bytes of a character are held back until it is whole."""
        machine = codecs.getincrementaldecoder("utf-8")(errors)
        for i in ids:
            if text := machine.decode(self.transducer.tokens[i]):
                yield text
        if text := machine.decode(b"", final=True):
            yield text

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


def _pattern(folder: str, name: str) -> str:
    """The pattern beside the vocabulary, where the folder is a package that has one."""
    try:
        with open(f"{folder}/__init__.py", encoding="utf-8") as f:
            for line in f:
                if line.startswith("PATTERN"):
                    import ast

                    return ast.literal_eval(line.split("=", 1)[1].strip())
    except OSError:
        pass
    return PATTERN


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str = DEFAULT_FOLDER, name: str = DEFAULT_NAME) -> Encoder:
    """One encoder per worker process, with the states it has met so far."""
    key = (folder, name)
    if key not in _encoders:
        _encoders[key] = Encoder(load_ranks(folder, name), _pattern(folder, name))
    return _encoders[key]


def encode(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    folder: str = DEFAULT_FOLDER,
    name: str = DEFAULT_NAME,
    null_ids: tuple[int, ...] = (),
    empty_ids: tuple[int, ...] = (),
) -> DataFrame:
    """(key, ids) of every row, without special tokens; strings of special tokens in a text are ordinary text.

    A null text gives ``null_ids`` and an empty one ``empty_ids``, both without ids unless given;
    blanks are text. No shuffle; rows with null or equal keys stay apart.
    """
    rows = session.spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(folder, name)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ends, flat = [0], []
                for t in part.column(1).to_pylist():
                    flat.extend(null_ids if t is None else empty_ids if t == "" else coder.encode(t))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.asarray(flat, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["k", "ids"])

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count(df: DataFrame, columns: tuple[str, ...], text: str = "text", folder: str = DEFAULT_FOLDER, name: str = DEFAULT_NAME) -> DataFrame:
    """``columns`` of every row with n_tokens, the number of tokens of its text."""
    rows = session.spread(df.select(*columns, F.col(text).cast("string").alias("_text")))
    schema = rows.drop("_text").schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(folder, name)
        for batch in batches:
            sizes = pa.array([len(coder.encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], [*columns, "n_tokens"])

    return rows.mapInArrow(run, schema)
