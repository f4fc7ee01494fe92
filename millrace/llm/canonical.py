"""One consistent form of texts that look the same.

The texts of a batch are exploded to one relation of positioned code points (text, position, code
point), held as arrays. It is joined with a broadcast table that holds, for every code point that
changes, its canonical decomposition, the plain form of wide and narrow signs, blanks, line ends
and ligatures, and the letter it looks like. Combining marks are then ordered by class within their
run, pairs of starter and mark are joined with the table of compositions, and the strings are built
again from the positions. Since a text is never parted, no step shuffles.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import session
from millrace.operators import skew

POINTS = 0x110000
#: Scripts whose letters share shapes with Latin ones, by the first word of their Unicode names.
SCRIPTS = ("GREEK", "CYRILLIC", "ARMENIAN", "COPTIC", "CHEROKEE", "LISU")
_ONE_OF_SCRIPTS = re.compile("[Ͱ-֏Ꭰ-᏿ᲀ-᲏ᴦ-ᴫἀ-῿Ⲁ-⳿ⷠ-ⷿꓐ-꓿Ꙁ-ꚟꭰ-ꮿ]")

# Letters that Unicode's table of confusable letters calls alike, but that print differently.
NOT_ALIKE = "αγισυᴦгѡҽꙇ"
# Further letters that print like a Latin letter: that table has them only through another form.
ALSO_ALIKE: dict[str, str] = {"ӏ": "l", "Ԛ": "Q", "ϲ": "c", "Ϲ": "C", "ɡ": "g", "ⅼ": "l"}

# Other signs that print alike.
SIGNS: dict[str, str] = {"‐": "-", "‑": "-", "﹣": "-", "µ": "μ", "ʼ": "’", "∶": ":", "∕": "/", "⁄": "/"}

# Code points that print nothing.
UNSEEN = (0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF)
LINE_ENDS = (0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029)
_BLANKS = (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)


def _script(letter: str) -> str:
    return unicodedata.name(letter, "").split(" ")[0]


@lru_cache(maxsize=1)
def _letters() -> tuple[str, ...]:
    """All letters of SCRIPTS that have no other form."""
    found = (chr(c) for c in range(0x80, POINTS) if unicodedata.category(chr(c))[0] == "L")
    return tuple(c for c in found if _script(c) in SCRIPTS and not unicodedata.decomposition(c))


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts that print like a Latin letter of the same case, from Unicode's confusable letters.

    The table is that of the ICU library that Spark brings along; the driver reads it in one call.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = (*string.ascii_letters, *_letters())
    shape = dict(zip(letters, checker.getSkeleton(0, "\n".join(letters)).split("\n")))
    latin: dict[tuple[str, bool], str] = {}
    for c in string.ascii_letters:
        latin.setdefault((shape[c], c.isupper()), c)
    out = {}
    for c in _letters():
        upper = unicodedata.category(c) == "Lu" or (unicodedata.category(c) == "Lo" and (shape[c], True) in latin)
        if c not in NOT_ALIKE and (shape[c], upper) in latin:
            out[c] = latin[shape[c], upper]
    return {**out, **ALSO_ALIKE}


def plain(alike: Mapping[str, str]) -> dict[int, tuple[int, ...]]:
    """Code point to its replacement, for decomposed code points that change."""
    table: dict[int, tuple[int, ...]] = {}
    for code in (*range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x2160, 0x2180)):
        parts = unicodedata.decomposition(chr(code)).split()
        if parts and parts[0] in ("<wide>", "<narrow>", "<compat>"):
            table[code] = tuple(ord(c) for c in unicodedata.normalize("NFKD", chr(code)))
    table.update(dict.fromkeys(_BLANKS, (0x20,)))
    table.update(dict.fromkeys(LINE_ENDS, (0x0A,)))
    table.update(dict.fromkeys(UNSEEN, ()))
    for a, b in (*SIGNS.items(), *alike.items()):
        table[ord(a)] = (ord(b),)
    one = {ord(a): ord(b) for a, b in alike.items()}
    return {k: tuple(one.get(x, x) for x in v) for k, v in table.items()}


@dataclass(frozen=True)
class Rules:
    """The broadcast tables, bounded by Unicode: replacements as (codes, sizes, values), classes, and pairs that compose."""

    codes: np.ndarray
    sizes: np.ndarray
    values: np.ndarray
    marks: np.ndarray
    classes: np.ndarray
    pairs: np.ndarray
    made: np.ndarray
    back: dict[str, dict[str, str]]


def rules(alike: Mapping[str, str], table: Mapping[int, tuple[int, ...]] | None = None) -> Rules:
    """The tables for one set of look-alike letters; ``table`` replaces the plain forms if given."""
    table = plain(alike) if table is None else table
    changed: dict[int, tuple[int, ...]] = {}
    composed: dict[int, int] = {}
    classes: dict[int, int] = {}
    for code in range(POINTS):
        if code < 0x80 and code not in table or 0xD800 <= code < 0xE000:
            continue
        sign = chr(code)
        if c := unicodedata.combining(sign):
            classes[code] = c
        first = unicodedata.decomposition(sign)
        hangul = 0xAC00 <= code < 0xD7A4
        if not hangul and (not first or first[0] == "<"):
            if code in table:
                changed[code] = table[code]
            continue
        whole = unicodedata.normalize("NFD", sign)
        changed[code] = tuple(y for x in whole for y in table.get(ord(x), (ord(x),)))
        two = (unicodedata.normalize("NFC", whole[:-1]) + whole[-1]) if hangul else "".join(chr(int(x, 16)) for x in first.split())
        if len(two) == 2 and unicodedata.normalize("NFC", two) == sign:
            composed[ord(two[0]) << 32 | ord(two[1])] = code
    keys = sorted(composed)
    back: dict[str, dict[str, str]] = {}
    for letter in sorted(alike, reverse=True):  # the smallest code point wins
        back.setdefault(_script(letter), {})[alike[letter]] = letter
    return Rules(
        np.array(list(changed), np.uint32), np.array([len(v) for v in changed.values()], np.uint8), np.array([x for v in changed.values() for x in v], np.uint32),
        np.array(list(classes), np.uint32), np.array(list(classes.values()), np.uint8), np.array(keys, np.uint64), np.array([composed[k] for k in keys], np.uint32), back,
    )


class Mapper:
    """Brings many texts to their form at once."""

    def __init__(self, r: Rules):
        self.size = np.ones(POINTS, np.uint8)
        self.size[r.codes] = r.sizes
        self.start = np.zeros(POINTS, np.int64)
        self.start[r.codes] = np.cumsum(r.sizes, dtype=np.int64) - r.sizes
        self.values = r.values
        self.changes = np.zeros(POINTS, bool)
        self.changes[r.codes] = True
        self.rank = np.zeros(POINTS, np.uint8)
        self.rank[r.marks] = r.classes
        self.pairs, self.made = r.pairs, r.made
        self.joins = np.zeros(POINTS, bool)
        self.joins[(r.pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
        self.back = r.back
        self.scripts: dict[str, str] = {}

    def _replaced(self, points: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The relation joined with the replacements; a code point gives as many rows as its replacement is long."""
        hit = self.changes[points]
        if not hit.any():
            return points, text
        size = np.where(hit, self.size[points], 1).astype(np.int64)
        row = np.repeat(np.arange(len(points)), size)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        out = points[row]
        at = hit[row]
        out[at] = self.values[self.start[out[at]] + nth[at]]
        return out, text[row]

    def _ordered(self, points: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Marks of a run sorted by class, equal ones as they came."""
        at = np.flatnonzero(self.rank[points])
        if len(at):
            new_run = np.concatenate(([True], (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])))
            order = np.lexsort((at, self.rank[points[at]], np.cumsum(new_run)))
            points[at] = points[at][order]
        return points

    def _composed(self, points: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each starter with the marks that it composes with, one mark a round, from left to right."""
        todo = np.flatnonzero(self.joins[points])
        todo = todo[todo > 0]
        if not len(todo):
            return points, text
        rank = self.rank[points]
        holder = np.maximum.accumulate(np.where(rank == 0, np.arange(len(points)), -1))
        there = np.ones(len(points), bool)
        start = holder[todo - 1]
        while len(todo):
            while (gone := (start >= 0) & ~there[start]).any():
                start[gone] = np.where(start[gone] > 0, holder[start[gone] - 1], -1)
            ok = (start >= 0) & (text[start] == text[todo])
            before = todo - 1
            while (gone := ok & ~there[before] & (before > start)).any():
                before[gone] -= 1
            ok &= (before == start) | (rank[before] < rank[todo]) & (rank[before] > 0)
            key = points[start].astype(np.uint64) << np.uint64(32) | points[todo].astype(np.uint64)
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            ok &= self.pairs[place] == key
            hit = np.flatnonzero(ok)
            owner, first = np.unique(start[hit], return_index=True)
            hit = hit[first]
            points[owner] = self.made[place[hit]]
            there[todo[hit]] = False
            # What comes behind the mark may compose with the new starter, or with it in place of one that is gone.
            behind = np.full(len(points), len(points), np.int64)
            behind[owner] = todo[hit]
            top = np.where(start >= 0, start, 0)
            moved = ~there[top]
            top[moved] = holder[np.maximum(top[moved] - 1, 0)]
            more = (todo > behind[top]) & there[todo]
            todo, start = todo[more], start[more]
        return points[there], text[there]

    def _own_script(self, word: re.Match) -> str:
        """A word with letters that only one other script has gets that script's look-alikes back; this depends on the mapped word alone."""
        text = unicodedata.normalize("NFD", word.group())
        found = set()
        for c in text:
            if not c.isascii() and not unicodedata.combining(c):
                if c not in self.scripts:
                    self.scripts[c] = _script(c)
                found.add(self.scripts[c])
        if len(found) != 1 or not (back := self.back.get(next(iter(found)))) or any(c.isascii() and c not in back for c in text):
            return word.group()
        return unicodedata.normalize("NFC", "".join(back.get(c, c) for c in text))

    def __call__(self, texts: list[str]) -> list[str]:
        """Forms of texts: line ends are LF, no line or text ends in a blank, words are in one script."""
        texts = [t.replace("\r\n", "\n") if "\r" in t else t for t in texts]
        deep = [i for i, t in enumerate(texts) if not t.isascii() or _OTHER_ENDS.search(t)]
        if deep:
            points = np.frombuffer("".join(texts[i] for i in deep).encode("utf-32-le", "surrogatepass"), np.uint32)
            text = np.repeat(np.arange(len(deep), dtype=np.int32), [len(texts[i]) for i in deep])
            points, text = self._replaced(points.copy(), text)
            points, text = self._composed(self._ordered(points, text), text)
            whole = points.tobytes().decode("utf-32-le", "surrogatepass")
            ends = np.cumsum(np.bincount(text, minlength=len(deep))).tolist()
            for i, begin, end in zip(deep, [0, *ends], ends):
                t = whole[begin:end]
                texts[i] = _WORD.sub(self._own_script, t) if _ONE_OF_SCRIPTS.search(t) else t
        return [_TAILS.sub("", t).rstrip() for t in texts]


_OTHER_ENDS = re.compile("[\x0b\x0c\r]")
_TAILS = re.compile(r"[ \t]+(?=\n)")
_WORD = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")


def forms(df: DataFrame, key: str = "doc_id", text: str = "text", with_form: bool = True) -> DataFrame:
    """key, form, form_hi, form_lo, raw_hash, visible: one row per row of ``df``.

    ``form`` is the consistent text, null for a null text. Texts print alike exactly if their forms
    are equal; form_hi and form_lo are 128 bits of hash of the form, which the row carries in place
    of the form where ``with_form`` is false. ``visible`` tells whether a sign is left that prints.
    Empty and blank texts give "". Rows with equal or null keys stay apart. One pass, no shuffle.
    """
    table = df.sparkSession.sparkContext.broadcast(rules(look_alikes(df.sparkSession)))
    rows = session.spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    kind = rows.schema["k"].dataType.simpleString()
    names = ["k", "form", "form_hi", "form_lo", "raw_hash", "visible"]
    half = 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper(table.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):  # bounds the relation of code points
                part = batch.slice(start, 2000)
                texts = part.column(1).to_pylist()
                form, high, low, raw, visible = [], [], [], [], []
                for t, m in zip(texts, mapper([t or "" for t in texts])):
                    if t is None:
                        for x in (form, high, low, raw):
                            x.append(None)
                        visible.append(False)
                        continue
                    form.append(m if with_form else None)
                    whole = xxhash.xxh3_128_intdigest(m.encode())
                    high.append((whole >> 64) - half)
                    low.append((whole & 0xFFFFFFFFFFFFFFFF) - half)
                    raw.append(xxhash.xxh3_64_intdigest(t.encode()) - half)
                    visible.append(m != "")
                made = [pa.array(form, pa.string()), *(pa.array(x, pa.int64()) for x in (high, low, raw)), pa.array(visible, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names)

    schema = f"k {kind}, form string, form_hi long, form_lo long, raw_hash long, visible boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


_FORM = ["form_hi", "form_lo"]


def pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(<key>_a, <key>_b), the smaller first: texts with a visible sign that have one form but aren't equal strings.

    Variants of a text are found before documents are paired, so a group of equal strings costs
    nothing however large it is; only pairs of the result are formed, and adaptive execution splits a
    form that many documents share. Rows without a key are in no pair, repeated rows of one key count once.
    """
    marks = forms(df, key, text, with_form=False).filter(F.col("visible") & F.col(key).isNotNull()).select(key, *_FORM, "raw_hash")
    marks = session.cut(marks)  # a few numbers per text, read three times below
    several = marks.groupBy(*_FORM).agg(F.min("raw_hash").alias("lo"), F.max("raw_hash").alias("hi")).filter("lo <> hi").select(*_FORM)
    members = marks.join(several, _FORM, "left_semi").distinct()
    variants = members.select(*_FORM, "raw_hash").distinct()
    other = variants.select(*_FORM, F.col("raw_hash").alias("other_hash"))
    both = variants.join(other, _FORM).filter("raw_hash < other_hash")
    a = members.select(*_FORM, "raw_hash", F.col(key).alias("a"))
    b = members.select(*_FORM, F.col("raw_hash").alias("other_hash"), F.col(key).alias("b"))
    out = both.join(a, [*_FORM, "raw_hash"]).join(b, [*_FORM, "other_hash"]).filter("a <> b")
    return out.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_variants): one row per row with a visible sign and a key; class_id is the smallest key of its form.

    n_variants is the number of different strings of the form, so 1 means that only copies look like
    the text. No pairs are formed: classes are combined before the shuffle and joined back, a form of
    very many rows as a broadcast one.
    """
    marks = session.cut(forms(df, key, text, with_form=False).filter(F.col("visible") & F.col(key).isNotNull()).select(key, *_FORM, "raw_hash"))
    strings = marks.groupBy(*_FORM, "raw_hash").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    each = session.cut(strings.groupBy(*_FORM).agg(F.min("least").alias("class_id"), F.count("*").alias("n_variants"), F.sum("n").alias("n_rows")))
    return skew.join_to_one(marks.select(key, *_FORM), each, _FORM, "n_rows").select(key, "class_id", "n_variants")
