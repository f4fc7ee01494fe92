"""Full-text search: weighted documents, web-style queries, match, rank and a table of terms.

A document is one string of lower-case words with a blank on either side of each, made in one pass
when a listing is written. Words are not stemmed there: a sought word is widened to the inflections
of its possible bases instead ("planning": plan, plans, planned, planning, ...), so the rules are
applied to the few words of a query and never to all texts.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import reduce

import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the four fields, title first (public PostgreSQL defaults for A to D).
WEIGHTS = (1.0, 0.4, 0.2, 0.1)
#: Signs of a description that are searched, as in the stored documents.
LONGEST = 100_000
# Words that no query looks for.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with", "you", "your", "we", "our")
#: Parts of the table of terms.
BUCKETS = 64


def document(text: Column) -> Column:
    """The words of a text in lower case, each between blanks; null counts as empty."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))


def weighted_document(title: Column, department: Column, city: Column, description: Column) -> Column:
    """struct<a, b, c, d>: the documents of the four fields, the most telling first."""
    parts = zip("abcd", (title, department, city, F.substring(description, 1, LONGEST)))
    return F.struct(*[document(c).alias(n) for n, c in parts])


def whole(doc: Column) -> Column:
    """The four fields of a weighted document as one."""
    return F.concat(*[doc[n] for n in "abcd"])


def bases(word: str) -> tuple[str, ...]:
    """The words that ``word`` may be an inflection of, itself first; three letters remain at least."""
    out = [word]
    if len(word) > 4 and word.endswith("ies"):
        out.append(word[:-3] + "y")
    if len(word) > 3 and word.endswith("s") and not word.endswith("ss"):
        out.append(word[:-1])
        if word[:-1].endswith(("se", "xe", "ze", "che", "she")):
            out.append(word[:-2])
    for ending in ("ing", "ed"):
        stem = word[: -len(ending)]
        if word.endswith(ending) and len(stem) >= 3 and re.search("[aeiouy]", stem):
            out += [stem, stem + "e"]
            if stem[-1] == stem[-2]:
                out.append(stem[:-1])
            if ending == "ed" and stem.endswith("i"):
                out.append(stem[:-1] + "y")
    return tuple(dict.fromkeys(out))


def inflections(word: str) -> tuple[str, ...]:
    """All words that share a base with ``word``; words with other signs than plain letters, or fewer than three, only themselves."""
    if not re.fullmatch("[a-z]{3,}", word):
        return (word,)
    out = []
    for b in bases(word):
        short = b[:-1] if b.endswith("e") else b
        twice = b + b[-1] if re.search("[^aeiou][aeiou][^aeiouwxy]$", b) else short
        sibilant = b.endswith(("s", "x", "z", "ch", "sh"))
        out += [b, b + "es" if sibilant else b + "s", short + "ed", short + "ing", twice + "ed", twice + "ing"]
        if re.search("[^aeiou]y$", b):
            out += [b[:-1] + "ies", b[:-1] + "ied"]
    return tuple(dict.fromkeys(w for w in out if w == word or len(w) >= 3))


@dataclass(frozen=True)
class Query:
    """Alternatives of required and refused phrases; a phrase is a tuple of words."""

    alternatives: tuple[tuple[tuple[bool, tuple[str, ...]], ...], ...] = field(default=())


def parse(query: str) -> Query:
    """Words must all occur; "quotes" are phrases, ``or`` parts alternatives, - refuses. Never raises."""
    out: list[list[tuple[bool, tuple[str, ...]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query or ""):
        if word.lower() == "or" and not minus:
            out.append([])
            continue
        words = tuple(regex.findall(r"[\p{L}\p{N}]+", (phrase or word).lower()))
        if not phrase and word.lower() in STOP_WORDS:
            words = ()
        if words:
            out[-1].append((minus == "", words))
    return Query(tuple(tuple(a) for a in out if a))


def _pattern(phrase: tuple[str, ...]) -> str:
    """Finds the phrase in a document, each word in any of its inflections."""
    return " " + "  ".join("(?:" + "|".join(re.escape(w) for w in inflections(p)) + ")" for p in phrase) + " "


def _found(doc: Column, phrase: tuple[str, ...]) -> Column:
    """Whether the phrase is in the document; most documents lack the letters that all its inflections begin with, which a plain search tells."""
    begin = lambda word: " " + os.path.commonprefix(list(inflections(word)))
    plain = reduce(lambda a, b: a & b, (doc.contains(begin(w)) for w in phrase))
    return plain & doc.rlike(_pattern(phrase))


def matches(doc: Column, query: Query) -> Column:
    """Whether the document fulfils the query; a query without words matches nothing."""
    def one(w: Column, parts: tuple) -> Column:
        return reduce(lambda a, b: a & b, (_found(w, p) if wanted else ~_found(w, p) for wanted, p in parts))

    if not query.alternatives:
        return F.lit(False)
    # As the variable of a function on arrays the document is made once, however often it is looked at.
    return F.exists(F.array(doc), lambda w: reduce(lambda a, b: a | b, (one(w, a) for a in query.alternatives)))


def rank(fields: list[Column], query: Query, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """Sum over sought words and fields of the field's weight times its hits, damped by the field's length."""
    sought = sorted({w for a in query.alternatives for wanted, p in a if wanted for w in p})
    score = F.lit(0.0)
    for doc, weight in zip(fields, weights):
        for s in sought:
            score = score + F.lit(weight) * F.regexp_count(doc, F.lit(_pattern((s,)))) / (1 + F.log1p(F.length(doc)))
    return score


def terms(df: DataFrame, key: str, doc: Column, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, term, key): each word of each document once. Written by bucket, a query reads the buckets of its words only."""
    words = F.array_distinct(F.filter(F.split(doc, " "), lambda w: w != ""))
    one = df.select(F.col(key).alias("key"), F.explode(words).alias("term"))
    return one.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", "key")


def _bucket(term: str, buckets: int) -> int:
    value = xxhash.xxh64_intdigest(term.encode(), seed=42)
    return (value - (1 << 64) if value >> 63 else value) % buckets


def candidates(index: DataFrame, query: Query, buckets: int = BUCKETS) -> DataFrame:
    """(key): documents that hold all required words of an alternative; phrases and refusals are left to ``matches``.

    An alternative that only refuses words can't be looked up, so it is a ValueError.
    """
    out = None
    for parts in query.alternatives:
        sought = sorted({w for wanted, p in parts if wanted for w in p})
        if not sought:
            raise ValueError("an alternative needs a required word")
        group = {w: i for i, s in enumerate(sought) for w in inflections(s)}
        chain = None
        for i, s in enumerate(sought):
            hit = F.col("term").isin(*inflections(s))
            chain = F.when(hit, i) if chain is None else chain.when(hit, i)
        rows = index.filter(F.col("bucket").isin(*sorted({_bucket(w, buckets) for w in group})) & F.col("term").isin(*group))
        found = rows.groupBy("key").agg(F.countDistinct(chain).alias("n")).filter(F.col("n") == len(set(group.values()))).select("key")
        out = found if out is None else out.union(found)
    return index.sparkSession.createDataFrame([], index.select("key").schema) if out is None else out.distinct()
