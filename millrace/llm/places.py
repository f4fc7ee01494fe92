"""Free-entered places mapped to the entries of a reference list.

Each distinct token of the texts is joined with the vocabulary of the list by edit distance. Names
of the list are indexed by their rarest word, so a text is joined with those names only whose rarest
word it holds, and its corrected tokens are combined by soft TF-IDF to rank these or refuse them.
The list is a table like the texts and may be of any length; no part of it is held by the driver.
Codes and names that stand for several things (IN: Indiana or India) keep all their readings until
the other values of the record tell them apart.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import text as text_functions
from millrace.operators import skew

#: A token of so many letters may have one edit: a letter more, less, changed, or two neighbours swapped.
ONE_EDIT_FROM = 4
#: The least soft TF-IDF similarity of a text and an entry's name.
LEAST_SCORE = 0.75
#: A word of either that finds no partner weighs so many times as much as the rarest word of the list.
UNMATCHED = 3.0

# Fixed values, the default of the alias table: short forms of words in names.
SHORT_WORDS: dict[str, tuple[str, ...]] = {
    "mt": ("mount",), "mnt": ("mount",), "ft": ("fort",), "frt": ("fort",), "st": ("saint",), "ste": ("saint",), "pt": ("port",), "prt": ("port",),
    "n": ("north",), "no": ("north",), "nth": ("north",), "s": ("south",), "so": ("south",), "e": ("east",), "w": ("west",),
    "hts": ("heights",), "hgts": ("heights",), "fls": ("falls",), "spgs": ("springs",), "sprs": ("springs",), "spr": ("springs",), "spngs": ("springs",), "jct": ("junction",), "jctn": ("junction",), "jn": ("junction",), "junc": ("junction",),
    "brit": ("british",),
}

# Fixed values, likewise: other names of countries, by code.
COUNTRY_NAMES: dict[str, tuple[str, ...]] = {
    "US": ("us", "usa", "u s", "u s a", "united states", "united states of america", "the united states", "the united states of america", "america", "estados unidos", "etats unis", "vereinigte staaten", "vereinigte staaten von amerika", "stati uniti", "the us", "the usa", "unitedstates"),
    "IN": ("ind", "india", "bharat", "indien", "inde", "republic of india", "hindustan"),
    "CA": ("can", "canada", "kanada", "dominion of canada"),
    "GB": ("gb", "gbr", "uk", "u k", "united kingdom", "the united kingdom", "great britain", "britain", "vereinigtes konigreich", "royaume uni", "reino unido", "unitedkingdom", "grossbritannien", "united kingdom of great britain and northern ireland"),
    "DE": ("deu", "ger", "germany", "deutschland", "allemagne", "alemania", "germania", "federal republic of germany", "fed rep of germany", "brd", "bundesrepublik deutschland"),
    "AU": ("au", "aus", "australia", "australien", "australie", "commonwealth of australia"),
}

# Fixed values, likewise: other names of states, by country and code.
STATE_NAMES: dict[tuple[str, str], tuple[str, ...]] = {
    ("US", "CA"): ("calif", "cali", "cal"), ("US", "TX"): ("tex",), ("US", "NY"): ("n y", "new york state", "nys"), ("US", "FL"): ("fla", "flor"),
    ("US", "IL"): ("ill", "ills"), ("US", "GA"): ("geo",), ("US", "NC"): ("n c", "n carolina", "no carolina", "n car"), ("US", "MI"): ("mich",),
    ("US", "WA"): ("wash", "washington state", "wn"), ("US", "MA"): ("mass",), ("US", "TN"): ("tenn",), ("US", "IN"): ("ind", "indi"), ("US", "CO"): ("colo", "col"),
    ("US", "MN"): ("minn",), ("US", "OR"): ("ore", "oreg"), ("US", "PA"): ("penn", "penna", "pa"), ("US", "AZ"): ("ariz",), ("US", "DE"): ("del", "dela"), ("US", "WI"): ("wis", "wisc"), ("US", "OH"): ("oh", "o"),
    ("IN", "KA"): ("karn",), ("IN", "TN"): ("t n", "tamilnadu"), ("IN", "MH"): ("maha", "mah"), ("IN", "TG"): ("ts", "tel", "tela"), ("IN", "KL"): ("ker",), ("IN", "GJ"): ("guj",), ("IN", "RJ"): ("raj",), ("IN", "WB"): ("w b", "w bengal", "bengal"),
    ("CA", "ON"): ("ont",), ("CA", "QC"): ("que", "p q", "pq"), ("CA", "BC"): ("b c", "brit columbia"), ("CA", "AB"): ("alta", "alb"),
    ("GB", "ENG"): ("eng", "engl"), ("GB", "SCT"): ("scot",), ("GB", "WLS"): ("wal", "cymru"),
    ("DE", "BY"): ("bayern", "bav"), ("DE", "HE"): ("hessen",), ("DE", "NW"): ("nordrhein westfalen", "nrw", "n r w", "northrhine westphalia"), ("DE", "SN"): ("sachsen",),
    ("AU", "NSW"): ("n s w",), ("AU", "VIC"): ("vic",), ("AU", "QLD"): ("qld", "q l d"),
}

# Words around a city's name, and texts for no place in particular.
AROUND = ("city", "of", "greater", "metro", "metropolitan", "area", "region", "office", "hq", "headquarters", "downtown", "hybrid", "remote", "onsite", "on", "site", "campus", "central", "centre", "center", "suburbs", "near", "the", "based", "county", "district", "uptown", "midtown")
STATE_AROUND = ("state", "of", "the", "province")

_SPLIT = re.compile(r"[,;/|()\[\]\n\t]+|\s[-–—]+\s|\s[-–—]+$|^[-–—]+\s")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_TOKEN = re.compile(r"[^\W_]+")
_UNSEEN = re.compile("[\\u00ad\\u180e\\u200b-\\u200f\\u2060\\ufeff]")


def tidy(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l")


def segments(text: str | None) -> list[tuple[str, ...]]:
    """Tokens of each part of a text; joined words of mixed case are parted."""
    if not text:
        return []
    out = []
    for part in _SPLIT.split(_UNSEEN.sub("", text)):
        tokens = tuple(_TOKEN.findall(tidy(_CAMEL.sub(" ", part).replace("'", "").replace("’", ""))))
        if tokens:
            out.append(tokens)
    return out


def one_swap(a: str, b: str) -> bool:
    """Whether two neighbours changed places and nothing else differs."""
    if len(a) != len(b):
        return False
    d = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    return len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]


class Gazetteer:
    """The names that a batch of texts can mean, with what is needed to read them.

    ``names`` are rows (place_id, kind, state_code, country_code, tokens, weights, key); ``top`` is
    the weight of a word that one name only has.
    """

    def __init__(self, names: Iterable[tuple], top: float):
        self.top = top
        self.cities: list[tuple[int, tuple[str, ...], dict[str, float]]] = []
        self.names: dict[tuple[str, ...], list[tuple]] = defaultdict(list)
        self.states: dict[tuple[str, str], int] = {}
        self.countries: dict[str, int] = {}
        self.place: dict[int, tuple[str, str]] = {}
        self.by_key: dict[str, list[int]] = defaultdict(list)
        for place_id, kind, state, country, tokens, weights, key in sorted(names, key=lambda r: (r[0], r[4])):
            tokens = tuple(tokens)
            if kind == "city":
                self.place[place_id] = (state, country)
                self.by_key[key].append(len(self.cities))
                self.cities.append((place_id, tokens, dict(zip(tokens, weights))))
                continue
            means = ("country", country) if kind == "country" else ("state", (country, state))
            if kind == "country":
                self.countries[country] = place_id
            else:
                self.states[country, state] = place_id
            if means not in self.names[tokens]:
                self.names[tokens].append(means)
        for means in self.names.values():
            means.sort(key=str)
        self.longest_name = max((len(n) for n in self.names), default=0)
        self.starts = {n[:k] for n in self.names for k in range(1, len(n) + 1)}

    @staticmethod
    def _words(token: str, repairs: dict[str, list[tuple[tuple[str, ...], float]]]) -> list[tuple[tuple[str, ...], float]]:
        """Readings of one token as words of the list, with their closeness."""
        return repairs.get(token, [])

    def _cities(self, tokens: tuple[str, ...], repairs: dict) -> dict[int, float]:
        """Entries whose name the tokens give, by soft TF-IDF."""
        near: list[dict[str, float]] = []
        for token in tokens:
            words: dict[str, float] = {}
            for reading, sim in self._words(token, repairs):
                if len(reading) == 1:
                    words[reading[0]] = max(sim, words.get(reading[0], 0.0))
                elif len(tokens) == 1:  # a whole name written as one word
                    return self._scored([{w: sim} for w in reading])
            near.append(words)
        return self._scored(near)

    def _scored(self, near: list[dict[str, float]]) -> dict[int, float]:
        """The similarity of each entry that reaches LEAST_SCORE: the cosine of the weights of text and name, with the closeness of each pair of words."""
        lost = (UNMATCHED * self.top) ** 2
        out: dict[int, float] = {}
        for i in {i for words in near for w in words for i in self.by_key.get(w, ())}:
            place, name, weight = self.cities[i]
            left, dot, ours, theirs = list(name), 0.0, 0.0, 0.0
            for words in near:
                sim, word = max(((words.get(w, 0.0), w) for w in left), default=(0.0, ""))
                if sim <= 0:
                    ours += lost
                    continue
                left.remove(word)
                square = weight[word] ** 2
                dot += sim * square
                ours += square
                theirs += square
            theirs += lost * len(left)
            score = dot / math.sqrt(ours * theirs) if dot else 0.0
            if score >= LEAST_SCORE:
                out[place] = max(score, out.get(place, 0.0))
        return out

    def _named(self, tokens: tuple[str, ...], repairs: dict) -> list[tuple]:
        """States and countries that the tokens name, exactly or with a repaired word."""
        if tokens in self.names:
            return self.names[tokens]
        core = tuple(t for t in tokens if t not in STATE_AROUND)
        if core and core != tokens and core in self.names and max(map(len, core)) > 2:
            return self.names[core]
        readings: list[tuple[str, ...]] = [()]
        for token in core:
            options = [r for r, _ in self._words(token, repairs)] or [(token,)]
            # Only starts of names are kept, so there are never more readings than the list has.
            readings = list(dict.fromkeys(r + o for r in readings for o in options if r + o in self.starts))
        out: list[tuple] = []
        for r in readings:
            if max(map(len, r), default=0) >= ONE_EDIT_FROM:
                out.extend(m for m in self.names.get(r, ()) if m not in out)
        return out

    def _part(self, tokens: tuple[str, ...], repairs: dict) -> tuple[dict[int, float], list[list[tuple]], str]:
        """(cities, what is named beside, kind) of one part of a text; kind is city, named, around or unknown."""
        tokens = tuple(t for t in tokens if not t.isdigit())
        if not tokens:
            return {}, [], "around"
        if means := self.names.get(tokens):
            return {}, [means], "named"
        if found := self._cities(tokens, repairs):
            return found, [], "city"
        bare = tuple(t for t in tokens if t not in AROUND)
        if not bare:
            return {}, [], "around"
        if bare != tokens and (found := self._cities(bare, repairs)):
            return found, [], "city"
        if means := self._named(tokens, repairs):
            return {}, [means], "named"
        for size in range(min(len(bare) - 1, self.longest_name), 0, -1):
            means = self.names.get(bare[-size:])
            if means:
                rest = bare[:-size]
                if found := self._cities(rest, repairs):
                    return found, [means], "city"
                if size == len(bare) - 1:
                    break
                inner, beside, kind = self._part(rest, repairs)
                if kind in ("city", "named"):
                    return inner, [*beside, means], kind
        return {}, [], "unknown"

    def resolve(self, city: str | None, state: str | None, country: str | None, repairs: dict[str, list[tuple[tuple[str, ...], float]]]) -> int:
        """The most specific entry that the three values together name, 0 if there is none or several."""
        named: list[tuple[str, list[tuple]]] = []
        cities: list[dict[int, float]] = []
        lost = around = False
        for where, text in (("city", city), ("state", state), ("country", country)):
            parts = segments(text)
            for tokens in parts:
                found, beside, kind = self._part(tokens, repairs)
                if kind == "city":
                    cities.append(found)
                elif kind == "unknown":
                    lost = True
                elif kind == "around":
                    around = around or any(not t.isdigit() for t in tokens)
                named.extend((where if len(parts) == 1 and kind == "named" else "mixed", means) for means in beside)
        if cities:
            return self._pick_city(cities, named)
        if lost or around:
            return 0
        preferred = []
        for where, means in named:
            own = [m for m in means if m[0] == where]
            preferred.append(own or means)
        for evidence in (preferred, [m for _, m in named]):
            if place := self._pick_wider(evidence):
                return place
        return 0

    @staticmethod
    def _agrees(state: str | None, country: str, means: list[tuple]) -> bool:
        return any(m == ("state", (country, state)) or m == ("country", country) for m in means)

    def _pick_city(self, cities: list[dict[int, float]], named: list[tuple[str, list[tuple]]]) -> int:
        score: dict[int, float] = {}
        for place in set.intersection(*(set(c) for c in cities)):
            state, country = self.place[place]
            if all(self._agrees(state, country, means) for _, means in named):
                score[place] = sum(c[place] for c in cities)
        best = max(score.values(), default=0.0)
        top = [p for p, v in score.items() if v > best - 1e-9]
        return top[0] if len(top) == 1 else 0

    def _pick_wider(self, evidence: list[list[tuple]]) -> int:
        states = {m[1] for means in evidence for m in means if m[0] == "state"}
        fitting = [s for s in states if all(self._agrees(s[1], s[0], means) for means in evidence)]
        if len(fitting) == 1:
            return self.states.get(fitting[0], 0)
        if fitting:
            return 0
        countries = {m[1] for means in evidence for m in means if m[0] == "country"}
        fitting = [c for c in countries if all(("country", c) in means for means in evidence)]
        return self.countries.get(fitting[0], 0) if len(fitting) == 1 else 0


ALIASES = "kind string, country_code string, state_code string, alias string, meaning string"


def default_aliases(spark: SparkSession) -> DataFrame:
    """(kind, country_code, state_code, alias, meaning): other names of countries and states, and short forms of words (kind "word")."""
    rows = [("country", c, None, n, None) for c, names in COUNTRY_NAMES.items() for n in names]
    rows += [("state", c, s, n, None) for (c, s), names in STATE_NAMES.items() for n in names]
    rows += [("word", None, None, w, m) for w, meanings in SHORT_WORDS.items() for m in meanings]
    return spark.createDataFrame(rows, ALIASES)


def names(places: DataFrame, aliases: DataFrame) -> DataFrame:
    """(place_id, kind, state_code, country_code, tokens, weights, key, top) of every name of every entry; cut from its lineage.

    ``weights`` are the inverse frequencies of the tokens among names of cities, ``key`` is the rarest
    token and ``top`` the weight of a token that one name only has.
    """
    own = F.when(F.col("place_level") == "country", F.array("country_code", "country_name")).when(F.col("place_level") == "state", F.array("state_code", "state_name"))
    own = own.otherwise(F.concat(F.array("city"), F.split(F.coalesce("alt_names", F.lit("")), r"\|")))
    listed = places.filter("place_id is not null and place_level in ('city', 'state', 'country')")
    listed = listed.select(F.col("place_id").cast("long").alias("place_id"), F.col("place_level").alias("kind"), "state_code", "country_code", F.explode(own).alias("name"))
    other = aliases.filter("kind <> 'word'").select(F.col("kind").alias("_kind"), F.col("country_code").alias("_country"), F.col("state_code").alias("_state"), F.col("alias").alias("_alias"))
    which = listed.filter("kind <> 'city'").drop("name").distinct()
    more = which.join(other, (F.col("kind") == F.col("_kind")) & (F.col("country_code") == F.col("_country")) & ((F.col("kind") == "country") | (F.col("state_code") == F.col("_state"))))
    whole = listed.unionByName(more.select("place_id", "kind", "state_code", "country_code", F.col("_alias").alias("name"))).filter("name is not null")
    about = ["place_id", "kind", "state_code", "country_code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_TOKEN.findall(tidy(n)) for n in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.list_(pa.string()))], [*about, "tokens"])

    split = whole.mapInArrow(run, "place_id long, kind string, state_code string, country_code string, tokens array<string>")
    split = split.filter(F.size("tokens") > 0).distinct()
    cities = split.agg(F.count_if(F.col("kind") == "city").alias("n_cities"))  # one row
    used = split.select(*about, "tokens", F.posexplode("tokens").alias("at", "word"))
    distinct_words = split.select("kind", F.explode(F.array_distinct("tokens")).alias("word"))
    counts = distinct_words.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "city").alias("n_city")).crossJoin(F.broadcast(cities))
    counts = counts.withColumn("weight", F.log(1 + F.greatest(F.col("n_cities"), F.lit(1)) / F.greatest(F.col("n_city"), F.lit(1))))
    counts = counts.withColumn("top", F.log(1.0 + F.greatest(F.col("n_cities"), F.lit(1))))
    each = used.join(counts.select("word", "n", "weight", "top"), "word").groupBy(*about, "tokens").agg(
        F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("w"), F.min(F.struct("n", "word")).alias("k"), F.max("top").alias("top")
    )
    return session.cut(each.select(*about, "tokens", F.col("w.weight").alias("weights"), F.col("k.word").alias("key"), "top"))


def vocabulary(named: DataFrame) -> DataFrame:
    """(word, reading): words of the list, and names of several words written as one."""
    long_ = (F.col("kind") == "city") | (F.array_max(F.transform("tokens", lambda t: F.length(t))) > 3)
    used = named.filter(long_).select("kind", "tokens")
    single = used.select("kind", F.explode("tokens").alias("word")).filter((F.length("word") >= ONE_EDIT_FROM) | (F.col("kind") == "city"))
    single = single.select("word", F.array("word").alias("reading"))
    in_one = used.filter(F.size("tokens") > 1).select(F.array_join("tokens", "").alias("word"), F.col("tokens").alias("reading"))
    return single.union(in_one).groupBy("word").agg(F.min_by("reading", F.struct(F.size("reading"), F.array_join("reading", " "))).alias("reading"))


def _forms(word: Column) -> Column:
    """The word and, if it is long enough for an edit, what is left without one of its letters."""
    size = F.length(word)
    shorter = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size)))
    return F.when(size >= ONE_EDIT_FROM, F.array_distinct(F.concat(F.array(word), shorter))).otherwise(F.array(word))


def repairs(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, words): the words of the vocabulary within one edit of each distinct token, with reading and closeness.

    Two words within one edit, or one swap of neighbours, share a form with at most one letter less,
    so the join is on such forms.
    """
    table = words.select("word", "reading", F.explode(_forms(F.col("word"))).alias("form"))
    met = tokens.select("token", F.explode(_forms(F.col("token"))).alias("form")).join(table, "form").select("token", "word", "reading").distinct()
    distance = F.levenshtein("token", "word")
    differing = F.filter(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring("token", i, F.lit(1)) != F.substring("word", i, F.lit(1)))
    swap = (
        (F.length("token") == F.length("word")) & (distance == 2) & (F.size(differing) == 2)
        & (F.get(differing, F.lit(1)) == F.get(differing, F.lit(0)) + 1)
        & (F.array_sort(F.split("token", "")) == F.array_sort(F.split("word", "")))
    )
    edits = F.when(F.col("token") == F.col("word"), 0).when((F.length("token") >= ONE_EDIT_FROM) & (F.length("word") >= ONE_EDIT_FROM) & ((distance <= 1) | swap), 1)
    near = met.withColumn("edits", edits).filter("edits is not null")
    closeness = 1 - F.col("edits") / F.greatest(F.length("token"), F.length("word"))
    return near.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("word", "reading", closeness.alias("closeness")))).alias("words"))


def _text_tokens(texts: DataFrame, fields: tuple[str, str, str]) -> DataFrame:
    """(text_no, token): the tokens of each text, an empty one for a text that has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                tokens = {t for v in values for part in segments(v) for t in part if not t.isdigit()} or {""}
                rows.extend([i] * len(tokens))
                found.extend(sorted(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["text_no", "token"])

    return session.spread(texts.select("text_no", *fields)).mapInArrow(run, "text_no string, token string")


def values(df: DataFrame, places: DataFrame, fields: tuple[str, str, str] = ("raw_city", "raw_state", "raw_country"), aliases: DataFrame | None = None) -> DataFrame:
    """(fields, n_rows, place_id) of each distinct combination with something other than blanks in it; cut from its lineage.

    A text gets the names whose rarest word is among its tokens or their repairs. Every name that it
    can mean is among them, since all words of a name must be in the text.
    """
    aliases = default_aliases(df.sparkSession) if aliases is None else aliases
    listing = names(places, aliases)
    filled = F.coalesce(*[text_functions.clean(F.col(f)) for f in fields]).isNotNull()
    texts = df.filter(filled).groupBy(*fields).agg(F.count("*").alias("n_rows"))
    texts = session.cut(texts.withColumn("text_no", F.md5(F.to_json(F.struct(*fields)))))
    tokens = _text_tokens(texts, fields)
    # Little data with much work per row: a stated number of parts keeps adaptive execution from putting it into one task.
    cores = df.sparkSession.sparkContext.defaultParallelism
    fixed = repairs(tokens.select("token").repartition(cores, "token").distinct(), vocabulary(listing))
    short = aliases.filter("kind = 'word'").groupBy(F.col("alias").alias("token")).agg(F.array_sort(F.collect_set(F.struct(F.array("meaning").alias("reading"), F.lit(1.0).alias("closeness")))).alias("short"))
    found = tokens.join(fixed, "token", "left").join(short, "token", "left")
    near = F.transform(F.coalesce("words", F.array()), lambda w: F.struct(w["reading"].alias("reading"), w["closeness"].alias("closeness")))
    found = found.select("text_no", "token", F.concat(F.coalesce("short", F.array()), near).alias("readings"))
    fix = F.when(F.size("readings") > 0, F.struct("token", "readings"))
    met = found.select("text_no", F.explode(F.array_union(F.array("token"), F.flatten(F.col("readings.reading")))).alias("key")).distinct()
    meant = met.join(listing, "key").groupBy("text_no").agg(F.collect_list(F.struct("place_id", "kind", "state_code", "country_code", "tokens", "weights", "key", "top")).alias("names"))
    known = found.groupBy("text_no").agg(F.collect_list(fix).alias("repairs"))
    one = texts.join(known, "text_no").join(meant, "text_no", "left").select(*fields, "n_rows", "repairs", "names")
    schema = df.select(*fields).schema.add("n_rows", "long").add("place_id", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            city, state, country, _, known, meant = (c.to_pylist() for c in batch.columns)
            rows = {(n["place_id"], n["kind"], tuple(n["tokens"])): n for some in meant for n in some or ()}
            top = max((n["top"] for n in rows.values()), default=0.0)
            reader = Gazetteer((tuple(n.values())[:-1] for n in rows.values()), top)
            chosen = [
                reader.resolve(c, s, k, {r["token"]: [(tuple(w["reading"]), w["closeness"]) for w in r["readings"]] for r in fix})
                for c, s, k, fix in zip(city, state, country, known)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(chosen, pa.int64())], [*fields, "n_rows", "place_id"])

    return session.cut(one.mapInArrow(run, schema))


def resolve(df: DataFrame, places: DataFrame, key: str = "record_id", fields: tuple[str, str, str] = ("raw_city", "raw_state", "raw_country"), aliases: DataFrame | None = None) -> DataFrame:
    """(key, place_id): one row per row of ``df`` with something other than blanks in any field.

    ``place_id`` is the most specific entry that the values together name, wherever their parts sit,
    and 0 for a text that names no entry or several that the other values can't tell apart. Rows
    with null or equal keys stay apart; an empty list of places gives 0 for every row. ``aliases``
    replaces the table of other names and short forms (``default_aliases``).
    """
    known = values(df, places, fields, aliases)
    return skew.join_to_one(df.select(key, *fields), known, fields, "n_rows").select(key, "place_id")


def unmatched(df: DataFrame, places: DataFrame, fields: tuple[str, str, str] = ("raw_city", "raw_state", "raw_country"), aliases: DataFrame | None = None) -> DataFrame:
    """(fields, n_rows): the distinct combinations that found no entry, with the number of their rows."""
    return values(df, places, fields, aliases).filter("place_id = 0").drop("place_id")
