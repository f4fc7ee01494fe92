"""Timestamps of many notations and zones as instants of UTC.

Each text is rewritten by the first notation it fits into one canonical text of nine fields
(year, month, day, hour, minute, second, fraction, half of the day, zone), split once, and checked.
Texts with an offset or a count since 1970 are instants at once. Wall-clock times meet the interval
table of their zone (``zones``): one holding interval gives the offset, two mean that the time
occurs twice, none that the zone skips it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace import session
from millrace.operators import zones

MICROS = 1_000_000
DAY = 86_400 * MICROS

#: Month names by number (fixed values): English, German, French, Spanish, Portuguese, Italian, Dutch; matched by any prefix of three letters or more.
MONTHS: dict[int, tuple[str, ...]] = {
    1: ("january", "januar", "jänner", "janvier", "enero", "janeiro", "gennaio", "januari"),
    2: ("february", "februar", "février", "fevrier", "febrero", "fevereiro", "febbraio", "februari"),
    3: ("march", "märz", "maerz", "mrz", "mars", "marzo", "março", "maart"),
    4: ("april", "avril", "abril", "aprile"),
    5: ("may", "mai", "mayo", "maio", "maggio", "mei"),
    6: ("june", "juni", "juin", "junio", "junho", "giugno"),
    7: ("july", "juli", "juillet", "julio", "julho", "luglio"),
    8: ("august", "août", "aout", "agosto", "augustus"),
    9: ("september", "septembre", "septiembre", "setembro", "settembre"),
    10: ("october", "oktober", "octobre", "octubre", "outubro", "ottobre"),
    11: ("november", "novembre", "noviembre", "novembro"),
    12: ("december", "dezember", "décembre", "decembre", "diciembre", "dezembro", "dicembre"),
}

#: Zone abbreviations in minutes east of UTC (fixed values). IST is India's.
ABBREVIATIONS: dict[str, int] = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0,
    "BST": 60, "CET": 60, "MEZ": 60, "WEST": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180,
}

_BLANKS = r"[\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?: ?([AaPp])\.?[Mm]\b\.?)?"
_ZONE = r"(?: ?([A-Za-z+\-−\[].*))?"
_WEEKDAY = r"(?:\p{L}{2,10}\.?,? )?"
_MONTH = r"(\p{L}{3,10})\.?"

#: (notation, pattern, canonical text). Fields are split by "|": y|mo|d|h|mi|s|fraction|half|zone.
NOTATIONS: tuple[tuple[str, str, str], ...] = (
    ("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[Tt ,]{{1,2}}{_TIME}{_HALF}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt ](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("numeric", rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}),? {_TIME}(?: Uhr)?{_HALF}{_ZONE}$", "?$1?$2?$3|$4|$5|$6|$7|$8|$9"),
    ("day_first", rf"^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th|er|º)?\.?[ -](?:de )?{_MONTH}[ -](?:de )?(\d{{4}}|\d{{2}}),?(?: (?:at|à|um|a las|às|alle|om|-))? ?(?:(\d{{1,2}}) ?[:h] ?(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?)(?: ?Uhr)?{_HALF}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("month_first", rf"^{_WEEKDAY}{_MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}),?(?: at)? {_TIME}{_HALF}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
)
#: Twelve bare digits that are also a year to minute name two instants, so they are no count.
_TO_MINUTE = r"(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:[01]\d|2[0-3])[0-5]\d"
_EPOCH = rf"^(?!{_TO_MINUTE}$)(?:/Date\()?(-?\d{{9,10}}|-?\d{{12,13}}|-?\d{{15,16}}|-?\d{{18,19}})(?:[+-]\d{{4}})?(?:\)/)?$"
_EPOCH_FRACTION = r"^(\d{9,10})\.(\d+)$"


def tidy(text: Column) -> Column:
    """Blanks of every kind as one space, none at the ends."""
    return F.trim(F.when(text.rlike("[^ -~]|  "), F.regexp_replace(text, _BLANKS, " ")).otherwise(text))


def _literal_map(values: dict) -> Column:
    """A map of plain words; one parsed text is much quicker to build than a literal each."""
    quoted = lambda x: "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in values.items()) + ")")


def canonical(text: Column) -> Column:
    """The nine fields joined by "|", null for a text of no known notation.

    The first signs tell which notation a text can have, so that one pattern is applied to most
    texts; a text that it doesn't fit comes back as it was, without a bar, and is of no notation.
    """
    made = {name: F.regexp_replace(text, pattern, to) for name, pattern, to in NOTATIONS}
    only = lambda c: F.when(c.contains("|"), c)
    first, fifth, ninth = (F.substring(text, i, 1) for i in (1, 5, 9))
    digit = first.between("0", "9")
    candidate = (
        F.when(digit & fifth.isin("-", "/", ".") & text.rlike(r"^\d{4}"), made["iso"]).when(digit & ninth.isin("T", "t", " ") & text.rlike(r"^\d{8}"), made["basic"])
        .when(digit & text.rlike(r"^\d{1,2}[-/.]\d"), made["numeric"]).when(digit, made["day_first"])
    )
    return F.when(text.contains("|"), None).when(digit, only(candidate)).otherwise(F.coalesce(only(made["month_first"]), only(made["day_first"])))


def _month_names() -> dict[str, int]:
    known: dict[str, int] = {}
    clashing: set[str] = set()
    for number, names in MONTHS.items():
        for name in names:
            for end in range(3, len(name) + 1):
                if known.setdefault(name[:end], number) != number:
                    clashing.add(name[:end])
    return {k: v for k, v in known.items() if k not in clashing}


def epoch_micros(text: Column, digits: Column) -> Column:
    """Microseconds of a count of seconds, milli-, micro- or nanoseconds, by its number of digits; else null.

    Seconds have 9 or 10 digits, finer units 3, 6 or 9 more: fewer (before March 1973) could be a day.
    """
    n = digits.try_cast("long")
    size = F.length(digits) - digits.startswith("-").cast("int")
    whole = F.when(size.isin(9, 10), n * MICROS).when(size.isin(12, 13), n * 1000).when(size.isin(15, 16), n).when(size.isin(18, 19), F.floor(n / 1000).cast("long"))
    parts = F.split(F.when((digits == "") & text.rlike(_EPOCH_FRACTION), text), r"\.")
    fine = parts[0].try_cast("long") * MICROS + F.rpad(F.substring(parts[1], 1, 6), 6, "0").try_cast("long")
    return F.coalesce(whole, fine)


#: An offset, as sign|hours|minutes|seconds.
_OFFSET = r"^(?:GMT|UTC|UT|Z)? ?([+\-−])(\d{1,2}):?(\d{2})?(?::?(\d{2}))?$"


def offset_seconds(bare: Column, parts: Column) -> Column:
    """Seconds east of UTC of a zone that fixes them: Z, an abbreviation, an offset, or one before a bracketed name.

    ``bare`` is the zone without a bracketed name, ``parts`` its split offset or null.
    """
    named = F.element_at(_literal_map({k: v * 60 for k, v in ABBREVIATIONS.items()}), F.upper(bare))
    hours, minutes, seconds = (F.coalesce(parts[i].try_cast("int"), F.lit(0)) for i in (1, 2, 3))
    size = hours * 3600 + minutes * 60 + seconds
    fine = (hours <= 18) & (minutes < 60) & (seconds < 60)
    return F.when(parts.isNotNull() & fine, F.when(parts[0] == "+", size).otherwise(-size)).when(parts.isNull() & (bare != ""), named)


def normalize(
    df: DataFrame,
    key: str,
    fields: Sequence[str],
    source: str,
    sources: DataFrame,
    zone_column: str = "home_zone",
    style_column: str = "date_style",
) -> DataFrame:
    """One row per value: key, field_name, raw, status, utc_micros.

    ``status`` is ok, blank, unreadable (no instant is named: a day, a relative time, a word, or no
    such time of day), ambiguous or skipped (wall-clock times that the zone has twice or not at
    all), or unknown_zone; ``utc_micros`` is null unless it is ok. ``sources`` holds the home zone
    and the order of numeric dates of each source; it must have one row per source and is broadcast
    only if Spark finds it small. An unknown or null source counts as UTC and without an order, so
    its numeric dates are unreadable. Repeated rows and null keys stay; no rows are combined and
    nothing but the join with ``sources`` can shuffle. Columns not named here are not read.
    """
    spark = df.sparkSession
    about = sources.select(F.col(source).alias("_source"), F.col(zone_column).alias("_home"), F.upper(F.trim(F.col(style_column))).alias("_style"))
    about = about.groupBy("_source").agg(F.first("_home").alias("_home"), F.first("_style").alias("_style"))
    rows = session.spread(df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), *[F.col(f).cast("string").alias(f"_raw_{i}") for i, f in enumerate(fields)]))
    values = [F.struct(F.lit(f).alias("field_name"), F.col(f"_raw_{i}").alias("raw")) for i, f in enumerate(fields)]
    one = rows.select("_key", "_source", F.explode(F.array(*values)).alias("v")).select("_key", "_source", "v.field_name", "v.raw")
    out = one.join(about, "_source", "left").withColumn("_t", tidy(F.col("raw")))
    # Steps are columns of their own, so that no pattern is matched twice for a value.
    out = out.withColumn("_digits", F.when(F.col("_t").contains(":"), "").otherwise(F.regexp_extract("_t", _EPOCH, 1)))
    # Fields without text are null. Functions on arrays also keep a projection out of the fused stage, whose one method would grow too large to be compiled.
    fields_of = F.split(F.when(F.col("_digits") == "", canonical(F.col("_t"))), r"\|")
    out = out.withColumn("_f", F.transform(fields_of, lambda x: F.nullif(F.trim(x), F.lit(""))))
    # A numeric date fills the first field with "?a?b?c"; its order is that of the source.
    first = F.col("_f")[0]
    numeric = first.startswith("?")
    abc = F.split(first, r"\?")
    style = F.when(numeric, F.col("_style"))
    at = F.when(numeric, F.lit(-2)).otherwise(F.lit(0))
    y = F.when(~numeric, first).when(style == "YMD", F.when(F.length(abc[3]) == 2, abc[1])).when(style.isNotNull(), abc[3])
    mo = F.when(~numeric, F.col("_f")[1]).when(style == "DMY", abc[2]).when(style == "MDY", abc[1]).when(style == "YMD", abc[2])
    d = F.when(~numeric, F.col("_f")[2]).when(style == "DMY", abc[1]).when(style == "MDY", abc[2]).when(style == "YMD", abc[3])
    part = lambda i: F.get("_f", F.lit(i) + at)
    months = _literal_map(_month_names())
    out = out.select(
        "_key", "field_name", "raw", "_home", "_t", "_digits",
        F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).alias("_y"),
        F.coalesce(mo.try_cast("int"), F.element_at(months, F.lower(mo))).alias("_mo"), d.alias("_d"),
        part(3).try_cast("long").alias("_h"), part(4).try_cast("long").alias("_mi"), F.coalesce(part(5).try_cast("long"), F.lit(0)).alias("_s"),
        F.coalesce(F.rpad(F.substring(part(6), 1, 6), 6, "0").try_cast("long"), F.lit(0)).alias("_us"), F.lower(part(7)).alias("_half"), part(8).alias("_zone"),
    )
    day = F.concat_ws("-", F.lpad("_y", 4, "0"), F.lpad(F.col("_mo").cast("string"), 2, "0"), F.lpad("_d", 2, "0")).try_cast("date")
    out = out.withColumn("_day", F.when(F.col("_y").isNotNull() & F.col("_mo").isNotNull() & (F.col("_y") > "0000"), day))
    bracketed = F.col("_zone").endswith("]")
    out = out.withColumn("_bare", F.when(bracketed, F.trim(F.regexp_replace("_zone", r"\[[^\]]*\]$", ""))).otherwise(F.col("_zone")))
    signed = F.when(F.col("_bare").rlike("[+−-]"), F.regexp_replace("_bare", _OFFSET, "$1|$2|$3|$4"))
    out = out.withColumn("_offset_parts", F.transform(F.split(F.when(signed.contains("|"), signed), r"\|"), lambda x: F.trim(x)))
    h = F.col("_h")
    half = F.col("_half")
    hour = F.when(half.isNull(), F.when(h < 24, h)).when((h >= 1) & (h <= 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    clock = F.when((F.col("_mi") < 60) & (F.col("_s") < 60), ((hour * 60 + F.col("_mi")) * 60 + F.col("_s")) * MICROS + F.col("_us"))
    local = F.unix_date("_day").cast("long") * DAY + clock
    stated = F.col("_zone")
    out = out.select(
        "_key", "field_name", "raw", "_t", epoch_micros(F.col("_t"), F.col("_digits")).alias("_epoch"), local.alias("_local"), F.year("_day").alias("_year"),
        offset_seconds(F.col("_bare"), F.col("_offset_parts")).alias("_offset"), F.coalesce(F.regexp_extract(stated, r"^\[?([^\[\]]+)\]?$", 1), F.coalesce("_home", F.lit("UTC"))).alias("_name"),
    )
    fixed = F.coalesce("_epoch", F.col("_local") - F.col("_offset").cast("long") * MICROS)
    table = zones.table(spark).select(F.lower("zone").alias("_zone_name"), F.col("local_year").alias("_zone_year"), "periods")
    wanted = F.when(fixed.isNull() & F.col("_local").isNotNull(), F.lower("_name"))
    out = out.withColumn("_fixed", fixed).withColumn("_wanted", wanted)
    out = out.join(F.broadcast(table), (F.col("_wanted") == F.col("_zone_name")) & (F.col("_year") == F.col("_zone_year")), "left")
    out = out.withColumn("_hold", F.filter("periods", lambda p: (p["local_from"] <= F.col("_local")) & (F.col("_local") < p["local_to"])))
    held = F.size("_hold")
    utc = F.when(F.col("_fixed").isNotNull(), F.col("_fixed")).when(held == 1, F.col("_local") - F.get("_hold", F.lit(0))["offset_s"].cast("long") * MICROS)
    status = (
        F.when(F.coalesce("_t", F.lit("")) == "", "blank")
        .when(utc.isNotNull(), "ok")
        .when(F.col("_local").isNull(), "unreadable")
        .when(F.col("periods").isNull(), "unknown_zone")
        .when(held > 1, "ambiguous")
        .otherwise("skipped")
    )
    return out.select(F.col("_key").alias(key), "field_name", "raw", status.alias("status"), utc.alias("utc_micros"))


def instants(normalized: DataFrame, key: str) -> DataFrame:
    """The values that name exactly one instant."""
    return normalized.filter(F.col("status") == "ok").select(key, "field_name", "utc_micros")
