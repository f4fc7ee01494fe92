"""Amounts of different units, scales and notations in one common unit.

Numbers and unit words are extracted with regular expressions, unit words become canonical units
by joins with alias tables, the unit of a value is the first of its unit field, its own text and
the source's default, and the value is amount * factor + offset in decimal arithmetic. Everything
is column expressions and broadcast joins with tables of fixed size; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of currencies, with the number of units each name stands for.
CURRENCY_ALIASES: dict[str, tuple[str, Decimal]] = {
    **{x: ("USD", Decimal(1)) for x in ("usd", "us$", "us dollars", "us dollar", "u.s. dollars", "u.s. dollar", "american dollars")},
    **{x: ("USD", Decimal("0.01")) for x in ("us cents", "us cent", "u.s. cents", "cents usd")},
    **{x: ("EUR", Decimal(1)) for x in ("eur", "€", "euro", "euros")},
    **{x: ("EUR", Decimal("0.01")) for x in ("euro cents", "euro cent", "eurocents")},
    "teur": ("EUR", Decimal(1000)), "t€": ("EUR", Decimal(1000)), "tusd": ("USD", Decimal(1000)), "tchf": ("CHF", Decimal(1000)),
    **{x: ("GBP", Decimal(1)) for x in ("gbp", "£", "pound", "pounds", "pound sterling", "pounds sterling", "british pounds", "sterling")},
    **{x: ("GBP", Decimal("0.01")) for x in ("pence", "penny", "gbx")},
    **{x: ("INR", Decimal(1)) for x in ("inr", "₹", "rs.", "rs", "rupees", "rupee", "indian rupees", "indian rupee")},
    **{x: ("INR", Decimal("0.01")) for x in ("paise", "paisa")},
    **{x: ("CAD", Decimal(1)) for x in ("cad", "c$", "ca$", "can$", "canadian dollars", "canadian dollar")},
    **{x: ("AUD", Decimal(1)) for x in ("aud", "a$", "au$", "australian dollars", "australian dollar")},
    **{x: ("SGD", Decimal(1)) for x in ("sgd", "s$", "sg$", "singapore dollars", "singapore dollar")},
    **{x: ("JPY", Decimal(1)) for x in ("jpy", "¥", "円", "yen", "japanese yen")},
    **{x: ("CHF", Decimal(1)) for x in ("chf", "sfr", "sfr.", "fr.", "swiss francs", "swiss franc", "franken", "schweizer franken")},
    **{x: ("MXN", Decimal(1)) for x in ("mxn", "mx$", "mex$", "mexican pesos", "mexican peso")},
    **{x: ("BRL", Decimal(1)) for x in ("brl", "r$", "reais", "real", "brazilian reais", "brazilian real")},
    **{x: ("PLN", Decimal(1)) for x in ("pln", "zł", "zl", "zloty", "zlotys", "złoty", "złotych", "polish zloty")},
}

# Names of pay periods.
PERIOD_ALIASES: dict[str, str] = {
    **{x: "hour" for x in ("hour", "hours", "hourly", "hr", "hrs", "/hr", "/h", "/hour", "per hour", "an hour", "ph", "p.h.", "p/h", "per_hour", "per hr", "stunde", "pro stunde", "stündlich", "heure", "par heure", "por hora", "hora")},
    **{x: "day" for x in ("day", "daily", "/day", "/d", "per day", "a day", "per diem", "day rate", "pd", "p.d.", "per_day", "tag", "pro tag", "täglich", "jour", "par jour", "journalier", "por día", "por dia")},
    **{x: "week" for x in ("week", "weekly", "/wk", "/week", "wk", "per week", "a week", "pw", "p.w.", "per_week", "woche", "pro woche", "wöchentlich", "semaine", "par semaine", "hebdomadaire", "por semana")},
    **{x: "fortnight" for x in ("fortnight", "fortnightly", "biweekly", "bi-weekly", "bi weekly", "per fortnight", "a fortnight", "every two weeks", "every 2 weeks", "two-weekly", "per_fortnight", "zweiwöchentlich", "quinzaine")},
    **{x: "month" for x in ("month", "monthly", "/mo", "/mth", "/month", "per month", "a month", "pm", "p.m.", "pcm", "p.c.m.", "per calendar month", "per_month", "monat", "pro monat", "monatlich", "mois", "par mois", "mensuel", "al mes", "mensual", "por mes", "mensal", "por mês")},
    **{x: "year" for x in ("year", "yearly", "/yr", "/year", "/y", "yr", "per year", "a year", "per annum", "annum", "p.a.", "p.a", "pa", "annual", "annually", "per_year", "jahr", "pro jahr", "jährlich", "année", "par an", "par année", "annuel", "al año", "anual", "por ano", "lpa")},
}

# Words that multiply the amount beside them.
SCALE_ALIASES: dict[str, Decimal] = {
    **{x: Decimal(1000) for x in ("k", "thousand", "thousands", "tsd", "tsd.", "mille", "mil", "'000", "’000", "000s", "(000s)", "in thousands", "(in thousands)")},
    **{x: Decimal(1_000_000) for x in ("m", "mn", "mio", "million", "millions")},
    **{x: Decimal(100_000) for x in ("l", "lac", "lacs", "lakh", "lakhs", "lpa")},
    **{x: Decimal(10_000_000) for x in ("cr", "cr.", "crore", "crores")},
}

_SPACES = "\\u00a0\\u2007\\u2009\\u202f"  # escapes of the regular expressions
#: A number: groups of digits parted by blanks or apostrophes, or any run of digits, dots and commas.
NUMBER = rf"(\d{{1,3}}(?:[ {_SPACES}'’]\d{{3}})+(?:[.,]\d{{1,2}})?|\d[\d.,]*\d|\d)"
AMOUNT = "decimal(20,6)"


def _alternation(names: Mapping[str, object]) -> str:
    """A pattern for any of the names, longest first, not inside a longer word."""
    parts = []
    for name in sorted(names, key=lambda x: (-len(x), x)):
        head = r"(?<!\p{L})" if name[0].isalpha() else ""
        tail = r"(?!\p{L})" if name[-1].isalpha() else ""
        parts.append(f"{head}{re.escape(name)}{tail}")
    return "(" + "|".join(parts) + ")"


def number(text: Column, scaled: Column) -> Column:
    """The value of one number in any of the usual notations, null if it can't be read.

    The last of two different signs is the decimal one. A single comma or dot before exactly three
    digits parts groups, except for a dot in a scaled amount or after a lone zero.
    """
    t = F.regexp_replace(text, rf"[ {_SPACES}'’]", "")
    plain = F.regexp_replace(t, ",", "")
    continental = F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")
    both = t.contains(",") & t.contains(".")
    value = (
        F.when(both & (F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")), continental)
        .when(both, plain)
        .when(t.rlike(r"^\d{1,3}(,\d{2,3})*,\d{3}$"), plain)
        .when(t.contains(","), F.when(t.rlike(r"^\d+,\d{1,2}$"), continental))
        .when(t.rlike(r"^[1-9]\d{0,2}(\.\d{3}){2,}$") | (t.rlike(r"^[1-9]\d{0,2}\.\d{3}$") & ~scaled), continental)
        .otherwise(t)
    )
    return value.try_cast(AMOUNT)


def alias_table(spark: SparkSession, kind: str) -> DataFrame:
    """alias, unit, factor of one of: currency, period, scale. Fixed size."""
    rows = {
        "currency": [(a, u, f) for a, (u, f) in CURRENCY_ALIASES.items()],
        "period": [(a, u, Decimal(1)) for a, u in PERIOD_ALIASES.items()],
        "scale": [(a, "", f) for a, f in SCALE_ALIASES.items()],
    }[kind]
    return spark.createDataFrame(rows, f"alias string, unit string, factor {AMOUNT}")


def _looked_up(df: DataFrame, kind: str, word: str) -> DataFrame:
    """Adds <word>_unit and <word>_factor for the alias in the column ``word``."""
    t = F.broadcast(alias_table(df.sparkSession, kind).select(F.col("alias").alias(f"{word}_alias"), F.col("unit").alias(f"{word}_unit"), F.col("factor").alias(f"{word}_factor")))
    return df.join(t, F.col(word) == F.col(f"{word}_alias"), "left").drop(f"{word}_alias", word)


def convert(
    df: DataFrame,
    key: str,
    low: str,
    high: str,
    unit: str,
    period: str,
    rates: DataFrame,
    periods: DataFrame,
    default_unit: Column | None = None,
    default_period: Column | None = None,
    offset: Decimal = Decimal(0),
) -> DataFrame:
    """One row per amount above zero: key, bound, amount, unit, per, value (null if unit or period is unknown).

    ``low`` and ``high`` are texts with one number or a range and perhaps a scale, a unit and a
    period; ``unit`` and ``period`` are the fields for them. A scale, unit or period that is
    written once holds for both amounts. Fields come before texts, then the defaults, which are
    none unless given. ``rates`` (currency, usd_per_unit) and ``periods`` (pay_unit,
    units_per_year) give the factors. Of several amounts the smallest is min and the largest max;
    a lone one goes by its column. Nulls, blanks, words without a number, zeros and unreadable
    numbers give no row; repeated rows and null keys stay apart.
    """
    lower = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), rf"[{_SPACES}\s]+", " ")))
    # The blanks that part groups of digits must outlive tidying, so numbers are read from the raw text.
    words = F.concat_ws(" ; ", lower(low), lower(high))
    unit_text, period_text = lower(unit), lower(period)
    letters = F.regexp_replace(words, NUMBER, " # ")
    scale = _alternation({k: 0 for k in SCALE_ALIASES if k[0].isalpha()})
    written = _alternation({k: 0 for k in SCALE_ALIASES if len(k) > 2})
    out = df.select(
        F.col(key).alias("_key"),
        F.regexp_extract_all(F.coalesce(F.col(low).cast("string"), F.lit("")), F.lit(NUMBER), 1).alias("_low"),
        F.regexp_extract_all(F.coalesce(F.col(high).cast("string"), F.lit("")), F.lit(NUMBER), 1).alias("_high"),
        F.regexp_extract(unit_text, _alternation(CURRENCY_ALIASES), 1).alias("_unit_field"),
        F.regexp_extract(letters, _alternation(CURRENCY_ALIASES), 1).alias("_unit_text"),
        F.regexp_extract(period_text, _alternation(PERIOD_ALIASES), 1).alias("_period_field"),
        F.regexp_extract(letters, _alternation(PERIOD_ALIASES), 1).alias("_period_text"),
        # A one-letter scale must follow its number.
        F.regexp_extract(letters, "# {1,2}" + scale, 1).alias("_scale_text"),
        F.regexp_extract(unit_text, written, 1).alias("_scale_unit"),
        F.regexp_extract(period_text, written, 1).alias("_scale_period"),
        (default_unit if default_unit is not None else F.lit(None)).cast("string").alias("_default_unit"),
        (default_period if default_period is not None else F.lit(None)).cast("string").alias("_default_period"),
    ).filter((F.size("_low") > 0) | (F.size("_high") > 0))
    for kind, word in (("currency", "_unit_field"), ("currency", "_unit_text"), ("period", "_period_field"), ("period", "_period_text"), ("scale", "_scale_text"), ("scale", "_scale_unit"), ("scale", "_scale_period")):
        out = _looked_up(out, kind, word)
    unit_of = F.coalesce("_unit_field_unit", "_unit_text_unit", "_default_unit")
    minor = F.coalesce("_unit_field_factor", "_unit_text_factor", F.lit(Decimal(1)))
    period_of = F.coalesce("_period_field_unit", "_period_text_unit", "_default_period")
    times = F.coalesce("_scale_text_factor", "_scale_unit_factor", "_scale_period_factor", F.lit(Decimal(1)))
    scaled = F.col("_scale_text_factor").isNotNull()
    read = lambda name: F.filter(F.transform(name, lambda x: number(x, scaled)), lambda x: x > 0)
    out = out.select(
        "_key", unit_of.alias("unit"), period_of.alias("per"), (times * minor).cast(AMOUNT).alias("_times"), read("_low").alias("_low"), read("_high").alias("_high")
    )
    both = F.concat("_low", "_high")
    single = F.struct(F.when(F.size("_low") > 0, "min").otherwise("max").alias("bound"), both[0].alias("amount"))
    pair = F.array(F.struct(F.lit("min").alias("bound"), F.array_min(both).alias("amount")), F.struct(F.lit("max").alias("bound"), F.array_max(both).alias("amount")))
    out = out.filter(F.size(both) > 0).withColumn("_b", F.explode(F.when(F.size(both) == 1, F.array(single)).otherwise(pair)))
    rate = rates.select(F.col("currency").alias("unit"), F.col("usd_per_unit").alias("_rate"))
    span = periods.select(F.col("pay_unit").alias("per"), F.col("units_per_year").alias("_span"))
    out = out.join(rate, "unit", "left").join(span, "per", "left")
    amount = (F.col("_b.amount") * F.col("_times")).cast("decimal(26,8)")
    value = F.round((amount * F.col("_rate").cast("decimal(12,6)")).cast("decimal(34,14)") * F.col("_span").cast("decimal(8,0)") + F.lit(offset), 0)
    return out.select(F.col("_key").alias(key), F.col("_b.bound").alias("bound"), amount.alias("amount"), "unit", "per", value.cast("decimal(20,0)").alias("value"))
