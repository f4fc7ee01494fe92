"""Cleaning of strings and the keys made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of Unicode with those that print nothing, as a class of a Java regular expression.
BLANK = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def clean(text: Column) -> Column:
    """Stripped, null if nothing is left."""
    stripped = strip(text)
    return F.when(stripped != "", stripped)


def filled(text: Column) -> Column:
    """Whether there is a sign that is no blank; false for null. Ends at the first such sign, however long the text."""
    return F.coalesce(text.rlike(f"[^{BLANK[1:]}"), F.lit(False))


# Words that say which legal form a company has.
LEGAL_WORDS = (
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "plc", "sa", "nv",
    "bv", "ag", "pty", "llp", "lp", "holdings", "group", "international", "worldwide",
)

# Words of a title that tell a level.
LEVEL_WORDS = ("senior", "sr", "junior", "jr", "lead", "principal", "staff", "i", "ii", "iii", "iv", "v")

# Words that stay in lower case inside a name.
CONNECTIVES = ("and", "or", "of", "the", "for", "in", "on", "to", "a", "an", "&")


def key(text: Column) -> Column:
    """Lower case with every run of other signs than ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\W+"), lambda w: w != "")


def company_key(name: Column, fallback: Column | None = None) -> Column:
    """The key of a company's name without legal forms; ``fallback`` where nothing is left."""
    plain = F.regexp_replace(F.lower(name), r"(?U)\bl\.l\.c\b", "llc")
    kept = F.filter(_words(plain), lambda w: ~w.isin(*LEGAL_WORDS))
    made = F.nullif(key(F.array_join(kept, " ")), F.lit(""))
    return made if fallback is None else F.coalesce(made, fallback)


def title_key(title: Column) -> Column:
    """The key of a title without level words, numbers, bracketed asides and, line by line, all behind the first dash or bar; the plain key if nothing is left."""
    open_ = F.regexp_replace(F.regexp_replace(F.lower(title), r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")
    heads = F.array_join(F.transform(F.split(open_, "\n"), lambda line: F.get(F.split(line, "[-\u2013\u2014|]"), F.lit(0))), " ")
    kept = F.filter(_words(heads), lambda w: ~w.isin(*LEVEL_WORDS) & ~w.rlike("^[0-9]+$"))
    return F.coalesce(F.nullif(key(F.array_join(kept, " ")), F.lit("")), key(title))


def digest(text: Column, first: int = 4000) -> Column:
    """32 hex digits for the lower-case text with single spaces, cut to ``first`` signs as the stored keys are; "" for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    return F.substring(F.sha2(F.substring(plain, 1, first).cast("binary"), 256), 1, 32)


def title_case(text: Column, longest: int = 120) -> Column:
    """Words capitalised, the parts between slashes and hyphens each; connectives in lower case but as the first word; null stays null."""
    def part(sign: str, x: Column) -> Column:
        return F.array_join(F.transform(F.split(x, sign), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), sign)

    def word(x: Column) -> Column:
        return F.array_join(F.transform(F.split(x, "/"), lambda p: part("-", p)), "/")

    words = F.filter(F.split(strip(text), r"\s+"), lambda x: x != "")
    cased = F.transform(words, lambda x, i: F.when((i > 0) & F.lower(x).isin(*CONNECTIVES), F.lower(x)).otherwise(word(x)))
    return F.nullif(F.substring(F.array_join(cased, " "), 1, longest), F.lit(""))


def domain(url: Column) -> Column:
    """Host of a web address in lower case without www., port and path; null if there is none."""
    host = F.regexp_extract(F.lower(strip(url)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(host.contains("."), host)


def prefix(text: Column, sign: str = ":") -> Column:
    """What comes before the first ``sign``, null if there is none."""
    return F.when(F.instr(text, sign) > 1, F.substring_index(text, sign, 1))


def first_prefix(text: Column, values: dict[str, str], other: str, unknown: str) -> Column:
    """The value of the first name, in order, that the text without other signs than letters and digits begins with."""
    squashed = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    chain = F.when(squashed.isNull() | (squashed == ""), unknown)
    for name, value in values.items():
        chain = chain.when(squashed.startswith(name), value)
    return chain.otherwise(other)


# Kinds of employment and pay intervals by the words feeds use, in order.
EMPLOYMENT = {
    "fulltime": "FULL_TIME", "full": "FULL_TIME", "permanent": "FULL_TIME", "regular": "FULL_TIME", "parttime": "PART_TIME", "part": "PART_TIME",
    "contract": "CONTRACT", "contractor": "CONTRACT", "contracttemporary": "CONTRACT", "freelance": "CONTRACT", "temporary": "TEMPORARY", "temp": "TEMPORARY",
    "seasonal": "TEMPORARY", "intern": "INTERNSHIP", "internship": "INTERNSHIP", "apprenticeship": "INTERNSHIP", "volunteer": "VOLUNTEER",
}
INTERVALS = {
    "hourly": "HOURLY", "hour": "HOURLY", "daily": "DAILY", "day": "DAILY", "weekly": "WEEKLY", "week": "WEEKLY", "monthly": "MONTHLY", "month": "MONTHLY",
    "annually": "ANNUAL", "annual": "ANNUAL", "yearly": "ANNUAL", "year": "ANNUAL",
}


def lookup(text: Column, values: dict[str, str], other: str) -> Column:
    """The value of the stripped lower-case text."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(strip(text))), F.lit(other))


def currency_code(text: Column) -> Column:
    """Three ASCII letters in upper case, else null."""
    code = F.upper(strip(text))
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def amount(text: Column) -> Column:
    """A bare number of a pay field as sent, null for anything else; ``operators.units`` reads notations."""
    plain = F.replace(strip(text.cast("string")), F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"^\d+(\.\d+)?$"), plain.try_cast("double"))


def amounts_in_order(low: Column, high: Column, most: int = 100_000_000) -> Column:
    """struct<low, high> of decimals within 0 and ``most``, swapped if the other way round; a lone bound keeps its place."""
    fine = lambda c: F.when((c >= 0) & (c <= most), c.cast("decimal(14,2)"))
    a, b = fine(low), fine(high)
    return F.struct(F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)).otherwise(a).alias("low"), F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)).otherwise(b).alias("high"))


def redact(text: Column) -> Column:
    """Passwords in addresses and values of secret-looking settings masked."""
    masked = F.regexp_replace(text, r"(://[^:/@\s]+:)[^@\s]+@", "$1***@")
    return F.regexp_replace(masked, r"(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)[^\s,;&]+", "$1$2***")
