"""Keys under which copies of one listing meet, from exact to fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text, urls

# Titles too common to tell listings apart.
GENERIC_TITLES = (
    "software engineer", "engineer", "developer", "manager", "analyst", "consultant", "associate", "specialist", "coordinator", "administrator",
    "technician", "sales", "sales representative", "account manager", "project manager", "intern", "internship", "customer service",
    "customer service representative", "server", "cashier", "cook", "driver", "nurse", "registered nurse", "team member", "crew member",
    "warehouse associate", "security officer", "general manager", "assistant manager", "shift supervisor", "receptionist", "data analyst",
    "data scientist", "product manager", "designer",
)


def _joined(*parts: Column) -> Column:
    """SHA-256 in hex of the parts with bars between; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def identity(source: Column, external_id: Column) -> Column:
    return _joined(source, external_id)


def address(url: Column) -> Column:
    return urls.digest(url)


def title_and_place(company: Column, title: Column, country: Column, state: Column, city: Column) -> Column:
    """Company, title and place, null unless all are known and the title says something."""
    return _place_key(text.company_key(company, company), text.title_key(title), company, title, country, state, city)


def _place_key(company_key: Column, title_key: Column, company: Column, title: Column, country: Column, state: Column, city: Column) -> Column:
    known = F.coalesce(company != "", F.lit(False)) & F.coalesce(title_key != "", F.lit(False)) & city.isNotNull() & state.isNotNull()
    generic = title_key.isin(*GENERIC_TITLES) | F.lower(text.strip(title)).isin(*GENERIC_TITLES)
    return F.when(known & ~generic, _joined(company_key, title_key, country, state, F.lower(city)))


def fingerprint(company: Column, title: Column, country: Column, state: Column, city: Column, description: Column) -> Column:
    return _joined(text.company_key(company, company), text.title_key(title), country, state, F.lower(city), text.digest(description))


def with_keys(df: DataFrame, source: str, external_id: str, url: str, company: str, title: str, place: tuple[str, str, str], description: str) -> DataFrame:
    """Adds title_key, url (canonical), l1 to l4: the keys from exact to fuzzy. The parts are columns of their own, so none is worked out twice."""
    c = F.col
    out = df.withColumns({"company_key": text.company_key(c(company), c(company)), "title_key": text.title_key(c(title)), "canonical_url": urls.canonical(c(url))})
    where = tuple(c(p) for p in place)
    return out.withColumns({
        "l1": identity(c(source), c(external_id)), "l2": F.sha2(c("canonical_url").cast("binary"), 256),
        "l3": _place_key(c("company_key"), c("title_key"), c(company), c(title), *where),
        "l4": _joined(c("company_key"), c("title_key"), where[0], where[1], F.lower(where[2]), text.digest(c(description))),
    })


def content(*parts: Column) -> Column:
    """Changes whenever one of the parts does; amounts should come as decimals."""
    return _joined(*parts)


#: Columns whose change makes a stored listing change. The status is among them, so that a listing that only closes is updated.
CONTENT = (
    "title", "l4", "apply_url", "country_code", "state_code", "city", "remote_type", "employment_type", "salary_min", "salary_max", "salary_currency", "salary_interval", "status",
)


def content_of(columns: tuple[str, ...] = CONTENT) -> Column:
    """The content hash of a listing whose columns have these names; amounts as decimals of two places."""
    amount = lambda n: F.col(n).cast("decimal(14,2)") if n.startswith("salary_m") else F.col(n)
    return _joined(*[amount(n) for n in columns])
