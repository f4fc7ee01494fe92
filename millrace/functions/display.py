"""Labels for readers: pay, place, date, and the start of a bucket of recency."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.freshness import BUCKETS, relative_label

# What follows an amount by its interval, and names of countries.
PER = {"HOURLY": "/hr", "DAILY": "/day", "WEEKLY": "/wk", "MONTHLY": "/mo"}
COUNTRIES = {"US": "United States", "IN": "India"}


def _amount(value: Column, interval: Column) -> Column:
    """Annual amounts in thousands (K) or millions (M); others whole or with two places."""
    whole = lambda x: F.format_string("%d", F.round(x).cast("long"))
    millions = value / 1_000_000
    exact = lambda x: x == F.floor(x)
    yearly = (
        F.when(value >= 1_000_000, F.concat(F.when(exact(millions), whole(millions)).otherwise(F.format_string("%.1f", millions)), F.lit("M")))
        .when(value >= 1000, F.concat(whole(value / 1000), F.lit("K"))).otherwise(whole(value))
    )
    return F.when(interval == "ANNUAL", yearly).otherwise(F.when(exact(value), whole(value)).otherwise(F.format_string("%.2f", value)))


def pay_label(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """"$60K–$80K", "Up to EUR 30/hr", "From ..."; zero counts as unknown, null if both bounds are."""
    bound = lambda c: F.when(c > 0, c.cast("double"))
    kind = F.coalesce(interval, F.lit("UNKNOWN"))
    sign = F.when(F.coalesce(currency, F.lit("USD")) == "USD", "$").otherwise(F.concat(currency, F.lit(" ")))
    after = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PER.items() for x in p]), kind), F.lit(""))
    a, b = bound(low), bound(high)
    shown = lambda c: F.concat(sign, _amount(c, kind))
    return (
        F.when(a.isNull() & b.isNull(), None).when(a.isNull(), F.concat(F.lit("Up to "), shown(b), after)).when(b.isNull(), F.concat(F.lit("From "), shown(a), after))
        .when(a == b, F.concat(shown(a), after)).otherwise(F.concat(shown(a), F.lit("–"), shown(b), after))
    )


def place_label(city: Column, state: Column, country: Column, remote_type: Column) -> Column:
    """City and state, else "Remote" with the country, else the country's name."""
    named = F.nullif(F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(state, F.lit(""))), F.lit(""))
    remote = (remote_type == "REMOTE") & (F.coalesce(city, F.lit("")) == "")
    far = F.when(F.coalesce(country, F.lit("")) != "", F.concat(F.lit("Remote ("), country, F.lit(")"))).otherwise("Remote")
    nation = F.element_at(F.create_map(*[F.lit(x) for p in COUNTRIES.items() for x in p]), F.coalesce(country, F.lit("")))
    return F.when(remote, far).otherwise(F.coalesce(named, nation, F.lit("Location unknown")))


def posted_label(posted_at: Column, valid: Column, as_of: Column) -> Column:
    """struct<text, trusted>: the elapsed time only where the date can be trusted."""
    ok = posted_at.isNotNull() & F.coalesce(valid, F.lit(False))
    text = F.when(posted_at.isNull(), "Posting date not provided by source").when(~ok, "Posting date reported by source is unreliable").otherwise(F.concat(F.lit("Posted "), relative_label(posted_at, as_of)))
    return F.struct(text.alias("text"), ok.alias("trusted"))


def bucket_start(bucket: str, as_of: datetime) -> datetime | None:
    """The earliest instant of a bucket of ``freshness.bucket``; None for those that are no window. For predicates."""
    hours = {BUCKETS[1]: 1, BUCKETS[2]: 6, BUCKETS[4]: 24}
    if bucket in hours:
        return as_of - timedelta(hours=hours[bucket])
    return as_of.replace(hour=0, minute=0, second=0, microsecond=0) if bucket in (BUCKETS[3], BUCKETS[5], BUCKETS[6]) else None
