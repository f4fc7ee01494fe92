"""How recent a listing is, at a given instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = ("EXPIRED", "FOUND_LAST_HOUR", "FOUND_LAST_6_HOURS", "FOUND_TODAY", "POSTED_LAST_24_HOURS", "POSTED_TODAY", "UPDATED_TODAY", "OLDER")


def assess(posted_at: Column, as_of: Column, tolerance_hours: int = 24, first_year: int = 2000) -> Column:
    """struct<valid, reason>: a date too far ahead or too old is kept but not valid; null is not valid and has no reason."""
    ahead = posted_at > as_of + F.make_dt_interval(hours=F.lit(tolerance_hours))
    reason = F.when(ahead, "FUTURE_POSTED_AT").when(F.year(posted_at) < first_year, "IMPLAUSIBLE_POSTED_AT")
    return F.struct((posted_at.isNotNull() & reason.isNull()).alias("valid"), reason.alias("reason"))


def bucket(status: Column, first_seen: Column, posted_at: Column, valid: Column, updated: Column, as_of: Column) -> Column:
    """The first rung of the ladder that holds; derived when asked for, since it changes with time."""
    within = lambda c, h: (c > as_of - F.make_dt_interval(hours=F.lit(h))) & (c <= as_of)
    same_day = lambda c: F.to_date(c) == F.to_date(as_of)
    return (
        F.when(status.isin("EXPIRED", "REMOVED"), BUCKETS[0]).when(within(first_seen, 1), BUCKETS[1]).when(within(first_seen, 6), BUCKETS[2])
        .when(same_day(first_seen), BUCKETS[3]).when(valid & within(posted_at, 24), BUCKETS[4]).when(valid & same_day(posted_at), BUCKETS[5])
        .when(same_day(updated), BUCKETS[6]).otherwise(BUCKETS[7])
    )


def relative_label(at: Column, as_of: Column) -> Column:
    """Elapsed time in the largest whole unit."""
    s = F.unix_micros(as_of) / 1_000_000 - F.unix_micros(at) / 1_000_000
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(name))
    return (
        F.when(at.isNull(), None).when(s < 0, "in the future").when(s < 60, unit(1, "s ago")).when(s < 3600, unit(60, "min ago")).when(s < 86400, unit(3600, "h ago"))
        .when(s < 2592000, unit(86400, "d ago")).when(s < 31536000, unit(2592000, "mo ago")).otherwise(unit(31536000, "yr ago"))
    )
