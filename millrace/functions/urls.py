"""Canonical web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip

# Query parameters that only track where a visitor came from.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gh_src", "gh_jid", "lever-source", "lever-origin",
    "source", "src", "ref", "referrer", "referer", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "trackingid", "tracking_id",
    "campaign", "medium", "recruiter", "rx_source", "rx_campaign", "rx_medium", "rx_group", "rx_job", "sourcetype", "iis", "iisn",
)
_PARTS = r"(?i)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case without www. and the ports 443 and 80, no fragment, tracking or empty parameters, the rest sorted.

    Both ports go whatever the scheme, and a user name before the host stays, as in the stored keys.
    The case of the path stays; slashes at its end go unless they are the whole path. A percent sign
    that encodes nothing counts as itself. Null for anything but http and https, and for an address without a host.
    """
    raw = strip(url)
    scheme, authority, path, query = (F.regexp_extract(raw, _PARTS, i) for i in (1, 2, 3, 4))
    scheme = F.lower(scheme)
    host = F.regexp_replace(F.lower(authority), r"^www\.", "")
    host = F.regexp_replace(F.regexp_replace(host, ":443$", ""), ":80$", "")
    short = F.regexp_replace(path, "/+$", "")
    path = F.when(short == "", F.lit("/")).otherwise(short)
    plain = lambda c: F.try_url_decode(F.regexp_replace(c, "%(?![0-9a-fA-F]{2})", "%25"))
    pairs = F.transform(F.split(query, "&"), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p)))).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: p["k"].isNotNull() & (F.coalesce(p["v"], F.lit("")) != "") & ~F.lower(p["k"]).isin(*TRACKING)))
    quote = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    text = F.array_join(F.transform(kept, lambda p: F.concat(quote(p["k"]), F.lit("="), quote(p["v"]))), "&")
    made = F.concat(scheme, F.lit("://"), host, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(F.lit("")))
    return F.when((scheme != "") & (host != ""), made)


def digest(url: Column) -> Column:
    """SHA-256 of the canonical address in hex, null where there is none."""
    return F.sha2(canonical(url).cast("binary"), 256)
