"""URL expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
EXCLUDED = (r"\.pdf$", r"\.jpg$", r"\.png$", r"\.gif$", r"\.css$", r"\.js$", "login", "signup", "register", "logout", "cart", "checkout")


def authority(url: Column) -> Column:
    """User, host and port."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def normalise(url: Column) -> Column:
    """An absolute URL without its fragment; an empty query goes."""
    parts = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^#?]*)", 1)
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    return F.concat(parts, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def resolve(href: Column, base: Column) -> Column:
    """Absolute and root-relative references; others take the general path below."""
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(href.rlike("^https?://"), normalise(href)).when(href.rlike("^/(?!/)"), normalise(F.concat(site, href))).otherwise(resolve_any(href, base))


@F.pandas_udf(T.StringType())
def resolve_any(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from urllib.parse import urljoin, urlsplit

    def one(href: str | None, base: str | None) -> str | None:
        if href is None or base is None:
            return None
        u = urlsplit(urljoin(base, href))
        return f"{u.scheme}://{u.netloc}{u.path}" + (f"?{u.query}" if u.query else "")

    for hrefs, bases in pairs:
        yield pd.Series([one(h, b) for h, b in zip(hrefs, bases, strict=True)], dtype=object)


def is_valid(url: Column, allowed: tuple[str, ...] = (), excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Scheme http or https, no excluded pattern anywhere, and, if domains are given, one of them in the authority."""
    sound = F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), F.lit(False))
    sound = sound & ~url.rlike("(?i)" + "|".join(excluded))
    if allowed:
        host = authority(url)
        any_of = F.lit(False)
        for a in allowed:
            any_of = any_of | F.contains(host, F.lit(a))
        sound = sound & any_of
    return sound
