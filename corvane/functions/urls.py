"""URL normalisation, hosts and address predicates."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: scheme, authority, path with parameters, query, fragment (RFC 3986, appendix B, for http and https alone)
PARTS = r"(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: user part, host (bracketed or plain), port
AUTHORITY = r"(?s)^(?:.*@)?(\[[^\]]*\]|[^:@\[\]]*)(?::([0-9]*))?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host_of(url: Column | str) -> Column:
    """Lower-case host without port and user part; null where the url is null, has no host, or isn't http(s)."""
    authority = F.regexp_extract(F.trim(_col(url)), PARTS, 2)
    return F.nullif(F.lower(F.regexp_extract(authority, AUTHORITY, 1)), F.lit(""))


def normalize(url: Column | str) -> Column:
    """Normal form of an absolute url; null for null, empty, fragments and everything that isn't http or https.

    Trimmed; tabs and line breaks inside are dropped, as browsers do; scheme and host in lower case; no user part,
    default port or fragment; an empty path becomes "/"; an empty query is dropped. A port beyond 65535 gives null.
    """
    text = F.regexp_replace(F.regexp_replace(_col(url), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), r"[\t\r\n]", "")
    scheme, authority = F.lower(F.regexp_extract(text, PARTS, 1)), F.regexp_extract(text, PARTS, 2)
    path, query = F.regexp_extract(text, PARTS, 3), F.regexp_extract(text, PARTS, 4)
    host, port = F.lower(F.regexp_extract(authority, AUTHORITY, 1)), F.regexp_extract(authority, AUTHORITY, 2)
    number = F.expr("try_cast(NULL as int)") if port is None else port.try_cast("int")
    default = F.when(scheme == "http", F.lit(80)).otherwise(F.lit(443))
    shown = F.when((port == "") | (number == default), F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string")))
    whole = F.concat(
        scheme, F.lit("://"), host, shown,
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when((scheme != "") & (host != "") & ((port == "") | (number <= 65535)), whole)


def normalize_text(url: str | None, base: str | None = None) -> str | None:
    """normalize() for one string, resolved against base when that is given. A url that can't be read gives None."""
    import re

    url = (url or "").strip()
    if not url or url.startswith("#"):
        return None
    try:
        whole = urljoin(base, url) if base else url
    except ValueError:
        return None
    m = re.match(PARTS, re.sub(r"[\t\r\n]", "", whole))
    a = m and re.match(AUTHORITY, m[2])
    if not a or not a[1] or (a[2] and int(a[2]) > 65535):
        return None
    scheme, port = m[1].lower(), a[2] and int(a[2])
    shown = f":{port}" if a[2] and port != {"http": 80, "https": 443}[scheme] else ""
    return f"{scheme}://{a[1].lower()}{shown}{m[3] or '/'}{'?' + m[4] if m[4] else ''}"


@F.pandas_udf(T.BooleanType())
def disallowed_address(ip: pd.Series) -> pd.Series:
    """True for every address that a crawler mustn't reach, and for what isn't an address, null and empty included."""

    def bad(x) -> bool:
        try:
            a = ipaddress.ip_address((x or "").strip())
        except ValueError:
            return True
        return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified

    return ip.map(bad)


def url_hash(url: Column | str) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 form; null stays null."""
    return F.sha2(_col(url), 256)
