"""URL and enum helpers (built-in regex functions; same regexes in the oracles).

Registered domain: the reference gives no definition; ours is the host
without a leading ``www.``, reduced to its last two labels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL patterns.
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"
PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
DOMAIN_RE = r"([^.]+\.[^.]+)$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_host(url) -> Column:
    return F.regexp_extract(_c(url), HOST_RE, 1)


def url_path(url) -> Column:
    return F.regexp_extract(_c(url), PATH_RE, 1)


def registered_domain(url) -> Column:
    host = F.regexp_replace(F.lower(url_host(url)), r"^www\.", "")
    return F.regexp_extract(host, DOMAIN_RE, 1)


def enum_code(c, codes: dict[str, int]) -> Column:
    """Enum text to its declared integer code (``toInt8(enum)``); NULL when unknown."""
    m = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(c)]
