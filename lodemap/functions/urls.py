"""URL expressions: normal forms of paths, prefixes of services, hosts, and removal of secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the normal form of a path, in order. Free of look-around, so any engine runs them.
NORMAL_FORM = [
    (r"^/?[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""),
    (r"([^/])\$\{.*$", "$1"),
    (r"[?#].*$", ""),
    (r"\$\{[^}]*\}|\[\[\.\.\.[^\]]*\]\]|\[[^\]]*\]|\{[^}]*\}", "{param}"),
    (r"/:[A-Za-z_][A-Za-z0-9_]*", "/{param}"),
    (r"(.)/+$", "$1"),
]
USERINFO = (r"://[^/@?#]*@", "://")
QUERY = (r"[?#].*$", "")
AUTHORITY = r"^/?[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)"
LEADING_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def normalize_url(url: Column) -> Column:
    """The path of a URL or template: no origin, query or trailing slash; every parameter dialect is {param}."""
    for pattern, to in NORMAL_FORM:
        url = F.regexp_replace(url, pattern, to)
    return url


def sanitize_url(url: Column) -> Column:
    """A URL without user names, passwords, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, *USERINFO), *QUERY)


def service_path_prefix(url: Column) -> Column:
    """The path of a base URL without trailing slashes; empty if there is none."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, *QUERY), LEADING_AUTHORITY, ""), "/+$", "")


def system(url: Column) -> Column:
    """Host and port of an absolute URL; empty for others. Ports are kept: they tell local services apart."""
    return F.regexp_extract(url, AUTHORITY, 1)


def page_route(path: Column) -> Column:
    """The route of a page file below pages/, or null: src/pages/users.tsx is /users, index files are their folder."""
    inner = F.regexp_extract(path, r"(?:^|/)pages/(.*)\.(?:tsx|jsx|ts|js)$", 1)
    route = F.regexp_replace(F.concat(F.lit("/"), inner), r"/index$", "")
    return F.when((inner != "") & ~inner.startswith("api/"), F.when(route == "", "/").otherwise(route))
