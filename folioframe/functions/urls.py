"""URLs as columns: parts, joining, editing, normal form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ports that a scheme implies; fixed values.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443}


def _piece(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def scheme(url: Column) -> Column:
    return F.lower(_piece(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):"))


def netloc(url: Column) -> Column:
    return _piece(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)")


def path(url: Column) -> Column:
    return _piece(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)")


def query(url: Column) -> Column:
    return _piece(url, r"^[^?#]*\?([^#]*)")


def fragment(url: Column) -> Column:
    return _piece(url, r"#(.*)$")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(netloc(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::\d*)?$", 1))


def port(url: Column) -> Column:
    """As written, else that of the scheme, else null."""
    written = F.regexp_extract(netloc(url), r":(\d+)$", 1)
    implied = F.element_at(F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv]), scheme(url))
    return F.coalesce(written.try_cast("int"), implied)


def params(url: Column) -> Column:
    """name -> array of values, in order, decoded."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    names = F.array_distinct(F.transform(pairs, lambda p: F.url_decode(F.substring_index(p, "=", 1))))
    values = F.transform(names, lambda n: F.transform(
        F.filter(pairs, lambda p: F.url_decode(F.substring_index(p, "=", 1)) == n),
        lambda p: F.url_decode(F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, F.lit("=")) + 1)).otherwise(""))))
    return F.map_from_arrays(names, values)


def first_params(url: Column) -> Column:
    return F.transform_values(params(url), lambda _, v: v[0])


def is_secure(url: Column) -> Column:
    return scheme(url).isin("https", "wss")


def is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def is_websocket(url: Column) -> Column:
    return scheme(url).isin("ws", "wss")


def build(scheme_: Column, netloc_: Column, path_: Column, query_: Column, fragment_: Column) -> Column:
    """The URL of its parts, empty parts left out."""
    return F.concat(
        F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""), F.when(netloc_ != "", F.concat(F.lit("//"), netloc_)).otherwise(""),
        path_, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""), F.when(fragment_ != "", F.concat(F.lit("#"), fragment_)).otherwise(""))


def replace(url: Column, **parts: Column) -> Column:
    """The URL with some of scheme, netloc, path, query and fragment replaced."""
    own = {"scheme": scheme, "netloc": netloc, "path": path, "query": query, "fragment": fragment}
    return build(*[parts.get(name, get(url)) for name, get in own.items()])


def segments(url: Column, *names: Column) -> Column:
    """The URL with escaped segments at the end of its path."""
    escaped = [F.replace(F.url_encode(n), F.lit("+"), F.lit("%20")) for n in names]
    return replace(url, path=reduce(lambda p, s: F.concat(F.rtrim(p, F.lit("/")), F.lit("/"), s), escaped, path(url)))


def with_scheme(url: Column, name: str) -> Column:
    return replace(url, scheme=F.lit(name))


def as_websocket(url: Column) -> Column:
    return replace(url, scheme=F.when(is_secure(url), "wss").otherwise("ws"))


def as_http(url: Column) -> Column:
    return replace(url, scheme=F.when(is_secure(url), "https").otherwise("http"))


def merge_query(url: Column, **values: str) -> Column:
    """Set query parameters; others stay in place and new ones come last."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(list(values)))
    added = F.array(*[F.concat(F.url_encode(F.lit(k)), F.lit("="), F.url_encode(F.lit(v))) for k, v in values.items()])
    return replace(url, query=F.array_join(F.concat(kept, added), "&"))


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no default port, single slashes in the path, / for an empty path."""
    place = netloc(url)
    low = F.when(F.contains(place, F.lit(":")) & ~place.startswith("["), F.concat(
        F.lower(F.regexp_extract(place, r"^(.*):[^:]*$", 1)), F.lit(":"), F.regexp_extract(place, r":([^:]*)$", 1))).otherwise(F.lower(place))
    for name, number in DEFAULT_PORTS.items():
        low = F.when((scheme(url) == name) & low.endswith(f":{number}"), F.regexp_replace(low, f":{number}$", "")).otherwise(low)
    single = F.regexp_replace(F.regexp_replace(path(url), "/+", "/"), "(.)/$", "$1")
    single = F.when((low != "") & (single == ""), "/").otherwise(single)
    return build(scheme(url), low, single, query(url), fragment(url))
