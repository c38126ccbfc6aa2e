"""URL columns: parts, keys and rewrites, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
_AUTH = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def scheme(url: Column) -> Column:
    """Lower-case scheme; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, _SCHEME, 1)), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host without user and port; null without ``//``."""
    authority = F.regexp_replace(F.regexp_extract(url, _AUTH, 1), "^.*@", "")
    return F.nullif(F.lower(F.regexp_replace(authority, ":[0-9]*$", "")), F.lit(""))


def port(url: Column) -> Column:
    """Port, or the scheme's own."""
    given = F.regexp_extract(F.regexp_extract(url, _AUTH, 1), ":([0-9]+)$", 1)
    own = F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80)
    return F.coalesce(F.try_to_number(F.nullif(given, F.lit("")), F.lit("99999")).cast("int"), own)


def path(url: Column) -> Column:
    rest = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(rest == "", "/").otherwise(rest)


def is_http(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(scheme(url).isin("http", "https") & host(url).isNotNull(), F.lit(False))


def is_local_or_contact(url: Column) -> Column:
    """mailto:, tel:, a fragment, or anything that no scheme makes a URL of its own."""
    kind = scheme(url)
    broken = kind.isin("http", "https") & host(url).isNull()
    return F.coalesce(kind.isin("mailto", "tel"), F.lit(False)) | F.startswith(url, F.lit("#")) | kind.isNull() | F.coalesce(broken, F.lit(False))


def link_kind(url: Column) -> Column:
    """http, mailto, tel, anchor, local or other."""
    kind = scheme(url)
    return F.when(is_http(url), "http").when(kind.isin("mailto", "tel"), kind).when(F.startswith(url, F.lit("#")), "anchor").when(is_local_or_contact(url), "local").otherwise("other")


def normalised(url: Column) -> Column:
    """Cache key: scheme and host in lower case, without default port and fragment; path and query as they are."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    low = F.lower(head)
    low = F.when(F.startswith(low, F.lit("http://")), F.regexp_replace(low, ":80$", "")).when(F.startswith(low, F.lit("https://")), F.regexp_replace(low, ":443$", "")).otherwise(low)
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    rest = F.when((head != "") & ~rest.rlike("^/"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.concat(low, rest)


def host_key(url: Column) -> Column:
    """host:port, the key of per-host limits."""
    return F.concat_ws(":", host(url), port(url).cast("string"))


def excluded_by_domain(url: Column, domains: list[str]) -> Column:
    """Host equal to or under a domain; URLs without a host never are."""
    h = host(url)
    tests = [(h == d.lower()) | F.endswith(h, F.lit("." + d.lower())) for d in domains]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def excluded_by_pattern(url: Column, patterns: list[str]) -> Column:
    """Any pattern found anywhere in the URL; look-around and back-references are refused."""
    import re

    out = F.lit(False)
    for p in patterns:
        if re.search(r"\(\?[=!<]|\\[1-9]", p):
            raise ValueError(f"look-around or back-reference in {p!r}")
        out = out | url.rlike("(?U)" + p)
    return F.coalesce(out, F.lit(False))


def version_upgrade(url: Column) -> Column:
    """The URL with its first path segment v<number> raised by one; null without one or at the 32-bit limit."""
    m = "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/(?!v[+]?[0-9]+(?:[/?#]|$))[^/?#]*)*?/v)([+]?[0-9]+)((?:[/?#].*)?)$"
    number = F.regexp_extract(url, m, 2)
    value = F.when((number != "") & (F.length(F.ltrim(F.regexp_replace(number, "[+]", ""), F.lit("0"))) <= 10), F.regexp_replace(number, "[+]", "").cast("long"))
    new = F.concat(F.regexp_extract(url, m, 1), (value + 1).cast("string"), F.regexp_extract(url, m, 3))
    return F.when(value < 4294967295, new)


def sibling(url: Column) -> Column:
    """A URL beside this one that should not exist: its parent path and a name hashed from the URL."""
    base = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "[^/]*$", "")
    return F.concat(base, F.lit("missing-"), F.lower(F.hex(F.xxhash64(url))))


def without_dots(path: Column) -> Column:
    """A URL's path without its ``.`` and ``..`` segments; what climbs over the top is dropped, empty segments stay."""
    parts = F.split(path, "/")
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", up(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s)))
    last = F.element_at(parts, -1)
    return F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def joined(base: Column, target: Column) -> Column:
    """A redirect's target against the URL that names it, by the general rules of relative references; a null stays one."""
    part = lambda u, i: F.regexp_extract(u, "^(?s)(([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)([?][^#]*)?(#.*)?$", i)
    b_path, t_path, query = part(base, 4), part(target, 4), part(target, 5)
    merged = F.when(b_path == "", F.concat(F.lit("/"), t_path)).otherwise(F.concat(F.regexp_replace(b_path, "[^/]*$", ""), t_path))
    own = F.when(part(target, 3) != "", without_dots(t_path)).when(t_path == "", b_path).when(F.startswith(t_path, F.lit("/")), without_dots(t_path)).otherwise(without_dots(merged))
    asked = F.when((part(target, 3) == "") & (t_path == "") & (query == ""), part(base, 5)).otherwise(query)
    authority = F.when(part(target, 3) != "", part(target, 3)).otherwise(part(base, 3))
    relative = F.concat(part(base, 1), authority, own, asked, part(target, 6))
    whole = F.concat(part(target, 1), part(target, 3), F.when(part(target, 3) != "", without_dots(t_path)).otherwise(t_path), query, part(target, 6))
    return F.when(part(target, 2) != "", whole).otherwise(relative)


def contact_scheme(url: Column) -> Column:
    kind = F.lower(F.substring_index(url, ":", 1))
    return F.when(kind.isin("mailto", "tel") & F.contains(url, F.lit(":")), kind)


def mailto_ok(url: Column) -> Column:
    """One @ with something before it, and a domain with an inner dot; no blank, ``?`` or ``#``."""
    a = F.regexp_replace(url, "^[^:]*:", "")
    domain = F.substring_index(a, "@", -1)
    return (a != "") & ~a.rlike("[ ?#]") & (F.length(a) - F.length(F.replace(a, F.lit("@"), F.lit(""))) == 1) & ~F.startswith(a, F.lit("@")) & F.contains(domain, F.lit(".")) & ~F.startswith(domain, F.lit(".")) & ~F.endswith(domain, F.lit("."))


def tel_ok(url: Column) -> Column:
    a = F.regexp_replace(url, "^[^:]*:", "")
    return a.rlike("[0-9]") & a.rlike("^[0-9+() -]+$")
