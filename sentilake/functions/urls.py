"""Columns over urls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), "^[^:/?#]+://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), "^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), "^[^?#]*\\?([^#]*)", 1)


def named(**fields: Column) -> Column:
    """A struct whose names hold in any place of a plan."""
    return F.named_struct(*[x for k, c in fields.items() for x in (F.lit(k), c)])


def parts(url: Column) -> Column:
    """Scheme, authority, path and query of a url, for columns that need several of them: put it behind ``once``."""
    return named(scheme=scheme(url), authority=authority(url), path=path(url), query=query(url))


def normalized_parts(p: Column) -> Column:
    """The normalised path and query of a url's parts, and its scheme and authority."""
    bare = F.regexp_replace(F.regexp_replace(p["path"], ";[^/]*$", ""), "/+$", "")
    telling = F.filter(F.split(p["query"], "&"), lambda x: x.rlike("^[^=]+=.") & ~F.lower(F.split(x, "=").getItem(0)).isin(*V.TRACKING_KEYS))
    recode = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))
    pairs = F.transform(telling, lambda x: F.concat(recode(F.regexp_extract(x, "^([^=]*)", 1)), F.lit("="), recode(F.regexp_extract(x, "^[^=]*=(.*)$", 1))))
    return named(scheme=p["scheme"], authority=p["authority"], path=bare, query=F.array_join(pairs, "&"))


def joined(n: Column) -> Column:
    """The url of normalised parts, if it is one of http(s); else an empty string."""
    whole = F.concat(n["scheme"], F.lit("://"), n["authority"], F.when(n["path"] == "", F.lit("/")).otherwise(n["path"]), F.when(n["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), n["query"])))
    return F.when(n["scheme"].isin("http", "https"), whole).otherwise(F.lit(""))


def normalize_url(url: Column) -> Column:
    """One spelling for each http(s) url, without fragment, tracking and blank keys; else an empty string."""
    return joined(normalized_parts(parts(url)))


def unique_id(normalized: Column) -> Column:
    return F.substring(F.sha2(normalized, 256), 1, 24)


def document_id(normalized: Column) -> Column:
    return F.concat(F.lit("doc_"), unique_id(normalized))


def domain(url: Column) -> Column:
    return F.regexp_replace(authority(url), "^www\\.", "")


def platform_of(d: Column) -> Column:
    """The first platform whose domain ends this one, dot or not; then news by name; else web."""
    out = F.when(F.lit(False), F.lit(None))
    for name, ends in V.PLATFORM_DOMAINS:
        out = out.when(any_of(d.endswith(e) for e in ends), F.lit(name))
    return out.when(any_of(d.contains(k) for k in V.NEWS_KEYWORDS), F.lit("news_site")).otherwise(F.lit("web"))


def infer_platform(url: Column) -> Column:
    return platform_of(domain(url))


def is_search_engine(host: Column) -> Column:
    """By the end of the domain, dot or not."""
    return any_of(F.lower(F.coalesce(host, F.lit(""))).endswith(e) for e in V.SEARCH_ENGINES)


def is_navigable(href: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(href, F.lit(""))))
    return (low != "") & ~any_of(low.startswith(x) for x in V.NO_ADDRESSES) & (normalize_url(F.coalesce(href, F.lit(""))) != "")


def low_value(u: Column, d: Column, place: Column, keys: Column) -> Column:
    """By a normalised url, its authority, its path and its query's keys in lower case."""
    low = F.lower(u)
    return (
        (u == "")
        | any_of((d == x) | d.endswith("." + x) for x in V.LOW_VALUE_DOMAINS)
        | any_of(F.lower(place).contains(x) for x in V.LOW_VALUE_PATHS)
        | F.arrays_overlap(keys, F.array(*[F.lit(k) for k in V.LOW_SIGNAL_KEYS]))
        | any_of(low.contains(x) for x in V.LOW_VALUE_PATTERNS)
        | any_of(low.endswith(x) for x in V.ASSET_ENDINGS)
    )


def query_keys(text: Column) -> Column:
    return F.transform(F.split(text, "&"), lambda p: F.lower(F.split(p, "=").getItem(0)))


def is_low_value(url: Column) -> Column:
    u = normalize_url(url)
    return low_value(u, authority(u), path(u), query_keys(query(u)))


def without_dots(place: Column) -> Column:
    """A path whose segments "." and ".." are resolved; nothing is above the top."""
    segments = F.split(place, "/")
    last = F.element_at(segments, -1)
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    done = F.aggregate(segments, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", up(s)).when(x == ".", s).otherwise(F.concat(s, F.array(x))))
    whole = F.array_join(F.when(last.isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done), "/")
    return F.when(place.rlike("(^|/)[.][.]?(/|$)"), F.when(whole == "", F.lit("/")).otherwise(whole)).otherwise(place)


def join_parts(base: Column, b: Column, href: Column) -> Column:
    """An anchor's absolute url, from its page's url and the parts of that."""
    site = F.concat(b["scheme"], F.lit("://"), b["authority"])
    folder = F.regexp_replace(b["path"], "[^/]*$", "")
    place, rest = F.regexp_extract(href, "^[^?#]*", 0), F.regexp_extract(href, "[?#].*$", 0)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(b["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, without_dots(place), rest))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(site, F.when(b["path"] == "", F.lit("/")).otherwise(b["path"]), href))
        .otherwise(F.concat(site, without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), place)), rest))
    )


def join_url(base: Column, href: Column) -> Column:
    return join_parts(base, parts(base), href)


def backend_plan(platform: Column, available: tuple[str, ...]) -> Column:
    """Backends to try for a platform, in order; those without a service are always there."""
    usable = {p: [b for b in plan if b in V.NATIVE_BACKENDS or b in available] for p, plan in V.BACKENDS.items()}
    plans = F.create_map(*[x for p, plan in usable.items() for x in (F.lit(p), F.array(*[F.lit(b) for b in plan]).cast("array<string>"))])
    return F.coalesce(F.try_element_at(plans, platform), F.element_at(plans, F.lit("web")))
