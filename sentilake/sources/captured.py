"""Captured answers of services as DataFrames: searches, pages, videos and feeds.

A registry names the sources; each reads rows of captured JSON or XML with Spark's own
parsers, from whatever store Spark reads, and nothing goes over the network. A search
source says where its entries are, what their fields are called and how much its
word counts for a link's quality and relevance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import payloads as X
from ..functions import texts as T
from ..functions import urls as U
from ..functions.plan import once
from . import html as H

SPACES = " \t\n\r\x0b\x0c"

_ENTRY = "struct<link:string,url:string,title:string,snippet:string,description:string,date:string>"


@dataclass(frozen=True)
class Search:
    """Where a service's entries are, the first field that has an address and a description, and its signals."""

    schema: str
    entries: Callable[[Column], Column]
    address: tuple[str, ...]
    about: tuple[str, ...]
    quality: Callable[[Column], Column]
    relevance: float
    dated: bool = False
    most: int | None = None


def _bucket(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{_ENTRY}>"))


SEARCHES = {
    "serper": Search(f"struct<organic:array<{_ENTRY}>>", lambda j: _bucket(j["organic"]), ("link",), ("snippet",), lambda i: F.greatest(F.lit(0.0), 0.2 - (i - 1) * 0.01), 0.1, most=10),
    "firecrawl_search": Search(f"struct<data:struct<web:array<{_ENTRY}>,news:array<{_ENTRY}>>>", lambda j: F.concat(_bucket(j["data"]["web"]), _bucket(j["data"]["news"])), ("url",), ("description", "snippet"), lambda i: F.lit(0.18), 0.12, dated=True),
    "serpapi": Search(f"struct<organic_results:array<{_ENTRY}>>", lambda j: _bucket(j["organic_results"]), ("link", "url"), ("snippet",), lambda i: F.lit(0.15), 0.1),
}


def source_name(name: Column, available: tuple[str, ...]) -> Column:
    """The source that a name means; null if it means none, or one that isn't available."""
    low = F.replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit("-"), F.lit("_"))
    out = F.when(low == "", F.lit(None).cast("string")).when(low.isin(*available), low)
    for canonical, aliases in V.SOURCE_ALIASES:
        out = out.when(low.isin(canonical, *aliases), F.lit(canonical if canonical in available else None).cast("string"))
    return out


def hinted_platform(domain: Column, hint: Column) -> Column:
    """The platform of a domain, and only where that says nothing what a hint says."""
    low = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    said = F.when(low.isin("", "web", "generic"), F.lit(None).cast("string")).when(low.isin(*[p for p, _ in V.PLATFORM_DOMAINS]), low).when(low == "news", F.lit("news_site"))
    for canonical, aliases in V.PLATFORM_ALIASES:
        said = said.when(U.any_of(low.contains(a) for a in aliases), F.lit(canonical))
    known = U.platform_of(domain)
    return F.when(known == "web", F.coalesce(said, F.lit("web"))).otherwise(known)


def target_platform(platform: Column, domain: Column, url: Column) -> Column:
    """A target's platform: its own, a feed by its path, one whose domain its host contains, else web."""
    own, host, place = F.lower(F.trim(F.coalesce(platform, F.lit("")))), F.lower(F.coalesce(F.nullif(domain, F.lit("")), U.authority(url))), F.lower(U.path(url))
    out = F.when((own != "") & (own != "web"), own).when(place.endswith(".xml") | place.contains("/feed") | place.endswith("/rss"), F.lit("rss"))
    for name, domains in V.TARGET_DOMAINS:
        out = out.when(U.any_of(host.contains(x) for x in domains), F.lit(name))
    return out.otherwise(F.lit("web"))


def catalog(configured: DataFrame) -> DataFrame:
    """Sources (name, enabled, has_key) with what they need and whether they are ready; a null is no."""
    keyed = F.col("name").isin(*V.KEYED_SOURCES)
    return configured.select("name", keyed.alias("needs_key"), (F.coalesce("enabled", F.lit(False)) & (~keyed | F.coalesce("has_key", F.lit(False)))).alias("ready"))


def search_links(captured: DataFrame, source: str, *, per_query: int = V.PER_QUERY) -> DataFrame:
    """Links of captured searches (query, platform_hint, target_results, json) of one source, with OPTIONAL columns of a score.

    Positions count from 1 as entries come, those without a usable address too. A query
    gives no more than ``per_query`` and its own target_results, and what its service gives.
    JSON that can't be read has no links.
    """
    s = SEARCHES[source]
    most = F.least(F.lit(per_query), F.coalesce("target_results", F.lit(per_query)), *([F.lit(s.most)] if s.most else []))
    rows = captured.select("query", "platform_hint", F.posexplode(F.slice(s.entries(F.from_json("json", s.schema)), F.lit(1), F.greatest(most, F.lit(0)))).alias("pos", "e"))
    first = lambda names: F.coalesce(*[F.nullif(F.col(f"e.{n}"), F.lit("")) for n in names], F.lit(""))
    rows = once(rows.select("query", "platform_hint", (F.col("pos") + 1).alias("position"), "e", first(s.address).alias("url")))
    rows = once(rows.withColumn("normalized_url", U.normalize_url(F.col("url"))).withColumn("domain", U.domain(F.col("url")))).where("normalized_url <> ''")
    return rows.select(
        "url", F.coalesce("e.title", F.lit("")).alias("title"), first(s.about).alias("description"), hinted_platform(F.col("domain"), F.col("platform_hint")).alias("platform"), F.lit(source).alias("source_name"), F.lit("search").alias("source_type"),
        F.col("query").alias("discovery_query"), "position", "domain", (F.col("e.date") if s.dated else F.lit(None).cast("string")).alias("published_at"), s.quality(F.col("position")).cast("double").alias("quality_signal"), F.lit(s.relevance).alias("relevance_signal"),
    )


def scraped_pages(captured: DataFrame) -> DataFrame:
    """Documents from captured scrapes (url, title, html, markdown): of the page's html, its text replaced by the Markdown where it has none; without html of the Markdown alone. Rows with neither are left out."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    plain = F.btrim(F.coalesce("markdown", F.lit("")), F.lit(SPACES))
    rows = captured.where(given("html") | (plain != ""))
    pages = H.documents(rows.select("url", F.col("title").alias("given_title"), "markdown", "html"))
    text = F.when(F.coalesce("content_text", F.lit("")) != "", F.col("content_text")).otherwise(plain)
    return pages.select("url", F.coalesce(F.nullif("title", F.lit("")), "given_title", F.lit("")).alias("title"), text.alias("content_text"), X.without_markdown(plain).alias("plain_markdown"), F.substring(text, 1, 400).alias("excerpt"), target_platform(F.lit(None).cast("string"), F.col("domain"), F.col("url")).alias("platform"))


def videos(captured: DataFrame) -> DataFrame:
    """Documents from captured embed answers (url, title, description, json) of videos."""
    j = F.from_json("json", "struct<title:string,author_name:string,provider_name:string,thumbnail_url:string>")
    either = lambda a, b: F.coalesce(F.nullif(T.squeeze(a), F.lit("")), b)
    rows = captured.select("url", either(j["title"], T.squeeze(F.coalesce("title", F.lit("")))).alias("title"), either(j["author_name"], F.lit(None).cast("string")).alias("author"), either(j["provider_name"], F.lit("YouTube")).alias("site_name"), F.col("description"), j["thumbnail_url"].alias("thumbnail_url"))
    rows = rows.withColumn("description", T.squeeze(F.coalesce(F.nullif("description", F.lit("")), F.lit("YouTube video metadata extracted from oEmbed."))))
    return rows.withColumn("content_text", F.concat_ws("\n\n", F.nullif("title", F.lit("")), "description"))


_RSS = "struct<channel:struct<title:string,item:array<struct<title:string,link:string,description:string,author:string,pubDate:string,guid:string>>>>"
_ATOM = "struct<title:string,entry:array<struct<title:string,link:array<struct<_href:string>>,summary:string,author:struct<name:string>,published:string,id:string>>>"


def feed_entries(captured: DataFrame, *, most: int = 40) -> DataFrame:
    """url, format, feed_title, position and the entries of captured feeds (url, xml): RSS, else Atom, up to ``most`` of each. What can't be read has none."""
    rows = once(captured.select("url", F.from_xml("xml", _RSS).alias("rss"), F.from_xml("xml", _ATOM).alias("atom")))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    entry = lambda title, link, about, author, at, guid: U.named(title=text(title), link=text(link), text=T.squeeze(F.coalesce(text(about), text(title), F.lit(""))), author=text(author), published_at=text(at), guid=text(guid))
    rss = F.transform("rss.channel.item", lambda i: entry(i.title, i.link, i.description, i.author, i.pubDate, i.guid))
    atom = F.transform("atom.entry", lambda i: entry(i.title, F.get(i.link, F.lit(0))["_href"], i.summary, i.author["name"], i.published, i.id))
    is_rss = F.col("rss.channel").isNotNull()
    rows = rows.select("url", F.when(is_rss, F.lit("rss")).otherwise(F.lit("atom")).alias("format"), F.when(is_rss, text(F.col("rss.channel.title"))).otherwise(text(F.col("atom.title"))).alias("feed_title"), F.when(is_rss, rss).otherwise(atom).alias("entries"))
    return rows.select("url", "format", "feed_title", F.posexplode(F.slice("entries", 1, most)).alias("position", "e")).select("url", "format", "feed_title", "position", "e.*")
