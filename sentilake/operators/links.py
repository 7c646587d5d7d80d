"""Links: anchors of pages, scores, acceptance, the cap, and the merge of sightings.

Arrival order is the column seq; every rule about what came first or last uses it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import urls as U
from ..functions.plan import once, staged
from ..functions.texts import count_terms
from . import merging


#: An anchor: its quoted address, and what it holds.
ANCHOR = "(?is)<a\\s[^>]*href=(\"[^\"]*\"|'[^']*')[^>]*>(.*?)</a>"
#: Anchors of a page that have a place in arrival order; more than a page of 64 MB can hold.
PER_PAGE = 10_000_000


@dataclass(frozen=True)
class Brief:
    """What a topic is about."""

    topic: str
    keywords: tuple[str, ...] = ()
    hashtags: tuple[str, ...] = ()

    def terms(self) -> list[str]:
        found = (self.topic, *self.keywords[:25], *self.hashtags[:15])
        return list(dict.fromkeys(t for x in found if (t := x.lower().strip("# "))))


def anchors(pages: DataFrame) -> DataFrame:
    """A row for each anchor of each page: seq, page_id, pos, url (absolute) and title, without inner tags."""
    whole = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))
    rows = pages.select("page_id", F.col("url").alias("base"), U.parts(F.col("url")).alias("b"), F.posexplode(whole).alias("pos", "a"))
    rows = once(rows.select("*", F.regexp_extract("a", ANCHOR, 1).alias("href")))
    rows = once(rows.withColumn("h", F.substring("href", F.lit(2), F.length("href") - 2)))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("a", ANCHOR, 2), "<[^>]*>", ""), "[ \\t\\n\\r]+", " "))
    return rows.select(
        (F.col("page_id") * PER_PAGE + F.col("pos")).alias("seq"), "page_id", F.col("pos").cast("long").alias("pos"),
        U.join_parts(F.col("base"), F.col("b"), F.col("h")).alias("url"), title.alias("title"),
    )


#: What a link may bring besides url and title, and what stands for it where it doesn't.
OPTIONAL = {"description": "string", "author": "string", "published_at": "string", "discovery_query": "string", "anchor_text": "string", "source_name": "string", "position": "int", "quality_signal": "double", "relevance_signal": "double"}


def score(links: DataFrame, brief: Brief) -> DataFrame:
    """``links`` (url, title and any of OPTIONAL) with quality, relevance and reason.

    What fails before it is scored has fixed scores and a reason. Else relevance counts the
    brief's and the telling terms in title, description, query and anchor text, and quality
    adds up what is known of the link, its place and platform, and a part of the relevance.
    Pages that a browser found on no known platform without a telling term lose a quarter.
    """
    had = links.columns
    rows = links.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in OPTIONAL.items() if c not in had])
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    part = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    text = F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "description", "discovery_query", "anchor_text")]))
    # a url is taken apart once, and so are its text and terms
    rows = once(rows.withColumn("__parts", U.parts(F.col("url"))).withColumn("__text", text))
    counts = [count_terms(F.col("__text"), terms).alias(c) for c, terms in (("__terms", brief.terms()), ("__evidence", V.EVIDENCE_TERMS), ("__neutral", V.NEUTRAL_TERMS))]
    rows = once(rows.select("*", U.normalized_parts(F.col("__parts")).alias("__n"), F.regexp_replace("__parts.authority", "^www\\.", "").alias("__domain"), *counts))
    rows = once(rows.select("*", U.joined(F.col("__n")).alias("normalized_url"), U.platform_of(F.col("__domain")).alias("platform"), U.query_keys(F.col("__n.query")).alias("__keys")))
    title = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    low = U.low_value(F.col("normalized_url"), F.col("__n.authority"), F.concat(F.col("__n.path"), F.when(F.col("__n.path") == "", F.lit("/")).otherwise(F.lit(""))), F.col("__keys"))
    reason = F.when(F.col("normalized_url") == "", F.lit("invalid_url")).when(low, F.lit("low_value_url")).when(title.isin(*V.LOW_SIGNAL_TITLES), F.lit("navigation_link"))
    signal = lambda c: F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0)))
    relevance = F.least(F.lit(1.0), 0.15 + F.col("__terms") * 0.12 + F.col("__evidence") * 0.04 + signal("relevance_signal"))
    rows = once(rows.select("*", reason.alias("reason"), relevance.alias("__relevance")))
    web = F.col("platform") == "web"
    quality = 0.2 + part(given("title"), 0.12) + part(given("description"), 0.10) + part(given("author"), 0.05) + part(given("published_at"), 0.05)
    quality = quality + F.coalesce((20 - F.least("position", F.lit(20))) * 0.01, F.lit(0.0)) + part(~web, 0.08)
    quality = quality + F.least(F.lit(0.18), F.col("__evidence") * 0.03) - F.least(F.lit(0.2), F.col("__neutral") * 0.05)
    quality = quality - part(F.col("source_name").isin(*V.BROWSER_SOURCES) & web & (F.col("__evidence") == 0), 0.25)
    quality = quality + signal("quality_signal") + F.col("__relevance") * 0.35
    fixed = F.when(F.col("reason") == "invalid_url", F.lit(0.0)).when(F.col("reason").isNotNull(), F.lit(0.05))
    scores = F.coalesce(fixed, F.least(F.lit(1.0), F.greatest(F.lit(0.0), quality))).alias("quality"), F.coalesce(fixed, F.col("__relevance")).alias("relevance")
    return rows.select(*had, "normalized_url", "platform", "reason", *scores)


def accepted(scored: DataFrame, minimum: float = V.MIN_QUALITY) -> DataFrame:
    return scored.where((F.col("normalized_url") != "") & (F.col("quality") >= minimum))


def cap(links: DataFrame, most: int = V.MAX_LINKS) -> DataFrame:
    """Sightings up to the moment when ``most`` distinct links have come."""
    links = staged(links)
    firsts = links.groupBy("normalized_url").agg(F.min("seq").alias("first"))
    last = firsts.orderBy("first").limit(most).agg(F.max("first").alias("last"), F.count("*").alias("n"))
    # fewer links than the cap: everything stays
    return links.crossJoin(F.broadcast(last)).where((F.col("n") < most) | (F.col("seq") <= F.col("last"))).drop("last", "n")


def merge(sightings: DataFrame) -> DataFrame:
    """One row for each link, from all its sightings in one grouped pass."""
    longest = lambda c: F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col("seq")))
    return sightings.groupBy("normalized_url").agg(
        F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen"), (F.count("*") - 1).alias("duplicate_count"),
        longest("title").alias("title"), F.max("quality").alias("quality"), F.max("relevance").alias("relevance"),
        F.max_by("page_id", "seq").alias("last_page"), F.min_by("author", F.when(F.col("author").isNotNull(), F.col("seq"))).alias("author"),
    )


#: Columns of a stored link that the latest sighting sets, and those where the longest text stays.
LATEST, LONGEST = ("platform", "source_name", "source_type", "discovery_query", "raw_payload"), ("title", "description")
LINK_RULES = {
    "first_seen": merging.LEAST, "times": merging.ADD, **dict.fromkeys(LONGEST, merging.LONGEST), **dict.fromkeys(("author", "published_at"), merging.FIRST),
    **dict.fromkeys(LATEST, merging.LATEST), **dict.fromkeys(("quality", "relevance"), merging.MOST), "metadata": merging.MAPPED,
}


def upsert(stored: DataFrame | None, sightings: DataFrame) -> DataFrame:
    """The stored links after all sightings in order of seq, and the links that these bring.

    Both have normalized_url, LATEST, LONGEST, author, published_at, quality, relevance and
    metadata (a map of texts); ``stored`` also first_seen, last_seen and duplicate_count,
    ``sightings`` seq, which grows and lies beyond what is stored. Longest texts stay, of
    equal ones the earlier; the first author and date stay; scores only rise; of a metadata
    key the latest value counts.
    """
    new = sightings.withColumns({"last_seen": F.col("seq"), "first_seen": F.col("seq"), "times": F.lit(1).cast("long")})
    old = new.limit(0) if stored is None else stored.withColumn("times", F.col("duplicate_count") + 1)
    links = merging.merge(old, new, ["normalized_url"], "last_seen", LINK_RULES).withColumn("duplicate_count", F.col("times") - 1)
    return links.select("normalized_url", "first_seen", "last_seen", "duplicate_count", *LONGEST, "author", "published_at", *LATEST, "quality", "relevance", "metadata")


def distinct_anchors(found: DataFrame) -> DataFrame:
    """The first anchor of each address on each page, without empty addresses."""
    rows = found.withColumn("normalized_url", U.normalize_url(F.col("url"))).where("normalized_url <> ''")
    return rows.groupBy("page_id", "normalized_url").agg(F.min(F.struct("seq", "title")).alias("a")).select("page_id", "normalized_url", "a.seq", "a.title")


def expansion_seeds(scored: DataFrame, n: int) -> DataFrame:
    """The n strongest links that no rule rejected, by both scores together; of equal ones the first."""
    return scored.where("reason is null").withColumn("strength", F.round(F.col("quality") + F.col("relevance"), 9)).orderBy(F.desc("strength"), "seq").limit(n)


def queue(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links that the scrape queue doesn't hold by either of its keys."""
    rows = links.withColumn("unique_id", U.unique_id(F.col("normalized_url")))
    return rows.join(known.select("unique_id"), "unique_id", "left_anti").join(known.select("normalized_url"), "normalized_url", "left_anti")


def best_targets(links: DataFrame, n: int = V.MAX_TARGETS) -> DataFrame:
    return links.orderBy(F.desc("quality"), F.desc("relevance"), "first_seen").limit(n)


def reusable(now: Column, last: Column, days: int = V.REUSE_DAYS) -> Column:
    return F.coalesce(last >= now - F.make_interval(days=F.lit(days)), F.lit(False))
