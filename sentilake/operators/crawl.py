"""A bounded crawl over captured pages: a frontier for each task, gates, and a visited set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import urls as U
from ..functions.plan import staged
from ..functions.texts import count_terms
from . import links


def low_signal(href: Column, title: Column, text: Column) -> Column:
    """Whether a browser's link leads to a search, a sign-in page or a menu's entry."""
    low, empty = F.lower(F.coalesce(href, F.lit(""))), F.lit("")
    return (
        U.any_of(low.contains(x) for x in V.BROWSER_KEYS)
        | (low.contains("?q=") & U.any_of(low.contains(x) for x in V.SEARCH_HOSTS))
        | U.any_of(low.contains(x) for x in V.SIGN_IN_PATHS)
        | F.lower(F.trim(F.coalesce(title, empty))).isin(*V.BROWSER_TITLES)
        | F.lower(F.trim(F.coalesce(text, empty))).isin(*V.BROWSER_TITLES)
    )


def outbound(anchors: DataFrame, most: int = V.CRAWL_LINKS) -> DataFrame:
    """page_url, pos and url of the links that a crawl may follow: of each page's first ``most`` anchors (page_url, pos, href, title) those that lead somewhere, to no search engine, and aren't low in signal."""
    rows = anchors.where(F.col("pos") < most).withColumn("url", U.normalize_url(F.col("href")))
    ok = U.is_navigable(F.col("href")) & (F.col("url") != "") & ~U.is_search_engine(U.domain(F.col("url"))) & ~low_signal(F.col("url"), F.col("title"), F.col("title"))
    return rows.where(ok).select("page_url", "pos", "url")


def crawl(pages: DataFrame, anchors: DataFrame, seeds: DataFrame, brief: links.Brief, *, hops: int = V.CRAWL_HOPS, per_hop: int = V.CRAWL_PAGES, minimum: float = V.MIN_QUALITY, links_per_page: int = V.CRAWL_LINKS) -> DataFrame:
    """task, hop, ord, url, quality and relevance of the pages that each task's crawl accepts.

    ``pages`` (url, title, text) has each captured page once by its normalised url,
    ``anchors`` page_url, pos, href and title, ``seeds`` task, ord and url. A hop looks at a
    task's first ``per_hop`` urls in the order in which they were found, and goes on from the
    pages that pass: scored, not low in signal, quality of 0.5 and relevance of 0.35. What was
    found once is never found again by that task, whether it was looked at or not. Pages that
    weren't captured are passed over.

    Every hop is written to the shared folder. A hop takes at most ``per_hop`` pages of a
    task with ``links_per_page`` links each, so a hub is read as far as that.
    """
    edges = staged(outbound(anchors, links_per_page))
    first = seeds.where("task is not null").withColumn("url", U.normalize_url(F.col("url"))).where("url <> ''")
    frontier = staged(first.groupBy("task", "url").agg(F.min("ord").alias("ord")).withColumn("from", F.lit(0).cast("long")))
    seen, out = frontier.select("task", "url"), None
    for hop in range(1, hops + 1):
        in_order = Window.partitionBy("task").orderBy("from", "ord", "url")
        asked = frontier.withColumn("place", F.row_number().over(in_order).cast("long")).where(F.col("place") <= per_hop).select("task", "url", "place")
        met = asked.join(pages, "url").where(~low_signal(F.col("url"), F.col("title"), F.substring(F.coalesce("text", F.lit("")), 1, 120)))
        low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
        bonus = F.least(F.lit(0.2), count_terms(low, V.BROWSER_EVIDENCE) * 0.02)
        rows = met.select("task", "place", "url", "title", F.substring("text", 1, 220).alias("description"), F.lit("camoufox_agentic").alias("source_name"), F.lit(0.1 + max(0.0, 0.03 * (hops - hop))).alias("quality_signal"), (0.08 + bonus).alias("relevance_signal"))
        scored = links.score(rows, brief).where(F.col("reason").isNull() & (F.col("quality") >= max(minimum, V.CRAWL_QUALITY)) & (F.col("relevance") >= V.CRAWL_RELEVANCE))
        taken = staged(scored.select("task", F.lit(hop).alias("hop"), "place", "url", "quality", "relevance"))
        out = taken if out is None else out.unionByName(taken)
        if hop == hops or taken.isEmpty():
            break
        found = taken.select("task", "place", F.col("url").alias("page_url")).join(edges, "page_url").groupBy("task", "url").agg(F.min(F.struct("place", "pos")).alias("at"))
        frontier = staged(found.join(seen, ["task", "url"], "left_anti").select("task", "url", F.col("at.pos").cast("long").alias("ord"), F.col("at.place").alias("from")))
        seen = staged(seen.unionByName(frontier.select("task", "url")))
    return out
