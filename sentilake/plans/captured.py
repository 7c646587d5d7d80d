"""Queries over captured answers of services, made from the tables, and over small rules, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sentiment as S
from ..functions import urls as U
from ..sources import captured as C
from . import sql as Q
from .pages import _T, escaped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
HINTS = ("", "news", "Subreddit r/x", "YT clips", "generic", "tiktok", "nothing known")
NAMES = ("Search", "firecrawl", "firecrawl-news", "agentic-browser", "serpapi", "rendered_browser", " ", "unknown", "camoufox", "x")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


def cycled(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


@query
def captured_searches(spark, d):
    """Pages as the results of queries, in the answers of three services."""
    k, url = F.col("page_id"), F.col("url")
    address = F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.lit("mailto:someone")).otherwise(url)
    entry = F.struct(k.alias("k"), address.alias("link"), F.when(k % 5 == 0, url).otherwise(address).alias("url"), F.when(k % 7 > 0, F.concat(F.lit("title "), k.cast("string"))).alias("title"), F.concat(F.lit("snippet "), k.cast("string")).alias("snippet"), F.when(k % 3 == 0, F.lit("about it")).alias("description"), F.when(k % 4 == 0, F.lit("2024-01-05")).alias("date"))
    asked = table(spark, d, "pages").groupBy((k % 15).alias("q")).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    some = lambda i: F.filter("all", lambda e: e.k % 2 == i)
    answers = {"serper": F.struct(F.col("all").alias("organic")), "firecrawl_search": F.struct(F.struct(some(0).alias("web"), some(1).alias("news")).alias("data")), "serpapi": F.struct(F.col("all").alias("organic_results"))}
    rows = asked.select(F.concat(F.lit("query "), F.col("q").cast("string")).alias("query"), cycled(HINTS, F.col("q")).alias("platform_hint"), (F.col("q") % 14 + 1).cast("int").alias("target_results"), *[F.to_json(a).alias(n) for n, a in answers.items()])
    found = [C.search_links(rows.withColumn("json", F.col(n)), n) for n in answers]
    return reduce(DataFrame.unionByName, found).withColumn("quality_signal", F.round("quality_signal", 6))


@query
def captured_pages(spark, d):
    """Documents as scraped pages: with html, with Markdown, with both where the html has no text."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    html = F.when(k % 4 == 0, F.concat(F.lit("<html><title>Page</title><body><p>"), escaped(text), F.lit("</p></body></html>"))).when(k % 4 == 1, F.lit("<html><script>x</script></html>")).when(k % 4 == 2, F.lit(""))
    rows = table(spark, d, "documents").select(F.concat(F.lit("https://www.reddit.com/r/"), k.cast("string")).alias("url"), F.concat(F.lit("given "), k.cast("string")).alias("title"), html.alias("html"), F.when(k % 8 < 7, F.concat(F.lit("\n *"), F.col("source"), F.lit("* [label](http://a.b) `code`  "))).alias("markdown"))
    return C.scraped_pages(rows).select("url", "title", F.md5("content_text").alias("content_text"), "plain_markdown", "platform")


@query
def captured_feeds(spark, d):
    """Conversations as feeds of their turns, by turns RSS and Atom."""
    k, t = F.col("conv_id"), F.col("t")
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    wrap = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    link = lambda x: F.concat(F.lit("http://a.example/"), x.turn.cast("string"))
    item = lambda x: wrap("item", F.concat(wrap("title", F.concat(F.lit(" T"), x.turn.cast("string"), F.lit(" "))), wrap("link", link(x)), wrap("description", F.when(x.turn % 5 == 4, F.lit("")).otherwise(escaped(x.text))), wrap("author", x.role), wrap("pubDate", F.lit("2024-01-05"))))
    entry = lambda x: wrap("entry", F.concat(wrap("title", F.concat(F.lit("T"), x.turn.cast("string"))), F.lit("<link href='"), link(x), F.lit("'/><link href='http://b.example/'/>"), wrap("summary", F.when(x.turn % 5 == 4, F.lit("")).otherwise(escaped(x.text))), wrap("author", wrap("name", x.role)), wrap("published", F.lit("2024-01-05"))))
    name = wrap("title", F.concat(F.lit("Feed "), k.cast("string")))
    rss = F.concat(F.lit("<?xml version='1.0'?><rss version='2.0'><channel>"), name, F.array_join(F.transform(t, item), ""), F.lit("</channel></rss>"))
    atom = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), name, F.array_join(F.transform(t, entry), ""), F.lit("</feed>"))
    rows = turns.select(k.cast("string").alias("url"), F.when(k % 10 == 9, F.lit("no feed")).when(k % 2 == 0, rss).otherwise(atom).alias("xml"))
    return C.feed_entries(rows, most=6).select("url", "format", "feed_title", "position", "title", "link", F.md5("text").alias("text"), "author", "published_at")


@query
def source_names(spark, d):
    rows = table(spark, d, "events").select(cycled(NAMES, F.col("event_id")).alias("name"))
    return rows.groupBy(C.source_name(F.col("name"), ("serper", "firecrawl_search", "camoufox_agentic", "camoufox_browser", "firecrawl_news")).alias("source")).agg(F.count("*").alias("n"))


@query
def target_platforms(spark, d):
    k = F.col("page_id")
    hosts = cycled(("old.reddit.com", "x.com", "netflix.com", "bsky.app", "a.example", "youtu.be"), k)
    url = F.concat(F.lit("https://"), hosts, F.element_at(F.array(*map(F.lit, ("/a", "/feed/x", "/b.xml", "/c/rss", "/rss/c"))), (k % 5 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", C.target_platform(F.when(k % 7 == 0, F.lit(" Forum ")).when(k % 7 == 1, F.lit("web")), F.lit(None).cast("string"), url).alias("platform"))


@query
def scoring_inputs(spark, d):
    """The text that is scored, and the best of three results made of its length."""
    k, n = F.col("doc_id"), F.length("text")
    results = F.when(k % 6 == 0, F.array().cast("array<struct<label:string,score:double>>")).otherwise(F.array(*[F.struct(F.lit(label).alias("label"), ((n * m + k) % 10 / 10).alias("score")) for label, m in (("positive", 3), ("negative", 7), ("neutral", 1))]))
    picked = S.text_to_score(F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("  "), F.col("text"))), F.when(k % 4 > 0, F.lit("")).otherwise(F.lit(" cleaned ")), F.col("text"))
    best = S.best_result(results)
    return table(spark, d, "documents").select("doc_id", U.document_id(k.cast("string")).alias("document_id"), F.md5(picked).alias("text"), best["label"].alias("label"), best["score"].alias("score"))


@query
def shown_deltas(spark, d):
    return table(spark, d, "events").select("event_id", S.shown_delta((F.floor(F.abs("value")) % 41 - 20) / 100 + 0.003).alias("shown"))


def _cycled(values: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{n} % {len(values)} + 1]"


_PLATFORM = "CASE WHEN own = 'web' THEN coalesce(CASE hint WHEN 'news' THEN 'news' WHEN 'Subreddit r/x' THEN 'reddit' WHEN 'YT clips' THEN 'youtube' WHEN 'tiktok' THEN 'tiktok' END, 'web') ELSE own END"
_ANSWERS = {
    "serper": ("k", "link", "snippet", "greatest(0.0::DOUBLE, 0.2::DOUBLE - (position - 1) * 0.01::DOUBLE)", "0.1::DOUBLE", "NULL", 10), "firecrawl_search": ("k % 2, k", "u", "coalesce(about, snippet)", "0.18::DOUBLE", "0.12::DOUBLE", "dated", 25),
    "serpapi": ("k", "coalesce(nullif(link, ''), u)", "snippet", "0.15::DOUBLE", "0.1::DOUBLE", "NULL", 25),
}
SQL = {
    "captured_searches": f"""WITH e AS (SELECT page_id AS k, page_id % 15 AS q, CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 13 = 0 THEN 'mailto:someone' ELSE url END AS link, CASE WHEN page_id % 5 = 0 THEN url WHEN page_id % 11 = 0 THEN '' WHEN page_id % 13 = 0 THEN 'mailto:someone' ELSE url END AS u,
  CASE WHEN page_id % 7 > 0 THEN 'title ' || page_id ELSE '' END AS title, 'snippet ' || page_id AS snippet, CASE WHEN page_id % 3 = 0 THEN 'about it' END AS about, CASE WHEN page_id % 4 = 0 THEN '2024-01-05' END AS dated FROM pages),
a AS ({" UNION ALL ".join(f"SELECT *, {address} AS url, '{name}' AS source_name, {about} AS description, {quality} AS quality_signal, {relevance} AS relevance_signal, {dated} AS published_at FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {order}) AS position FROM e) WHERE position <= least(25, q % 14 + 1, {most})" for name, (order, address, about, quality, relevance, dated, most) in _ANSWERS.items())}),
b AS (SELECT *, {Q.NORMALIZED} AS normalized, {Q.DOMAIN} AS domain, {Q.PLATFORM} AS own, {_cycled(HINTS, "q")} AS hint FROM a)
SELECT url, title, description, {_PLATFORM} AS platform, source_name, 'search' AS source_type, 'query ' || q AS discovery_query, position::INT AS position, domain, published_at, round(quality_signal, 6) AS quality_signal, relevance_signal FROM b WHERE normalized <> ''""",
    "captured_pages": f"""WITH d AS (SELECT doc_id AS k, {_T} AS t, CASE WHEN doc_id % 8 < 7 THEN '*' || source || '* [label](http://a.b) `code`' ELSE '' END AS m, CASE WHEN doc_id % 8 < 7 THEN trim(regexp_replace(replace(source, '-', ' '), ' +', ' ', 'g')) || ' label' ELSE '' END AS plain FROM documents)
SELECT 'https://www.reddit.com/r/' || k AS url, CASE WHEN k % 4 = 0 THEN 'Page' ELSE 'given ' || k END AS title, md5(CASE WHEN k % 4 = 0 THEN CASE WHEN t = '' THEN 'Page' WHEN length(t) > 30 THEN t ELSE 'Page ' || t END ELSE m END) AS content_text, plain AS plain_markdown, 'reddit' AS platform FROM d WHERE k % 4 < 2 OR m <> ''""",
    "captured_feeds": """WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 = 4 THEN 'T' || turn ELSE coalesce(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), ''), 'T' || turn) END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations)
SELECT conv_id::VARCHAR AS url, CASE WHEN conv_id % 2 = 0 THEN 'rss' ELSE 'atom' END AS format, 'Feed ' || conv_id AS feed_title, position::INT AS position, 'T' || turn AS title, 'http://a.example/' || turn AS link, md5(text) AS text, role AS author, '2024-01-05' AS published_at FROM c WHERE position < 6 AND conv_id % 10 <> 9""",
    "source_names": f"SELECT CASE {_cycled(NAMES, 'event_id')} WHEN 'Search' THEN 'serper' WHEN 'x' THEN 'serper' WHEN 'firecrawl' THEN 'firecrawl_search' WHEN 'firecrawl-news' THEN 'firecrawl_news' WHEN 'agentic-browser' THEN 'camoufox_agentic' WHEN 'camoufox' THEN 'camoufox_browser' END AS source, count(*) AS n FROM events GROUP BY 1",
    "target_platforms": """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'forum' WHEN page_id % 5 BETWEEN 1 AND 3 THEN 'rss' ELSE ['reddit', 'x', 'x', 'bluesky', 'web', 'youtube'][page_id % 6 + 1] END AS platform FROM pages""",
    "scoring_inputs": """WITH d AS (SELECT doc_id AS k, text, length(text) AS n, CASE WHEN doc_id % 3 = 1 THEN '  ' || text WHEN doc_id % 4 = 0 THEN ' cleaned ' ELSE text END AS t FROM documents),
r AS (SELECT *, CASE WHEN k % 6 > 0 THEN (n * 3 + k) % 10 END AS a, (n * 7 + k) % 10 AS b, (n + k) % 10 AS c FROM d)
SELECT k AS doc_id, 'doc_' || substring(sha256(k::VARCHAR), 1, 24) AS document_id, md5(substring(trim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1, 4000)) AS text,
  CASE WHEN a IS NULL THEN 'neutral' WHEN a >= b AND a >= c THEN 'positive' WHEN b >= c THEN 'negative' ELSE 'neutral' END AS label, CASE WHEN a IS NULL THEN 0.5 ELSE greatest(a, b, c) / 10 END::DOUBLE AS score FROM r""",
    "shown_deltas": "SELECT event_id, CASE WHEN v > 0.01 THEN '+' || printf('%.2f', v) WHEN v < -0.01 THEN printf('%.2f', v) ELSE 'No change' END AS shown FROM (SELECT event_id, (floor(abs(value))::BIGINT % 41 - 20) / 100 + 0.003::DOUBLE AS v FROM events)",
}
