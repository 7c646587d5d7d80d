"""Pages, feeds and threads as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts as T


def metadata(pages: DataFrame) -> DataFrame:
    """Title, language, author and description of each page; meta tags come before elements."""
    tag = lambda p: F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit(""))
    meta = lambda n: tag(f'(?is)<meta[^>]*(?:property|name)="{n}"[^>]*content="([^"]*)"')
    return pages.select(
        "page_id", F.coalesce(meta("og:title"), meta("twitter:title"), tag("(?is)<title[^>]*>(.*?)</title>"), tag("(?is)<h1[^>]*>(.*?)</h1>")).alias("title"),
        tag('(?is)<html[^>]*lang="([^"]*)"').alias("lang"), F.coalesce(meta("author"), meta("article:author")).alias("author"), F.coalesce(meta("og:description"), meta("description")).alias("description"),
    )


def feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of RSS (row_tag item) or Atom (row_tag entry) files."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def thread_depths(turns: DataFrame) -> DataFrame:
    """Messages of a conversation as a reply chain: parent and depth of each."""
    return turns.select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent"), F.col("turn").alias("depth"))


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """Captured search responses with buckets web and news, ranked from 1 as they come."""
    raw = spark.read.schema("query string, web array<struct<title:string,link:string,snippet:string>>, news array<struct<title:string,link:string,snippet:string>>").json(path)
    hits = F.concat(F.coalesce("web", F.array()), F.coalesce("news", F.array()))
    return raw.select("query", F.posexplode(hits).alias("pos", "hit")).select("query", (F.col("pos") + 1).alias("position"), "hit.*")
