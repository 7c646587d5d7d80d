"""Stored documents: their items, one row each, and what is kept of a scraped page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V

SPACES = " \t\n\r\x0b\x0c"


def given(c: Column) -> Column:
    """A text without outer white space; null where nothing is left."""
    return F.nullif(F.btrim(c, F.lit(SPACES)), F.lit(""))


def reference_url(source_url: Column, url: Column, metadata: Column) -> Column:
    """The first address given: the item's own, then those that its metadata names."""
    return F.coalesce(given(source_url), given(url), *[given(F.try_element_at(metadata, F.lit(k))) for k in V.ADDRESS_KEYS])


def content_items(items: DataFrame) -> DataFrame:
    """Items with an id, an excerpt and the counted metrics of their metadata.

    ``items`` has normalized_url, position, kind, title, text, source_url, url and metadata, a
    map of texts. An item's id is a hash of its page and its address, or of what it holds.
    """
    rows = items.withColumn("address", reference_url(F.col("source_url"), F.col("url"), F.col("metadata")))
    title, text, kind = given(F.col("title")), given(F.col("text")), F.coalesce(F.nullif("kind", F.lit("")), F.lit("content"))
    held = F.concat_ws(":", kind, F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 160), F.col("position").cast("string"))
    item_id = F.sha2(F.btrim(F.concat_ws(":", "normalized_url", F.coalesce("address", held)), F.lit(SPACES)), 256)
    return rows.select(
        "normalized_url", item_id.alias("item_id"), "position", kind.alias("kind"), F.col("address").alias("url"), title.alias("title"), text.alias("text"),
        F.substring(text, 1, 280).alias("excerpt"), F.map_filter("metadata", lambda k, _: k.isin(*V.METRICS)).alias("metrics"),
        F.when(F.col("address").isNotNull(), F.coalesce(title, "address")).alias("reference"),
    )


def payloads(targets: DataFrame, scraped: DataFrame, key: str) -> DataFrame:
    """What is stored of each scraped target: the page's own values, else the target's, and hashes.

    ``targets`` has the key, normalized_url, title, domain and platform; ``scraped`` the key, the
    last three, content_text and raw_text. Targets that weren't scraped have no payload.
    """
    both = targets.alias("t").join(scraped.alias("s"), key)
    either = [F.coalesce(F.nullif(f"s.{c}", F.lit("")), f"t.{c}").alias(c) for c in ("title", "domain", "platform")]
    body = F.coalesce(F.nullif("s.content_text", F.lit("")), "s.raw_text")
    return both.select(key, "normalized_url", F.sha2("normalized_url", 256).alias("normalized_url_hash"), *either, F.sha2(given(body), 256).alias("content_hash"))
