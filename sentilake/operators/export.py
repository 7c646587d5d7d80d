"""Exports: rows for CSV and JSON, a Markdown report of the small aggregates, file names."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

from .reporting import keyword_list, platform_breakdown, summary, top_keywords


def iso_time(ts: Column, kind: DataType) -> Column:
    """A time as Python's isoformat writes it: microseconds only if there are any, an offset only if it has a zone."""
    if not isinstance(kind, (TimestampType, TimestampNTZType)):
        return ts.cast("string")
    part = F.when(F.date_format(ts, "SSSSSS") == "000000", F.lit("")).otherwise(F.date_format(ts, ".SSSSSS"))
    zone = F.date_format(ts, "xxx") if isinstance(kind, TimestampType) else F.lit("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), part, zone)


def csv_rows(posts: DataFrame) -> DataFrame:
    """The reference's columns in its order, with whole contents; url and timestamp only where the posts have them.

    Keywords are the distinct ones of the content, in order, joined by "; ".
    """
    c, known = F.col("compound"), {f.name: f.dataType for f in posts.schema}
    url = ["url"] if "url" in known else []
    ts = [iso_time(F.col("timestamp"), known["timestamp"]).alias("timestamp")] if "timestamp" in known else []
    words = F.concat_ws("; ", F.array_distinct(keyword_list(F.col("content"))))
    return posts.select(F.col("seq").alias("id"), "platform", "author", "content", *url, F.round(F.greatest(c, F.lit(0.0)), 4).alias("positive"), F.round(F.greatest(-c, F.lit(0.0)), 4).alias("negative"), F.round(1 - F.abs(c), 4).alias("neutral"), F.round(c, 4).alias("compound"), words.alias("keywords"), *ts)


def write_csv(posts: DataFrame, path: str) -> None:
    """Quotes are doubled and white space stays, so that CSV readers get the contents back."""
    whole = csv_rows(posts).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True)
    whole.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(posts: DataFrame, path: str) -> None:
    posts.write.mode("overwrite").json(path)


def file_name(topic: str, version: int, day: date, ending: str) -> str:
    return f"{re.sub(' ', '-', topic.lower())[:40]}-v{version}-{day:%Y%m%d}.{ending}"


def markdown(posts: DataFrame, topic: str) -> str:
    """A report from aggregated rows, one for each platform."""
    s = summary(posts).head()
    tone = "positive" if s.avg_sentiment > 0.1 else "negative" if s.avg_sentiment < -0.1 else "neutral"
    lines = [f"# {topic}", "", f"{s.post_count} posts, {tone} on the whole ({s.avg_sentiment:+.4f}).", "", "| platform | posts | mean | positive % | negative % | neutral % |", "| --- | --- | --- | --- | --- | --- |"]
    lines += [f"| {r.platform} | {r.post_count} | {r.avg_sentiment} | {r.positive_pct} | {r.negative_pct} | {r.neutral_pct} |" for r in platform_breakdown(posts).collect()]
    lines += ["", "Keywords: " + ", ".join(r.keyword for r in top_keywords(posts, 10).collect())]
    return "\n".join(lines) + "\n"
