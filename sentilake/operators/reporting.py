"""What a dashboard asks of scored posts: breakdowns, timelines, keywords, comparisons, pages.

Posts have seq, platform, author, content and compound (-1 to 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentiment as S
from ..functions.plan import once, staged


def posts(documents: DataFrame) -> DataFrame:
    """Documents as posts, scored by the lexicon."""
    named = documents.select(F.col("doc_id").alias("seq"), F.col("source").alias("platform"), F.col("lang").alias("author"), F.col("text").alias("content"))
    return S.lexicon_scored(named, "content").select("*", S.compound(F.col("score")).alias("compound"))


def shares(c: str = "compound") -> list[Column]:
    """Count, mean and the shares of the three classes; above 0.2 is positive, below -0.2 negative."""
    n = F.greatest(F.count("*"), F.lit(1))
    pos, neg = F.count_if(F.col(c) > 0.2), F.count_if(F.col(c) < -0.2)
    pct = lambda x: F.round(x / n * 100, 1)
    return [F.count("*").alias("post_count"), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias("avg_sentiment"), pct(pos).alias("positive_pct"), pct(neg).alias("negative_pct"), pct(F.count("*") - pos - neg).alias("neutral_pct")]


def platform_breakdown(p: DataFrame) -> DataFrame:
    return once(p.select("platform", "compound")).groupBy("platform").agg(*shares()).orderBy("platform")


def summary(p: DataFrame) -> DataFrame:
    return once(p.select("compound")).agg(*shares())


def timeline(facts: DataFrame, ts: str = "ts") -> DataFrame:
    """Mean and class counts of each day."""
    return facts.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(
        F.round(F.avg("compound"), 4).alias("avg_sentiment"), F.count("*").alias("post_count"),
        F.count_if(F.col("compound") > 0.2).alias("positive"), F.count_if(F.col("compound") < -0.2).alias("negative"), F.count_if(F.col("compound").between(-0.2, 0.2)).alias("neutral"),
    )


def volume_share(days: DataFrame) -> DataFrame:
    """Each day's posts as a share of the busiest day's."""
    busiest = days.agg(F.max("post_count").alias("busiest"))
    return days.crossJoin(F.broadcast(busiest)).select("day", "post_count", F.round(F.col("post_count") / F.col("busiest") * 100, 1).alias("volume_pct"))


def keyword_list(content: Column) -> Column:
    """Words of four letters or more, in order."""
    return F.regexp_extract_all(F.lower(content), F.lit("[\\p{L}\\p{N}_]{4,}"), 0)


def keywords(p: DataFrame) -> DataFrame:
    """A row for each keyword a post holds, and where they come."""
    return p.select(*[c for c in p.columns if c not in ("seq", "content", "compound", "score", "author", "ts")], "seq", F.posexplode(keyword_list(F.col("content"))).alias("pos", "keyword"))


def top_keywords(p: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k most frequent keywords; on ties the one seen first."""
    by = by or []
    counts = keywords(p).groupBy(*by, "keyword").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    order = [F.desc("n"), "first", "keyword"]
    if not by:
        return counts.orderBy(*order).limit(k).select("keyword", "n")
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).select(*by, "rank", "keyword", "n")


def keyword_lists(p: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k top keywords of each group as a list, in order."""
    ranked = top_keywords(p, k, by)
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x.keyword).alias("top_keywords"))


def breakdown_report(p: DataFrame, k: int = 5) -> DataFrame:
    """Each platform's counts and shares with its top keywords, by platform."""
    words = keyword_lists(p, k, ["platform"]).withColumnRenamed("platform", "of")
    b = platform_breakdown(p)
    return b.join(words, b["platform"].eqNullSafe(F.col("of")), "left").select(*b.columns, F.coalesce("top_keywords", F.array().cast("array<string>")).alias("top_keywords")).orderBy("platform")


def summary_report(p: DataFrame, ts: str = "ts", k: int = 10) -> DataFrame:
    """One row: counts and shares of all posts, the contents of the most positive and the most negative, the top keywords, and each day's counts in order.

    Days without a date are left out; of equally extreme posts the first counts.
    """
    facts = staged(p.select("seq", "compound", ts))  # narrow, and scored once
    ends = extremes(facts)
    contents = p.select("seq", "content").join(F.broadcast(ends), F.col("seq").isin(F.col("most_positive"), F.col("most_negative")))
    content = lambda c: F.max(F.when(F.col("seq") == F.col(c), F.col("content")))
    said = contents.agg(F.coalesce(content("most_positive"), F.lit("")).alias("most_positive_post"), F.coalesce(content("most_negative"), F.lit("")).alias("most_negative_post"))
    words = keyword_lists(p.withColumn("all", F.lit(1)), k, ["all"]).agg(F.coalesce(F.first("top_keywords"), F.array().cast("array<string>")).alias("top_keywords"))
    days = timeline(facts.where(F.col(ts).isNotNull()), ts).agg(F.array_sort(F.collect_list(F.struct("day", "avg_sentiment", "post_count", "positive", "negative", "neutral"))).alias("sentiment_over_time"))
    # each is one row
    whole = summary(facts).withColumnsRenamed({"post_count": "total_posts", "avg_sentiment": "avg_compound"})
    return whole.crossJoin(said).crossJoin(words).crossJoin(days)


def keyword_weights(top: DataFrame) -> DataFrame:
    """Of few keywords in order their weight: from 1 down in equal steps."""
    ranked = top.coalesce(1).withColumn("i", F.monotonically_increasing_id())
    whole = Window.partitionBy(F.lit(0))
    return ranked.select("keyword", "n", F.round((F.count("*").over(whole) - F.col("i")) / F.count("*").over(whole), 6).alias("weight"))


def extremes(p: DataFrame) -> DataFrame:
    """The most positive and the most negative post; on ties the first."""
    return once(p.select("seq", "compound")).agg(F.max_by("seq", F.struct("compound", -F.col("seq"))).alias("most_positive"), F.min_by("seq", F.struct("compound", "seq")).alias("most_negative"))


def label_counts(p: DataFrame) -> DataFrame:
    p = once(p.select("score", "compound"))
    three = p.groupBy(S.label3(F.col("score")).alias("label")).agg(F.count("*").alias("n")).withColumn("scheme", F.lit("three"))
    five = p.groupBy(S.label5(F.col("compound")).alias("label")).agg(F.count("*").alias("n")).withColumn("scheme", F.lit("five"))
    return three.unionByName(five)


def dominant_class(breakdown: DataFrame) -> DataFrame:
    pos, neg, neu = (F.col(f"{c}_pct") for c in ("positive", "negative", "neutral"))
    label = F.when((pos > neg) & (pos > neu), F.lit("Positive")).when((neg >= pos) & (neg > neu), F.lit("Negative")).otherwise(F.lit("Neutral"))
    return breakdown.select("platform", label.alias("dominant"))


def dashboard_page(p: DataFrame, *, platforms: list[str] = (), low: float = -1.0, high: float = 1.0, search: str = "", page: int = 0, size: int = 20) -> DataFrame:
    """One page of the posts that pass the dashboard's filters, most positive first."""
    if platforms:
        p = p.where(F.col("platform").isin(*platforms))
    if search:
        p = p.where(F.lower("content").contains(search.lower()) | F.lower("author").contains(search.lower()))
    # what is cheap comes before the scores, and these are worked out once
    scored = once(p.select("seq", "platform", "compound"))
    return scored.where(F.col("compound").between(low, high)).orderBy(F.desc("compound"), "seq").offset(page * size).limit(size)


def sorted_page(p: DataFrame, by: str, *, descending: bool = False, page: int = 0, size: int = 20) -> DataFrame:
    """One page of posts in order of a column, either way; of equal ones the first comes first."""
    order = F.desc(by) if descending else F.asc(by)
    return p.orderBy(order, "seq").offset(page * size).limit(size)


def quick_ranges(p: DataFrame) -> DataFrame:
    c = F.col("compound")
    return p.agg(F.count("*").alias("everything"), F.count_if(c.between(0.2, 1)).alias("positive"), F.count_if(c.between(-0.2, 0.2)).alias("neutral"), F.count_if(c.between(-1, -0.2)).alias("negative"))


def compare_platforms(base: DataFrame, target: DataFrame) -> DataFrame:
    """Platforms of two results side by side; a change only where both have one."""
    sides = [d.groupBy("platform").agg(F.count("*").alias(f"{n}_posts"), F.round(F.avg("compound"), 4).alias(f"{n}_avg")) for n, d in (("base", base), ("target", target))]
    joined = sides[0].join(sides[1], "platform", "full_outer")
    delta = F.round(F.col("target_avg") - F.col("base_avg"), 4)
    return joined.select("platform", *[F.coalesce(f"{n}_posts", F.lit(0)).cast("long").alias(f"{n}_posts") for n in ("base", "target")], "base_avg", "target_avg", delta.alias("delta"), S.direction(delta).alias("direction"))


def compare_summaries(base: DataFrame, target: DataFrame) -> DataFrame:
    delta = F.round(F.col("t.avg_sentiment") - F.col("b.avg_sentiment"), 4)
    return summary(base).alias("b").crossJoin(summary(target).alias("t")).select(F.col("b.post_count").alias("base_posts"), F.col("t.post_count").alias("target_posts"), F.col("b.avg_sentiment").alias("base_avg"), F.col("t.avg_sentiment").alias("target_avg"), delta.alias("delta"), S.direction(delta).alias("direction"))


def compare_keywords(base: DataFrame, target: DataFrame) -> DataFrame:
    """Keywords that came, went or stayed."""
    a, b = (d.select("keyword").distinct().withColumn(n, F.lit(True)) for n, d in (("was", base), ("is", target)))
    change = F.when(F.col("was").isNull(), F.lit("added")).when(F.col("is").isNull(), F.lit("removed")).otherwise(F.lit("common"))
    return a.join(b, "keyword", "full_outer").select("keyword", change.alias("change"))


def narrative(rows: DataFrame, out: str = "narrative") -> DataFrame:
    """``rows`` with a comparison in words: of base and target their topic, version, posts and avg, and delta, direction, added and removed (keywords in order, of which five are named)."""
    two = lambda c: F.format_string("%.2f", c)
    bold = lambda prefix, c: F.concat(F.lit(f"**{prefix}"), F.col(c).cast("string"), F.lit("**"))
    quoted = lambda c: F.concat(F.lit('**"'), F.col(c), F.lit('"**'))
    same = F.concat(F.lit("Comparing "), bold("v", "base_version"), F.lit(" vs "), bold("v", "target_version"), F.lit(" for "), quoted("base_topic"), F.lit("."))
    unlike = F.concat(F.lit("Comparing "), quoted("base_topic"), F.lit(" (v"), F.col("base_version").cast("string"), F.lit(") vs "), quoted("target_topic"), F.lit(" (v"), F.col("target_version").cast("string"), F.lit(")."))
    avgs = F.concat(two("base_avg"), F.lit(" → "), two("target_avg"))
    moved = F.concat(F.lit("Overall sentiment **"), F.col("direction"), F.lit("** by "), two(F.abs("delta")), F.lit(" (from "), avgs, F.lit(")."))
    shift = F.when(F.col("direction") == "stable", F.concat(F.lit("Overall sentiment remained **stable** ("), avgs, F.lit(")."))).otherwise(moved)
    more = F.col("target_posts") - F.col("base_posts")
    volume = lambda word: F.concat(F.lit(f"Data volume {word} by "), F.abs(more).cast("string"), F.lit(" posts ("), F.col("base_posts").cast("string"), F.lit(" → "), F.col("target_posts").cast("string"), F.lit(")."))
    listed = lambda said, c: F.when(F.size(c) > 0, F.concat(F.lit(said), F.array_join(F.slice(c, 1, 5), ", "), F.lit(".")))
    parts = [F.when(F.col("base_topic") == F.col("target_topic"), same).otherwise(unlike), shift, F.when(more > 0, volume("increased")).when(more < 0, volume("decreased")), listed("New keywords emerged: ", "added"), listed("Keywords dropped out: ", "removed")]
    return rows.withColumn(out, F.concat_ws(" ", *parts))


def confusion(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """How a scorer's labels meet the true ones (an extension)."""
    return scored.join(labels, scored["seq"] == labels["doc_id"]).groupBy(S.label3(F.col("score")).alias("label"), "quality", "toxic").agg(F.count("*").alias("n"))
