"""The query catalogue: each query over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import planning as N
from ..functions import sentiment as S
from ..functions import texts as T
from ..functions import urls as U
from ..operators import cleaning, documents, export, links, reporting, runs
from ..sources import pages as P
from ..streaming import events as E
from . import captured, pages, sql, states, writers

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = states.QUERIES | pages.QUERIES | writers.QUERIES | captured.QUERIES
SQL = sql.SQL | states.SQL | pages.SQL | writers.SQL | captured.SQL
BRIEF = links.Brief("the", ("and", "tion"), ("#of",))
HINTS = ("reddit", "YouTube", "facebook", "instagram", "news", "web")
POSITIVE_KEYWORDS, NEGATIVE_KEYWORDS = ("the", "and", "tion"), ("of", "eau")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


def posts(spark, d):
    return reporting.posts(table(spark, d, "documents"))


def facts(spark, d):
    """Events as scored facts."""
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("platform"), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("value") - 50) / 100)).alias("compound"))


def halves(spark, d):
    e, cut = facts(spark, d), F.lit("2024-01-16").cast("timestamp_ntz")
    return e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut)


@query
def platform_breakdown(spark, d):
    return reporting.platform_breakdown(posts(spark, d))


@query
def sentiment_summary(spark, d):
    return reporting.summary(posts(spark, d))


@query
def daily_timeline(spark, d):
    return reporting.timeline(facts(spark, d))


@query
def timeline_volume_pct(spark, d):
    return reporting.volume_share(reporting.timeline(facts(spark, d)))


@query
def top_keywords_global(spark, d):
    return reporting.top_keywords(posts(spark, d), 10)


@query
def top_keywords_per_platform(spark, d):
    return reporting.top_keywords(posts(spark, d), 5, ["platform"])


@query
def extreme_posts(spark, d):
    return reporting.extremes(posts(spark, d))


@query
def label_histograms(spark, d):
    return reporting.label_counts(posts(spark, d))


@query
def dominant_class(spark, d):
    return reporting.dominant_class(reporting.platform_breakdown(posts(spark, d)))


@query
def dashboard_filter_page(spark, d):
    return reporting.dashboard_page(posts(spark, d), platforms=["src0", "src1", "src2"], low=-0.5, high=1.0, search="the", page=1)


@query
def quick_range_counts(spark, d):
    return reporting.quick_ranges(facts(spark, d))


@query
def compare_platforms(spark, d):
    return reporting.compare_platforms(*halves(spark, d))


@query
def compare_summary(spark, d):
    return reporting.compare_summaries(*halves(spark, d))


@query
def compare_keywords(spark, d):
    p = reporting.keywords(posts(spark, d))
    return reporting.compare_keywords(p.where("platform = 'src0'"), p.where("platform = 'src1'"))


@query
def normalize_urls(spark, d):
    u = U.normalize_url(F.col("url"))
    return table(spark, d, "pages").select("page_id", u.alias("normalized_url"), U.unique_id(u).alias("unique_id"), U.domain(F.col("url")).alias("domain"))


@query
def infer_platforms(spark, d):
    return table(spark, d, "pages").groupBy(U.infer_platform(F.col("url")).alias("platform")).agg(F.count("*").alias("n"))


@query
def low_value_urls(spark, d):
    return table(spark, d, "pages").select("page_id", U.is_low_value(F.col("url")).alias("low_value"))


@query
def backend_plans(spark, d):
    plan = U.backend_plan(U.infer_platform(F.col("url")), ("generic_http", "crawlbase"))
    return table(spark, d, "pages").select("page_id", F.array_join(plan, ",").alias("plan"))


def sightings(spark, d):
    """Anchors as scored sightings; the title of each third page stands in for an author."""
    a = links.anchors(table(spark, d, "pages"))
    return links.score(a.withColumn("position", F.col("pos") + 1), BRIEF).withColumn("author", F.when(F.col("page_id") % 3 == 0, F.col("title")))


@query
def anchor_edges(spark, d):
    return links.anchors(table(spark, d, "pages"))


@query
def score_links(spark, d):
    return sightings(spark, d).select("seq", "platform", "reason", F.round("quality", 6).alias("quality"), F.round("relevance", 6).alias("relevance"))


@query
def link_merge(spark, d):
    m = links.merge(links.accepted(sightings(spark, d)))
    return m.withColumn("quality", F.round("quality", 6)).withColumn("relevance", F.round("relevance", 6))


@query
def link_cap(spark, d):
    return links.cap(links.accepted(sightings(spark, d)), 500).select("seq", "normalized_url")


@query
def scrape_queue_bootstrap(spark, d):
    rows = table(spark, d, "pages")
    known = rows.where("page_id % 2 = 0").select(U.normalize_url(F.col("url")).alias("normalized_url")).withColumn("unique_id", U.unique_id(F.col("normalized_url")))
    return links.queue(rows.select("page_id", U.normalize_url(F.col("url")).alias("normalized_url")), known).select("page_id", "unique_id")


@query
def scrape_queue_topk(spark, d):
    m = links.merge(links.accepted(sightings(spark, d)))
    return links.best_targets(m.withColumn("quality", F.round("quality", 6)).withColumn("relevance", F.round("relevance", 6))).select("normalized_url", "quality", "relevance")


@query
def clean_text_features(spark, d):
    rows = cleaning.with_features(table(spark, d, "documents"))
    return rows.select("doc_id", "char_count", "token_count", *[F.round(c, 6).alias(c) for c in ("alpha_ratio", "url_ratio", "symbol_ratio", "unique_token_ratio", "quality_score")])


@query
def clean_text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("cleaned"))


@query
def clean_quality_gates(spark, d):
    return cleaning.clean(table(spark, d, "documents")).select("doc_id", "flags", "status")


@query
def exact_dedupe(spark, d):
    return cleaning.mark_duplicates(cleaning.clean(table(spark, d, "documents"))).select("doc_id", "status", "duplicate_of")


@query
def clean_run_stats(spark, d):
    return cleaning.run_counts(cleaning.mark_duplicates(cleaning.clean(table(spark, d, "documents"))))


@query
def keyword_adjustment(spark, d):
    p = posts(spark, d)
    return p.select("seq", F.round(S.keyword_adjusted(F.col("score"), F.col("content"), POSITIVE_KEYWORDS, NEGATIVE_KEYWORDS), 6).alias("adjusted"))


@query
def recovery_budget(spark, d):
    p = posts(spark, d).withColumn("confidence", F.when(F.length("content") % 3 == 0, 0.4).otherwise(0.8))
    return cleaning.recoveries(p, 10).select("seq", S.recovery_score(F.col("content")).alias("score"))


@query
def sentiment_run_stats(spark, d):
    p = posts(spark, d)
    return p.agg(F.count("*").alias("analyzed"), F.round(F.avg("score"), 6).alias("avg_score"), *[F.count_if(S.label3(F.col("score")) == x).alias(x) for x in ("positive", "neutral", "negative")])


@query
def model_label_normalize(spark, d):
    labels = F.array(*map(F.lit, ("5 stars", "1 star", "POSITIVE", "negative", "Neutral", "LABEL_1", "3 Stars")))
    rows = table(spark, d, "events").select("event_id", F.element_at(labels, (F.col("event_id") % 7 + 1).cast("int")).alias("label"), (F.col("value") / 60).alias("raw"))
    return rows.select("event_id", F.round(S.model_score(F.col("label"), F.col("raw")), 6).alias("score"))


@query
def queue_status_counts(spark, d):
    return runs.status_counts(table(spark, d, "orders"), "o_orderstatus")


@query
def latest_run_per_topic(spark, d):
    return runs.latest(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query
def status_state_fold(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"), "value")
    return runs.fold_status(e, "user_id", "ts", "event_id")


@query
def doc_reuse_ttl(spark, d):
    o = table(spark, d, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    return o.crossJoin(F.broadcast(now)).select("o_orderkey", links.reusable(F.col("now"), F.col("o_orderdate")).alias("reusable"))


@query
def json_props_extract(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), T.payload_date(F.col("props")).cast("string").alias("published_at"))


@query
def session_messages(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by("role", "turn").alias("last_role"), F.min_by("text", "turn").alias("opening"))


@query
def version_swap(spark, d):
    return runs.versions(table(spark, d, "conversations"))


@query
def qa_sample(spark, d):
    return cleaning.sample(table(spark, d, "documents"), 50)


@query
def ordered_distinct_terms(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.tokens(F.lower("text"))).alias("pos", "term"))
    first = c.groupBy("conv_id", "term").agg(F.min(F.struct("turn", "pos")).alias("at"))
    return first.select("conv_id", "term", F.col("at.turn").alias("first_turn"), F.col("at.pos").alias("first_pos"))


@query
def slug_ids(spark, d):
    s = T.slug(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.alias("slug"), F.substring(F.md5(F.concat(s, F.lit("-"), F.col("doc_id").cast("string"))), 1, 12).alias("post_id"))


@query
def export_csv_rows(spark, d):
    return export.csv_rows(posts(spark, d))


@query
def published_dates(spark, d):
    """Dates of orders, each spelt in one of several ways or not at all."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    spelt = [F.date_format(at, f) for f in ("yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM-dd'T'HH:mm:ss")]
    given = F.element_at(F.array(*spelt, F.unix_timestamp(at).cast("string"), F.lit("soon"), F.lit("0"), F.lit(" ")), (k % 11 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(T.parse_date(given), "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query
def reply_tree_depth(spark, d):
    return P.thread_depths(table(spark, d, "conversations"))


@query
def html_metadata(spark, d):
    return P.metadata(table(spark, d, "pages"))


@query
def stream_daily_window(spark, d):
    return E.replayed_days(spark, f"{d}/events.parquet")


@query
def eval_confusion(spark, d):
    return reporting.confusion(posts(spark, d), table(spark, d, "labels"))


@query
def search_phrases(spark, d):
    phrases = N.query_phrases(F.col("text"), F.concat(F.lit("topic "), F.col("conv_id").cast("string")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(phrases, "|").alias("phrases"))


@query
def priority_levels(spark, d):
    number, name, k = F.substring("o_orderpriority", 1, 1), F.substring("o_orderpriority", 3, 20), F.col("o_orderkey")
    raw = F.when(k % 3 == 0, number).when(k % 3 == 1, name)
    return table(spark, d, "orders").select("o_orderkey", N.priority(raw, k % 6).alias("priority"))


@query
def search_pages(spark, d):
    hints = F.array(*map(F.lit, HINTS))
    rows = table(spark, d, "part").withColumn("hint", F.element_at(hints, (F.col("p_partkey") % len(HINTS) + 1).cast("int")))
    return rows.select("p_partkey", F.posexplode(N.search_urls(F.col("p_name"), F.col("hint"))).alias("pos", "url"))


@query
def content_items(spark, d):
    turn, page = F.col("turn"), F.concat(F.lit("https://example.org/"), F.col("conv_id").cast("string"))
    item = F.concat(page, F.lit("#"), turn.cast("string"))
    rows = table(spark, d, "conversations").select(
        page.alias("normalized_url"), turn.alias("position"), F.col("role").alias("kind"), F.when(turn % 3 == 0, F.col("role")).alias("title"), "text",
        F.when(turn % 4 == 0, item).when(turn % 4 == 1, F.lit("  ")).alias("source_url"), F.lit(None).cast("string").alias("url"),
        F.create_map(F.lit("score"), turn.cast("string"), F.lit("link"), F.when(turn % 4 == 2, item), F.lit("seen"), F.lit("yes")).alias("metadata"),
    )
    metrics = F.array_join(F.transform(F.map_entries("metrics"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return documents.content_items(rows).withColumn("metrics", metrics)


@query
def document_payloads(spark, d):
    url, k = F.col("url"), F.col("doc_id")
    targets = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), U.normalize_url(url).alias("normalized_url"), url.alias("title"), U.domain(url).alias("domain"), U.infer_platform(url).alias("platform"))
    scraped = table(spark, d, "documents").select("doc_id", F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.col("lang")).alias("title"), F.lit("").alias("domain"), F.when(k % 2 == 0, F.col("source")).alias("platform"), F.when(k % 5 == 0, F.lit("")).otherwise(F.col("text")).alias("content_text"), F.col("text").alias("raw_text"))
    return documents.payloads(targets, scraped, "doc_id")
