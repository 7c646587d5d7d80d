"""Queries over links with all their inputs and over stored documents, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import urls as U
from ..functions.plan import staged
from ..operators import cleaning, links, reporting, stores, trees
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BRIEF = links.Brief("the", ("and", "tion"), ("#of",))
BRIEF_TERMS = ("the", "and", "tion", "of")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


def informed(spark, d):
    """Anchors with all that a score looks at, made of their page and place."""
    a = links.anchors(table(spark, d, "pages"))
    k = F.col("seq") % 7
    some = lambda c, x: F.when(c, x)
    return a.select(
        "seq", "page_id", "url", "title", some(k % 2 == 0, F.concat(F.lit("A debate, and a reaction about "), "title")).alias("description"), some(k == 1, F.lit("someone")).alias("author"), some(k == 2, F.lit("2024-01-05")).alias("published_at"),
        some(k == 3, F.lit("office holidays of the nation")).alias("discovery_query"), some(k == 4, F.lit("read the comments")).alias("anchor_text"), some(k < 2, F.lit("camoufox_browser")).alias("source_name"), some(k != 5, (F.col("pos") + 1).cast("int")).alias("position"),
        ((k - 3) / 20.0).alias("quality_signal"), ((k - 2) / 10.0).alias("relevance_signal"),
    )


@query
def score_links_full(spark, d):
    s = links.score(informed(spark, d), BRIEF)
    return s.select("seq", "normalized_url", "reason", F.round("quality", 6).alias("quality"), F.round("relevance", 6).alias("relevance"))


def stored_sightings(spark, d):
    s = links.accepted(links.score(informed(spark, d), BRIEF))
    payload = F.concat(F.lit("p"), F.col("seq").cast("string"))
    meta = F.create_map(F.lit("seq"), F.col("seq").cast("string"), F.concat(F.lit("k"), (F.col("seq") % 3).cast("string")), F.col("page_id").cast("string"))
    return s.select("seq", "page_id", "normalized_url", "platform", "source_name", F.lit("web").alias("source_type"), "discovery_query", payload.alias("raw_payload"), "title", "description", "author", "published_at", F.round("quality", 6).alias("quality"), F.round("relevance", 6).alias("relevance"), meta.alias("metadata"))


@query
def link_upsert(spark, d):
    s = staged(stored_sightings(spark, d))
    old, new = s.where(F.col("page_id") % 2 == 0), s.where(F.col("page_id") % 2 == 1).withColumn("seq", F.col("seq") + 10**15)
    out = links.upsert(links.upsert(None, old), new)
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return out.withColumn("metadata", flat)


@query
def anchor_dedupe(spark, d):
    return links.distinct_anchors(links.anchors(table(spark, d, "pages")))


@query
def seed_anchor_limit(spark, d):
    return links.anchors(table(spark, d, "pages")).where("pos < 3").select("page_id", "pos", "url")


@query
def expansion_seeds(spark, d):
    return links.expansion_seeds(links.score(informed(spark, d), BRIEF), 40).select("seq", "strength")


@query
def navigable_hrefs(spark, d):
    return links.anchors(table(spark, d, "pages")).select("seq", U.is_navigable(F.col("url")).alias("navigable"), U.is_search_engine(U.domain(F.col("url"))).alias("search_engine"))


def states(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k.alias("document_id"), F.array("lang", "source").alias("topics"), F.col("lang").alias("topic"), "text", k.alias("updated_at"),
        F.when(k % 4 == 0, F.lit("not_started")).when(k % 4 == 1, F.lit("failed")).when(k % 4 == 2, F.lit("completed")).alias("cleaning"),
        F.when(k % 3 == 0, F.lit("accepted")).otherwise(F.lit("too_short")).alias("status"), F.when(k % 5 == 0, F.lit("completed")).when(k % 5 == 1, F.lit("failed")).alias("sentiment"),
    )


@query
def pending_cleaning(spark, d):
    return stores.pending_cleaning(states(spark, d), "en", 100)


@query
def pending_sentiment(spark, d):
    return stores.pending_sentiment(states(spark, d), "en", 100)


@query
def near_dup_pairs(spark, d):
    return stores.near_duplicates(cleaning.clean(table(spark, d, "documents")))


@query
def reply_trees(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("parent"))
    return trees.depths(turns, "conv_id", "turn", "parent")


@query
def reply_preorder(spark, d):
    """Turns that answer one of the two before them, the later answers first."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 1 - F.col("conv_id") % 2 * (F.col("turn") > 1).cast("long")).alias("parent"))
    return trees.preorder(turns.withColumn("o", -F.col("turn")), "conv_id", "turn", "parent", "o")


def nested(spark, d):
    """Conversations as listings: each third turn stands alone, with the next below it and the one after below that."""
    turn = F.col("turn")
    node = lambda i, below: F.struct(F.when(F.col("t")[i]["turn"] % 7 == 6, F.lit("more")).otherwise(F.lit("t1")).alias("kind"), F.struct(F.col("t")[i]["role"].alias("author"), F.col("t")[i]["text"].alias("body"), F.col("t")[i]["turn"].alias("score"), below.alias("replies")).alias("data"))
    listing = lambda i, below: F.when(F.size("t") > i, F.struct(F.struct(F.array(node(i, below)).alias("children")).alias("data")))
    three = table(spark, d, "conversations").groupBy("conv_id", F.floor(turn / 3).alias("part")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    tops = three.select("conv_id", "part", node(0, listing(1, listing(2, F.lit("")))).alias("node"))
    return tops.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("part", F.to_json("node").alias("node")))), lambda x: x.node)).alias("strings"))


@query
def thread_comments(spark, d):
    # the nodes are JSON already, and stand between brackets
    threads = nested(spark, d).select("conv_id", F.concat(F.lit("["), F.array_join(F.from_json("strings", "array<string>"), ","), F.lit("]")).alias("json"))
    return trees.flatten_threads(threads, "json", "listing").select("conv_id", "position", "depth", "author", F.md5("text").alias("text"), "score")


@query
def author_rollup(spark, d):
    c = table(spark, d, "conversations")
    main = c.where("turn = 0").select("conv_id", F.lit(-1).cast("long").alias("ord"), F.when(F.col("conv_id") % 3 == 0, F.lit("user")).when(F.col("conv_id") % 3 == 1, F.lit(" ")).otherwise(F.lit("editor")).alias("name"), F.lit("document").alias("origin"))
    items = c.select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("name"), F.lit("item").alias("origin"))
    return stores.unique_first(main.unionByName(items), "conv_id", "name", "ord", ["origin"])


@query
def reference_rollup(spark, d):
    pages = table(spark, d, "pages")
    main = pages.select("page_id", F.lit(-1).cast("long").alias("ord"), "url", F.lit("canonical").alias("kind"))
    found = links.anchors(pages).select("page_id", F.col("pos").alias("ord"), "url", F.lit("anchor").alias("kind"))
    return stores.unique_first(main.unionByName(found), "page_id", "url", "ord", ["kind"])


@query
def keyword_weights(spark, d):
    top = reporting.top_keywords(reporting.posts(table(spark, d, "documents")), 20)
    return reporting.keyword_weights(top)


@query
def platform_distribution(spark, d):
    p = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))
    return table(spark, d, "documents").groupBy(F.lower(F.coalesce(p, F.lit("unknown"))).alias("platform")).agg(F.count("*").alias("n"))


@query
def backend_usage(spark, d):
    plan = U.backend_plan(U.infer_platform(F.col("url")), ("generic_http", "firecrawl"))
    return table(spark, d, "pages").groupBy(F.get(plan, F.lit(0)).alias("backend")).agg(F.count("*").alias("n"))


@query
def source_summary(spark, d):
    source = F.get_json_object(F.when(F.col("event_id") % 9 > 0, F.col("props")).otherwise(F.lit("{bad")), "$.k")
    return table(spark, d, "events").select(source.alias("source")).where("trim(coalesce(source, '')) <> ''").groupBy("source").agg(F.count("*").alias("n"))


@query
def missing_dates(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(" ")).when(F.col("event_id") % 3 == 1, F.col("ts").cast("string")).alias("published_at"), "props")
    return e.where("coalesce(trim(published_at), '') = '' and coalesce(trim(props), '') <> ''").select("event_id")


@query
def failure_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("  ")).when(F.col("doc_id") % 10 == 1, F.lit(None)).otherwise(F.col("text")).alias("text"))
    return stores.failures(docs)


@query
def review_sample(spark, d):
    return stores.reviewed(table(spark, d, "documents"), "doc_id", 0.05, 40)


def archived(spark, d):
    c = table(spark, d, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("active"))
    return c.join(last, "conv_id").select(F.col("conv_id").alias("session"), (F.col("turn") + 1).cast("long").alias("version"), F.col("text").alias("payload"), (F.col("turn") == F.col("active")).alias("active"))


@query
def version_archive(spark, d):
    c = table(spark, d, "conversations")
    current = c.where("turn = 0 and conv_id % 2 = 0").select(F.col("conv_id").alias("session"), F.concat(F.lit("now: "), "text").alias("payload"))
    return stores.archive(archived(spark, d), current)


@query
def version_switch(spark, d):
    wanted = archived(spark, d).where("version = session % 4 + 1").select("session", "version")
    return stores.resolve(stores.switch(archived(spark, d), wanted)).select("session", "version")


@query
def version_pairs(spark, d):
    v = archived(spark, d)
    base, target = stores.resolve(v, 1).alias("b"), stores.resolve(v).alias("t")
    return base.join(target, "session").select("session", F.col("t.version").alias("target_version"), (F.length("t.payload") - F.length("b.payload")).cast("long").alias("delta"))


@query
def run_events(spark, d):
    runs, events = table(spark, d, "orders"), table(spark, d, "lineitem")
    counts = events.groupBy("l_orderkey").agg(F.count("*").alias("n_events"), F.max("l_shipdate").alias("last_event"))
    return runs.join(counts, runs["o_orderkey"] == counts["l_orderkey"], "left").select("o_orderkey", F.coalesce("n_events", F.lit(0)).alias("n_events"), "last_event")


@query
def table_page_sorted(spark, d):
    p = reporting.posts(table(spark, d, "documents"))
    return reporting.sorted_page(p, "platform", descending=True, page=2).select("seq", "platform")


@query
def topic_slug_sets(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.array_join(F.sort_array(F.collect_set((F.col("conv_id") % 5).cast("string"))), ",").alias("topic_slugs"))


@query
def target_defaults(spark, d):
    k = F.col("page_id")
    raw = table(spark, d, "pages").select("page_id", F.when(k % 2 == 0, F.lit("")).when(k % 3 == 0, F.lit("news")).alias("platform"), F.when(k % 5 > 0, F.lit("a title")).alias("title"), F.when(k % 4 == 0, k / 100).alias("quality_score"), F.when(k % 3 == 1, F.lit("failed")).alias("status"), F.when(k % 7 == 0, k).alias("attempts"))
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)).alias(c)
    return raw.select("page_id", blank("platform", "web"), blank("title", ""), F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), blank("status", "not_started"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


#: DuckDB's distance counts bytes: letters beyond ASCII become capitals, which cleaned texts don't have.
_ONE_BYTE = "translate({}, 'äöüßéèêëàâçôîïñíóúáûùœ', 'ABCDEFGHIJKLMNOPQRSTUV')"
_COUNT = Q._count
_GIVEN = lambda c: f"coalesce({c}, '') <> ''"
INFORMED = f"""{Q.ANCHORS}, i0 AS (SELECT seq, page_id, pos, url AS raw, title, seq % 7 AS k FROM a), i1 AS (SELECT seq, page_id, raw, title, CASE WHEN k % 2 = 0 THEN 'A debate, and a reaction about ' || title END AS description, CASE WHEN k = 1 THEN 'someone' END AS author,
  CASE WHEN k = 2 THEN '2024-01-05' END AS published_at, CASE WHEN k = 3 THEN 'office holidays of the nation' END AS discovery_query, CASE WHEN k = 4 THEN 'read the comments' END AS anchor_text, CASE WHEN k < 2 THEN 'camoufox_browser' END AS source_name,
  CASE WHEN k <> 5 THEN pos + 1 END AS position, (k - 3) / 20.0::DOUBLE AS quality_signal, (k - 2) / 10.0::DOUBLE AS relevance_signal, raw AS url FROM i0),
i2 AS (SELECT * EXCLUDE (url), {Q.NORMALIZED} AS url, {Q.PLATFORM} AS platform, lower(concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(discovery_query, ''), nullif(anchor_text, ''))) AS words FROM i1), {Q._low_value("i2").replace("lv AS", "i3 AS", 1)},
i4 AS (SELECT *, {_COUNT("words", BRIEF_TERMS)} AS terms, {_COUNT("words", V.EVIDENCE_TERMS)} AS evidence, {_COUNT("words", V.NEUTRAL_TERMS)} AS neutral_, CASE WHEN url = '' THEN 'invalid_url' WHEN low_value THEN 'low_value_url' WHEN lower(trim(coalesce(title, ''))) IN ({', '.join(repr(t) for t in V.LOW_SIGNAL_TITLES)}) THEN 'navigation_link' END AS reason FROM i3),
i5 AS (SELECT *, least(1.0::DOUBLE, 0.15::DOUBLE + terms * 0.12::DOUBLE + evidence * 0.04::DOUBLE + greatest(0.0::DOUBLE, relevance_signal)) AS rel FROM i4),
i AS (SELECT *, url AS normalized_url, round(CASE WHEN reason = 'invalid_url' THEN 0.0::DOUBLE WHEN reason IS NOT NULL THEN 0.05::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.2::DOUBLE + CASE WHEN {_GIVEN("title")} THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END
    + CASE WHEN {_GIVEN("description")} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {_GIVEN("author")} THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {_GIVEN("published_at")} THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END + coalesce((20 - least(position, 20)) * 0.01::DOUBLE, 0.0::DOUBLE)
    + CASE WHEN platform <> 'web' THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + least(0.18::DOUBLE, evidence * 0.03::DOUBLE) - least(0.2::DOUBLE, neutral_ * 0.05::DOUBLE) - CASE WHEN source_name IN ('camoufox_browser', 'camoufox_agentic') AND platform = 'web' AND evidence = 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
    + greatest(0.0::DOUBLE, quality_signal) + rel * 0.35::DOUBLE)) END, 6) AS quality,
  round(CASE WHEN reason = 'invalid_url' THEN 0.0::DOUBLE WHEN reason IS NOT NULL THEN 0.05::DOUBLE ELSE rel END, 6) AS relevance FROM i5)"""
_UPSERT = f"""WITH {INFORMED}, o AS (SELECT *, CASE WHEN page_id % 2 = 1 THEN seq + 1000000000000000 ELSE seq END AS moment FROM i WHERE normalized_url <> '' AND quality >= {V.MIN_QUALITY}),
g AS (SELECT normalized_url, min(moment) AS first_seen, max(moment) AS last_seen, (count(*) - 1)::BIGINT AS duplicate_count, arg_max(title, {{'n': length(coalesce(title, '')), 's': -moment}}) AS title, arg_max_null(description, {{'n': length(coalesce(description, '')), 's': -moment}}) AS description,
  arg_min(author, moment) FILTER (WHERE author IS NOT NULL) AS author, arg_min(published_at, moment) FILTER (WHERE published_at IS NOT NULL) AS published_at, arg_max_null(platform, moment) AS platform, arg_max_null(source_name, moment) AS source_name, 'web' AS source_type, arg_max_null(discovery_query, moment) AS discovery_query,
  'p' || arg_max(seq, moment)::VARCHAR AS raw_payload, max(quality) AS quality, max(relevance) AS relevance FROM o GROUP BY normalized_url),
e AS (SELECT normalized_url, 'seq' AS k, seq::VARCHAR AS v, moment FROM o UNION ALL SELECT normalized_url, 'k' || (seq % 3)::VARCHAR, page_id::VARCHAR, moment FROM o), f AS (SELECT normalized_url, k, arg_max(v, moment) AS v FROM e GROUP BY ALL), m AS (SELECT normalized_url, string_agg(k || '=' || v, ',' ORDER BY k) AS metadata FROM f GROUP BY 1)
SELECT normalized_url, first_seen, last_seen, duplicate_count, title, description, author, published_at, platform, source_name, source_type, discovery_query, raw_payload, quality, relevance, metadata FROM g JOIN m USING (normalized_url)"""
_STATES = """st AS (SELECT doc_id AS document_id, [lang, source] AS topics, lang AS topic, text, doc_id AS updated_at, CASE doc_id % 4 WHEN 0 THEN 'not_started' WHEN 1 THEN 'failed' WHEN 2 THEN 'completed' END AS cleaning,
  CASE WHEN doc_id % 3 = 0 THEN 'accepted' ELSE 'too_short' END AS status, CASE doc_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' END AS sentiment FROM documents)"""
_VERSIONS = "v AS (SELECT conv_id AS session, (turn + 1)::BIGINT AS version, text AS payload, turn = max(turn) OVER (PARTITION BY conv_id) AS active FROM conversations)"
_PLANS = {p: next(b for b in plan if b in V.NATIVE_BACKENDS or b in ("generic_http", "firecrawl")) for p, plan in V.BACKENDS.items()}

SQL = {
    "score_links_full": f"WITH {INFORMED} SELECT seq, normalized_url, reason, quality, relevance FROM i",
    "link_upsert": _UPSERT,
    "anchor_dedupe": f"WITH {Q.ANCHORS}, n AS (SELECT seq, page_id, title, {Q.NORMALIZED} AS normalized_url FROM a) SELECT page_id, normalized_url, min(seq) AS seq, arg_min(title, seq) AS title FROM n WHERE normalized_url <> '' GROUP BY 1, 2",
    "seed_anchor_limit": f"WITH {Q.ANCHORS} SELECT page_id, pos, url FROM a WHERE pos < 3",
    "expansion_seeds": f"WITH {INFORMED.replace(', 6) AS', ', 12) AS')} SELECT seq, round(quality + relevance, 9) AS strength FROM i WHERE reason IS NULL ORDER BY strength DESC, seq LIMIT 40",
    "navigable_hrefs": f"WITH {Q.ANCHORS} SELECT seq, trim(url) <> '' AND NOT {Q._any(f'starts_with(lower(trim(url)), {x!r})' for x in V.NO_ADDRESSES)} AND {Q.NORMALIZED} <> '' AS navigable, {Q._any(f'ends_with({Q.DOMAIN}, {x!r})' for x in V.SEARCH_ENGINES)} AS search_engine FROM a",
    "pending_cleaning": f"WITH {_STATES} SELECT document_id, text, updated_at FROM st WHERE list_contains(topics, 'en') AND cleaning IN ('not_started', 'failed') ORDER BY updated_at DESC, document_id LIMIT 100",
    "pending_sentiment": f"WITH {_STATES} SELECT document_id, text, updated_at FROM st WHERE topic = 'en' AND status = 'accepted' AND (sentiment IS NULL OR sentiment IN ('not_started', 'failed')) ORDER BY updated_at DESC, document_id LIMIT 100",
    "near_dup_pairs": f"""WITH {Q.CLEAN}, r AS (SELECT doc_id, topic, cleaned, list_distinct(string_split(cleaned, ' ')) AS w, row_number() OVER (PARTITION BY topic ORDER BY doc_id DESC) AS n FROM c WHERE status = 'accepted' AND trim(cleaned) <> ''),
p AS (SELECT r.doc_id, x.doc_id AS match_id, r.cleaned AS a, x.cleaned AS b FROM r JOIN r x ON x.n <= 250 AND r.topic IS NOT DISTINCT FROM x.topic AND r.doc_id <> x.doc_id AND len(r.w) <= 1.5 * len(x.w) AND len(x.w) <= 1.5 * len(r.w)
  WHERE 2.0::DOUBLE * len(list_intersect(r.w, x.w)) >= 0.8::DOUBLE * (len(r.w) + len(x.w))),
b AS (SELECT doc_id, match_id, 100.0::DOUBLE - 100.0::DOUBLE * CASE WHEN a = b THEN 0 ELSE levenshtein({_ONE_BYTE.format('a')}, {_ONE_BYTE.format('b')}) END / greatest(length(a), length(b)) AS score FROM p WHERE abs(length(a) - length(b)) <= 0.07 * greatest(length(a), length(b)))
SELECT doc_id, arg_max(match_id, {{'s': score, 'm': match_id}}) AS match_id, round(max(score), 4) AS score FROM b WHERE score >= 93 GROUP BY doc_id""",
    "reply_trees": "WITH RECURSIVE e AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent FROM conversations), r AS (SELECT conv_id, turn, parent, 0::BIGINT AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.conv_id, e.turn, e.parent, r.depth + 1 FROM e JOIN r ON e.conv_id = r.conv_id AND e.parent = r.turn) SELECT * FROM r",
    "reply_preorder": """WITH RECURSIVE e AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 - conv_id % 2 * (turn > 1)::BIGINT END AS parent FROM conversations),
r AS (SELECT conv_id, turn, parent, 0::BIGINT AS depth, [-turn] AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.conv_id, e.turn, e.parent, r.depth + 1, list_append(r.path, -e.turn) FROM e JOIN r ON e.conv_id = r.conv_id AND e.parent = r.turn)
SELECT conv_id, turn, parent, depth, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS position FROM r""",
    "thread_comments": """WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, turn % 3 AS depth, turn % 7 = 6 OR (turn % 3 > 0 AND (turn - 1) % 7 = 6) OR (turn % 3 > 1 AND (turn - 2) % 7 = 6) AS gone FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, depth, role AS author, md5(t) AS text, turn AS score FROM c WHERE NOT gone AND t <> ''""",
    "author_rollup": "WITH x AS (SELECT conv_id, -1::BIGINT AS ord, CASE conv_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN ' ' ELSE 'editor' END AS name, 'document' AS origin FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, turn, role, 'item' FROM conversations), f AS (SELECT conv_id, name, min(ord) AS ord, arg_min(origin, ord) AS origin FROM x WHERE trim(coalesce(name, '')) <> '' GROUP BY 1, 2) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ord, name)::INT AS position, name, origin FROM f",
    "reference_rollup": f"WITH {Q.ANCHORS}, x AS (SELECT page_id, -1::BIGINT AS ord, url, 'canonical' AS kind FROM pages UNION ALL SELECT page_id, pos, url, 'anchor' FROM a), f AS (SELECT page_id, url, min(ord) AS ord, arg_min(kind, ord) AS kind FROM x WHERE trim(coalesce(url, '')) <> '' GROUP BY 1, 2) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord, url)::INT AS position, url, kind FROM f",
    "keyword_weights": f"WITH {Q.POSTS}, w AS (SELECT seq, unnest({Q._WORDS}) AS keyword, generate_subscripts({Q._WORDS}, 1) AS i FROM p), t AS (SELECT keyword, count(*) AS n, min({{'s': seq, 'i': i}}) AS f FROM w GROUP BY 1 ORDER BY n DESC, f, keyword LIMIT 20) SELECT keyword, n, round((count(*) OVER () - row_number() OVER (ORDER BY n DESC, f, keyword) + 1) / count(*) OVER (), 6) AS weight FROM t",
    "platform_distribution": "SELECT lower(coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END, 'unknown')) AS platform, count(*) AS n FROM documents GROUP BY 1",
    "backend_usage": f"SELECT CASE {Q.PLATFORM} {' '.join(f'WHEN {p!r} THEN {b!r}' for p, b in _PLANS.items())} ELSE '{_PLANS['web']}' END AS backend, count(*) AS n FROM pages GROUP BY 1",
    "source_summary": "SELECT json_extract_string(props, '$.k') AS source, count(*) AS n FROM events WHERE event_id % 9 > 0 AND trim(coalesce(json_extract_string(props, '$.k'), '')) <> '' GROUP BY 1",
    "missing_dates": "SELECT event_id FROM events WHERE event_id % 3 <> 1 AND coalesce(trim(props), '') <> ''",
    "failure_rows": "SELECT doc_id, 0.5::DOUBLE AS score, 'neutral' AS label, 0.0::DOUBLE AS confidence, 'failed' AS status, false AS recovered, 'empty_text' AS error FROM documents WHERE doc_id % 10 < 2 OR trim(coalesce(text, '')) = ''",
    "review_sample": "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL ORDER BY md5('qa' || doc_id::VARCHAR), doc_id LIMIT (SELECT least(count(doc_id), 40, greatest(1, floor(count(doc_id) * 0.05)::BIGINT)) FROM documents)",
    "version_archive": f"WITH {_VERSIONS}, n AS (SELECT conv_id AS session, 'now: ' || text AS payload FROM conversations WHERE turn = 0 AND conv_id % 2 = 0) SELECT session, version, payload, active AND session NOT IN (SELECT session FROM n) AS active FROM v UNION ALL SELECT n.session, (SELECT max(version) FROM v WHERE v.session = n.session) + 1, n.payload, true FROM n",
    "version_switch": f"WITH {_VERSIONS}, w AS (SELECT session, version AS to_ FROM v WHERE version = session % 4 + 1) SELECT v.session, version FROM v LEFT JOIN w ON v.session = w.session WHERE CASE WHEN to_ IS NULL THEN active ELSE version = to_ END",
    "version_pairs": f"WITH {_VERSIONS} SELECT b.session, t.version AS target_version, (length(t.payload) - length(b.payload))::BIGINT AS delta FROM v b JOIN v t ON b.session = t.session AND b.version = 1 AND t.active",
    "run_events": "SELECT o_orderkey, coalesce(n_events, 0)::BIGINT AS n_events, last_event FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_events, max(l_shipdate) AS last_event FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
    "table_page_sorted": "SELECT doc_id AS seq, source AS platform FROM documents ORDER BY source DESC, doc_id LIMIT 20 OFFSET 40",
    "topic_slug_sets": "SELECT role, string_agg(DISTINCT (conv_id % 5)::VARCHAR, ',' ORDER BY (conv_id % 5)::VARCHAR) AS topic_slugs FROM conversations GROUP BY role",
    "target_defaults": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'web' WHEN page_id % 3 = 0 THEN 'news' ELSE 'web' END AS platform, CASE WHEN page_id % 5 > 0 THEN 'a title' ELSE '' END AS title, CASE WHEN page_id % 4 = 0 THEN page_id / 100 ELSE 0.0 END::DOUBLE AS quality_score, CASE WHEN page_id % 3 = 1 THEN 'failed' ELSE 'not_started' END AS status, CASE WHEN page_id % 7 = 0 THEN page_id ELSE 0 END AS attempts FROM pages",
}
