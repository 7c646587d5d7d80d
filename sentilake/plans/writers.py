"""Queries that write stored state by declared merges, in batches and from streams, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import urls as U
from ..functions.plan import shared_folder, staged
from ..operators import links, merging
from ..streaming import sessions, tables
from ..streaming.events import parquet_stream, replay_then_follow
from . import sql as Q
from . import states

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


def twice(rows: DataFrame, write: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """What is stored after two writes: rows of an even number, and then the others, later."""
    rows = staged(rows)
    return write(staged(write(None, rows.where("at % 2 = 0"))), rows.where("at % 2 = 1").withColumn("at", F.col("at") + 10**12))


def listed(c: str | Column, by: str = ",") -> Column:
    return F.array_join(F.array_sort(c), by)


def some(n: int, i: int, value: Column, of: str = "at") -> Column:
    return F.when(F.col(of) % n == i, value)


def text(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


@query
def target_upserts(spark, d):
    at, slug = F.col("page_id"), text("t", F.col("page_id") % 3)
    host = F.concat(F.lit("https://"), U.authority(F.col("url")), F.lit("/"))
    rows = table(spark, d, "pages").select(
        host.alias("normalized_url"), at.alias("at"), "url", slug.alias("topic_slug"), F.upper(slug).alias("topic"), text("r", at % 4).alias("run_id"), (at / 100).alias("quality_score"), (at / 50).alias("relevance_score"), F.lit("web").alias("source_name"),
        at.alias("discovered_link_id"), text("id", at % 5).alias("target_id"), (at % 3).alias("attempts"), F.when(at % 4 == 1, F.lit("")).when(at % 4 == 2, F.lit("2024-01-05")).alias("published_at"), F.when(at % 2 == 0, F.lit("failed")).otherwise(F.lit("not_started")).alias("status"),
        F.col("url").alias("canonical_url"), U.infer_platform(F.col("url")).alias("platform"), text("title ", at).alias("title"), F.lit(None).cast("string").alias("description"), F.when(at % 3 == 0, F.lit("someone")).alias("author"),
    ).drop("url")
    refs = F.transform(F.map_entries("topic_refs"), lambda e: F.concat_ws("/", e.key, e.value.topic, e.value.run_id, e.value.status, e.value.last_seen_at.cast("string"), e.value.published_at))
    out = twice(rows, merging.sync_targets)
    return out.select("normalized_url", "at", "canonical_url", "domain", "title", "author", "published_at", "latest_run_id", "first_seen_at", "state", "attempts", listed("topics").alias("topics"), listed("topic_slugs").alias("topic_slugs"), listed("target_ids").alias("target_ids"), listed(refs, " ").alias("refs"))


def attempts(spark, d):
    at = F.col("event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("target"), F.col("event_type").alias("topic_slug"), at.alias("at"), text("s", at % 4).alias("status"), F.when(at % 3 == 0, text("b", at % 5)).when(at % 3 == 1, F.lit("")).alias("backend"),
        F.when(at % 4 == 0, text("e", at)).alias("error"), F.when(at % 5 == 0, text("doc", at)).when(at % 5 == 1, F.lit("")).alias("document_id"), F.when(at % 6 == 0, at % 10).alias("attempts"), F.when(at % 2 == 0, F.create_map(text("k", at % 3), at.cast("string"))).alias("meta"),
    )


def patched(out: DataFrame, *key: str) -> DataFrame:
    return out.select(*key, "at", "state", "last_attempt_at", "backend", "last_error", "document_id", "attempts", listed(F.transform(F.map_entries("meta"), lambda e: F.concat(e.key, F.lit("="), e.value))).alias("meta"))


@query
def target_status_patches(spark, d):
    return patched(twice(attempts(spark, d), lambda old, new: merging.patch_status(old, new, ["target"])), "target")


@query
def topic_status_patches(spark, d):
    return patched(twice(attempts(spark, d), lambda old, new: merging.patch_status(old, new, ["target", "topic_slug"])), "target", "topic_slug")


@query
def document_reuse(spark, d):
    k = F.col("page_id")
    docs = table(spark, d, "pages").select(text("u", k).alias("normalized_url"), text("doc_", k).alias("document_id"), F.lit(-1).cast("long").alias("at"), F.array(F.lit("own")).alias("topics"), F.when(k % 2 == 0, k).alias("reuse_count"))
    uses = table(spark, d, "conversations").select(text("u", F.col("conv_id") * 7 % 100).alias("normalized_url"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), text("t", F.col("turn") % 3).alias("topic"))
    return merging.attach(docs, uses).select("normalized_url", "document_id", "at", listed("topics").alias("topics"), "reuse_count")


@query
def clean_result_writes(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    raw = docs.select(text("d", k).alias("document_id"), "source", F.when(k % 10 == 0, F.lit("not_started")).alias("cleaning_state"))
    state = F.element_at(F.array(*map(F.lit, ("accepted", "duplicate", "too_short", "failed"))), (F.col("at") % 4 + 1).cast("int"))
    ids = F.when(k % 9 == 0, F.lit("")).when(k % 8 == 0, text("gone", k)).otherwise(text("d", k % 300))
    results = docs.where("doc_id % 5 > 0").select(ids.alias("document_id"), F.col("lang").alias("topic"), k.alias("at")).select("*", state.alias("status"), text("why", F.col("at")).alias("reason"), text("text ", F.col("at")).alias("cleaned_text"), F.md5(text("", F.col("at"))).alias("cleaned_hash"), F.array().cast("array<string>").alias("quality_flags"), text("r", F.col("at") % 2).alias("run_id"))
    new_raw, cleaned = merging.save_clean(raw, merging.save_clean(raw, None, results.where("at % 2 = 0"))[1], results.where("at % 2 = 1").withColumn("at", F.col("at") + 10**12))
    return cleaned.join(new_raw, "document_id", "full").select("document_id", "source", "topic", "status", "created_at", "cleaned_signature", "cleaning_state", F.col("cleaning.reason").alias("raw_reason"), F.col("cleaning.at").alias("raw_at"))


@query
def sentiment_result_writes(spark, d):
    k = F.col("at")
    rows = table(spark, d, "events").select(F.col("event_id").alias("at"), "user_id", "event_type", "value").select(
        F.when(k % 50 == 0, F.lit("")).otherwise(text("d", F.col("user_id"))).alias("document_id"), F.col("event_type").alias("topic"), "at", F.when(k % 4 > 0, F.lit("analyzed")).otherwise(F.lit("error")).alias("status"), text("r", k % 3).alias("run_id"),
        F.round("value", 4).alias("score"), F.when(F.col("value") > 50, F.lit("positive")).otherwise(F.lit("negative")).alias("label"), F.lit(0.5).alias("confidence"), F.lit("m").alias("model"), F.lit("p").alias("provider"), F.when(k % 3 == 0, k % 2 == 0).alias("recovered"), F.when(k % 7 == 0, F.lit("low")).alias("recovery_reason"),
    )
    return twice(rows, merging.save_sentiment).select("document_id", "topic", "at", "status", "run_id", "score", "label", "recovered", "recovery_reason")


@query
def topic_summary_writes(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("topic"), F.dayofmonth("ts").cast("long").alias("at")).agg(F.count("*").alias("total_documents"), F.count_if(F.col("value") > 50).alias("analyzed"))
    return twice(rows, merging.save_summaries).select("topic", "at", "total_documents", "analyzed")


@query
def agent_status_updates(spark, d):
    at = F.col("event_id")
    rows = table(spark, d, "events").select(
        text("agent", F.col("user_id") % 40).alias("agent"), at.alias("at"), F.col("event_type").alias("status"), F.when(at % 37 == 0, at % 4).alias("retries"), (at % 3 == 0).alias("retrying"), F.when(at % 3 == 0, text("e", at)).alias("error"),
        (at % 5 == 0).alias("started"), (at % 2 == 1).alias("completed"), F.create_map(text("k", at % 6), at.cast("string")).alias("meta"),
    )
    out = twice(rows, merging.agent_status)
    return out.select("agent", "at", "status", "retries", "last_error", "started_at", "completed_at", listed(F.transform(F.map_entries("meta"), lambda e: F.concat(e.key, F.lit("="), e.value))).alias("meta"))


def link_table(path: str, sightings: DataFrame) -> tables.Table:
    return tables.Table(path, ["normalized_url"], links.upsert(None, sightings).schema, links.upsert, buckets=8)


@query
def stream_link_upsert(spark, d):
    """Sightings come in four lots, and the stream merges what has come each time; the last lot is delivered once more."""
    rows, folder = staged(states.stored_sightings(spark, d)), shared_folder(spark)
    links_ = link_table(f"{folder}/links", rows)
    pages = rows.agg(F.max("page_id")).head()[0] or 0
    for lot in range(4):
        some_ = rows.where((F.col("page_id") * 4 >= lot * (pages + 1)) & (F.col("page_id") * 4 < (lot + 1) * (pages + 1)))
        some_.write.mode("append").parquet(f"{folder}/sightings")
        tables.merge_stream(parquet_stream(spark, f"{folder}/sightings"), links_, f"{folder}/checkpoint").awaitTermination()
    links_.apply(some_, "stream", 3)
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return links_.read(spark).withColumn("metadata", flat)


@query
def stream_status_sweep(spark, d):
    """Documents are tried as they come; those that failed are tried again, twice at most."""
    folder = shared_folder(spark)
    merge = lambda old, new: merging.merge(old, new, ["document_id"], "at", {"status": merging.LATEST, "attempts": merging.ADD})

    def work(rows: DataFrame) -> DataFrame:
        k, n = F.col("document_id"), F.col("attempts")
        failed = (k % 11 == 0) | ((k % 7 == 0) & (n < 1))
        return rows.select("document_id", n.alias("at"), F.when(failed, F.lit("failed")).otherwise(F.lit("completed")).alias("status"), F.lit(1).cast("long").alias("attempts"))

    new = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).cast("long").alias("attempts"))
    states_ = tables.Table(f"{folder}/states", ["document_id"], work(new).schema, merge, buckets=4)
    for lot in range(2):
        new.where(F.col("document_id") % 2 == lot).write.mode("append").parquet(f"{folder}/documents")
        tables.merge_stream(parquet_stream(spark, f"{folder}/documents"), states_, f"{folder}/checkpoint", prepare=work).awaitTermination()
    tables.sweep(spark, states_, F.col("status") == "failed", work, rounds=2)
    return states_.read(spark).select("document_id", "status", "attempts")


@query
def late_joiner(spark, d):
    """Half of the events are there when someone joins, the others come then: what each way brought, by type."""
    folder = shared_folder(spark)
    rows = table(spark, d, "events")
    rows.where("event_id % 2 = 0").write.parquet(f"{folder}/events")
    history, live = replay_then_follow(spark, f"{folder}/events")
    rows.where("event_id % 2 = 1").write.mode("append").parquet(f"{folder}/events")
    live.writeStream.format("parquet").option("path", f"{folder}/live").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    both = history.withColumn("came", F.lit("history")).unionByName(spark.read.schema(rows.schema).parquet(f"{folder}/live").withColumn("came", F.lit("live")))
    return both.groupBy("came", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


ACTIONS = {"click": "advance", "view": "start", "purchase": "ask", "signup": "answer", "error": "fail"}


@query
def session_transitions(spark, d):
    """Users as sessions, and what they do as steps that a session may or may not allow."""
    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    steps = parquet_stream(spark, f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.element_at(actions, F.col("event_type")).alias("action"))
    return sessions.replayed(spark, steps).withColumn("at", F.unix_millis("at"))


# --- SQL ---

_LATER = "CASE WHEN {0} % 2 = 1 THEN {0} + 1000000000000 ELSE {0} END"
_HOST = f"'https://' || {Q.AUTHORITY} || '/'"
_ATTEMPTS = f"""a AS (SELECT user_id AS target, event_type AS topic_slug, event_id AS k, {_LATER.format("event_id")} AS "at", 's' || event_id % 4 AS status, CASE WHEN event_id % 3 = 0 THEN 'b' || event_id % 5 END AS backend, CASE WHEN event_id % 4 = 0 THEN 'e' || event_id END AS error,
  CASE WHEN event_id % 5 = 0 THEN 'doc' || event_id END AS document_id, CASE WHEN event_id % 6 = 0 THEN event_id % 10 END AS attempts FROM events)"""


def _patched(*key: str) -> str:
    keys = ", ".join(key)
    last = lambda c: f'arg_max({c}, "at") FILTER (WHERE {c} IS NOT NULL)'
    return f"""WITH {_ATTEMPTS}, g AS (SELECT {keys}, max("at") AS "at", arg_max(status, "at") AS state, max("at") AS last_attempt_at, {last("backend")} AS backend, {last("error")} AS last_error, {last("document_id")} AS document_id, {last("attempts")} AS attempts FROM a GROUP BY {keys}),
m AS (SELECT {keys}, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS meta FROM (SELECT {keys}, 'k' || k % 3 AS k, arg_max(k::VARCHAR, "at") AS v FROM a WHERE k % 2 = 0 GROUP BY {keys}, 'k' || k % 3) GROUP BY {keys})
SELECT * FROM g LEFT JOIN m USING ({keys})"""


_DAY, _LIVE = 24 * 3600 * 1000, "(" + ", ".join(map(repr, (*V.PHASES, V.WAITING))) + ")"
_PHASES = "(" + ", ".join(map(repr, V.PHASES)) + ")"
_NEXT = "CASE status " + " ".join(f"WHEN {a!r} THEN {b!r}" for a, b in zip(V.PHASES, [*V.PHASES[1:], V.COMPLETED])) + " END"
_SESSIONS = f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS session, event_id AS seq, epoch_us(ts) // 1000 AS ms, CASE event_type {" ".join(f"WHEN {a!r} THEN {b!r}" for a, b in ACTIONS.items())} END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT DISTINCT session, 0::BIGINT AS i, 0::BIGINT AS seq, 0::BIGINT AS ms, '' AS action, NULL::BIGINT AS due, '' AS was, '' AS before, '{V.IDLE}' AS status, '' AS resume, 0::BIGINT AS since, false AS accepted FROM e
  UNION ALL
  SELECT session, i, seq, ms, action, due, was, status, coalesce(after, status), CASE WHEN after IS NULL THEN resume WHEN action = 'ask' THEN status ELSE '' END, CASE WHEN after IS NULL THEN since ELSE ms END, after IS NOT NULL FROM (
    SELECT *, CASE WHEN action = 'start' AND status IN ('idle', 'error', 'completed') THEN '{V.PHASES[0]}' WHEN action = 'advance' AND status IN {_PHASES} THEN {_NEXT} WHEN action = 'ask' AND status IN {_PHASES} THEN '{V.WAITING}'
      WHEN action = 'answer' AND status = '{V.WAITING}' THEN resume WHEN action = 'fail' AND status IN {_LIVE} THEN '{V.FAILED}' END AS after
    FROM (SELECT session, i, seq, ms, action, due, was, CASE WHEN due IS NULL THEN was ELSE '{V.FAILED}' END AS status, CASE WHEN due IS NULL THEN resume ELSE '' END AS resume, coalesce(due, since) AS since
      FROM (SELECT e.*, r.status AS was, r.resume, r.since, CASE WHEN r.status IN {_LIVE} AND r.since + {_DAY} < e.ms THEN r.since + {_DAY} END AS due FROM r JOIN e ON e.session = r.session AND e.i = r.i + 1)))
)
SELECT session, ms AS "at", seq, action, before, status AS after, accepted FROM r WHERE i > 0
UNION ALL SELECT session, due, NULL, 'timeout', was, '{V.FAILED}', true FROM r WHERE due IS NOT NULL
UNION ALL SELECT session, since + {_DAY}, NULL, 'timeout', status, '{V.FAILED}', true FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session ORDER BY i DESC) = 1)
  WHERE status IN {_LIVE} AND since + {_DAY} <= (SELECT max(ms) - 3600000 FROM e)"""


SQL = {
    "late_joiner": "SELECT CASE WHEN event_id % 2 = 0 THEN 'history' ELSE 'live' END AS came, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL",
    "session_transitions": _SESSIONS,
    "target_upserts": f"""WITH p AS (SELECT page_id AS k, {_LATER.format("page_id")} AS "at", url, {_HOST} AS normalized_url, {Q.DOMAIN} AS domain, 't' || page_id % 3 AS slug, CASE WHEN page_id % 2 = 0 THEN 'failed' ELSE 'not_started' END AS status, CASE WHEN page_id % 4 = 2 THEN '2024-01-05' END AS published FROM pages),
r AS (SELECT normalized_url, slug, arg_max(concat_ws('/', slug, upper(slug), 'r' || k % 4, status, "at"::VARCHAR, published), "at") AS ref FROM p GROUP BY ALL), f AS (SELECT normalized_url, string_agg(ref, ' ' ORDER BY ref) AS refs FROM r GROUP BY 1)
SELECT normalized_url, max("at") AS "at", arg_max(url, "at") AS canonical_url, arg_max(domain, "at") AS domain, arg_max('title ' || k, "at") AS title, arg_max_null(CASE WHEN k % 3 = 0 THEN 'someone' END, "at") AS author, arg_max_null(CASE k % 4 WHEN 1 THEN '' WHEN 2 THEN '2024-01-05' END, "at") AS published_at,
  arg_max('r' || k % 4, "at") AS latest_run_id, min("at") AS first_seen_at, arg_min(status, "at") AS state, arg_min(k % 3, "at") AS attempts, string_agg(DISTINCT upper(slug), ',' ORDER BY upper(slug)) AS topics, string_agg(DISTINCT slug, ',' ORDER BY slug) AS topic_slugs,
  string_agg(DISTINCT 'id' || k % 5, ',' ORDER BY 'id' || k % 5) AS target_ids, any_value(refs) AS refs FROM p JOIN f USING (normalized_url) GROUP BY normalized_url""",
    "target_status_patches": _patched("target"),
    "topic_status_patches": _patched("target", "topic_slug"),
    "document_reuse": """WITH u AS (SELECT 'u' || conv_id * 7 % 100 AS normalized_url, conv_id * 1000 + turn AS "at", 't' || turn % 3 AS topic FROM conversations),
g AS (SELECT normalized_url, max("at") AS "at", count(*) AS n FROM u GROUP BY 1), t AS (SELECT 'u' || page_id AS normalized_url, 'own' AS topic FROM pages UNION SELECT normalized_url, topic FROM u), l AS (SELECT normalized_url, string_agg(topic, ',' ORDER BY topic) AS topics FROM t GROUP BY 1)
SELECT 'u' || page_id AS normalized_url, 'doc_' || page_id AS document_id, coalesce("at", -1)::BIGINT AS "at", topics, (CASE WHEN page_id % 2 = 0 THEN page_id ELSE 0 END + coalesce(n, 0))::BIGINT AS reuse_count
FROM pages LEFT JOIN g ON 'u' || page_id = g.normalized_url JOIN l ON 'u' || page_id = l.normalized_url""",
    "clean_result_writes": f"""WITH r AS (SELECT CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 8 = 0 THEN 'gone' || doc_id ELSE 'd' || doc_id % 300 END AS document_id, lang AS topic, doc_id AS k, {_LATER.format("doc_id")} AS "at" FROM documents WHERE doc_id % 5 > 0),
c AS (SELECT document_id, arg_max(topic, "at") AS topic, arg_max(k, "at") AS k, max("at") AS "at", min("at") AS created_at FROM r WHERE document_id <> '' GROUP BY 1),
s AS (SELECT document_id, topic, "at", created_at, ['accepted', 'duplicate', 'too_short', 'failed'][k % 4 + 1] AS status, 'why' || k AS reason, substring(md5(k::VARCHAR), 1, 16) AS cleaned_signature FROM c), w AS (SELECT 'd' || doc_id AS document_id, source, CASE WHEN doc_id % 10 = 0 THEN 'not_started' END AS old FROM documents)
SELECT coalesce(s.document_id, w.document_id) AS document_id, source, topic, status, created_at, cleaned_signature, CASE WHEN w.document_id IS NULL THEN NULL WHEN s.document_id IS NULL THEN old WHEN status = 'failed' THEN 'failed' ELSE 'completed' END AS cleaning_state,
  CASE WHEN w.document_id IS NOT NULL THEN reason END AS raw_reason, CASE WHEN w.document_id IS NOT NULL THEN "at" END AS raw_at FROM s FULL JOIN w ON s.document_id = w.document_id""",
    "sentiment_result_writes": f"""WITH r AS (SELECT 'd' || user_id AS document_id, event_type AS topic, event_id AS k, {_LATER.format("event_id")} AS "at", round(value, 4) AS score, CASE WHEN value > 50 THEN 'positive' ELSE 'negative' END AS label FROM events WHERE event_id % 50 > 0),
g AS (SELECT document_id, topic, max("at") AS "at", arg_max(k, "at") AS k, arg_max(score, "at") AS score, arg_max(label, "at") AS label FROM r GROUP BY ALL)
SELECT document_id, topic, "at", CASE WHEN k % 4 > 0 THEN 'completed' ELSE 'failed' END AS status, 'r' || k % 3 AS run_id, score, label, k % 6 = 0 AS recovered, CASE WHEN k % 7 = 0 THEN 'low' END AS recovery_reason FROM g""",
    "topic_summary_writes": f"""WITH r AS (SELECT event_type AS topic, day(ts)::BIGINT AS k, count(*) AS total_documents, count(*) FILTER (WHERE value > 50) AS analyzed FROM events GROUP BY ALL), l AS (SELECT *, {_LATER.format("k")} AS "at" FROM r)
SELECT topic, max("at") AS "at", arg_max(total_documents, "at") AS total_documents, arg_max(analyzed, "at") AS analyzed FROM l GROUP BY topic""",
    "agent_status_updates": f"""WITH e AS (SELECT 'agent' || user_id % 40 AS agent, event_id AS k, {_LATER.format("event_id")} AS "at", event_type AS status FROM events), s AS (SELECT agent, max("at") FILTER (WHERE k % 37 = 0) AS since, arg_max(k % 4, "at") FILTER (WHERE k % 37 = 0) AS base FROM e GROUP BY agent),
m AS (SELECT agent, string_agg(x || '=' || v, ',' ORDER BY x || '=' || v) AS meta FROM (SELECT agent, 'k' || k % 6 AS x, arg_max(k::VARCHAR, "at") AS v FROM e GROUP BY ALL) GROUP BY agent)
SELECT agent, max("at") AS "at", arg_max(status, "at") AS status, (coalesce(any_value(base), 0) + count(*) FILTER (WHERE k % 3 = 0 AND (since IS NULL OR "at" > since)))::BIGINT AS retries, arg_max_null(CASE WHEN k % 3 = 0 THEN 'e' || k END, "at") AS last_error,
  min("at") FILTER (WHERE k % 5 = 0) AS started_at, arg_max_null(CASE WHEN k % 2 = 1 THEN "at" END, "at") AS completed_at, any_value(meta) AS meta FROM e JOIN s USING (agent) JOIN m USING (agent) GROUP BY agent""",
    "stream_link_upsert": states.SQL["link_upsert"].replace("CASE WHEN page_id % 2 = 1 THEN seq + 1000000000000000 ELSE seq END AS moment", "seq AS moment"),
    "stream_status_sweep": "SELECT doc_id AS document_id, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN doc_id % 11 = 0 THEN 3 WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts FROM documents",
}
