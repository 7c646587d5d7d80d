"""Keyed upserts by one declared rule per column, and the writers of stored state that use them.

Rules look at rows in the order of a number that grows; what is stored comes before what
is new. All columns but maps are merged in one grouped pass with partial aggregation, so a
key with very many rows is folded where these lie; maps take one more pass over their
entries. Merging the same rows again changes nothing but what is added up.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions import urls as U

#: What is kept of a column: the last value, null too; the last that isn't null; the first, null too; the first that
#: isn't null; the longest text, of equal ones the first; the largest, the smallest; the sum; all elements of arrays;
#: all keys of maps, each with its last value.
LATEST, KNOWN, INSERTED, FIRST, LONGEST, MOST, LEAST, ADD, UNION, MAPPED = "latest", "known", "inserted", "first", "longest", "most", "least", "add", "union", "mapped"


def kept(column: str, rule: str, order: str) -> Column:
    c, at = F.col(column), F.col(order)
    when = F.when(c.isNotNull(), at)
    return {
        KNOWN: lambda: F.max_by(c, when), FIRST: lambda: F.min_by(c, when), LONGEST: lambda: F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -at)),
        MOST: lambda: F.max(c), LEAST: lambda: F.min(c), ADD: lambda: F.sum(c), UNION: lambda: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array()))))),
    }[rule]().alias(column)


def merge(stored: DataFrame, new: DataFrame, key: list[str], order: str, rules: Mapping[str, str]) -> DataFrame:
    """``stored`` after the rows of ``new``: key, order (the last one's) and the columns of ``rules``.

    Both have all these columns; ``order`` is a number, larger in ``new`` than what is stored
    of the same key, and unique for it. A null key is a key like others. Other columns are dropped.
    """
    columns = [*key, order, *rules]
    rows = stored.select(*columns).unionByName(new.select(*columns))
    of = lambda *names: [c for c, r in rules.items() if r in names]
    last, first = of(LATEST), of(INSERTED)
    folds = [F.max(order).alias(order), *[kept(c, r, order) for c, r in rules.items() if r not in (LATEST, INSERTED, MAPPED)]]
    folds += [F.max_by(F.struct(*last), order).alias("__last")] if last else []
    folds += [F.min_by(F.struct(*first), order).alias("__first")] if first else []
    out = rows.groupBy(*key).agg(*folds)
    out = out.select(*key, order, *[c for c, r in rules.items() if r not in (LATEST, INSERTED, MAPPED)], *[f"__last.{c}" for c in last], *[f"__first.{c}" for c in first])
    kinds: dict[str, list[str]] = {}
    for c in of(MAPPED):
        kind = rows.schema[c].dataType
        assert isinstance(kind, MapType)
        kinds.setdefault(kind.simpleString(), []).append(c)
    for maps in kinds.values():  # those of one type together
        parts = [rows.select(*key, order, F.lit(c).alias("__c"), F.explode(c).alias("__k", "__v")) for c in maps]
        entries = reduce(DataFrame.unionByName, parts).groupBy(*key, "__c", "__k").agg(F.max_by("__v", order).alias("__v"))
        mine = lambda c: F.collect_list(F.when(F.col("__c") == c, F.struct("__k", "__v")))
        whole = entries.groupBy(*key).agg(*[F.when(F.size(mine(c)) > 0, F.map_from_entries(mine(c))).alias(c) for c in maps])
        names = [f"__key{i}" for i in range(len(key))]
        whole = whole.toDF(*names, *maps)
        same = reduce(lambda a, b: a & b, [out[k].eqNullSafe(whole[n]) for k, n in zip(key, names, strict=True)])
        out = out.join(whole, same, "left").drop(*names)
    return out.select(*columns)


# --- stored targets and documents ---

TARGET_RULES = {
    **dict.fromkeys(("target_id", "canonical_url", "normalized_url_hash", "domain", "platform", "title", "description", "author", "published_at", "latest_run_id"), LATEST),
    "first_seen_at": INSERTED, "state": INSERTED, "attempts": INSERTED, "topics": UNION, "topic_slugs": UNION, "target_ids": UNION, "topic_refs": MAPPED,
}
#: What is known of an attempt, in a target's state and in its topic's reference.
STATUS_RULES = {"state": LATEST, "last_attempt_at": LATEST, "backend": KNOWN, "last_error": KNOWN, "document_id": KNOWN, "attempts": KNOWN, "meta": MAPPED}


def topic_ref(status: Column, document_id: Column | None = None) -> Column:
    """What a target is to a topic, from the target's own columns; dates and documents only where there are any."""
    given = lambda c: F.nullif(c, F.lit(""))
    names = ("topic", "topic_slug", "run_id", "quality_score", "relevance_score", "source_name", "discovered_link_id", "target_id", "attempts")
    document = F.lit(None).cast("string") if document_id is None else given(document_id)
    return F.struct(*names, status.alias("status"), F.col("at").alias("last_seen_at"), given(F.col("published_at")).alias("published_at"), document.alias("document_id"))


def sync_targets(stored: DataFrame, targets: DataFrame) -> DataFrame:
    """Stored targets after ``targets`` (normalized_url, at, canonical_url, status, and the columns of a reference): one for each url, with a reference for each topic.

    What came first stays for first_seen_at and for the state and its attempts.
    """
    rows = targets.select(
        "normalized_url", "at", "target_id", "canonical_url", F.sha2("normalized_url", 256).alias("normalized_url_hash"), U.domain(F.col("canonical_url")).alias("domain"), "platform", "title", "description", "author", "published_at",
        F.col("run_id").alias("latest_run_id"), F.col("at").alias("first_seen_at"), F.col("status").alias("state"), "attempts", F.array("topic").alias("topics"), F.array("topic_slug").alias("topic_slugs"),
        F.array("target_id").alias("target_ids"), F.create_map("topic_slug", topic_ref(F.col("status"))).alias("topic_refs"),
    )
    return merge(rows.limit(0) if stored is None else stored, rows, ["normalized_url"], "at", TARGET_RULES)


def patch_status(stored: DataFrame | None, attempts: DataFrame, key: list[str]) -> DataFrame:
    """A state for each key (of targets, or of targets and topics) after attempts with ``at``, status and, where known, backend, error, document_id, attempts and meta.

    Blank backends and documents say nothing; no later attempt takes back what an earlier one knew.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = attempts.select(*key, "at", F.col("status").alias("state"), F.col("at").alias("last_attempt_at"), given("backend").alias("backend"), F.col("error").alias("last_error"), given("document_id").alias("document_id"), "attempts", "meta")
    return merge(rows.limit(0) if stored is None else stored, rows, key, "at", STATUS_RULES)


def attach(documents: DataFrame, reuses: DataFrame) -> DataFrame:
    """Documents (normalized_url, document_id, at, topics, reuse_count) after their reuse by other topics (normalized_url, at, topic); urls without a document bring none."""
    known = documents.select("normalized_url", "document_id")
    rows = reuses.join(known, "normalized_url").select("normalized_url", "document_id", "at", F.array("topic").alias("topics"), F.lit(1).cast("long").alias("reuse_count"))
    return merge(documents.withColumn("reuse_count", F.coalesce("reuse_count", F.lit(0)).cast("long")), rows, ["normalized_url"], "at", {"document_id": INSERTED, "topics": UNION, "reuse_count": ADD})


# --- results ---

CLEAN = ("status", "reason", "cleaned_text", "cleaned_hash", "quality_flags", "run_id")


def save_clean(raw: DataFrame, cleaned: DataFrame | None, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw documents (document_id and others) with the state of their cleaning, and the cleaned documents, after results (document_id, topic, at and CLEAN).

    Results without an id are left out, and those of unknown documents change no raw one.
    """
    rows = results.where(F.coalesce("document_id", F.lit("")) != "").withColumn("cleaned_signature", F.substring("cleaned_hash", 1, 16)).withColumn("created_at", F.col("at"))
    names = ["topic", *CLEAN, "cleaned_signature"]
    table = merge(rows.limit(0) if cleaned is None else cleaned, rows, ["document_id"], "at", dict.fromkeys(names, LATEST) | {"created_at": INSERTED})
    done = F.when(F.col("status").isin("accepted", "duplicate", "too_short"), F.lit("completed")).otherwise(F.lit("failed"))
    latest = table.select("document_id", F.struct("status", "reason", "cleaned_hash", "run_id", "at").alias("cleaning"), done.alias("cleaning_state"))
    kept_ = [c for c in raw.columns if c not in ("cleaning", "cleaning_state")]
    old = raw.select(*kept_, *[raw[c].alias(f"__{c}") for c in raw.columns if c not in kept_])
    met = old.join(latest, "document_id", "left")
    either = [F.coalesce(c, f"__{c}").alias(c) if c in raw.columns else F.col(c) for c in ("cleaning", "cleaning_state")]
    return met.select(*kept_, *either), table


SENTIMENT = ("score", "label", "confidence", "model", "provider", "recovered", "recovery_reason")


def save_sentiment(stored: DataFrame | None, results: DataFrame) -> DataFrame:
    """The last result of each document and topic after ``results`` (document_id, topic, at, status, run_id and SENTIMENT); only what was analysed is completed."""
    rows = results.where(F.coalesce("document_id", F.lit("")) != "").withColumn("status", F.when(F.col("status") == "analyzed", F.lit("completed")).otherwise(F.lit("failed"))).withColumn("recovered", F.coalesce("recovered", F.lit(False)))
    return merge(rows.limit(0) if stored is None else stored, rows, ["document_id", "topic"], "at", dict.fromkeys((*SENTIMENT, "status", "run_id"), LATEST))


def save_summaries(stored: DataFrame | None, summaries: DataFrame) -> DataFrame:
    """The last summary of each topic; columns are those of ``summaries``, with topic and at."""
    columns = [c for c in summaries.columns if c not in ("topic", "at")]
    return merge(summaries.limit(0) if stored is None else stored, summaries, ["topic"], "at", dict.fromkeys(columns, LATEST))


def agent_status(stored: DataFrame | None, updates: DataFrame) -> DataFrame:
    """A row for each agent after updates (agent, at, status, retries, retrying, error, started, completed, meta).

    ``retries`` sets the number where it isn't null, ``retrying`` adds one to what it then
    is. The first start stays; errors and ends are the last update's, meta adds up.
    """
    last_set = F.max(F.when(F.col("retries").isNotNull(), F.col("at"))).over(Window.partitionBy("agent"))
    after = F.coalesce(F.col("at") > last_set, F.lit(True)) & F.coalesce("retrying", F.lit(False))
    rows = updates.withColumn("added", F.when(after, 1).otherwise(0).cast("long"))
    new = rows.select("agent", "at", "status", F.col("retries").cast("long").alias("base"), "added", F.col("error").alias("last_error"), F.when(F.col("started"), F.col("at")).alias("started_at"), F.when(F.col("completed"), F.col("at")).alias("completed_at"), "meta")
    if stored is not None:
        old = stored.select("agent", "at", "status", F.col("retries").cast("long").alias("base"), F.lit(0).cast("long").alias("added"), "last_error", "started_at", "completed_at", "meta")
    rules = {"status": LATEST, "base": KNOWN, "added": ADD, "last_error": LATEST, "started_at": FIRST, "completed_at": LATEST, "meta": MAPPED}
    merged = merge(new.limit(0) if stored is None else old, new, ["agent"], "at", rules)
    return merged.select("agent", "at", "status", (F.coalesce("base", F.lit(0)) + F.col("added")).alias("retries"), "last_error", "started_at", "completed_at", "meta")
