"""Cleaning: features, quality gates, exact duplicates, run counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import texts as T
from ..functions.plan import met, once, staged


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    found, low = "__tokens", "__found"
    rows = docs.withColumn(found, T.tokens(F.coalesce(F.col(text), F.lit("")))).withColumn(low, F.transform(found, F.lower))
    out = rows.select(*docs.columns, *[c.alias(k) for k, c in T.features(F.col(text), F.col(found), F.col(low)).items()])
    return out.withColumn("quality_score", T.quality(*[F.col(c) for c in ("char_count", "token_count", "alpha_ratio", "unique_token_ratio", "url_ratio", "symbol_ratio")]))


def clean(docs: DataFrame) -> DataFrame:
    """doc_id, topic, cleaned, flags and status: too_short, failed or accepted."""
    cleaned = once(docs.select("doc_id", F.col("lang").alias("topic"), T.normalize(F.col("text")).alias("whole")))
    cleaned = cleaned.select("doc_id", "topic", F.length("whole").alias("clean_chars"), F.trim(F.substring("whole", 1, V.MAX_CHARS)).alias("cleaned"))
    rows = with_features(cleaned, "cleaned")
    flags = F.array_compact(F.array(F.when(F.col("clean_chars") > V.MAX_CHARS, F.lit("truncated")), F.when(F.col("alpha_ratio") < V.MIN_ALPHA, F.lit("low_alpha_ratio")), F.when(F.col("url_ratio") > V.MAX_URL, F.lit("high_url_ratio")), F.when(F.col("symbol_ratio") > V.MAX_SYMBOL, F.lit("high_symbol_ratio"))))
    short = F.col("clean_chars") < V.MIN_CHARS
    flagged = rows.withColumn("flags", F.when(short, F.array(F.lit("too_short"))).otherwise(flags))
    status = F.when(short, F.lit("too_short")).when(F.size(F.array_except("flags", F.array(F.lit("truncated")))) > 0, F.lit("failed")).otherwise(F.lit("accepted"))
    return once(flagged.select("doc_id", "topic", "cleaned", F.array_join("flags", ",").alias("flags"), status.alias("status")))


def mark_duplicates(cleaned: DataFrame) -> DataFrame:
    """Accepted documents that repeat an earlier one of their topic become duplicates. Blank texts never do."""
    hash_ = F.when((F.col("status") == "accepted") & (F.trim("cleaned") != ""), F.sha2("cleaned", 256))
    # written once without the texts; rows without a hash never meet in one key
    key = F.concat_ws(":", F.coalesce(F.length("topic"), F.lit(-1)), "topic", "hash")
    rows = staged(cleaned.select("doc_id", "topic", "status", hash_.alias("hash")).withColumn("key", F.when(F.col("hash").isNotNull(), key)))
    first = staged(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    joined = met(rows.where("key is not null"), first, "key", "n").select("doc_id", "topic", "status", "first_id")
    joined = joined.unionByName(rows.where("key is null").select("doc_id", "topic", "status", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("first_id")))
    return joined.select("doc_id", "topic", F.when(F.col("first_id") < F.col("doc_id"), F.lit("duplicate")).otherwise(F.col("status")).alias("status"), F.when(F.col("first_id") < F.col("doc_id"), F.col("first_id")).alias("duplicate_of"))


def run_counts(marked: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status").isin("accepted", "duplicate", "too_short"))
    return marked.groupBy("topic").agg(F.count("*").alias("documents"), *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "duplicate", "too_short", "failed")], done.alias("completed"))


def recoveries(scored: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` low-confidence rows in order of seq."""
    return scored.where(F.col("confidence") < 0.5).orderBy("seq").limit(budget)


def sample(docs: DataFrame, k: int, seed: str = "qa") -> DataFrame:
    """A reproducible uniform sample without replacement."""
    return docs.select("doc_id", F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(k).select("doc_id")
