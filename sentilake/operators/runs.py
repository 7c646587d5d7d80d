"""Run and queue state: counts, latest rows, folded status logs, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, at: str, tie: str, columns: list[str]) -> DataFrame:
    """The latest row of each key: one grouped maximum, no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, tie)).alias("r")).select(key, *[f"r.{c}" for c in columns])


def fold_status(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """A target's state from its log: the first start stays, what came last replaces, attempts add up."""
    when = F.struct(at, tie)
    return log.groupBy(key).agg(F.min(at).alias("started_at"), F.max_by("status", when).alias("status"), F.max_by("value", when).alias("last_value"), F.count("*").alias("attempts"), F.min_by("value", F.when(F.col("value").isNotNull(), when)).alias("first_value"))


def versions(messages: DataFrame) -> DataFrame:
    """Immutable versions of each session, the active one, and the number that the next gets."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_versions"), F.max("turn").alias("active_version"), (F.max("turn") + 1).alias("next_version"))
