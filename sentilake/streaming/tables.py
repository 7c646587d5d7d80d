"""Keyed tables that streams merge into: each batch once, however often it is delivered.

A table is a folder of Parquet in buckets of its key. A batch is merged with the buckets
that it touches, and these are written anew under the next version. What makes them the
table is the version's state, written last as a small table of its own: which version
holds each bucket, and the number of the last batch of each writer. A state without
Spark's marker of success doesn't count, so a reader sees all of a batch or nothing, and a
batch that is delivered again, or again after a failure, changes nothing twice. One writer
at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

BUCKET = "__bucket"


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class State:
    """Of a version: the version of each bucket, and the last batch of each writer."""

    version: int = -1
    buckets: dict[int, int] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)


@dataclass
class Table:
    """``merge`` takes what is stored (``schema``) and a batch, and gives what is stored then; rows meet by ``key`` alone."""

    path: str
    key: list[str]
    schema: StructType
    merge: Callable[[DataFrame, DataFrame], DataFrame]
    buckets: int = 64

    def state(self, spark: SparkSession) -> State:
        for name in reversed(names(spark, f"{self.path}/state")):
            folder = f"{self.path}/state/{name}"
            if "_SUCCESS" in names(spark, folder):
                # a row for each bucket and writer
                rows = spark.read.schema("kind string, name string, value long").parquet(folder).collect()
                return State(int(name), {int(r.name): r.value for r in rows if r.kind == "bucket"}, {r.name: r.value for r in rows if r.kind == "writer"})
        return State()

    def _read(self, spark: SparkSession, buckets: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/{v:012d}/{BUCKET}={b}" for b, v in sorted(buckets.items())]
        return spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, self.state(spark).buckets)

    def apply(self, batch: DataFrame, writer: str, number: int) -> bool:
        """Merge a writer's batch unless it has come before; whether it was new."""
        spark, at = batch.sparkSession, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        state = self.state(spark)
        if number <= state.writers.get(writer, -1):
            return False
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(at.alias(BUCKET)).distinct().collect()]  # numbers below ``buckets``
            version = state.version + 1
            stored = self._read(spark, {b: v for b, v in state.buckets.items() if b in touched})
            merged = self.merge(stored, batch).select(*self.schema.names)
            # buckets in files of about Spark's advisory size: small ones share a task, large ones are split
            merged.withColumn(BUCKET, at).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/{version:012d}")
        finally:
            batch.unpersist()
        written = {int(n.split("=")[1]) for n in names(spark, f"{self.path}/data/{version:012d}") if n.startswith(BUCKET)}
        buckets = {b: v for b, v in state.buckets.items() if b not in touched} | dict.fromkeys(written, version)
        rows = [("bucket", str(b), v) for b, v in buckets.items()] + [("writer", w, n) for w, n in (state.writers | {writer: number}).items()]
        spark.createDataFrame(rows, "kind string, name string, value long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/{version:012d}")
        return True

    def vacuum(self, spark: SparkSession) -> None:
        """Delete the files of older versions, which no state but the last may need; no reader may be at them."""
        state = self.state(spark)
        for name in names(spark, f"{self.path}/state"):
            if int(name) < state.version:
                delete(spark, f"{self.path}/state/{name}")
        for name in names(spark, f"{self.path}/data"):
            for part in names(spark, f"{self.path}/data/{name}"):
                if part.startswith(BUCKET) and state.buckets.get(int(part.split("=")[1])) != int(name) <= state.version:
                    delete(spark, f"{self.path}/data/{name}/{part}")


def merge_stream(stream: DataFrame, table: Table, checkpoint: str, *, writer: str = "stream", prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merge each micro-batch of what is there now; started again with the same checkpoint, it goes on where it was."""

    def write(batch: DataFrame, number: int) -> None:
        table.apply(batch if prepare is None else prepare(batch), writer, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sweep(spark: SparkSession, table: Table, pending: Column, work: Callable[[DataFrame], DataFrame], *, writer: str = "sweep", rounds: int = 1) -> int:
    """Let the table's ``pending`` rows go through ``work`` again and merge what comes of it, up to ``rounds`` times; how many rounds had any."""
    for done in range(rounds):
        rows = table.read(spark).where(pending)
        if rows.isEmpty():
            return done
        table.apply(work(rows), writer, table.state(spark).writers.get(writer, -1) + 1)
    return rounds
