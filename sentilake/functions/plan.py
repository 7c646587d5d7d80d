"""Plan helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_staged: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget() -> None:
    """Delete what was staged."""
    for spark, path in _staged:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has gone, and its folder with it
            return


def once(df: DataFrame) -> DataFrame:
    """The same rows, with each column computed once.

    Filters above aren't pushed below a generated row, where the optimizer would write
    out the columns' long expressions again for each mention.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("row")).select("row.*")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share; only in local mode may that be a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-stage-")
    return f"{named.rstrip('/')}/table-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there, for plans that need them twice."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    _staged.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch of whole texts that goes to Python.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches to Python are small, so that workers' memory doesn't grow with the table; smaller ones stay."""
    for name, most in BATCHES.items():
        if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= most:
            spark.conf.set(name, most)


#: A key with more than one of this many parts of a table's rows is hot; so fewer keys than this are.
HOT = 512
#: Tables of up to this many narrow rows are broadcast.
SMALL = 10_000


def met(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of ``rows`` to ``facts``, a staged table that has each key once and the number of its rows in ``n``, which is dropped.

    Few facts are broadcast whole, else those of hot keys are, whose rows then stay where
    they are; only the rows of other keys are shuffled. A null key meets nothing.
    """
    count, total = facts.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).head()
    if count <= SMALL:
        return rows.join(F.broadcast(facts.drop(n)), key)
    hot = F.col(n) * HOT > total
    some, others = facts.where(hot).drop(n), facts.where(~hot).drop(n)
    few = rows.join(F.broadcast(some), key)
    return few.unionByName(rows.join(F.broadcast(some.select(key)), key, "left_anti").join(others, key))
