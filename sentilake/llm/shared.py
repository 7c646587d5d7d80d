"""Small helpers of the training-data operators: staged tables, fresh names, words.

Words are runs of anything but the six ASCII white-space characters. ``stage``
cuts a plan by writing it to the folder that ``spark.checkpoint.dir`` names, so a
lost executor never loses it, and reads it back as Parquet. ``unstage`` drops such a
table once a later one holds all that is still needed of it; the rest goes when the
driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The six characters that end a word, and the same as a regular expression.
SPACES = " \t\n\x0b\x0c\r"
GAP = "[\\x20\\x09-\\x0D]+"

#: A key with more than one of this many parts of a table's rows is hot; so fewer keys than this are.
HOT = 512
#: Facts about keys up to this many rows are broadcast whole; they are a few numbers each.
SMALL = 10_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a temporary one serves in local mode; elsewhere that's an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-stage-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete what ``stage`` wrote for these frames, which nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.staged_at)
        _staged.remove((df.sparkSession, df.staged_at))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _forget() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # the session has gone, and its folder with it
            return


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns of ``df`` under new names, so that others can't clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def key_of(*columns: Column) -> Column:
    """One text for the values of several columns; never null, though they may be."""
    return F.to_json(F.struct(*[c.cast("string").alias(f"k{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})


def attach(rows: DataFrame, facts: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` to ``facts``, which has each key once, on a key of which a few values may be hot.

    ``facts`` counts the rows of each key in ``n``, which is dropped; the counts add up to
    ``total`` at most. Fewer than HOT keys have over a HOT-th of that, so these are
    broadcast and their rows stay where they are; the rows of the others are shuffled.
    """
    hot = F.col(n) * HOT > total
    some, others = facts.where(hot).drop(n), facts.where(~hot).drop(n)
    few = rows.join(F.broadcast(some), key)
    rest = rows.join(F.broadcast(some.select(key)), key, "left_anti").join(others, key)
    return few.unionByName(rest)


def meet(rows: DataFrame, facts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``attach``, but facts of up to SMALL keys are broadcast whole. ``facts`` is a staged table."""
    count, total = facts.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).head()
    return rows.join(F.broadcast(facts.drop(n)), key) if count <= SMALL else attach(rows, facts, key, total, n)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    body = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, GAP))


def total_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column over the whole table."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).head()[0]


def parts(amount: int, each: int) -> int:
    """How many parts of size ``each`` hold ``amount``; one at least."""
    return max(1, -(-int(amount) // each))


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, and Arrow batches of few rows for it, since a row may hold a long text.

    Sets the session's batch size where it has Spark's default.
    """
    if df.sparkSession.conf.get(BATCH) == "10000":
        df.sparkSession.conf.set(BATCH, "500")
    return df


def add_column(df: DataFrame, text_col: str, name: str, kind: str, work: Callable[[list[bytes | None]], pa.Array], *, rows: int = 64) -> DataFrame:
    """``df`` and a column that Python works out from a text's UTF-8 bytes, a few rows at a time.

    Small slices keep a worker's memory to a few texts beside Spark's own batch.
    """

    at_text = [c.lower() for c in df.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                text = part.column(at_text).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, work(text)], names=[*part.schema.names, name])
        pa.default_memory_pool().release_unused()

    return text_batches(df).mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields]))
