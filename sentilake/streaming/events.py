"""Event streams: daily windows, and appends by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import shared_folder, staged


def daily_windows(stream: DataFrame) -> DataFrame:
    """Tumbling days of a stream of events; late events count for one day."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp"))
    days = timed.withWatermark("at", "1 day").groupBy(F.window("at", "1 day"))
    return days.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "total")


def parquet_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of the files of a table: of a folder, or of a single file."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(schema).options(**options)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", path.rpartition("/")[2]).parquet(path.rpartition("/")[0])


def replayed_days(spark: SparkSession, path: str) -> DataFrame:
    """The stream's complete answer over the files that are there now; of no events there are no days."""
    answer = shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{answer}/days")

    days = daily_windows(parquet_stream(spark, path))
    spark.createDataFrame([], days.schema).write.parquet(f"{answer}/days")
    days.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{answer}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(days.schema).parquet(f"{answer}/days")


def replay_then_follow(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What a folder of events holds now, as a table, and as a stream all that comes after, for one who joins late.

    The cut is the set of files that are there, written down before either is read. Files
    that come while the history is still being read are in the stream alone; no row is in
    both or in neither.
    """
    stream = parquet_stream(spark, path)
    file = F.col("_metadata.file_path").alias("__file")
    history = spark.read.schema(stream.schema).parquet(path).select("*", file)
    cut = staged(history.select("__file").distinct())
    return history.join(cut, "__file", "left_semi").drop("__file"), stream.select("*", file).join(cut, "__file", "left_anti").drop("__file")


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch of events to a table, in a folder of its own by day; a batch that is delivered again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
