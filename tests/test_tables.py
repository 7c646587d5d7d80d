"""Declared merges, and tables that streams merge into: delivered twice, failed half-way, swept."""

import pytest
from pyspark.sql import functions as F
from sentilake.functions.plan import staged
from sentilake.operators import merging
from sentilake.streaming import events, tables

RULES = {"a": merging.LATEST, "b": merging.KNOWN, "c": merging.INSERTED, "d": merging.FIRST, "e": merging.LONGEST, "f": merging.MOST, "g": merging.LEAST, "h": merging.ADD, "i": merging.UNION, "m": merging.MAPPED, "s": merging.MAPPED}
KINDS = "k string, n long, a string, b string, c string, d string, e string, f long, g long, h long, i array<string>, m map<string,string>, s map<string,struct<x:long>>"


def test_each_column_has_its_rule(spark):
    rows = lambda *r: spark.createDataFrame(list(r), KINDS)
    old = rows(("x", 1, "a1", "b1", None, None, "long", 5, 5, 5, ["p"], {"u": "1", "v": "1"}, {"r": (1,)}), (None, 2, "null key", None, None, None, None, None, None, None, None, None, None))
    new = rows(
        ("x", 3, "a3", None, "c3", "d3", "tall", 4, 4, 4, ["q", "p"], {"v": "2"}, {"r": (2,), "t": (3,)}), ("x", 4, None, None, "c4", "d4", None, 9, 9, 9, None, None, None),
        ("y", 5, "y", "y", "y", "y", "y", 1, 1, 1, [], {}, {}), (None, 6, "later", None, None, None, "e", None, None, 1, ["z"], {"w": "1"}, None),
    )
    merge = lambda a, b: merging.merge(a, b, ["k"], "n", RULES)
    got = {r.k: r for r in merge(old, new).collect()}
    x, null = got["x"], got[None]
    assert (x.n, x.a, x.b, x.c, x.d, x.e, x.f, x.g, x.h, x.i) == (4, None, "b1", None, "d3", "long", 9, 4, 18, ["p", "q"])
    assert x.m == {"u": "1", "v": "2"} and {k: v.x for k, v in x.s.items()} == {"r": 2, "t": 3}
    assert (null.a, null.e, null.h, null.i, null.m, null.s) == ("later", "e", 1, ["z"], {"w": "1"}, None) and got["y"].m is None and len(got) == 3
    # in two steps as in one
    step = merge(merge(old, new.where("n < 4")), new.where("n >= 4"))
    assert sorted(map(repr, step.collect())) == sorted(map(repr, got.values()))
    assert merge(old.limit(0), new.limit(0)).count() == 0


def test_agents_count_their_retries(spark):
    kinds = "agent string, at long, status string, retries long, retrying boolean, error string, started boolean, completed boolean, meta map<string,string>"
    rows = spark.createDataFrame([("a", 1, "running", None, False, None, True, False, {"x": "1"}), ("a", 2, "retrying", None, True, "e", False, False, None), ("a", 3, "retrying", None, True, "f", False, False, None), ("a", 4, "running", 7, False, None, True, False, {"y": "1"}), ("a", 5, "retrying", None, True, "g", False, False, {"x": "2"}), ("a", 6, "done", None, None, None, False, True, None)], kinds)
    whole = merging.agent_status(None, rows).head()
    assert (whole.retries, whole.status, whole.started_at, whole.completed_at, whole.last_error, whole.meta) == (8, "done", 1, 6, None, {"x": "2", "y": "1"})
    for cut in range(2, 7):
        assert merging.agent_status(staged(merging.agent_status(None, rows.where(F.col("at") < cut))), rows.where(F.col("at") >= cut)).head() == whole


@pytest.fixture
def counts(tmp_path):
    schema = "k string, n long, total long"
    from pyspark.sql.types import StructType

    return tables.Table(str(tmp_path / "table"), ["k"], StructType.fromDDL(schema), lambda old, new: merging.merge(old, new, ["k"], "n", {"total": merging.ADD}), buckets=4)


def read(spark, table):
    return {r.k: r.total for r in table.read(spark).collect()}


def test_a_batch_counts_once(spark, counts):
    batch = lambda *r: spark.createDataFrame(list(r), "k string, n long, total long")
    assert read(spark, counts) == {}
    assert counts.apply(batch(("a", 1, 1), ("b", 1, 5), (None, 1, 2)), "s", 0)
    assert not counts.apply(batch(("a", 1, 1)), "s", 0)
    assert counts.apply(batch(("a", 2, 1), ("c", 2, 1)), "s", 1) and counts.apply(batch(("a", 3, 1)), "other", 0)
    assert read(spark, counts) == {"a": 3, "b": 5, "c": 1, None: 2}
    counts.apply(batch().limit(0), "s", 2)
    counts.vacuum(spark)
    assert read(spark, counts) == {"a": 3, "b": 5, "c": 1, None: 2} and tables.names(spark, f"{counts.path}/state") == ["000000000003"]
    assert not counts.apply(batch(("a", 9, 9)), "s", 2)


def test_what_failed_half_way_is_not_seen(spark, counts):
    batch = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, n long, total long")
    counts.apply(batch, "s", 0)
    # data of the next version were written, its state wasn't
    batch.withColumn(tables.BUCKET, F.lit(0)).write.partitionBy(tables.BUCKET).parquet(f"{counts.path}/data/{1:012d}")
    spark.createDataFrame([("bucket", "0", 1)], "kind string, name string, value long").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{counts.path}/state/{1:012d}")
    assert read(spark, counts) == {"a": 1, "b": 1}
    assert counts.apply(batch, "s", 1) and read(spark, counts) == {"a": 2, "b": 2}


def test_a_stream_goes_on_where_it_was_and_a_failed_batch_comes_again(spark, counts, tmp_path):
    source, state = str(tmp_path / "source"), str(tmp_path / "checkpoint")
    rows = lambda n: spark.createDataFrame([("a", n, 1), (f"k{n}", n, 1)], "k string, n long, total long")
    run = lambda **how: tables.merge_stream(events.parquet_stream(spark, source), counts, state, **how).awaitTermination()
    rows(1).write.parquet(source)
    run()
    rows(2).write.mode("append").parquet(source)
    merge = counts.merge

    def fails(old, new):
        raise ValueError("lost")

    counts.merge = fails
    with pytest.raises(Exception):
        run()
    counts.merge = merge
    run()
    run()
    assert read(spark, counts) == {"a": 2, "k1": 1, "k2": 1}


def test_the_sweep_takes_up_what_is_pending(spark, counts):
    counts.apply(spark.createDataFrame([("a", 1, 1), ("b", 1, 3)], "k string, n long, total long"), "s", 0)
    work = lambda rows: rows.select("k", (F.col("n") + 1).alias("n"), F.lit(1).cast("long").alias("total"))
    assert tables.sweep(spark, counts, F.col("total") < 3, work, rounds=5) == 2
    assert read(spark, counts) == {"a": 3, "b": 3}


def test_streams_of_folders_and_of_no_events(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", 1.5), (2, "2024-01-02 10:00:00", 2.0), (3, "2024-01-02 11:00:00", 3.0)], "event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    folder, none = str(tmp_path / "events.parquet"), str(tmp_path / "none.parquet")
    rows.repartition(2).write.parquet(folder)
    rows.limit(0).write.parquet(none)
    assert {(r.day, r.n, r.total) for r in events.replayed_days(spark, folder).collect()} == {("2024-01-01", 1, 1.5), ("2024-01-02", 2, 5.0)}
    assert events.replayed_days(spark, none).count() == 0
    stream = lambda: spark.readStream.schema(rows.schema).parquet(folder)
    for state in ("one", "two"):  # all again, under the same batch numbers
        events.append_batches(stream(), str(tmp_path / "out"), str(tmp_path / state)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_a_late_joiner_misses_nothing_and_sees_nothing_twice(spark, tmp_path):
    source = str(tmp_path / "source")
    rows = lambda a, z: spark.range(a, z).select("id", F.current_timestamp().alias("ts"))
    rows(0, 10).repartition(2).write.parquet(source)
    history, live = events.replay_then_follow(spark, source)
    rows(10, 15).write.mode("append").parquet(source)  # comes before the history is read
    assert sorted(r.id for r in history.collect()) == list(range(10))
    for lot in (15, 20):
        live.writeStream.format("parquet").option("path", str(tmp_path / "live")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "live")).collect()) == list(range(10, lot))
        rows(lot, lot + 5).write.mode("append").parquet(source)
