"""Stored documents and links: near duplicates, reply trees, upserts and versions on small inline tables."""

import pytest
from pyspark.sql import functions as F
from sentilake.functions import urls as U
from sentilake.operators import cleaning, export, links, reporting, stores
from sentilake.streaming import events

BRIEF = links.Brief("Budget Vote", ("tax",), ("#reform",))


def scored(spark, **given):
    row = {"seq": 1, "url": "https://example.org/a", "title": ""} | given
    kinds = links.OPTIONAL | {"seq": "long", "url": "string", "title": "string"}
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[k]}" for k in row))
    return links.score(frame, BRIEF).head()


def test_what_raises_and_lowers_a_link(spark):
    plain = scored(spark, title="Something")
    assert (plain.quality, plain.relevance) == pytest.approx((0.2 + 0.12 + 0.15 * 0.35, 0.15))
    rich = scored(spark, title="Tax debate", description="Public reaction to the budget vote", author="x", published_at="2024-01-01", position=1, source_name="search")
    assert rich.reason is None and rich.quality >= 0.5 and rich.relevance >= 0.4
    browser = scored(spark, title="Something", source_name="camoufox_browser")
    assert browser.quality == pytest.approx(plain.quality - 0.25)
    assert scored(spark, title="Something", quality_signal=-1.0, relevance_signal=0.2).relevance == pytest.approx(0.35)
    assert scored(spark, title="Sign In").reason == "navigation_link" and scored(spark, url="mailto:x", title="a").reason == "invalid_url"
    assert scored(spark, title=None, description=None).quality == pytest.approx(0.2 + 0.15 * 0.35)


def test_upsert_keeps_the_longest_and_the_first(spark):
    kinds = "normalized_url string, seq long, platform string, source_name string, source_type string, discovery_query string, raw_payload string, title string, description string, author string, published_at string, quality double, relevance double, metadata map<string,string>"
    row = lambda seq, title, author, quality, meta, source: ("u", seq, "web", source, "s", None, f"p{seq}", title, None, author, None, quality, 0.1, meta)
    old = spark.createDataFrame([row(5, "abc", None, 0.5, {"a": "1", "b": "1"}, "one")], kinds)
    stored = old.withColumnRenamed("seq", "last_seen").withColumn("first_seen", F.lit(2).cast("long")).withColumn("duplicate_count", F.lit(3).cast("long"))
    new = spark.createDataFrame([row(7, "xyz", "me", 0.4, {"b": "2"}, "two"), row(9, "no", "you", 0.9, None, None), ("v", *row(8, "t", None, 0.2, {}, "z")[1:])], kinds)
    got = {r.normalized_url: r for r in links.upsert(stored, new).collect()}
    u = got["u"]
    assert (u.title, u.author, u.quality, u.first_seen, u.last_seen, u.duplicate_count, u.source_name, u.raw_payload) == ("abc", "me", 0.9, 2, 9, 5, None, "p9")
    assert u.metadata == {"a": "1", "b": "2"} and got["v"].duplicate_count == 0 and got["v"].metadata is None
    assert links.upsert(stored.limit(0), new.limit(0)).count() == 0


def test_near_duplicates_are_found_once(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(1, "t", " ".join(words), "accepted"), (2, "t", " ".join(words[1:]), "accepted"), (3, "t", "quite another text", "accepted"), (4, "u", " ".join(words), "accepted"), (5, "t", " ".join(words), "failed"), (6, None, "x", "accepted"), (7, None, "x", "accepted"), (8, "t", "  ", "accepted")]
    got = {(r.doc_id, r.match_id) for r in stores.near_duplicates(spark.createDataFrame(rows, "doc_id long, topic string, cleaned string, status string")).collect()}
    assert got == {(1, 2), (2, 1), (6, 7), (7, 6)}


def test_versions_are_put_away_and_switched(spark):
    kinds = "session long, version long, payload string, active boolean"
    versions = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", True), (2, 1, "c", True)], kinds)
    after = stores.archive(versions, spark.createDataFrame([(1, "new"), (3, "first")], "session long, payload string"))
    assert {(r.session, r.version, r.payload) for r in stores.resolve(after).collect()} == {(1, 3, "new"), (2, 1, "c"), (3, 1, "first")}
    back = stores.switch(after, spark.createDataFrame([(1, 1), (2, 7)], "session long, version long"))
    assert {(r.session, r.version) for r in stores.resolve(back).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert [r.payload for r in stores.resolve(after, 2).collect()] == ["b"]


def test_duplicates_of_null_topics_and_many_failures(spark):
    rows = [(1, None, "same", "", "accepted"), (2, None, "same", "", "accepted"), (3, "t", "same", "", "accepted"), (4, "t", " ", "", "accepted"), (5, "t", "same", "", "failed")]
    got = {r.doc_id: (r.status, r.duplicate_of) for r in cleaning.mark_duplicates(spark.createDataFrame(rows, "doc_id long, topic string, cleaned string, flags string, status string")).collect()}
    assert got == {1: ("accepted", None), 2: ("duplicate", 1), 3: ("accepted", None), 4: ("accepted", None), 5: ("failed", None)}


def test_anchors_with_inner_tags_and_single_quotes(spark):
    html = "<a class='x' href='/b'>two <b>words</b></a><A HREF=\"c\">\nthree </A>" + "".join(f'<a href="/{i}">{i}</a>' for i in range(1500))
    got = links.anchors(spark.createDataFrame([(1, "http://h.org/p/q", html), (2, "http://h.org/", '<a href="#x">y</a>')], "page_id long, url string, html string")).orderBy("seq").collect()
    assert [(r.url, r.title) for r in got[:2]] == [("http://h.org/b", "two words"), ("http://h.org/p/c", "three")]
    assert len({r.seq for r in got}) == 1503 and [r.pos for r in got if r.page_id == 1] == list(range(1502))


def test_addresses_that_lead_nowhere(spark):
    rows = spark.createDataFrame([("mailto:a@b.c",), ("#top",), (" ",), (None,), ("https://www.google.com/x",)], "u string")
    got = [tuple(r) for r in rows.select(U.is_navigable(F.col("u")), U.is_search_engine(U.domain(F.col("u")))).collect()]
    assert got == [(False, False)] * 4 + [(True, True)]


def test_sample_sizes(spark):
    docs = spark.range(100).withColumnRenamed("id", "doc_id")
    assert stores.reviewed(docs, "doc_id", 0.05, 40).count() == 5 and stores.reviewed(docs, "doc_id", 0.9, 40).count() == 40
    assert stores.reviewed(docs, "doc_id", 0.0001, 40).count() == 1 and stores.reviewed(docs, "doc_id", 0.5, 0).count() == 0 and stores.reviewed(docs.limit(0), "doc_id", 0.5, 9).count() == 0


def test_report_names_each_platform(spark):
    posts = spark.range(1200).select(F.col("id").alias("seq"), F.concat(F.lit("p"), "id").alias("platform"), F.lit("a").alias("author"), F.lit("good words here").alias("content"), F.lit(0.5).alias("compound"), F.lit(0.75).alias("score"))
    text = export.markdown(posts, "a topic")
    assert text.startswith("# a topic") and all(f"| p{i} |" in text for i in range(1200))
    assert reporting.sorted_page(posts, "platform", size=2).count() == 2


def test_batches_are_appended_by_day(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", 2.0), (2, "2024-01-02 10:00:00", 3.0)], "event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        events.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and {str(r.day) for r in got.collect()} == {"2024-01-01", "2024-01-02"}
