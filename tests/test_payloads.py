"""Dates deep in payloads, JSON in prose, nested values, and texts before they are normalised."""

import json

import pyarrow as pa
from pyspark.sql import functions as F
from sentilake.functions import payloads as X
from sentilake.functions import plan
from sentilake.functions import texts as T
from sentilake.operators import reporting


def values(spark, column, given):
    rows = spark.createDataFrame(list(enumerate(given)), "id long, v string")
    return [r[0] for r in rows.orderBy("id").select(column(F.col("v"))).collect()]


def test_the_last_nested_payload_is_searched_first(spark):
    dated = lambda c: F.date_format(X.published_at(F.lit(None).cast("string"), c), "yyyy-MM-dd")
    given = [
        {"a": {"xdate": "2024-01-01"}, "b": {"xdate": "2024-01-02"}}, {"b": {"xdate": "2024-01-02"}, "xTime": "2024-01-03"}, {"created": "2024-01-04", "xdate": "2024-01-05"},
        {"a": [{"b": [{"updated_timestamp": 1704412800}]}], "c": [1, "date", {"other": "2024-01-01"}]}, {"xdate": True, "ydate": "soon", "zdate": {"pubdate": "Jan 6, 2024"}}, {"x": 1}, [],
    ]
    assert values(spark, dated, [*map(json.dumps, given), "no json", None, "[" * 100_000]) == ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-06", None, None, None, None, None]
    rows = spark.createDataFrame([("2023-05-05", '{"date": "2024-01-01"}'), ("?", '{"date": "2024-01-01"}')], "own string, p string")
    assert [str(r[0])[:10] for r in rows.select(X.published_at(F.col("own"), F.col("p"))).collect()] == ["2023-05-05", "2024-01-01"]


def test_json_in_prose(spark):
    given = ['{"a": 1}', 'x ```json\n{"a": {"b": 1}}\n``` y ``` {"c": 2} ```', "a } b { c", '{"a": 1} and {"b": 2}', "", None, "{{}", "``` ```"]
    assert values(spark, X.json_candidates, given) == [
        ['{"a": 1}'], [given[1], '{"a": {"b": 1}}', '{"c": 2}', '{"a": {"b": 1}}\n``` y ``` {"c": 2}'], ["a } b { c"],
        ['{"a": 1} and {"b": 2}', '{"a": 1}', '{"b": 2}'], [], [], ["{{}"], ["``` ```"],
    ]
    assert values(spark, X.first_json, given)[:6] == ['{"a": 1}', '{"a": {"b": 1}}', None, '{"a": 1}', None, None]


def test_nested_values(spark):
    assert values(spark, X.nested_values, ['{"a": {"b": " x ", "c": ["y", " ", 3]}, "d": true}', '[1, {"z": 2}]', '"t"', "", None, "bad"]) == [["x", "y", "3", "True"], ["1", "{'z': 2}"], ["t"], [], [], []]


def test_pictures_and_mangled_letters(spark):
    given = ["I can't \U0001f621 go_there &amp; @foo_bar", "cafÃ© itâ€™s Ã alone, café", "\U0001f44d\U0001f3fd ok ❤️ \U0001f680", None, "  "]
    assert values(spark, X.prepared, given) == ["I can't enraged face go there & @foo bar", "café it’s Ã alone, café", "thumbs up ok red heart rocket", "", ""]
    cleaned = values(spark, lambda c: T.normalize(X.prepared(c)), ["I can't believe this \U0001f621 https://example.com/x"])[0]
    assert "cannot" in cleaned and "enraged face" in cleaned
    assert values(spark, X.without_markdown, ["# a `code` [label](http://x.y) *b* c-d ~e~ > f"]) == ["a label b c d e f"]


def test_whole_reports(spark):
    rows = [(1, "x", "a", "same words here", 0.5, "2024-01-02"), (2, "x", "a", "other words", -0.5, "2024-01-01"), (3, None, "a", "words words", 0.5, None), (4, "y", "a", "a b", 0.0, "2024-01-01")]
    posts = spark.createDataFrame(rows, "seq long, platform string, author string, content string, compound double, day string").withColumn("ts", F.to_date("day")).drop("day")
    s = reporting.summary_report(posts).head()
    assert (s.total_posts, s.most_positive_post, s.most_negative_post, s.top_keywords, s.avg_compound) == (4, "same words here", "other words", ["words", "same", "here", "other"], 0.125)
    assert [(d.day, d.post_count, d.negative) for d in s.sentiment_over_time] == [("2024-01-01", 2, 1), ("2024-01-02", 1, 0)]
    assert [(r.platform, r.post_count, r.top_keywords) for r in reporting.breakdown_report(posts).collect()] == [(None, 1, ["words"]), ("x", 2, ["words", "same", "here", "other"]), ("y", 1, [])]
    none = reporting.summary_report(posts.limit(0)).head()
    assert (none.total_posts, none.most_positive_post, none.top_keywords, none.sentiment_over_time) == (0, "", [], [])


def test_dates_are_worked_out_once(spark):
    """A payload is read once for each key, and a value of its own once, however often a date's forms mention them."""
    said = {
        '{"created": "soon", "time": "2024-01-05"}': "2024-01-05", '{"published": null, "epoch": 1700000000}': "2023-11-14", '{"d\\u0061te": "Jan 5, 2024"}': "2024-01-05",
        '{"x": {"date": "2024-01-05"}, "y": "date"}': None, '{"date": " 5 Jan 2024 ", "published_at": "2024/1/6"}': "2024-01-06", '{"date": ""}': None, "no json date": None, None: None,
    }
    rows = spark.createDataFrame([(x,) for x in said], "j string").select("j", T.payload_date(F.col("j")).cast("date").cast("string").alias("at"))
    assert {r.j: r["at"] for r in rows.collect()} == said
    assert str(T.payload_date(F.col("j"))).count("get_json_object") == len(T.V.DATE_KEYS)
    assert str(T.parse_date(F.md5("j"))).count("md5(") == 1


def test_whole_texts_go_to_python_in_small_batches(spark):
    names = list(plan.BATCHES)
    try:
        spark.conf.set(names[0], 7)
        spark.conf.unset(names[1])
        plan.small_batches(spark)
        assert [spark.conf.get(n) for n in names] == ["7", str(4 << 20)]
        spark.conf.set(names[0], 10_000)
        plan.small_batches(spark)
        rows = [(i, "x" * 100_000 if i % 2 else None) for i in range(1200)]
        seen = F.arrow_udf(lambda t: pa.array([len(t)] * len(t), pa.int64()), "long")
        largest = spark.createDataFrame(rows, "i long, t string").coalesce(1).select(seen("t").alias("n"), X.prepared(F.col("t")).alias("p")).agg(F.max("n"), F.min("p"), F.max(F.length("p"))).head()
        assert 0 < largest[0] <= 100 and largest[1:] == ("", 100_000)
    finally:
        for n in names:
            spark.conf.unset(n)
