"""Columns on inline rows: what the tables don't hold."""

import csv
from datetime import date

import pytest
from pyspark.sql import functions as F
from sentilake.functions import planning as N
from sentilake.functions import sentiment as S
from sentilake.functions import texts as T
from sentilake.functions import urls as U
from sentilake.operators import documents, export, links, reporting
from sentilake.sources import pages as P


def values(spark, column, given):
    rows = spark.createDataFrame(list(enumerate(given)), "id long, v string")
    return [r[0] for r in rows.orderBy("id").select(column(F.col("v"))).collect()]


def test_normalize_url(spark):
    given = ["HTTP://Www.Example.com/a/?utm_source=x&b=1&c=", "https://a.b/", "https://a.b", "ftp://x/y", " https://a.b/c;p?q=a%20b#z ", None, "", "nonsense"]
    assert values(spark, lambda c: F.coalesce(U.normalize_url(c), F.lit("")), given) == ["http://www.example.com/a?b=1", "https://a.b/", "https://a.b/", "", "https://a.b/c?q=a+b", "", "", ""]


def test_platforms_by_domain_end(spark):
    assert values(spark, U.infer_platform, ["https://old.reddit.com/r/x", "https://netflix.com/", "https://dailynews.org/", "https://a.org/"]) == ["reddit", "x", "news_site", "web"]


def test_low_value(spark):
    assert values(spark, U.is_low_value, ["https://a.org/search/x", "https://www.bing.com/", "https://a.org/p?hl=en", "https://a.org/x.png", "https://a.org/story"]) == [True, True, True, True, False]


def test_normalize_text(spark):
    got = values(spark, T.normalize, ["I can't see @foo_bar #Tag https://x.y/z?a=b now", "Accept all cookies!! Fine.", None])
    assert got == ["i cannot see user bar tag <url> now", "fine", ""]


def test_normalize_searches_before_it_replaces(spark):
    """The patterns one after the other give the same, and a text without their words is spared them."""

    def plainly(text, noise):
        t = F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" "))
        t = T.expand_contractions(t)
        t = F.regexp_replace(t, "(^|[^\\p{L}\\p{N}_])@[A-Za-z0-9_]{2,64}", "$1 @user ")
        t = F.regexp_replace(F.regexp_replace(t, "#([A-Za-z0-9_]+)", " $1 "), T.URL, " <url> ")
        for p in noise:
            t = F.regexp_replace(t, "(?i)" + p, " ")
        return F.lower(T.squeeze(F.translate(t, T.PUNCTUATION, " " * len(T.PUNCTUATION))))

    texts = [
        None, "", " \t ", "Cookie policy and COOKIES\n\tPolicy", "sign in cookie policy to continue", "Sign  in to continueSubscribe for more", "accept_all_cookies", "x'sign in to continue", "HTTPS://a.b/cookie policy", "WWW.x.y #tag @me a@b.cd @@user",
        "can't WON'T it's <b>a|b~c^d`e</b>", "java script is disabled, JavaScript\x0bis\fdisabled", "see http://a.b of it", "İI \u212a \u017fign in to continue ÄÖ", "a  b\u00a0\u3000c \x1c", "\\ [x] {y} $1 \\1 & && -", "aaa xy b",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for noise in (T.V.NOISE_PATTERNS, ("url\\s*",), ("cookie(s)?p", "a{2}", "[xy]+"), ()):
        got = rows.select("text", T.normalize(F.col("text"), noise).alias("a"), plainly(F.col("text"), noise).alias("b")).collect()
        assert len(got) == len(texts) and [r.a for r in got] == [r.b for r in got]
    assert T.needed_words("cookie(s)?\\s+policy") == ["cookie", "policy"] and T.needed_words("a(b)?c") == ["a", "c"] and T.needed_words("a{2}") == T.needed_words("a|b") == []


def test_dates_slugs_hashes(spark):
    assert values(spark, T.slug, ["  Hello, World_x!  ", "!!!"]) == ["hello-world-x", "untitled-topic"]
    assert values(spark, T.content_hash, [" ", None]) == [None, None]
    assert values(spark, lambda c: T.payload_date(c).cast("string"), ['{"created": "2024-01-05"}', '{"x": 1}', None]) == ["2024-01-05 00:00:00", None, None]


def test_scores_and_labels(spark):
    given = ["I love this great thing", "bad badge", "good and bad", None, "good " * 3, "love great amazing excellent good wonderful fantastic awesome"]
    rows = spark.createDataFrame(list(enumerate(given)), "id long, text string")
    assert [r.score for r in S.lexicon_scored(rows, "text").orderBy("id").collect()] == pytest.approx([0.8, 0.25, 0.5, 0.5, 0.75, 1.0])
    assert values(spark, lambda c: S.label3(c.cast("double")), ["0.6", "0.5", "0.4"]) == ["positive", "neutral", "negative"]
    assert values(spark, lambda c: S.label5(c.cast("double")), ["0.31", "0.3", "0.1", "-0.1", "-0.3"]) == ["Positive", "Slightly Positive", "Neutral", "Slightly Negative", "Negative"]


def test_navigation_is_rejected_and_opinion_is_not(spark):
    rows = [(1, "https://duckduckgo.com/?ia=images", "Images", 1, 1), (2, "https://www.reddit.com/r/x/comments/1", "Public reaction and debate: opinion thread", 1, 2)]
    got = links.score(spark.createDataFrame(rows, "page_id long, url string, title string, position int, seq long"), links.Brief("debate", ("reaction",))).orderBy("seq").collect()
    assert got[0].quality <= 0.1 and got[0].relevance <= 0.1
    assert got[1].reason is None and got[1].quality >= 0.5 and got[1].relevance >= 0.4


def test_merge_keeps_first_longest_and_last(spark):
    rows = [(3, "u", "longer title", 9, 0.5, 0.1, None), (1, "u", "title", 7, 0.4, 0.3, None), (2, "u", "other", 8, 0.9, 0.2, "ann"), (4, "v", None, 1, 0.1, 0.1, None)]
    got = {r.normalized_url: r for r in links.merge(spark.createDataFrame(rows, "seq long, normalized_url string, title string, page_id long, quality double, relevance double, author string")).collect()}
    u = got["u"]
    assert (u.first_seen, u.last_seen, u.duplicate_count, u.title, u.quality, u.relevance, u.last_page, u.author) == (1, 3, 2, "longer title", 0.9, 0.3, 9, "ann")
    assert got["v"].author is None


def test_cap_counts_distinct_links(spark):
    rows = [(i, f"u{i % 4}") for i in range(12)]
    frame = spark.createDataFrame(rows, "seq long, normalized_url string")
    assert sorted(r.seq for r in links.cap(frame, 3).collect()) == [0, 1, 2]
    assert links.cap(frame, 9).count() == 12


def test_exports(spark, tmp_path):
    posts = reporting.posts(spark.createDataFrame([(1, "I love it", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string"))
    export.write_csv(posts, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert "| s | 1 |" in export.markdown(posts, "Topic")
    assert export.file_name("A b", 2, date(2024, 1, 5), "md") == "a-b-v2-20240105.md"


def test_csv_holds_whole_contents(spark, tmp_path):
    long = ' He said "great words", \\ great\r\nnext\rline ' + "é filler text " * 500 + "end  "
    rows = [(1, long, "en", "s"), (2, "x" * 81, "en", "s"), (3, None, None, None)]
    posts = reporting.posts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert export.csv_rows(posts).columns == ["id", "platform", "author", "content", "positive", "negative", "neutral", "compound", "keywords"]
    full = posts.withColumn("url", F.lit("u")).withColumn("timestamp", F.expr("if(seq = 1, timestamp_ntz'2024-01-05 01:02:03', timestamp_ntz'2024-01-05 01:02:03.5')"))
    export.write_csv(full, str(tmp_path / "whole"))
    found = {}
    for part in (tmp_path / "whole").glob("*.csv"):
        with open(part, newline="", encoding="utf-8") as f:
            found |= {r["id"]: r for r in csv.DictReader(f)}
    assert list(found["1"]) == ["id", "platform", "author", "content", "url", "positive", "negative", "neutral", "compound", "keywords", "timestamp"]
    assert [found[str(i)]["content"] for i, *_ in rows] == [t or "" for _, t, *_ in rows]
    assert found["1"]["keywords"] == "said; great; words; next; line; filler; text" and found["3"]["keywords"] == ""
    assert (found["1"]["timestamp"], found["2"]["timestamp"]) == ("2024-01-05T01:02:03", "2024-01-05T01:02:03.500000")


def test_feeds_and_searches(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>a</title><link>l</link></item><item><title>b</title></item></channel></rss>")
    assert [r.title for r in P.feed_items(spark, str(tmp_path / "feed.xml")).orderBy("title").collect()] == ["a", "b"]
    (tmp_path / "s.json").write_text('{"query": "q", "web": [{"title": "w", "link": "1"}], "news": [{"title": "n", "link": "2"}]}\n')
    assert [(r.position, r.title) for r in P.search_results(spark, str(tmp_path / "s.json")).orderBy("position").collect()] == [(1, "w"), (2, "n")]


def test_entry_point_imports_without_the_subpackage(spark):
    import importlib
    import sys

    import __spark_entry__

    names = ["corpus_pipeline", *[m for m in sys.modules if m.startswith("sentilake.llm")]]
    kept = {n: sys.modules.pop(n) for n in names if n in sys.modules}
    sys.modules["corpus_pipeline"] = None
    try:
        assert set(importlib.reload(__spark_entry__).queries()) >= {"platform_breakdown"}
        assert not any(q.startswith("op") for q in __spark_entry__.queries())
    finally:
        del sys.modules["corpus_pipeline"]
        sys.modules.update(kept)
        importlib.reload(__spark_entry__)


def test_search_phrases_priorities_and_pages(spark):
    rows = [("1. price of rice, here; \"fuel queue\"\n- price of rice\n2) flood relief", "x"), ("are; short", "x"), (" \n", "x"), (None, "x")]
    got = spark.createDataFrame(rows, "text string, topic string").select(N.query_phrases(F.col("text"), F.col("topic")).alias("p")).collect()
    assert [r.p for r in got] == [["price of rice", "fuel queue", "flood relief"], ["x", "x public sentiment", "x Nepal reactions"], ["x"], ["x"]]
    levels = [("2", 9), ("3.5", 0), ("5", 0), (" High ", 9), ("soon", 1), (None, 3), ("", 4)]
    got = spark.createDataFrame(levels, "raw string, i int").select(N.priority(F.col("raw"), F.col("i")).alias("p")).collect()
    assert [r.p for r in got] == ["high", "medium", "low", "high", "high", "medium", "low"]
    got = spark.createDataFrame([("a b*~&", "Old.Reddit"), (None, "web")], "q string, hint string").select(N.search_urls(F.col("q"), F.col("hint")).alias("u")).collect()
    assert got[0].u == ["https://www.reddit.com/search/?q=a+b%2A~%26"] and got[1].u == [None, None]


def test_content_items_and_payloads_with_nulls(spark):
    schema = "normalized_url string, position int, kind string, title string, text string, source_url string, url string, metadata map<string,string>"
    rows = [("u", 0, None, None, None, None, " ", None), ("u", 1, "post", "t", " body ", None, None, {"permalink": " p ", "like_count": "3", "other": "1"})]
    a, b = documents.content_items(spark.createDataFrame(rows, schema)).orderBy("position").collect()
    assert (a.kind, a.url, a.text, a.excerpt, a.metrics, a.reference) == ("content", None, None, None, None, None) and len(a.item_id) == 64
    assert (b.url, b.text, b.metrics, b.reference) == ("p", "body", {"like_count": "3"}, "t")
    targets = spark.createDataFrame([(1, "n", "T", "d", "web"), (2, "m", "T", "d", "web")], "k int, normalized_url string, title string, domain string, platform string")
    scraped = spark.createDataFrame([(1, "", None, "x", "", " \n")], "k int, title string, domain string, platform string, content_text string, raw_text string")
    (only,) = documents.payloads(targets, scraped, "k").collect()
    assert (only.title, only.domain, only.platform, only.content_hash) == ("T", "d", "x", None)
