"""Captured answers of services and the small rules beside them."""

import json

from pyspark.sql import functions as F
from sentilake.functions import sentiment as S
from sentilake.sources import captured as C

ASKED = "query string, platform_hint string, target_results int, json string"


def found(spark, source, answer, target=25, **how):
    rows = spark.createDataFrame([("q", "news", target, answer if isinstance(answer, str) or answer is None else json.dumps(answer))], ASKED)
    return [(r.position, r.url, r.title, r.description, round(r.quality_signal, 3), r.relevance_signal, r.published_at) for r in C.search_links(rows, source, **how).orderBy("position").collect()]


def test_searches_have_their_signals_and_limits(spark):
    entries = [{"link": f"https://a.org/{i}", "title": f"t{i}", "snippet": "s", "other": {"x": 1}} for i in range(30)]
    got = found(spark, "serper", {"organic": entries, "demo": True})
    assert len(got) == 10 and got[0] == (1, "https://a.org/0", "t0", "s", 0.2, 0.1, None) and got[9][4] == 0.11
    assert len(found(spark, "serpapi", {"organic_results": entries})) == 25 and len(found(spark, "serpapi", {"organic_results": entries}, target=3)) == 3 and found(spark, "serpapi", {"organic_results": entries}, target=-1) == []
    both = {"data": {"news": [{"url": "https://n.org", "description": "", "snippet": "s", "date": "d"}], "web": [{"url": "ftp://no.org"}, {"url": "https://w.org", "title": None}]}}
    assert found(spark, "firecrawl_search", both) == [(2, "https://w.org", "", "", 0.18, 0.12, None), (3, "https://n.org", "", "s", 0.18, 0.12, "d")]
    assert found(spark, "serpapi", {"organic_results": [{"url": "https://u.org"}, {}]})[0][1] == "https://u.org"
    for bad in ("no json", None, "{}", "[]", '{"organic": null}'):
        assert found(spark, "serper", bad) == []


def test_names_hints_and_readiness(spark):
    names = spark.createDataFrame([("Search",), ("firecrawl-search",), ("browser",), ("",), (None,), ("serpapi",)], "n string")
    assert [r[0] for r in names.select(C.source_name(F.col("n"), ("serper", "firecrawl_search"))).collect()] == ["serper", "firecrawl_search", None, None, None, None]
    hints = spark.createDataFrame([("reddit.com", "youtube"), ("a.org", "youtube"), ("a.org", "a Tweet"), ("a.org", "generic"), ("a.org", None), ("dailytimes.org", "x")], "d string, h string")
    assert [r[0] for r in hints.select(C.hinted_platform(F.col("d"), F.col("h"))).collect()] == ["reddit", "youtube", "x", "web", "web", "news_site"]
    some = spark.createDataFrame([("serper", True, False), ("serpapi", True, True), ("crawlbase", True, None), ("camoufox", None, True)], "name string, enabled boolean, has_key boolean")
    assert {r.name: (r.needs_key, r.ready) for r in C.catalog(some).collect()} == {"serper": (False, True), "serpapi": (True, True), "crawlbase": (True, False), "camoufox": (False, False)}


def test_videos_and_scrapes(spark):
    rows = spark.createDataFrame([("u", "own", "", '{"title": " A  b ", "author_name": "", "thumbnail_url": "t"}'), ("v", " own ", "said", "bad")], "url string, title string, description string, json string")
    a, b = C.videos(rows).orderBy("url").collect()
    assert (a.title, a.author, a.site_name, a.thumbnail_url) == ("A b", None, "YouTube", "t") and a.content_text.startswith("A b\n\nYouTube video") and (b.title, b.content_text) == ("own", "own\n\nsaid")
    pages = spark.createDataFrame([("https://x.com/a", "t", None, " # Head\n"), ("https://b.org/a.xml", "t", "<p>no long text</p>", "m"), ("u", None, "", " ")], "url string, title string, html string, markdown string")
    got = {r.url: (r.title, r.content_text, r.plain_markdown, r.platform) for r in C.scraped_pages(pages).collect()}
    assert got == {"https://x.com/a": ("t", "# Head", "Head", "x"), "https://b.org/a.xml": ("t", "no long text", "m", "rss")}


def test_feeds(spark):
    rss = "<rss><channel><title> F </title>" + "".join(f"<item><title>t{i}</title><description> a  &lt;b&gt; </description></item>" for i in range(45)) + "</channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><title>A</title><entry><title>only</title><link href=' h '/><author><name>n</name></author><id>i</id></entry></feed>"
    rows = spark.createDataFrame([("r", rss), ("a", atom), ("n", "no xml"), ("z", None), ("e", "<rss><channel><title>x</title></channel></rss>")], "url string, xml string")
    got = C.feed_entries(rows).collect()
    assert sorted({(r.url, r.format, r.feed_title) for r in got}) == [("a", "atom", "A"), ("r", "rss", "F")] and sum(r.url == "r" for r in got) == 40
    (one,) = [r for r in got if r.url == "a"]
    assert (one.title, one.link, one.text, one.author, one.guid) == ("only", "h", "only", "n", "i") and {r.text for r in got if r.url == "r"} == {"a <b>"}


def test_best_results_and_shown_changes(spark):
    rows = spark.createDataFrame([(1, []), (2, [("a", 0.2), ("b", 0.9), ("c", 0.9)]), (3, None), (4, [("a", None)])], "i int, r array<struct<label:string,score:double>>")
    assert [tuple(r[0]) for r in rows.orderBy("i").select(S.best_result(F.col("r"))).collect()] == [("neutral", 0.5), ("b", 0.9), ("neutral", 0.5), ("a", 0.0)]
    deltas = spark.createDataFrame([(0.011,), (0.01,), (-0.5,), (None,)], "d double")
    assert [r[0] for r in deltas.select(S.shown_delta(F.col("d"))).collect()] == ["+0.01", "No change", "-0.50", "No change"]
