"""The crawl over captured pages: order, caps, gates and the visited set; urls of anchors."""

from sentilake.functions import urls as U
from sentilake.operators import crawl, links
from pyspark.sql import functions as F

BRIEF = links.Brief("budget", ("tax",))
GOOD = "Public reaction and debate on the budget tax, an opinion with many comments"


def run(spark, pages, anchors, seeds, **how):
    pages = spark.createDataFrame([(f"https://{u}.org/", t, x) for u, t, x in pages], "url string, title string, text string")
    anchors = spark.createDataFrame([(f"https://{a}.org/", i, f"https://{b}.org/" if b.isalnum() else b, t) for a, i, b, t in anchors], "page_url string, pos long, href string, title string")
    seeds = spark.createDataFrame([(k, i, f"https://{u}.org/") for k, i, u in seeds], "task string, ord long, url string")
    return sorted((r.task, r.hop, r.place, r.url[8:-5]) for r in crawl.crawl(pages, anchors, seeds, BRIEF, **how).collect())


def test_hops_go_on_from_what_passes(spark):
    pages = [(u, GOOD, GOOD) for u in "abcdefgh"] + [("bad", "Nothing", "plain words"), ("menu", "Home", GOOD)]
    anchors = [("a", 0, "b", "x"), ("a", 1, "c", "x"), ("b", 0, "a", "x"), ("b", 1, "d", "x"), ("c", 0, "d", "x"), ("c", 1, "e", "x"), ("bad", 0, "h", "x"), ("a", 2, "gone", "x"), ("a", 3, "mailto:x@y.z", "x"), ("a", 4, "https://www.google.com/x", "x"), ("a", 5, "f", "Sign In"), ("a", 99, "g", "x")]
    seeds = [("t", 2, "bad"), ("t", 1, "a"), ("t", 3, "menu"), ("u", 1, "c"), (None, 1, "a")]
    assert run(spark, pages, anchors, seeds, hops=3) == [("t", 1, 1, "a"), ("t", 2, 1, "b"), ("t", 2, 2, "c"), ("t", 3, 1, "d"), ("t", 3, 2, "e"), ("u", 1, 1, "c"), ("u", 2, 1, "d"), ("u", 2, 2, "e")]
    assert run(spark, pages, anchors, seeds, hops=1) == [("t", 1, 1, "a"), ("u", 1, 1, "c")]
    # what was found but not looked at is never found again
    assert run(spark, pages, anchors, [("t", 1, "a"), ("t", 2, "b")], hops=3, per_hop=1) == [("t", 1, 1, "a"), ("t", 2, 1, "c"), ("t", 3, 1, "d")]
    assert run(spark, pages, anchors, [("t", 1, "gone")]) == []


def test_anchors_lead_where_a_browser_goes(spark):
    base = "https://a.org/x/y/z.html?q=1#f"
    want = {"b": "https://a.org/x/y/b", "/b": "https://a.org/b", "//c.org/d": "https://c.org/d", "../b?k=v#g": "https://a.org/x/b?k=v#g", "../../../../b": "https://a.org/b", "./b/./c/..": "https://a.org/x/y/b/", "?p=2": "https://a.org/x/y/z.html?p=2", "#g": "https://a.org/x/y/z.html?q=1#g", "mailto:x": "mailto:x", "/p/../q": "https://a.org/q", "..": "https://a.org/x/"}
    rows = spark.createDataFrame([(base, h) for h in want], "base string, href string")
    assert {r.href: r.url for r in rows.select("href", U.join_url(F.col("base"), F.col("href")).alias("url")).collect()} == want
