"""HTML documents: what a page says of itself, and its texts."""

import duckdb
import pytest
from sentilake.plans import pages
from sentilake.sources import html as H

LD = """<script type='application/ld+json'>[{"headline": " From  LD ", "author": [{"name": "Ann"}], "articleBody": "Body of LD", "datePublished": "2024"}, 3]</script>"""
LONG = "A sentence of some words that goes on for a while, with a & and more. " * 4


def documents(spark, *pages):
    rows = spark.createDataFrame([(i, "http://A.com/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return sorted(H.documents(rows).collect(), key=lambda r: r.page_id)


def test_meta_comes_before_tag_and_tag_before_json_ld(spark):
    meta = "<meta content='By  name' name='twitter:title'><META Content=\"By property\" PROPERTY='og:title' x=1><meta name=author content=Bob>"
    got = documents(spark, f"<head>{LD}<title>T</title>{meta}</head>", f"<head>{LD}<title> T\n t</title></head>", LD, f"<meta name=og:title content=''>{LD}", None, "", "<p>no end <b>of it")
    assert [r.title for r in got] == ["By property", "T t", "From LD", "From LD", "", "", ""]
    assert [r.author for r in got] == ["Bob", "Ann", "Ann", "Ann", None, None, None]
    assert got[2].main_text == "Body of LD" and got[2].published_at == "2024" and got[2].json_ld_count == 1 and got[4].main_text == ""
    assert got[6].raw_text == "no end of it" and got[0].domain == "a.com"


def test_a_property_without_content_hides_the_name(spark):
    a, b = documents(spark, "<meta property=description><meta name=description content=x>", "<meta name=description content=x><meta property=description content=y>")
    assert (a.description, b.description) == ("", "y")


def test_json_ld_that_cannot_be_read_is_left_out(spark):
    (r,) = documents(spark, "<script type=application/ld+json>{bad</script><script type=application/ld+json>\"text\"</script><script type=application/ld+json>{\"name\": \"N\"}</script><script>{\"name\": 1}</script>")
    assert r.title == "N" and r.json_ld_count == 1


def test_main_text(spark):
    for tag in H.V.CONTENT_TAGS:
        (r,) = documents(spark, f"<body><header>h</header><{tag}><nav>n</nav>{LONG.replace('&', '&amp;')}<script>var x = '<p>';</script></{tag}><footer>f</footer></body>")
        assert r.main_text == LONG.strip() and r.content_text == r.main_text and r.excerpt == LONG[:400].strip()
    # a short article gives way to the body, and that to paragraphs
    (r,) = documents(spark, f"<body><article>short</article><div>{LONG}</div></body>")
    assert r.main_text == "short " + LONG.strip()
    some = "<p>too short</p>" + "".join(f"<{t}>{t} of more than thirty characters {i}</{t}>" for i in range(40) for t in ("p", "li", "blockquote"))
    (r,) = documents(spark, f"<div>{some}<nav><p>a navigation of more than thirty characters</p></nav></div>")
    assert r.main_text.split("\n\n") == [f"{t} of more than thirty characters {i}" for i in range(40) for t in ("p", "li", "blockquote")][:80]
    # an end that nothing opened is passed over, one further up closes what lies between
    (r,) = documents(spark, f"<article></b><p><b><i>{LONG}</article>after")
    assert r.main_text == LONG.strip() and r.raw_text.endswith("after")


def test_places_and_language(spark):
    a, b = documents(spark, "<html lang=ne><meta name='geo.region' content='NP'><meta property='og:locale' content='ne_NP'><meta property=og:site_name content=S>", "<html><meta property='og:locale' content='ne_NP'>")
    assert (a.language, a.geo, a.site_name) == ("ne", {"region": "NP", "locale": "ne_NP"}, "S") and (b.language, b.geo) == ("ne_NP", {"locale": "ne_NP"})


def test_best_text_is_that_of_the_highest_quality(spark):
    pages = [f"<body><article>{'### http://a.example/b ' * 40}</article><main>{LONG}</main></body>", f"<body><article>{LONG}</article></body>", "<p>none</p>", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r.page_id: r for r in H.best_text(rows).collect()}
    assert got[0].origin == "main" and got[1].origin == "article" and got[1].text == LONG.strip()
    assert got[2].origin is None and got[3].text is None


def test_references_without_a_semicolon():
    page = "<title>a&amp b&copy;&ampx;</title><meta name=author content='A&amp B&lt;'><script type=application/ld+json>{\"name\": \"R&D &amp x\"}</script><p>c&amp</p>&#65;&#65 &am"
    said = lambda **how: {k: v for k, v in H.Reader(page, **how).row().items() if k in ("title", "metas", "items", "raw_text")}
    ld = ['{"name": "R&D &amp x"}']
    assert said() == {"title": "a& b©&x;", "metas": [("author", "A& B<")], "items": ld, "raw_text": "a& b©&x; c& AA &am"}
    assert said(bare=False) == {"title": "a&amp b©&ampx;", "metas": [("author", "A&amp B<")], "items": ld, "raw_text": "a&amp b©&ampx; c&amp A&#65 &am"}


@pytest.mark.parametrize("name", ["html_document", "best_text_source"])
def test_pages_with_cut_references_equal_the_sql(spark, tmp_path, name):
    """Titles that are cut in the middle of a reference, as some of the tables' are."""
    html = [f'<html lang="en"><head><title>Cut {cut}</title></head><body><article><p>Cut {cut}</p><p>{LONG.replace("&", "&amp;&amp;")}</p></article></body></html>' for cut in ("&amp;&amp", "&am", "&", "&amp;", "&lt", "&quot")]
    spark.createDataFrame([(i, f"http://a.example/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(tuple(r) for r in pages.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(pages.SQL[name]).fetchall()) and len(got) == len(html)
