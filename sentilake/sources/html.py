"""HTML documents: what a page says of itself, its main text, and its best text.

``parsed`` reads each page once, in Arrow batches, with an open-element stack: meta tags
with their attributes in any order, title, language, JSON-LD scripts, and the texts of the
first element of each content tag. What wins over what is decided by columns.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed_values as V
from ..functions import texts as T
from ..functions import urls as U
from ..functions.plan import once, small_batches

#: Elements that never hold anything, and those whose text isn't the page's.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
SPACE = re.compile(r"\s+")
#: An ampersand, with the reference it begins if that has its semicolon.
REFERENCE = re.compile(r"&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([0-9A-Za-z]+;))?")
#: Characters that no text has.
NO_CHARACTERS = tuple(map(chr, range(0xFDD0, 0xFDF0)))
FIELDS = "metas map<string,string>, title string, lang string, items array<string>, article string, main string, section string, body string, paragraphs string, raw_text string"


def squeezed(strings: list[str]) -> str:
    return SPACE.sub(" ", " ".join(s for x in strings if (s := x.strip()))).strip()


def items(scripts: list[list[str]]) -> Iterator[str]:
    """The objects of JSON-LD scripts, alone or in lists; what can't be read has none."""
    for parts in scripts:
        try:
            whole = json.loads("".join(parts))
        except (ValueError, RecursionError):
            continue
        yield from (json.dumps(x) for x in (whole if isinstance(whole, list) else [whole]) if isinstance(x, dict))


class Reader(HTMLParser):
    """One page: its strings in order, and which of them lie in what element.

    Without ``bare`` a reference counts only with its semicolon: other ampersands pass the
    parser as a character that the page doesn't have.
    """

    def __init__(self, html: str, bare: bool = True):
        super().__init__(convert_charrefs=True)
        self.stands: str | None = None
        if not bare and "&" in html:
            self.stands = next((c for c in NO_CHARACTERS if c not in html), None)
        if self.stands:
            html = REFERENCE.sub(lambda m: m[0] if len(m[0]) > 1 and (m[1] is None or m[1] in html5) else self.stands + m[0][1:], html)
        self.stack: list[tuple[str, int | None]] = []
        self.open: Counter[str] = Counter()
        self.named: dict[str, str] = {}
        self.properties: dict[str, str] = {}
        self.title: list[str] = []
        self.lang: str | None = None
        self.json_ld: list[list[str]] = []
        self.every: list[str] = []
        self.kept: list[str] = []
        self.first: dict[str, list[int]] = {}
        self.blocks: list[list[int]] = []
        self.titles = 0
        self.feed(html)
        self.close()
        while self.stack:
            self._pop()

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if self.stands:
            attributes = [(k, v and v.replace(self.stands, "&")) for k, v in attributes]
        given = dict(reversed(attributes))
        if tag == "meta":
            for key, found in (("property", self.properties), ("name", self.named)):
                if given.get(key) is not None:
                    found.setdefault(given[key], given.get("content") or "")
        elif tag == "html" and self.lang is None:
            self.lang = given.get("lang") or ""
        elif tag == "script" and given.get("type") == "application/ld+json":
            self.json_ld.append([])
        if tag in VOID:
            return
        span = None
        if not any(self.open[x] for x in V.DROPPED_TAGS) and tag not in V.DROPPED_TAGS:
            if tag in V.BLOCK_TAGS:
                span = [len(self.kept), -1]
                self.blocks.append(span)
            elif tag in V.CONTENT_TAGS and tag not in self.first:
                span = self.first[tag] = [len(self.kept), -1]
        self.titles += tag == "title"
        self.stack.append((tag, span if tag != "script" or given.get("type") != "application/ld+json" else self.json_ld[-1]))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        while self.open[tag]:
            if self._pop() == tag:
                return

    def _pop(self) -> str:
        tag, span = self.stack.pop()
        self.open[tag] -= 1
        if span is not None and tag != "script":
            span[1] = len(self.kept)
        return tag

    def handle_data(self, data: str) -> None:
        if self.stands:
            data = data.replace(self.stands, "&")
        tag, span = self.stack[-1] if self.stack else ("", None)
        if tag == "script" and span is not None:
            span.append(data)
        if self.open["title"] and self.titles == 1:
            self.title.append(data.strip())
        if not any(self.open[x] for x in HIDDEN):
            self.every.append(data)
        if not any(self.open[x] for x in V.DROPPED_TAGS):
            self.kept.append(data)

    def paragraphs(self) -> str:
        found: list[str] = []
        for a, z in self.blocks:
            text = squeezed(self.kept[a:z])
            if len(text) > V.MIN_PARAGRAPH:
                found.append(text)
                if len(found) == V.MAX_PARAGRAPHS:
                    break
        return "\n\n".join(found)

    def row(self) -> dict:
        texts = {t: squeezed(self.kept[slice(*self.first[t])]) if t in self.first else None for t in V.CONTENT_TAGS}
        some = any(len(x or "") > V.MIN_MAIN_TEXT for x in texts.values())
        return texts | {
            "metas": list((self.named | self.properties).items()), "title": "".join(self.title), "lang": self.lang, "items": list(items(self.json_ld)),
            "paragraphs": None if some else self.paragraphs(), "raw_text": squeezed(self.every),
        }


def parsed(pages: DataFrame, html: str = "html", *, rows: int = 64, bare: bool = True) -> DataFrame:
    """``pages`` without the html column, and FIELDS; paragraphs only where no content tag has a text of some length. Null pages are empty.

    ``bare``: references without a semicolon are read too, as browsers do (``&amp x``).
    """
    small_batches(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name != html]
    fields = StructType.fromDDL(FIELDS)
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                found = [Reader(x or "", bare).row() for x in part.column(html).to_pylist()]
                own = [pa.array([r[f.name] for r in found], f.type) for f in kind]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *own], names=[*[f.name for f in kept], *kind.names])

    return pages.mapInArrow(read, StructType([*kept, *fields.fields]))


def given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_of(items: Column, value) -> Column:
    """The first value of an item that isn't null or empty."""
    return F.get(F.filter(F.transform(items, lambda i: given(value(i))), lambda x: x.isNotNull()), F.lit(0))


def documents(pages: DataFrame, *, bare: bool = True) -> DataFrame:
    """``pages`` (with url and html) as documents.

    Meta tags come before the tag, and that before JSON-LD; of two metas with one name the
    one with ``property`` counts. The main text is that of the first article, main, section
    or body with over 200 characters, else up to 80 paragraphs of over 30, else JSON-LD's
    articleBody. Scripts, navigation, headers and footers are no part of it. JSON-LD that
    can't be read is left out. A page without html has empty texts.
    """
    had = [c for c in pages.columns if c != "html"]
    rows = parsed(pages, bare=bare)
    meta = lambda *names: F.coalesce(*[given(T.squeeze(F.try_element_at("metas", F.lit(n)))) for n in names])
    get = lambda *paths: lambda i: F.coalesce(*[given(F.get_json_object(i, p)) for p in paths])
    main = F.coalesce(*[F.when(F.length(c) > V.MIN_MAIN_TEXT, F.col(c)) for c in V.CONTENT_TAGS], given(F.col("paragraphs")))
    geo = F.map_filter(F.create_map(*[x for k, n in V.GEO_METAS for x in (F.lit(k), meta(n))]), lambda k, v: v.isNotNull())
    rows = rows.select(
        *had, F.coalesce(meta("og:title", "twitter:title"), given(T.squeeze(F.col("title"))), T.squeeze(first_of(F.col("items"), get("$.headline", "$.name"))), F.lit("")).alias("title"),
        F.coalesce(meta("description", "og:description", "twitter:description"), T.squeeze(first_of(F.col("items"), get("$.description"))), F.lit("")).alias("description"),
        F.coalesce(meta("author", "article:author"), first_of(F.col("items"), get("$.author.name", "$.author[0].name"))).alias("author"),
        F.coalesce(meta("article:published_time", "pubdate", "date"), first_of(F.col("items"), get("$.datePublished"))).alias("published_at"),
        F.coalesce(given(F.trim("lang")), meta("og:locale")).alias("language"), meta("og:site_name", "application-name").alias("site_name"), geo.alias("geo"),
        F.coalesce(main, T.squeeze(first_of(F.col("items"), get("$.articleBody"))), F.lit("")).alias("main_text"), "raw_text", F.size("items").cast("long").alias("json_ld_count"),
    )
    content = F.coalesce(given(F.col("main_text")), "raw_text")
    rows = once(rows.withColumn("content_text", content).withColumn("excerpt", F.substring(content, 1, 400)))
    return rows.withColumn("domain", U.authority(F.col("url"))) if "url" in had else rows


def best_text(pages: DataFrame, *, bare: bool = True) -> DataFrame:
    """page_id, origin, text and quality: of the texts of the first article, main, section and body the one of the highest quality; of equal ones the first. Pages without any have none."""
    rows = parsed(pages.select("page_id", "html"), bare=bare).select("page_id", *V.CONTENT_TAGS)
    choices = []
    for place, tag in enumerate(V.CONTENT_TAGS):
        found, low = f"__{tag}_tokens", f"__{tag}_low"
        rows = rows.withColumn(found, T.tokens(F.coalesce(F.col(tag), F.lit("")))).withColumn(low, F.transform(found, F.lower))
        f = T.features(F.col(tag), F.col(found), F.col(low))
        quality = T.quality(*[f[c] for c in ("char_count", "token_count", "alpha_ratio", "unique_token_ratio", "url_ratio", "symbol_ratio")])
        choices.append(F.when(F.coalesce(F.trim(tag), F.lit("")) != "", F.struct(F.round(quality, 9).alias("quality"), F.lit(-place).alias("place"), F.lit(tag).alias("origin"), F.col(tag).alias("text"))))
    best = once(rows.select("page_id", F.array_max(F.array_compact(F.array(*choices))).alias("best")))
    return best.select("page_id", "best.origin", "best.text", F.round("best.quality", 6).alias("quality"))
