"""Columns for planning a search: phrases to search for, priorities, addresses of result pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V

EDGES = "^[ \\t\\n\\r\\-•*\"'`]+|[ \\t\\n\\r\\-•*\"'`]+$"


def query_phrases(text: Column, topic: Column, shortest: int = 8) -> Column:
    """The distinct phrases of a list in prose, in order.

    Commas, semicolons and line ends part them; bullets, quotes and numbers before them go. A
    blank text gives the topic, and one without a phrase of ``shortest`` characters the defaults.
    """
    bare = F.transform(F.split(text, "[,;\\n]+"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, EDGES, ""), "^[0-9]+[.)]\\s*", "")))
    kept = F.array_distinct(F.filter(bare, lambda p: (F.length(p) >= shortest) & ~F.lower(p).isin(*V.NO_PHRASES)))
    defaults = F.array(*[F.concat(topic, F.lit(end)) for end in V.DEFAULT_ENDS])
    blank = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")) == ""
    return F.when(blank, F.array(topic)).when(F.size(kept) > 0, kept).otherwise(defaults)


def priority(given: Column, index: Column) -> Column:
    """high, medium or low: by number, else by name, else by the place in the list from 0."""
    name, number = F.lower(F.trim(given)), F.try_to_number(F.trim(given), F.lit("S999999999.999")).cast("double")
    level = lambda c, high, medium: F.when(c <= high, F.lit("high")).when(c <= medium, F.lit("medium")).otherwise(F.lit("low"))
    by_number = F.when(number.isNotNull(), level(F.floor(number), 2, 4))
    return F.coalesce(by_number, F.when(name.isin("high", "medium", "low"), name), level(index, 1, 3))


def quote_plus(text: Column) -> Column:
    """A text as a form field of a query string."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_urls(query: Column, hint: Column) -> Column:
    """Addresses of result pages for a query, by what the hint of a platform contains first."""
    pages = lambda templates: F.array(*[F.concat(F.lit(t), quote_plus(query)) for t in templates])
    found = F.when(F.lit(False), F.array().cast("array<string>"))
    for platform, templates in V.SEARCH_PAGES.items():
        found = found.when(F.lower(hint).contains(platform), pages(templates))
    return found.otherwise(pages(V.ANY_SEARCH_PAGES))
