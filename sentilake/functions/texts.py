"""Columns over texts: counts, features, normalisation, ids, dates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import fixed_values as V

TOKEN = "[\\p{L}\\p{N}_]+"
URL = "(?i)https?://[^ \\t\\n\\r]+|www\\.[^ \\t\\n\\r]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~"


def count_terms(text: Column, terms: Iterable[str]) -> Column:
    """How many of the terms the text contains."""
    return reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in terms], F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\x0B\\f]+", " "))


def features(text: Column, found: Column, low: Column) -> dict[str, Column]:
    """Counts and ratios of a text, its tokens, and these in lower case."""
    body = F.coalesce(text, F.lit(""))
    n = F.length(body)
    part = lambda c: F.when(n > 0, c / n)
    # runs of what doesn't count are taken out at once, and what counts is left
    left = lambda p: F.length(F.regexp_replace(body, p, ""))
    urls = F.when(F.lower(body).contains("http") | F.lower(body).contains("www."), n - left(URL)).otherwise(F.lit(0))
    blank = F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), " \t\n\r\x0b\f", body))
    return {
        "char_count": n.cast("long"),
        "token_count": F.size(found).cast("long"),
        "alpha_ratio": F.coalesce(part(left("[^\\p{L}]+")), F.lit(0.0)),
        "url_ratio": F.coalesce(part(urls), F.lit(1.0)),
        "symbol_ratio": F.coalesce(part(blank - left("[^\\p{L}\\p{N}]+")), F.lit(1.0)),
        "unique_token_ratio": F.size(F.array_distinct(low)) / F.greatest(F.size(found), F.lit(1)),
    }


def quality(chars: Column, tokens_: Column, alpha: Column, unique: Column, url: Column, symbol: Column) -> Column:
    score = F.least(F.lit(1.0), tokens_ / 140.0) * 0.25 + alpha * 0.4 + unique * 0.2 + F.greatest(F.lit(0.0), 1.0 - url) * 0.1 + F.greatest(F.lit(0.0), 1.0 - symbol) * 0.05
    return F.when(chars == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def expand_contractions(text: Column) -> Column:
    return reduce(lambda t, c: F.regexp_replace(t, "(?i)" + c[0], c[1]), V.CONTRACTIONS, text)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value, which is worked out once however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def needed_words(pattern: str) -> list[str]:
    """Words that a text must hold, in any case, to match a pattern of words, spaces and letters that may be missing; none for other patterns."""
    words = [w for w in re.split(r"\\s\+|\([a-z]+\)\?", pattern) if w]
    return words if all(re.fullmatch("[a-z]+", w) for w in words) else []


def normalize(text: Column, noise: Iterable[str] = V.NOISE_PATTERNS) -> Column:
    """A text for scoring: contractions, mentions, hashtags, urls, noise, punctuation, spaces, case.

    Most texts hold nothing that most patterns look for, which a plain search tells sooner.
    """
    noise = tuple(noise)
    # of what is put in for a url, ``low`` doesn't tell
    held = lambda low, p: reduce(lambda a, b: a & b, [low.contains(w) for w in needed_words(p) if w not in "url"], F.lit(True))
    if_held = lambda mark, f: lambda x: F.when(x.contains(mark), f(x)).otherwise(x)

    def without_noise(x: Column, low: Column) -> Column:
        t = F.when(low.contains("http") | low.contains("www."), F.regexp_replace(x, URL, " <url> ")).otherwise(x)
        # no word of a pattern reaches across what was put in, as spaces are around it
        less = bound(t, lambda y: reduce(lambda z, p: F.regexp_replace(z, "(?i)" + p, " "), noise, y))
        return F.when(reduce(lambda a, b: a | b, [held(low, p) for p in noise], F.lit(False)), less).otherwise(t)

    t = F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" "))
    t = bound(t, if_held("'", expand_contractions))
    t = bound(t, if_held("@", lambda x: F.regexp_replace(x, "(^|[^\\p{L}\\p{N}_])@[A-Za-z0-9_]{2,64}", "$1 @user ")))
    t = bound(t, if_held("#", lambda x: F.regexp_replace(x, "#([A-Za-z0-9_]+)", " $1 ")))
    t = bound(t, lambda x: bound(F.lower(x), lambda low: without_noise(x, low)))
    return F.lower(F.trim(F.regexp_replace(t, f"[{re.escape(PUNCTUATION)} \\t\\n\\r\\x0B\\f]+", " ")))


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein's distance of two texts, -1 if it is above ``most``.

    A column of the table is a number whose bits tell where the distance goes up or down
    from one row to the next; of it only the ``most`` rows to each side of the diagonal are
    kept (Hyyrö's bit vectors in a band).
    """
    x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (a, b))
    if abs(len(x) - len(y)) > most:
        return -1
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    for _ in range(2):  # what both begin with goes, then what both end with
        k = len(y)
        other = np.flatnonzero(x[:k] != y)
        k = int(other[0]) if len(other) else k
        x, y = x[k:][::-1], y[k:][::-1]
    n = len(x)
    if not len(y):
        return n
    k = min(most, n)
    last = 2 * k + 1
    every = (2 << last) - 1
    places = {c: int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") << (k + 1) for c in np.unique(x).tolist()}
    up, down, found = every ^ ((2 << k) - 1), 0, k
    for i, c in enumerate(y.tolist()):
        same = places.get(c, 0) >> i & every
        flat = (((same & up) + up ^ up) | same | down) & every
        more, less = down | (flat | up) ^ every, flat & up
        # along the diagonal to the last row, then along that
        at = last - 1 - (i - n + k)
        found += (more >> at & 1) - (less >> at & 1) if i >= n - k else 1 - (flat >> last)
        flat >>= 1
        up, down = less | (flat | more) ^ every, flat & more
    return found if found <= most else -1


@F.pandas_udf(IntegerType())
def distance_within(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([distance(*row) for row in zip(a, b, most)], dtype="int32")


def content_hash(text: Column) -> Column:
    body = squeeze(F.coalesce(text, F.lit("")))
    return F.when(body != "", F.sha2(F.trim(text), 256))


def slug(text: Column, longest: int = 80) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^\\p{L}\\p{N}_ \\t\\n-]", ""), "[ \\t\\n_]+", "-")
    cut = F.regexp_replace(F.substring(bare, 1, longest), "^-+|-+$", "")
    return F.when(cut == "", F.lit("untitled-topic")).otherwise(cut)


def _parsed(v: Column) -> Column:
    """A date of a trimmed text, which is mentioned often."""
    seconds = F.when(v.rlike("^[0-9]+([.][0-9]+)?$"), F.when(F.try_to_number(v, F.lit("999999999999")).cast("double") > 0, F.timestamp_seconds(v.cast("double"))))
    iso = F.when(v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.try_to_timestamp(v))
    spelt = [F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(fmt))) for shape, fmt in (("^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"), ("^[A-Za-z]{4,} [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy"), ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"), ("^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "d MMM yyyy"), ("^[0-9]{1,2} [A-Za-z]{4,} [0-9]{4}$", "d MMMM yyyy"))]
    return F.coalesce(seconds, iso, *spelt)


def first_date(values: Column) -> Column:
    """The first date in an array of texts, each of which is worked out once: a plain expression would be written out again for each mention."""
    trimmed = F.transform(F.array_compact(values), lambda v: F.trim(v))
    return F.get(F.filter(F.transform(trimmed, _parsed), lambda x: x.isNotNull()), F.lit(0))


def parse_date(value: Column) -> Column:
    """A positive epoch, an ISO date or one of six spelt forms, in UTC; else null."""
    return first_date(F.array(value))


def payload_date(json: Column) -> Column:
    """The first date under the named keys of a JSON payload, which is read only for keys that it may hold: by name or escaped."""
    held = lambda k: json.contains(k) | json.contains("\\")
    return first_date(F.array(*[F.when(held(k), F.get_json_object(json, f"$.{k}")) for k in V.DATE_KEYS]))


def strip_html(html: Column) -> Column:
    """The text of a page, without scripts, styles, comments and tags."""
    t = F.regexp_replace(html, "(?is)<(script|style|noscript|template|svg|iframe)[^>]*>.*?</(script|style|noscript|template|svg|iframe)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(letter))
    return squeeze(t)
