"""Small helpers over nested JSON and characters that columns can't walk, as Arrow-batched functions."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import fixed_values as V
from . import texts as T


def _loaded(text: str | None):
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def _dated(whole) -> Iterator[str]:
    """Values under keys that speak of a time, from a stack of what is nested: the last found is looked at first."""
    stack = [whole]
    while stack:
        here = stack.pop()
        for key, value in here.items() if isinstance(here, dict) else enumerate(here) if isinstance(here, list) else ():
            if isinstance(here, dict) and isinstance(value, (str, int, float)) and not isinstance(value, bool) and any(t in key.lower() for t in V.DATE_TOKENS):
                yield str(value)
            if isinstance(value, (dict, list)):
                stack.append(value)


@F.pandas_udf(ArrayType(StringType()))
def dated_values(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: list(_dated(_loaded(x))), na_action=None)


def published_at(own: Column, payload: Column) -> Column:
    """A date of its own, else one under the named keys of a payload, else the first under any key that speaks of a time."""
    return F.coalesce(T.parse_date(own), T.payload_date(payload), T.first_date(dated_values(payload)))


def _values(value) -> Iterator[str]:
    """The scalars of nested maps in order; a list's items as they are."""
    if isinstance(value, dict):
        for v in value.values():
            yield from _values(v)
    else:
        for v in value if isinstance(value, list) else [value]:
            if text := str(v).strip():
                yield text


@F.pandas_udf(ArrayType(StringType()))
def nested_values(payload: pd.Series) -> pd.Series:
    """The texts in a JSON value; what can't be read has none."""
    return payload.map(lambda x: [] if _loaded(x) is None else list(_values(_loaded(x))), na_action=None)


def _candidates(text: str | None) -> list[str]:
    """Where an answer in prose may hold JSON: all of it, fenced blocks, from the first brace to the last, balanced spans; each once."""
    raw = (text or "").strip()
    found = [raw, *(b.strip() for b in re.findall(r"```(?:json)?\s*([\s\S]*?)\s*```", raw))]
    first, last = raw.find("{"), raw.rfind("}")
    if first < last:
        found.append(raw[first : last + 1])
    depth = begin = 0
    for m in re.finditer("[{}]", raw):
        if m[0] == "{":
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                found.append(raw[begin : m.end()])
    return list(dict.fromkeys(x for x in found if x))


@F.pandas_udf(ArrayType(StringType()))
def json_candidates(text: pd.Series) -> pd.Series:
    return text.map(_candidates, na_action=None)


def _readable(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


@F.pandas_udf(StringType())
def first_json(text: pd.Series) -> pd.Series:
    """The first candidate that is JSON as a whole."""
    return text.map(lambda x: next(filter(_readable, _candidates(x)), None), na_action=None)


MANGLED = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]+")
#: Blocks of pictures: symbols, dingbats, emoticons, pictographs, transport, and what is supplementary to them.
PICTURES = re.compile("[☀-➿⭐⭕\U0001f300-\U0001f64f\U0001f680-\U0001f6ff\U0001f900-\U0001f9ff\U0001fa70-\U0001faff][︎️\U0001f3fb-\U0001f3ff]*")


def _repaired(m: re.Match) -> str:
    """Letters that were UTF-8 and were read as Windows-1252; as they are if they weren't."""
    try:
        return bytes(ord(c) if ord(c) < 256 else c.encode("cp1252")[0] for c in m[0]).decode()
    except UnicodeError:
        return m[0]


def _named(m: re.Match) -> str:
    return f" {V.PICTURE_NAMES.get(m[0][0]) or unicodedata.name(m[0][0], '').lower()} "


def _prepared(text: str | None) -> str:
    t = MANGLED.sub(_repaired, html.unescape(text or ""))
    return " ".join(PICTURES.sub(_named, t).replace("_", " ").split())


@F.arrow_udf(StringType())
def prepared(text: pa.Array) -> pa.Array:
    """A text before it is normalised: entities read, mangled letters repaired, pictures as their names, underscores and white space as single spaces. Null is empty.

    Only one text at a time is a Python string.
    """
    return pa.array((_prepared(x.as_py()) for x in text), pa.string())


def without_markdown(text: Column) -> Column:
    """Without code spans and marks; links leave their labels."""
    t = F.regexp_replace(text, "`{1,3}[^`]*`{1,3}", " ")
    return T.squeeze(F.regexp_replace(F.regexp_replace(t, "\\[(.*?)\\]\\((.*?)\\)", " $1 "), "[*_~#>-]", " "))
