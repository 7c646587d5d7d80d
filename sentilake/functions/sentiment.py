"""Columns over sentiment: scorers, labels, adjustments."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as V
from .texts import count_terms


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def lexicon_scored(rows: DataFrame, text: str, out: str = "score") -> DataFrame:
    """``rows`` with a score from 0 to 1 by how many words of either list the text contains.

    Lower case and counts are columns of their own on the way, so each is worked out once.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns]
    low = rows.select(*kept, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__low"))
    counts = low.select(*kept, count_terms(F.col("__low"), V.POSITIVE_WORDS).alias("__pos"), count_terms(F.col("__low"), V.NEGATIVE_WORDS).alias("__neg"))
    return counts.select(*kept, lexicon_score(F.col("__pos"), F.col("__neg")).alias(out))


def lexicon_score(pos: Column, neg: Column) -> Column:
    return clamp(F.when(pos > neg, 0.7 + pos * 0.05).when(neg > pos, 0.3 - neg * 0.05).otherwise(F.lit(0.5)))


def recovery_score(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    pos, neg = count_terms(low, V.RECOVERY_POSITIVE), count_terms(low, V.RECOVERY_NEGATIVE)
    return F.when(F.length(low) <= 10, F.lit(0.5)).when(pos > neg, F.lit(0.75)).when(neg > pos, F.lit(0.25)).otherwise(F.lit(0.5))


def keyword_adjusted(score: Column, text: Column, positive: Iterable[str], negative: Iterable[str], weight: float = V.CONTEXT_WEIGHT) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    delta = clamp((count_terms(low, positive) - count_terms(low, negative)) * 0.02, -0.2, 0.2)
    return F.when(delta == 0, score).otherwise(clamp(score + delta * weight))


def compound(score: Column) -> Column:
    return 2 * score - 1


def label3(score: Column) -> Column:
    return F.when(score >= V.POSITIVE_FROM, F.lit("positive")).when(score <= V.NEGATIVE_TO, F.lit("negative")).otherwise(F.lit("neutral"))


def label5(c: Column) -> Column:
    return F.when(c > 0.3, F.lit("Positive")).when(c > 0.1, F.lit("Slightly Positive")).when(c > -0.1, F.lit("Neutral")).when(c > -0.3, F.lit("Slightly Negative")).otherwise(F.lit("Negative"))


def tone(c: Column) -> Column:
    return F.when(c > 0.1, F.lit("positive")).when(c < -0.1, F.lit("negative")).otherwise(F.lit("neutral"))


def direction(delta: Column) -> Column:
    return F.when(delta > 0.05, F.lit("improved")).when(delta < -0.05, F.lit("declined")).otherwise(F.lit("stable"))


def model_score(label: Column, raw: Column) -> Column:
    """A classifier's label as a score from 0 to 1."""
    low = F.lower(label)
    stars = F.regexp_extract(low, "([1-5]) *star", 1)
    return F.when(stars != "", (F.try_to_number(stars, F.lit("9")).cast("double") - 1) / 4).when(low.contains("positive"), F.lit(1.0)).when(low.contains("negative"), F.lit(0.0)).when(low.contains("neutral"), F.lit(0.5)).otherwise(clamp(raw))


def shown_delta(delta: Column) -> Column:
    """A change as it is shown: two digits and a sign beyond 0.01, else that there is none."""
    return F.when(delta > 0.01, F.concat(F.lit("+"), F.format_string("%.2f", delta))).when(delta < -0.01, F.format_string("%.2f", delta)).otherwise(F.lit("No change"))


def best_result(results: Column) -> Column:
    """Of a classifier's results (label, score) the first with the highest score; of none a neutral half."""
    placed = F.transform(results, lambda r, i: F.struct(F.coalesce(r.score, F.lit(0.0)).alias("score"), (-i).alias("place"), r.label.alias("label")))
    best = F.array_max(placed)
    return F.named_struct(F.lit("label"), F.when(best.isNull(), F.lit("neutral")).otherwise(best["label"]), F.lit("score"), F.coalesce(best["score"], F.lit(0.5)))


def text_to_score(sentiment_text: Column, cleaned_text: Column, text: Column, longest: int = V.SCORED_CHARS) -> Column:
    """The first of three texts that isn't empty, without outer white space, up to ``longest`` characters."""
    first = F.coalesce(F.nullif(sentiment_text, F.lit("")), F.nullif(cleaned_text, F.lit("")), text, F.lit(""))
    return F.substring(F.btrim(first, F.lit(" \t\n\r\x0b\x0c")), 1, longest)
