"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets word, symbol, line and repetition counts from its whole text. For
each language and source, each metric's values over the documents that pass the base
rules are summed up in a histogram sketch: buckets of integers with 16 steps for each
power of two, so a quantile is off by a sixteenth of its value at most, and adding the
buckets of two sketches gives the sketch of both. A group's sketch is drawn towards its
language's, and that towards the whole table's, as if ``weight`` of its documents were
spread like theirs; so small groups need no rule of their own.

A metric's fence is the quantile that leaves ``tail`` of a group beyond it. Where that
quantile is no more than the median (most documents have none of what is counted), its
spread tells nothing, and the fence lies below the median of what is beyond, so that the
milder half of it stays. No fence is a constant:
all come from the sketches, and at most ``tail`` of a group (with its priors) is beyond
any of them. Fences are joined to the documents by group, and documents beyond go.

Only DataFrame functions are used. Counts are whole numbers, so sketches are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, fresh, key_of, meet, only, stage, words

#: Steps of a sketch for each power of two, as bits.
STEP_BITS = 4
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Metric:
    """A number of a document, as whole thousandths. A larger value is worse."""

    name: str
    part: str
    whole: str

    @property
    def value(self) -> Column:
        return F.floor(1000 * F.col(self.part) / F.greatest(F.col(self.whole), F.lit(1))).cast("long")


METRICS = (Metric("symbols", "n_symbols", "word_chars"), Metric("dup_lines", "n_dup_lines", "n_lines"), Metric("repeats", "n_repeat_words", "n_words"), Metric("word_length", "word_chars", "n_words"))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def features(text_col: str, names: dict[str, str]) -> list[tuple[str, Column]]:
    """Columns of a whole text's counts, in steps that may refer to earlier ones; ``names`` are what they are called."""
    text, at = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), lambda k: F.col(names[k])
    # one number for each window of three words
    three = F.slice(F.transform(at("words"), lambda w, i: F.xxhash64(w, F.get(at("words"), i + 1), F.get(at("words"), i + 2))), F.lit(1), F.greatest(at("n_words") - 2, F.lit(0)).cast("int"))
    steps = {
        "words": words(F.col(f"`{text_col}`")),
        "n_words": F.size(at("words")).cast("long"),
        "windows": three,
        "lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(at("lines")).cast("long"),
        "n_dup_lines": (F.size(at("lines")) - F.size(F.array_distinct(at("lines")))).cast("long"),
        "places": F.when(F.size(F.array_distinct(at("windows"))) < F.size(at("windows")), F.sort_array(F.transform(at("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        "n_repeat_words": F.when(at("places").isNull(), F.lit(0)).otherwise(covered(at("places"))).cast("long"),
    }
    return [(names[k], c) for k, c in steps.items()]


def covered(places: Column) -> Column:
    """Words in windows whose hash another window shares. ``places`` are (h, i) in order, two at least."""
    shared = F.filter(places, lambda p, k: (F.get(places, k - 1)["h"] == p.h) | (F.get(places, k + 1)["h"] == p.h))
    at = F.sort_array(F.transform(shared, lambda p: p.i))
    # windows of three words: the next repeated window adds the words by which it is further on
    step = F.aggregate(at, F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last")), lambda s, i: F.struct((s.total + F.least(i - s.last, F.lit(3))).alias("total"), i.alias("last")))
    return step["total"]


def counted(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the base columns, and what these are called, since ``docs`` may have such names."""
    steps = ("words", "n_words", "windows", "lines", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "places", "n_repeat_words")
    names = {k: fresh(docs, k) for k in steps}
    kept = [f"`{c}`" for c in docs.columns]
    for name, column in features(text_col, names):
        docs = docs.withColumn(name, column)
    return docs.select(*kept, *[names[k] for k in BASE]), {k: names[k] for k in BASE}


def failed(least_words: int, most_repeats: int) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def bucket(value: Column) -> Column:
    """The sketch's bucket of a whole number from 0: 16 for each power of two, and one for each number below 32."""
    bits = F.length(F.bin(value))
    shift = F.greatest(bits - (STEP_BITS + 1), F.lit(0))
    return (shift * (1 << STEP_BITS) + F.call_function("shiftright", value, shift.cast("int"))).cast("int")


def value_of(at: Column) -> Column:
    """The least value of a bucket."""
    shift = F.greatest(F.floor(at / (1 << STEP_BITS)).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (at - shift * (1 << STEP_BITS)).cast("long"), shift)


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, metric, bucket and n: one sketch for each language, source and metric of the rows that passed."""
    each = F.array(*[F.struct(F.lit(m.name).alias("metric"), bucket(m.value).alias("bucket")) for m in METRICS])
    return counts.where(~F.col("base_failed")).select("lang", "source", F.explode(each).alias("m")).groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def drawn(names: DataFrame, own: DataFrame, prior: DataFrame, on: str, weight: int) -> DataFrame:
    """key, metric, bucket and share: of each name's rows up to each bucket of its prior, its own drawn towards that.

    ``names`` has key and ``on``; ``own`` has key, metric, bucket and n; ``prior`` has ``on``,
    metric, bucket and prior. A prior has all the buckets that its names have.
    """
    grid = names.withColumn("metric", F.explode(F.array(*[F.lit(m.name) for m in METRICS]))).join(prior, [on, "metric"]).drop(on)
    full = grid.join(own, ["key", "metric", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    group = Window.partitionBy("key", "metric")
    return full.select("key", "metric", "bucket", ((F.sum("n").over(group.orderBy("bucket")) + weight * F.col("prior")) / (F.sum("n").over(group) + weight)).alias("share"))


def fences(sketch: DataFrame, groups: DataFrame, *, tail: float, weight: int) -> DataFrame:
    """key, n and a fence for each metric: the adaptive thresholds of each row of ``groups`` (lang, source, n)."""
    one, lang, pair = F.lit("all"), key_of(F.col("lang")), key_of(F.col("lang"), F.col("source"))
    langs = sketch.groupBy(lang.alias("key"), "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = langs.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    by_metric = Window.partitionBy("metric")
    # a metric has a thousand buckets at most
    top = whole.select(one.alias("whole"), "metric", "bucket", (F.sum("n").over(by_metric.orderBy("bucket")) / F.sum("n").over(by_metric)).alias("prior"))
    wide = drawn(groups.select(lang.alias("key"), one.alias("whole")).distinct(), langs, F.broadcast(top), "whole", weight)
    wide = stage(wide.withColumnRenamed("key", "lang_key").withColumnRenamed("share", "prior"))
    own = sketch.select(pair.alias("key"), "metric", "bucket", "n")
    shares = drawn(groups.select(pair.alias("key"), lang.alias("lang_key")), own, wide, "lang_key", weight)
    group = Window.partitionBy("key", "metric")
    reach = lambda share: F.min(F.when(F.col("share") >= share, F.struct("bucket", "share"))).over(group)
    high = shares.select("*", reach(0.5).alias("middle"), reach(1.0 - tail).alias("high"))
    # where the quantile is no more than the median: the median of what lies beyond
    half = high.groupBy("key", "metric").agg(F.first("middle").alias("middle"), F.first("high").alias("high"), F.min(F.when(F.col("share") >= (1.0 + F.col("high.share")) / 2, F.col("bucket"))).alias("half"))
    above = value_of(F.col("high.bucket") + 1) - 1
    fence = F.when((F.col("high.bucket") > F.col("middle.bucket")) | F.col("half").isNull(), above).otherwise(F.greatest(above, value_of(F.col("half")) - 1))
    made = half.select("key", "metric", fence.alias("fence")).groupBy("key").agg(*[F.max(F.when(F.col("metric") == m.name, F.col("fence"))).alias(f"max_{m.name}") for m in METRICS])
    return groups.select(pair.alias("key"), "n").join(made, "key")


def verdicts(rows: DataFrame, *, tail: float, weight: int) -> DataFrame:
    """``rows``, a staged table with lang, source, base_failed and the base columns, with key, the fences and kept."""
    groups = stage(rows.groupBy("lang", "source").agg(F.count("*").alias("n")))
    sketch = stage(sketches(rows))
    limits = stage(fences(sketch, groups, tail=tail, weight=weight)) if not sketch.isEmpty() else None
    if limits is None:  # nothing passed the base rules
        return rows.withColumn("kept", F.lit(False)).withColumns({f"max_{m.name}": F.lit(None).cast("long") for m in METRICS})
    judged = meet(rows.withColumn("key", key_of(F.col("lang"), F.col("source"))), limits, "key")
    within = F.lit(True)
    for m in METRICS:
        within = within & (m.value <= F.col(f"max_{m.name}"))
    return judged.withColumn("kept", ~F.col("base_failed") & within).drop("key")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, least_words: int = 50, most_repeats: int = 50, tail: float = 0.02, weight: int = 5) -> DataFrame:
    """The base columns, base_failed and kept of each document, and the fences of its group.

    Null and blank texts have no words, so they fail. Null languages and sources are
    groups of their own. Repeated rows are judged each and count each. An empty table
    gives no rows; other columns aren't read.
    """
    counts, _ = counted(only(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col), "text")
    return verdicts(stage(counts.drop("text").withColumn("base_failed", failed(least_words, most_repeats))), tail=tail, weight=weight)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, least_words: int = 50, most_repeats: int = 50, tail: float = 0.02, weight: int = 5) -> DataFrame:
    """Documents that are kept, with all their columns. Verdicts are as in ``judge``.

    Whole rows are staged with their counts, which are made once; rows need no id, and no text is shuffled unless there are very many groups.
    """
    columns = [docs[f"`{c}`"] for c in docs.columns]
    rows, _ = counted(docs.select(F.struct(*columns).alias("row"), *[docs[f"`{c}`"].alias(k) for k, c in (("text", text_col), ("lang", lang_col), ("source", source_col))]), "text")
    # no filter before the table is staged: the optimizer would write the counts out again in it
    counts = stage(rows.drop("text").withColumn("base_failed", failed(least_words, most_repeats)))
    return verdicts(counts, tail=tail, weight=weight).where("kept").select("row.*")
