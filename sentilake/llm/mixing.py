"""Mixing sources to target weights with hash-threshold histograms.

Each source may take a share of all words. Documents get a hash of id and text; a
histogram of words by source and hash bucket shows in which bucket a source's budget
ends, and only that bucket is cut finer, level by level, until it holds one hash.
Documents are then kept by comparing hashes with their source's threshold; nothing is
sorted. Thresholds are nested: a source that takes more than all its words takes each
document once, and those below its threshold once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SMALL, attach, fresh, key_of, only, parts, stage, words

#: Bits of a document's hash, and how many of them a level of the histogram adds.
BITS, LEVEL = 60, 12


def unit_hash(id_col: Column, text_col: Column, seed: str) -> Column:
    """A 60-bit hash, from the MD5 of seed, id and text; SQL engines can compute it too."""
    given = [F.coalesce(c.cast("string"), F.lit("")) for c in (id_col, text_col)]
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), given[0], F.lit(":"), given[1])), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, *, weights: Sequence[float], share: float, ceiling: float) -> DataFrame:
    """source, source_size and target of each source.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share``
    of all words; a target stops at ``ceiling`` times its source's words, and the excess
    is shared again by weight until none is above. That fixed point is a water level: in
    the order of ceiling to weight, sources are capped up to the first whose share of
    what the capped ones leave is within its ceiling.
    """
    sources = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    by_name = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = before(sources, [by_name], {"rank": F.lit(1).cast("long")}).select("source", "source_size", weight.alias("weight"), (F.lit(float(ceiling)) * F.col("source_size")).alias("cap"))
    ordered = before(ranked, [F.col("cap") / F.col("weight"), by_name], {"caps": F.col("cap"), "weights": F.col("weight")})
    words_, weight_ = ordered.agg(F.sum("source_size"), F.sum("weight")).head()  # one row
    level = (F.lit(float(share) * float(words_ or 0)) - F.col("caps")) / (F.lit(weight_ or 0.0) - F.col("weights"))
    leveled = ordered.withColumn("level", level)
    first = leveled.agg(F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "level"))).alias("first")).head().first
    target = F.col("cap") if first is None else F.least("cap", F.lit(first.level) * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def before(rows: DataFrame, order: list[Column], sums: dict[str, Column], *, each: int = 100_000) -> DataFrame:
    """``rows`` and, of each sum, what the rows that come earlier in an order add up to.

    Ranges of the order are cut into parts of about ``each`` rows; a part adds up its own
    rows, and what lies before it comes from one total for each part.
    """
    staged = stage(rows)
    placed = stage(staged.repartitionByRange(parts(staged.count(), each), *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are parts
    totals = placed.groupBy("part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    ahead = totals.select("part", *[F.coalesce(F.sum(k).over(earlier), 0 * F.col(k)).alias(f"ahead_{k}") for k in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = [(F.col(f"ahead_{k}") + F.coalesce(F.sum(c).over(inside), 0 * F.col(f"ahead_{k}"))).alias(k) for k, c in sums.items()]
    return placed.join(F.broadcast(ahead), "part").select(*rows.columns, *found)


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, copies and threshold: hashes up to it are taken once more than ``copies``."""
    wanted = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    wanted = stage(wanted.select("source", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"), F.lit(0.0).alias("taken"), F.lit(0).cast("long").alias("prefix")))
    open_, level = wanted.where("budget > 0"), 0
    done = wanted.where("budget <= 0").select("source", "copies", F.lit(-1).cast("long").alias("threshold"))
    while True:
        level += LEVEL
        low = BITS - level
        bucket = F.shiftright("hash", low)
        near = sized.join(_small(open_).withColumnRenamed("source", "of"), sized["source"].eqNullSafe(F.col("of"))).where(F.shiftright("hash", low + LEVEL) == F.col("prefix"))
        counts = near.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("least"), F.max("hash").alias("most"))
        counts = counts.join(_small(open_).withColumnRenamed("source", "of"), counts["source"].eqNullSafe(F.col("of"))).drop("of")
        upto = F.col("taken") + F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        counts = counts.withColumn("after", upto).withColumn("before", F.col("after") - F.col("size"))
        # the bucket in which the budget ends; where none is, every hash of this prefix is taken
        cut = counts.groupBy("source").agg(
            F.min_by(F.struct("bucket", "before", "after", "least", "most"), F.when(F.col("after") > F.col("budget"), F.col("bucket"))).alias("at"),
            F.max("most").alias("last"), F.first("copies").alias("copies"), F.first("budget").alias("budget"),
        )
        cut = stage(cut)
        single = (F.col("at.least") == F.col("at.most")) if low else F.lit(True)
        nearer = F.col("at.after") - F.col("budget") < F.col("budget") - F.col("at.before")
        settled = cut.where(F.col("at").isNull() | single).select("source", "copies", F.when(F.col("at").isNull(), F.col("last")).when(nearer, F.col("at.most")).otherwise(F.col("at.least") - 1).alias("threshold"))
        done = done.unionByName(settled)
        open_ = cut.where(F.col("at").isNotNull() & ~single).select("source", "copies", "budget", F.col("at.before").alias("taken"), F.col("at.bucket").alias("prefix"))
        if not low or open_.isEmpty():
            return done
        open_ = stage(open_)


def _small(df: DataFrame) -> DataFrame:
    """A table by source, broadcast if it has few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def by_source(rows: DataFrame, source: Column, plan: DataFrame, of: str) -> DataFrame:
    """``rows`` joined to the plan of their source, whose column is ``of``; beyond SMALL sources the rows of hot ones stay where they are."""
    if plan.count() <= SMALL:
        return rows.join(F.broadcast(plan), source.eqNullSafe(F.col(of)))
    key, n = fresh(rows, "mix_key"), fresh(rows, "mix_n")
    keyed = rows.withColumn(key, key_of(source))
    counted = stage(plan.withColumn(key, key_of(F.col(of))).join(keyed.groupBy(key).agg(F.count("*").alias(n)), key))
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0))).head()[0]
    return attach(keyed, counted, key, total, n).drop(key)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: str = "mix:") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of each document.

    Size is the number of words of a whole text, null 0. A document that is taken twice
    counts twice. Rows with the same id and text are taken alike; reruns agree. The null
    source is a source of its own. A source without words has target 0. An empty table
    gives no rows; other columns aren't read.
    """
    sized = only(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = stage(sized.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), unit_hash(F.col("doc_id"), F.col("text"), seed).alias("hash")))
    targets = stage(source_targets(sized, weights=weights, share=share, ceiling=ceiling))
    limits = _thresholds(sized, targets).withColumnRenamed("source", "of")
    plan = stage(targets.join(limits, targets["source"].eqNullSafe(limits["of"])).drop("of").withColumnRenamed("source", "of"))
    copies = F.col("copies") + F.when(F.col("hash") <= F.col("threshold"), 1).otherwise(0)
    joined = by_source(sized, F.col("source"), plan, "of")
    return joined.select("doc_id", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixture itself: all columns of ``docs``, each document as often as it is taken."""
    seed = how.get("seed", "mix:")
    sized = only(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = stage(sized.select("source", F.size(words(F.col("text"))).cast("long").alias("size"), unit_hash(F.col("doc_id"), F.col("text"), seed).alias("hash")))
    targets = stage(source_targets(sized, weights=how.get("weights", (5, 2, 1)), share=how.get("share", 1.5), ceiling=how.get("ceiling", 2.0)))
    n = [fresh(docs, x) for x in ("mix_of", "mix_copies", "mix_threshold", "mix_copy")]
    plan = stage(_thresholds(sized, targets).select("source", "copies", "threshold").toDF(*n[:3]))
    joined = by_source(docs, F.col(f"`{source_col}`"), plan, n[0])
    times = F.col(n[1]) + F.when(unit_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed) <= F.col(n[2]), 1).otherwise(0)
    return joined.where(times > 0).withColumn(n[3], F.explode(F.sequence(F.lit(1), times))).select(*[f"`{c}`" for c in docs.columns])
