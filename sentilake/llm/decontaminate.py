"""Benchmark decontamination: words of documents inside windows of benchmark items.

Windows of items are normalised words; the hashes of the distinct ones are broadcast,
``MOST`` at a time (more come in blocks, each with a scan of its own). Every window of a
document is hashed and looked up, and what is found is compared with the items' windows
word by word, so that equal hashes of unlike windows do no harm. Only what is found is
shuffled, with one row for each document. Documents with hits can be dropped, or the words
inside windows removed from them.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, meet, only, parts, stage

#: What is between words, A-Z being in lower case; and the same, and a word, before that.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
RAW_GAP, RAW_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hashes that are broadcast together, which take some 64 bytes each.
MOST = 2_000_000


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none. ASCII texts take a shorter way to the same."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.coalesce(F.array_remove(F.split(lowered, f"{GAP}+"), ""), F.array().cast("array<string>"))


def run(i: Column, n: int) -> list[Column]:
    """``n`` words of ``w`` from place ``i``, null beyond its end. (A slice would copy the whole array.)"""
    return [F.get("w", i - 1 + j) for j in range(n)]


def hashes_of(n: int, many: Column) -> Column:
    """The hashes of the ``many`` windows of ``n`` words of ``w``."""
    return F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.xxhash64(*run(i, n)))).otherwise(F.array().cast("array<bigint>"))


def item_windows(bench: DataFrame, size: int) -> DataFrame:
    """window, words, hash and item: each item's windows of ``size`` words, or the one window of a shorter item."""
    cut = bench.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    each = F.least(F.size("w"), F.lit(size))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - each + 1), lambda i: F.struct(F.concat_ws(" ", *run(i, size)).alias("window"), each.alias("words"), F.xxhash64(*run(i, size)).alias("hash")))
    return cut.select("item", F.explode(windows).alias("x")).select("item", "x.*").distinct()


def _looked_up(docs: DataFrame, owned: DataFrame, most: int) -> DataFrame:
    """row, id, n_words, at, words and window of what the hashes of ``owned`` find, and a row with no window for each document."""
    lengths = [r.words for r in owned.select("words").distinct().orderBy("words").collect()]  # no more than the window's size
    many = lambda n: F.greatest(F.size("w") - n + 1, F.lit(0))
    cut = docs.select("row", "id", words(F.col("text").cast("string")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    hashes, where, before = [F.array().cast("array<bigint>")], F.when(F.lit(False), F.struct(F.lit(0).alias("at"), F.lit(0).alias("words"))), F.lit(0)
    for n in lengths:  # one length after another
        hashes.append(hashes_of(n, many(n)))
        where = where.when(F.col("pos") < before + many(n), F.struct((F.col("pos") - before + 1).alias("at"), F.lit(n).alias("words")))
        before = before + many(n)
    scan = cut.withColumn("hashes", F.concat(*hashes)).select("row", "id", "n_words", "w", F.posexplode_outer("hashes").alias("pos", "hash"))
    blocks, found = parts(owned.count(), most), []
    for b in range(blocks):
        mine = owned if blocks == 1 else owned.where(F.pmod(F.xxhash64(F.lit("block"), "hash"), F.lit(blocks)) == b)
        mine = mine.select("hash").distinct().withColumn("known", F.lit(True))
        hit = scan.join(F.broadcast(mine), "hash", "left").where(F.col("known") | (F.lit(b == 0) & (F.coalesce("pos", F.lit(0)) == 0)))
        place = F.when(F.col("known"), where)
        hit = hit.select("row", "id", "n_words", "pos", "w", "known", place["at"].alias("at"), place["words"].alias("words"))
        found.append(hit.select("row", "id", "n_words", F.lit(b == 0) & (F.coalesce("pos", F.lit(0)) == 0), "at", "words", F.when(F.col("known"), F.array_join(F.slice("w", F.col("at"), F.col("words")), " "))).toDF("row", "id", "n_words", "head", "at", "words", "window"))
    return stage(reduce(DataFrame.unionByName, found))


def hits(docs: DataFrame, bench: DataFrame, *, size: int = 10, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (row, id, text) and ``bench`` (item, text): heads with row, id and n_words, found windows with row, at, words and owner; and owner, items.

    Windows with the same items have one ``owner``. ``at`` counts words from 1.
    """
    owned = item_windows(bench, size).groupBy("window", "words", "hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    owned = stage(owned.withColumn("owner", F.sha2(F.to_json("items"), 256)))
    owners = stage(owned.select("owner", "items").dropDuplicates(["owner"]))
    seen = _looked_up(docs, owned, most)
    found = seen.where("window is not null")
    facts = stage(owned.join(found.groupBy("window").agg(F.count("*").alias("n")), "window").select("window", "owner", "n"))
    heads = seen.where("head").select("row", "id", "n_words", F.lit(None).cast("int").alias("at"), F.lit(0).alias("words"), F.lit(None).cast("string").alias("owner"))
    none = F.lit(None)
    real = meet(found, facts, "window").select("row", none.cast(docs.schema["id"].dataType).alias("id"), none.cast("long").alias("n_words"), "at", "words", "owner")
    return heads.unionByName(real), owners


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, size: int = 10, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted texts), items_sha256 and contaminated of each document.

    A word is hit if it is inside an occurrence of ``size`` consecutive words of an item; an
    item of fewer words, but not none, is one window. Null and blank texts have no words.
    Rows with a null or repeated id are judged each; items with one id count once, and a
    null item id is an empty text. No items: nothing is hit. An empty table gives no rows;
    other columns aren't read.
    """
    rows = only(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    marked, owners = hits(rows, only(bench, item=item_col, text=item_text_col), size=size, most=most)
    by_place = Window.partitionBy("row").orderBy("at")
    reached = F.max(F.col("at") + F.col("words")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("at") + F.col("words") - F.greatest(F.col("at"), F.coalesce(reached, F.col("at"))), F.lit(0))
    judged = marked.withColumn("new", new).groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("n_hit"), F.collect_set("owner").alias("owners"))
    judged = stage(judged)
    owed = judged.where(F.size("owners") > 0).select("row", "id", "n_words", "n_hit", F.explode("owners").alias("owner"))
    facts = stage(owners.join(owed.groupBy("owner").agg(F.count("*").alias("n")), "owner"))
    dirty = meet(owed, facts, "owner").groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    clean = judged.where(F.size("owners") == 0).select("row", "id", "n_words", "n_hit", F.array().cast("array<string>").alias("items"))
    return dirty.unionByName(clean).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """A text without the words in ``spans``, (start, end) from 1 and in order, and without what stands between such a word and the next."""
    pieces = F.regexp_extract_all(text, F.lit(f"{RAW_WORD}+{RAW_GAP}*"), F.lit(0))
    ends = F.concat(F.array(F.lit(1)), F.transform(spans, lambda s: s.end))
    starts = F.concat(F.transform(spans, lambda s: s.start), F.array(F.size(pieces) + 1))
    kept = F.flatten(F.zip_with(ends, starts, lambda e, s: F.slice(pieces, e, s - e)))
    return F.concat(F.regexp_extract(text, f"^{RAW_GAP}*", 0), F.array_join(kept, ""))


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, spans: bool = True, size: int = 10, most: int = MOST) -> DataFrame:
    """The columns of ``docs``, without hit words (``spans``) or without documents that have any.

    Rows are staged whole, so that those with hits are found again whatever their ids are.
    Documents without hits stay as they are, null texts and repeated rows included.
    """
    row, got = fresh(docs, "leak_row"), fresh(docs, "leak_spans")
    placed = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = only(placed, row=row, text=text_col).withColumn("id", F.lit(0))
    found = hits(rows, only(bench, item=item_col, text=item_text_col), size=size, most=most)[0].where("owner is not null").withColumn("end", F.col("at") + F.col("words"))
    by_place = Window.partitionBy("row").orderBy("at", "end")
    apart = F.col("at") > F.coalesce(F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = found.withColumn("run", F.sum(apart.cast("int")).over(by_place)).groupBy("row", "run").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    leaks = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(got)).withColumnRenamed("row", row)
    if not spans:
        return placed.join(leaks, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    text = F.when(F.col(got).isNull(), F.col(f"`{text_col}`")).otherwise(without_spans(F.col(f"`{text_col}`"), F.col(got)))
    return placed.join(leaks, row, "left").withColumn(text_col, text).select(*[f"`{c}`" for c in docs.columns])
