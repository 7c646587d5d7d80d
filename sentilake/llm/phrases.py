"""Phrase collocation mining by level-wise passes over the texts (Apriori).

Pass 1 counts words by language. Pass k counts phrases of k words, and only those whose
first and last k - 1 words are both frequent; what is frequent travels as a table of bits,
a bit for the hash of each frequent phrase of the pass before. The table has 16 bits for
each phrase or more, up to ``TABLE_BITS`` in all (64 MB), whatever the corpus holds: beyond
that more phrases than need be are counted, and none is missed, since counts decide and
hashes only spare work. Phrases are counted as texts; a task adds up its own before they
are shuffled.

Every cut of a frequent phrase into two is scored from the counts of both parts, which the
level tables have, for a part is never rarer than its phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import batches_of, cut, gathered, kinds, one
from .language_model import mix
from .shared import key_of, meet, only, stage, text_batches

#: Between words, and between the pieces that a phrase can't cross.
KINDS = kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
TABLE_BITS, LEAST_BITS, PIECE_BITS = 29, 16, 15


def hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 11) for w in words.to_pylist()), np.uint64, len(words))


def alike(rows: list[np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct row, and how often it comes; ``key`` is a hash of the rows, checked against them."""
    _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if any((r != r[first][inverse]).any() for r in rows):  # unlike rows share a hash
        _, first, n = np.unique(np.stack(rows), axis=1, return_index=True, return_counts=True)
    return first, n


def level_counts(texts: DataFrame, k: int, bits: bytes | None) -> DataFrame:
    """lang, phrase and n of the phrases of ``k`` words that can be frequent; pass 1 also has each language's words under an empty phrase."""
    table = texts.sparkSession.sparkContext.broadcast(bits) if bits else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(table.value, np.uint8) if table else None
        for some in gathered(batches, "text"):
            found = cut(one(some["text"]), KINDS)
            langs = one(some["lang"]).cast(pa.binary()).dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)[found.text]
            if k == 1:
                yield from batches_of(words_of(found, langs.dictionary, lang))
            else:
                yield from batches_of(phrases_of(found, langs.dictionary, lang, k, seen))
        pa.default_memory_pool().release_unused()

    rows = text_batches(texts).mapInArrow(count, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def counted(langs: pa.Array, lang: np.ndarray, phrase: pa.Array, n: np.ndarray) -> pa.Table:
    return pa.table({"lang": langs.take(pa.array(lang)).cast(pa.string()), "phrase": phrase.cast(pa.string()), "n": pa.array(n, pa.int64())})


def words_of(found, langs: pa.Array, lang: np.ndarray) -> pa.Table:
    keys, n = np.unique(lang.astype(np.int64) * max(len(found.words), 1) + found.codes, return_counts=True)
    total = np.bincount(lang, minlength=len(langs))
    rows = counted(langs, keys // max(len(found.words), 1), found.words.take(pa.array(keys % max(len(found.words), 1))), n)
    return pa.concat_tables([rows, counted(langs, np.arange(len(langs)), pa.array([b""] * len(langs), pa.binary()), total)])


def phrases_of(found, langs: pa.Array, lang: np.ndarray, k: int, seen: np.ndarray) -> pa.Table:
    """Counts of the phrases of ``k`` words whose parts of ``k - 1`` are both in the table."""
    word, size = hashes(found.words)[found.codes], len(found.codes)
    n = max(size - k + 1, 0)
    part = mix(hashes(langs)[lang], word)
    for j in range(1, k - 1):
        part = mix(part[:-1], word[j:]) if len(part) else part
    mask = np.uint64(len(seen) * 8 - 1)
    slot = part & mask
    frequent = (seen[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    at = np.flatnonzero((found.piece[:n] == found.piece[size - n :]) & frequent[:n] & frequent[1 : n + 1])
    codes = [found.codes[at + j] for j in range(k)]
    first, times = alike([lang[at], *codes], mix(part[at], word[at + k - 1]))
    text = pc.binary_join_element_wise(*[found.words.take(pa.array(c[first])) for c in codes], b" ")
    return counted(langs, lang[at[first]], text, times)


def bit_table(frequent: DataFrame, n: int) -> bytes:
    """Bits for the hashes of ``n`` phrases: at most 2 ** TABLE_BITS, sent to the driver in pieces of 4 KB."""
    size = min(max((16 * n - 1).bit_length(), LEAST_BITS), TABLE_BITS)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = one(pa.chunked_array([b.column("lang")])).cast(pa.binary()).dictionary_encode()
            lang = hashes(langs.dictionary)[langs.indices.to_numpy(zero_copy_only=False)] if b.num_rows else np.zeros(0, np.uint64)
            lists = pc.split_pattern(b.column("phrase"), " ")
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            words = lists.flatten().cast(pa.binary()).dictionary_encode()
            word = hashes(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
            at, value = np.cumsum(length) - length, lang
            for j in range(int(length[0]) if len(length) else 0):  # a level's phrases are of one length
                value = mix(value, word[at + j])
            slot = (value & np.uint64((1 << size) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> PIECE_BITS), pa.array(slot & ((1 << PIECE_BITS) - 1))], names=["piece", "slot"])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PIECE_BITS, bool)
        bits[rows["slot"].to_numpy()] = True
        return pa.table({"piece": [key[0].as_py()], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = frequent.select("lang", "phrase").mapInArrow(slots, "piece long, slot long").distinct().groupBy("piece").applyInArrow(pack, "piece long, bits binary")
    out = bytearray(1 << (size - 3))
    for r in rows.toLocalIterator():
        out[r.piece << (PIECE_BITS - 3) : (r.piece + 1) << (PIECE_BITS - 3)] = r.bits
    return bytes(out)


def frequent_phrases(texts: DataFrame, *, least: int, longest: int) -> list[DataFrame]:
    """The level tables, staged: lang, phrase and n of the phrases of 1, 2, ... words that come ``least`` times. The first also has each language's words under an empty phrase."""
    levels = [stage(level_counts(texts, 1, None).where((F.col("n") >= least) | (F.col("phrase") == "")))]
    for k in range(2, longest + 1):
        before = levels[-1].where("phrase != ''")
        n = before.count()
        if not n:
            break
        levels.append(stage(level_counts(texts, k, bit_table(before, n)).where(F.col("n") >= least)))
    return levels


def exact(c: str | Column, digits: int) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({digits},0)")


def scored(levels: list[DataFrame], *, absorb: int) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words and more that no longer one absorbs."""
    longest = len(levels)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    every = every.select(key_of(F.col("lang"), F.col("phrase")).alias("key"), F.col("n").alias("f"))
    words = F.split("phrase", " ", -1)
    some = levels[0].where("false").select("lang", "phrase", F.col("n").alias("a"), F.lit(0).alias("k"))
    for k, level in enumerate(levels[1:], 2):
        some = some.unionByName(level.select("lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("k")))
    part = lambda begin, n: F.array_join(F.slice(F.col("w"), begin, n), " ")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.array(
        F.struct(j.alias("j"), F.lit("l").alias("side"), part(F.lit(1), j).alias("part")), F.struct(j.alias("j"), F.lit("r").alias("side"), part(j + 1, F.col("k") - j).alias("part")))))
    whole = F.array(F.struct(F.lit(0).alias("j"), F.lit("n").alias("side"), F.lit("").alias("part")))
    asked = some.withColumn("w", words).select("lang", "phrase", "a", F.explode(F.concat(cuts, whole)).alias("cut")).select("lang", "phrase", "a", "cut.*")
    asked = stage(asked.withColumn("key", key_of(F.col("lang"), F.col("part"))))
    facts = stage(asked.groupBy("key").agg(F.count("*").alias("n")).join(every, "key"))
    known = meet(asked, facts, "key").select("lang", "phrase", "a", "j", "side", "f", F.lit(None).cast("long").alias("longer"))
    # every shorter phrase inside a longer one
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: part(i, m))))
    inner = some.where("k > 2").withColumn("w", words).select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer"))
    both = known.unionByName(inner, allowMissingColumns=True)
    at = lambda side, j: F.max(F.when((F.col("side") == side) & (F.col("j") == j), F.col("f"))).alias(f"{side}{j}")
    sums = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), at("n", 0), *[at(s, j) for j in range(1, longest) for s in "lr"])
    kept = sums.where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a")))
    score = lambda j: F.expr(f"cast(cast(1000 * cast(a as decimal(15,0)) as decimal(19,0)) * cast(n0 as decimal(19,0)) as decimal(38,0)) div cast(cast(l{j} as decimal(19,0)) * cast(r{j} as decimal(19,0)) as decimal(38,0))")
    best = F.array_min(F.filter(F.array(*[F.when(F.col(f"l{j}").isNotNull(), F.struct(score(j).cast("long").alias("score"), F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r"))) for j in range(1, longest)]), lambda x: x.isNotNull()))
    return kept.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", F.col("n0").alias("n"), "best.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, least: int = 100, longest: int = 5, absorb: int = 100, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's best phrases of 2 to ``longest`` words.

    ``a`` is how often a phrase comes within pieces, ``least`` times or more; ``l`` and
    ``r`` are the counts of the two parts of the cut with the lowest score, which is
    floor(1000 a n / (l r)), the first of equal ones; ``n`` is the words of the language.
    A phrase inside a longer frequent one that comes ``absorb`` percent as often is
    dropped. Ranks go by score, count and phrase in UTF-8 order, up to ``top``; None ranks
    all. Counts are exact, and products have 38 digits.

    Null texts are empty, null languages "und"; repeated rows count each. An empty table,
    and one without frequent phrases, gives no rows; other columns aren't read.
    """
    texts = only(docs, text=text_col, lang=lang_col).select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    levels = frequent_phrases(texts, least=least, longest=longest)
    if len(levels) == 1:
        return texts.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(levels, absorb=absorb).withColumn("rank", F.row_number().over(best))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
