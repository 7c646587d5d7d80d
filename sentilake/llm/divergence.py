"""Source divergence audit: how each source's terms differ from its language and from other sources.

Texts are read once, and give the counts of each term by language and source. These are
dealt in ranges of (language, term), so that a task holds a slice of the dictionary in
UTF-8 order. There the terms of enough documents are kept, as sorted arrays in chunks; a
row's id is its place among the kept terms by ``searchsorted``, and each source's counts
become one sparse vector for a chunk. Ids rise with the terms' bytes, so ties need no
texts. Per chunk the vectors are spread into dense ones by ``bincount``, and divergences of
all sources are sums over chunks.

A chunk has ``CHUNK`` terms at most, and sources meet in blocks of ``BLOCK``, so a group of
one task is bounded however many terms or sources a language has. No dictionary is
broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cuts import batches_of, cut, gathered, kinds, one
from .shared import key_of, meet, only, parts, stage, text_batches

#: Terms are runs of letters and of whatever is beyond ASCII.
KINDS = kinds(bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)))
CHUNK, BLOCK = 1024, 64
#: Rows of term counts in a task, and as many that it looks at together.
RANGE_ROWS, SLAB_ROWS = 500_000, 100_000
#: What probabilities are multiples of: a thousand to the power ``STEPS``.
STEPS = 3


def term_counts(texts: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: occurrences, and texts with any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(batches, "text"):
            found = cut(one(some["text"]), KINDS)
            langs, sources = one(some["lang"]).dictionary_encode(), one(some["source"]).dictionary_encode()
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            terms = max(len(found.words), 1)
            keys, n = np.unique(group[found.text] * terms + found.codes, return_counts=True)
            once = np.unique(found.text.astype(np.int64) * terms + found.codes)
            having, docs = np.unique(group[once // terms] * terms + once % terms, return_counts=True)
            assert len(having) == len(keys)  # the same groups and terms, in the same order
            group, term = keys // terms, keys % terms
            rows = [langs.dictionary.take(pa.array(group // len(sources.dictionary))), sources.dictionary.take(pa.array(group % len(sources.dictionary))), found.words.take(pa.array(term)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
            yield from batches_of(pa.table(rows, ["lang", "source", "term", "n", "docs"]))
        pa.default_memory_pool().release_unused()

    rows = text_batches(texts).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def changes(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before; the first does."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        out[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


def encode(counts: DataFrame, *, least: int, chunk: int = CHUNK) -> DataFrame:
    """Chunks of each language's dictionary, and each source's counts by ids in it.

    A row with terms has a chunk's kept terms in order and their counts in the language;
    a row with a source has ids and counts of its own.
    """

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Sorted rows, cut where a term ends."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= SLAB_ROWS:
                whole = pa.Table.from_batches(held).combine_chunks()
                last = int(np.flatnonzero(changes(one(whole["term"])) | changes(one(whole["lang"])))[-1])
                if last:
                    yield whole.slice(0, last).combine_chunks()
                held = whole.slice(last).to_batches()
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for slab in slabs(batches):
            lang, source, term = one(slab["lang"]), one(slab["source"]), one(slab["term"])
            n, docs = slab["n"].to_numpy(), slab["docs"].to_numpy()
            new_lang = changes(lang)
            begin = np.flatnonzero(changes(term) | new_lang)
            kept = begin[np.add.reduceat(docs, begin) >= least] if len(begin) else begin
            length = np.diff(np.append(begin, slab.num_rows))[np.searchsorted(begin, kept)]
            langs = np.flatnonzero(new_lang)
            for a, z in zip(langs, np.append(langs[1:], slab.num_rows), strict=True):
                mine = slice(*np.searchsorted(kept, [a, z]))
                for at in range(mine.start, mine.stop, chunk):
                    starts, sizes = kept[at : min(at + chunk, mine.stop)], length[at : min(at + chunk, mine.stop)]
                    rows = np.arange(starts[0], starts[-1] + sizes[-1])
                    ids = np.searchsorted(starts, rows, side="right") - 1
                    rows, ids = rows[rows < (starts + sizes)[ids]], ids[rows < (starts + sizes)[ids]]
                    whole = np.zeros(len(starts), np.int64)
                    np.add.at(whole, ids, n[rows])
                    coded = source.take(pa.array(rows)).dictionary_encode()
                    codes = coded.indices.to_numpy()
                    order = np.argsort(codes, kind="stable")
                    bounds = np.append(0, np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))).astype(np.int32)
                    own = pa.array(bounds)
                    of = len(coded.dictionary)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang[int(a)].as_py()] * (of + 1), pa.string()), pa.array([number] * (of + 1), pa.int64()), pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary]),
                            pa.array([term.take(pa.array(starts)).to_pylist()] + [None] * of, pa.list_(pa.string())),
                            pa.concat_arrays([pa.array([None], pa.list_(pa.int32())), pa.ListArray.from_arrays(own, pa.array(ids[order].astype(np.int32)))]),
                            pa.concat_arrays([pa.array([whole.tolist()], pa.list_(pa.int64())), pa.ListArray.from_arrays(own, pa.array(n[rows][order]))]),
                        ],
                        names=["lang", "chunk", "source", "terms", "ids", "counts"],
                    )
                    number += 1

    ranges = parts(counts.count(), RANGE_ROWS)
    dealt = counts.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "lang string, chunk long, source string, terms array<string>, ids array<int>, counts array<long>")


def share(counts: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + kept)), digit groups at a time: nothing passes 64 bits while the totals are below 9 * 10^15."""
    whole = np.asarray(total, np.int64) + kept
    rest, value = counts + 1, np.zeros_like(counts)
    for _ in range(STEPS):
        rest = rest * 1000
        value = value * 1000 + rest // whole
        rest = rest % whole
    return value + 1


def compare(key: tuple, rows: pa.Table, top: int) -> pa.Table:
    """Of one chunk: divergence from each source of block a to each of block b, and the best terms of a's where a is b."""
    lang, _, a, b = (k.as_py() for k in key)
    sides, size, kept = {}, rows["size"][0].as_py(), rows["kept"][0].as_py()
    for side, block in ((1, a), (2, b)):
        mine = rows.filter(pc.equal(pc.bit_wise_and(rows["side"], side), side))
        counts = np.zeros((mine.num_rows, size), np.int64)
        lists = one(mine["ids"])
        place = np.repeat(np.arange(mine.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        counts[place, lists.flatten().to_numpy()] = one(mine["counts"]).flatten().to_numpy()
        total = mine["n"].to_numpy().reshape(-1, 1)
        sides[side] = mine["source"].to_pylist(), counts, share(counts, total, kept)
    (sources, counts, p), (others, _, q) = sides[1], sides[2]
    out: list[tuple] = []
    for i, s in enumerate(sources):
        values = ((p[i] - q) ** 2 // q).sum(axis=1)
        out += [(lang, s, "pair", t, int(v)) for t, v in zip(others, values, strict=True) if t != s]
    if a == b:
        whole = rows.filter(pc.equal(rows["side"], 4))
        terms, base = whole["terms"][0].values, share(whole["counts"][0].values.to_numpy(), whole["n"][0].as_py(), kept)
        for i, s in enumerate(sources):
            at = np.flatnonzero((counts[i] > 0) & (p[i] > base))
            value = (p[i][at] - base[at]) ** 2 // base[at]
            best = np.argsort(-value, kind="stable")[:top]  # equal ones stay in UTF-8 order
            out += [(lang, s, "term", t, int(v)) for t, v in zip(terms.take(pa.array(at[best])).to_pylist(), value[best], strict=True)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.string()] * 4 + [pa.int64()], strict=True)], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank.

    A term is kept in a language where ``least`` of its documents have it. A source's share
    of a term is p = 1 + floor(10^9 (count + 1) / (N + V)), of V kept terms with N
    occurrences in the source; q is that of its language or of another source, and a term's
    divergence floor((p - q)^2 / q). Part "pair" has the sum over all kept terms for each
    other source of the language, part "term" the terms that the source has and uses more
    than its language, up to rank ``top``. Ranks go by value, then by item in UTF-8 order.

    Nulls are empty texts. Sources without terms are compared too; a language that keeps
    none has pairs of value 0. A source alone in its language has no pairs. Repeated rows
    count each; an empty table gives no rows; other columns aren't read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = only(docs, text=text_col, lang=lang_col, source=source_col).select(text("text"), text("lang"), text("source"))
    coded = stage(encode(stage(term_counts(texts)), least=least))
    cells, chunks = coded.where("source is not null").select("lang", "chunk", "source", "ids", "counts"), coded.where("source is null").select("lang", "chunk", "terms", "counts")
    totals = cells.groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    groups = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["n"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stage(groups.withColumn("block", F.floor(place / BLOCK).cast("int")))
    kept = chunks.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("kept"), F.count("*").alias("chunks"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("all"), (F.max("block") + 1).alias("blocks")).join(kept, "lang", "left").fillna(0, ["kept", "chunks"])
    langs = stage(langs)

    # every chunk with every block of sources of its language
    sized = meet(chunks, langs.where("kept > 0").withColumnRenamed("chunks", "n"), "lang")
    blocks = sized.select("lang", "chunk", "kept", "blocks", F.size("terms").alias("size"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    members = groups.groupBy("lang", "block").agg(F.collect_list(F.struct("source", "n")).alias("members"))  # BLOCK at most
    members = members.join(langs.select("lang", F.col("chunks").alias("n")), "lang")
    members = stage(members.select(key_of(F.col("lang"), F.col("block")).alias("key"), "members", "n"))
    seats = meet(blocks.withColumn("key", key_of(F.col("lang"), F.col("block"))), members, "key")
    seats = seats.select("lang", "chunk", "kept", "blocks", "size", "block", F.explode("members").alias("member")).select("*", "member.source", "member.n").drop("member")
    seats = seats.join(cells, ["lang", "chunk", "source"], "left")

    # a source of block x meets each block y, as side 1 of (x, y) and side 2 of (y, x); in (x, x) it is both
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.when(y == F.col("block"), F.array(F.struct(y.alias("a"), y.alias("b"), F.lit(3).alias("side")))).otherwise(
        F.array(F.struct(F.col("block").alias("a"), y.alias("b"), F.lit(1).alias("side")), F.struct(y.alias("a"), F.col("block").alias("b"), F.lit(2).alias("side")))))
    none = F.lit(None)
    rows = seats.withColumn("at", F.explode(F.flatten(met))).select("lang", "chunk", "at.a", "at.b", "at.side", "kept", "size", "source", "n", none.cast("array<string>").alias("terms"), "ids", "counts")
    dictionary = sized.select("lang", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), "kept", F.size("terms").alias("size"), F.col("all").alias("n"), "terms", "counts")
    dictionary = dictionary.select("lang", "chunk", "a", F.col("a").alias("b"), F.lit(4).alias("side"), "kept", "size", none.cast("string").alias("source"), "n", "terms", none.cast("array<int>").alias("ids"), "counts")
    found = stage(rows.unionByName(dictionary).groupBy("lang", "chunk", "a", "b").applyInArrow(lambda key, table: compare(key, table, top), "lang string, source string, part string, item string, value long"))

    blank = meet_blank(groups, langs)
    pairs = found.where("part = 'pair'").unionByName(blank).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(terms)


def meet_blank(groups: DataFrame, langs: DataFrame) -> DataFrame:
    """The pairs of sources of languages that keep no term: each of value 0."""
    some = groups.join(langs.where("kept = 0").select("lang"), "lang")
    other = some.select("lang", F.col("source").alias("item"))
    return some.join(other, "lang").where("source != item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
