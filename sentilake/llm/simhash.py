"""SimHash near-duplicates by anchor-point covering.

The 64 bits are taken as two halves. Of two fingerprints that differ in three bits at
most, one half differs in one bit at most, so each half has a threshold of 1. Anchors
are the words of the perfect Hamming code over 31 bits of a half: every value lies
within 1 (the covering radius) of exactly one anchor, its home. Each fingerprint is
sent to every anchor within covering radius plus threshold, 2 bits: its home and at
most 15 more. Two fingerprints that are close in a half then meet at the home of
either, where homes are compared with all that came, over all 64 bits.

An anchor that is home to many fingerprints is split: its homes are dealt into chunks
and what comes is sent to each. Within a task only a spanning forest of the links it
finds is emitted, so a dense group gives as many links as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import add_column, attach, fresh, only, stage, unstage

HALF, CODE_BITS, THRESHOLD = 32, 31, 3
#: Homes of an anchor that are compared in one place.
HOMES = 4096
#: Pairs that are compared at once in a task.
SLAB = 1 << 21


def _syndromes() -> np.ndarray:
    """Of each byte at each of the four places of a half: the XOR of its bits' numbers from 1."""
    out = np.zeros((4, 256), np.uint8)
    for place in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * place + bit < CODE_BITS:
                    out[place, value] ^= 8 * place + bit + 1
    return out


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """Of each syndrome: what to flip to reach the anchors within 2 bits, home first; how many."""
    masks, n = np.zeros((32, 16), np.uint64), np.ones(32, np.int64)
    for s in range(1, 32):
        found = [1 << (s - 1)] + [1 << (a - 1) | 1 << ((a ^ s) - 1) for a in range(1, 32) if a < a ^ s]
        masks[s, : len(found)], n[s] = found, len(found)
    return masks, n


SYNDROMES, (FLIPS, N_FLIPS) = _syndromes(), _flips()


def syndrome(half: np.ndarray) -> np.ndarray:
    b = half.astype("<u4").view(np.uint8).reshape(-1, 4)
    return SYNDROMES[0, b[:, 0]] ^ SYNDROMES[1, b[:, 1]] ^ SYNDROMES[2, b[:, 2]] ^ SYNDROMES[3, b[:, 3]]


def anchors(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is it the row's home) of every anchor that unsigned 64-bit fingerprints go to."""
    rows, keys, homes = [], [], []
    for which in (0, 1):
        half = (fingerprints >> np.uint64(HALF * which)) & np.uint64((1 << CODE_BITS) - 1)
        s = syndrome(half)
        n = N_FLIPS[s]
        row = np.repeat(np.arange(len(half)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        rows.append(row)
        keys.append((half[row] ^ FLIPS[s[row], place]) | np.uint64(which << HALF))
        homes.append(place == 0)
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64), np.concatenate(homes)


def simhash(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, A-Z in lower case, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-shingle]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    values = np.asarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(values), 1 << 16):
        bits += np.unpackbits(values[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(docs: DataFrame, text_col: str = "text", *, shingle: int = 3, out: str = "fingerprint") -> DataFrame:
    """``docs`` with the signed 64-bit SimHash of a whole text in ``out``, which ``docs`` doesn't have; without words it is 0."""

    def of(texts: list[bytes | None]) -> pa.Array:
        return pa.array(np.asarray([simhash(t or b"", shingle) for t in texts], np.uint64).view(np.int64))

    return add_column(docs, text_col, out, "long", of)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what the given links connect, one for each node but a component's smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        u, v = label[x], label[y]
        low, high = np.minimum(u, v), np.maximum(u, v)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(label, high[open_], low[open_])
        while (label != (up := label[label])).any():
            label = up
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def compare(key: np.ndarray, home: np.ndarray, value: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links at each anchor; rows are sorted by anchor, with its homes first."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(start, len(key)))
    run = np.repeat(np.arange(len(start)), size)
    mine = np.flatnonzero(home & (size[run] > 1))
    cost, out = size[run[mine]], []
    upto = np.cumsum(cost)
    at = 0
    while at < len(mine):
        last = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLAB, "right")))
        some, n = mine[at:last], cost[at:last]
        left = np.repeat(some, n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + start[run[left]]
        u, v = value[left], value[right]
        near = (np.bitwise_count(u ^ v) <= threshold) & (u != v)
        if near.any():
            out.append(forest(u[near].view(np.int64), v[near].view(np.int64)))
        at = last
    return out


def links(fingerprints: DataFrame, *, threshold: int = THRESHOLD, homes: int = HOMES) -> DataFrame:
    """Links (a, b) that connect distinct signed 64-bit fingerprints at ``threshold`` bits or fewer.

    ``fingerprints`` has one column of distinct values. The links span the graph of all
    close pairs: what it connects they connect.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors cover differences of 3 bits at most")
    values = fingerprints.toDF("fp")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                column = whole.column(0).slice(at, 4096)
                row, key, home = anchors(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), column.take(pa.array(row)), pa.array(home)], names=["anchor", "fp", "home"])

    sent = values.mapInArrow(send, "anchor long, fp long, home boolean")
    crowded = stage(sent.where("home").groupBy("anchor").count().where(F.col("count") > homes).select("anchor", F.ceil(F.col("count") / homes).cast("int").alias("chunks")))
    # most anchors have one chunk; where others have more, the homes are dealt out and the rest goes to each
    dealt = sent.join(crowded, "anchor", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("anchor", "chunk", "fp", (F.col("home") & (F.pmod(F.xxhash64("fp"), "chunks") == F.col("chunk"))).alias("home"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros(0, np.uint64)  # the homes of the anchor that the batch before ended in
        for batch in batches:
            anchor, chunk, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fp = fp.view(np.uint64)
            key = np.cumsum(np.concatenate([[0], ((anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1])).astype(np.int64)])) if len(anchor) else np.zeros(0, np.int64)
            if len(key):
                if last == (anchor[0], chunk[0]) and len(kept):
                    key = np.concatenate([np.zeros(len(kept), np.int64), key])
                    fp, home = np.concatenate([kept, fp]), np.concatenate([np.ones(len(kept), bool), home])
                last = (anchor[-1], chunk[-1])
                kept = fp[(key == key[-1]) & home]
            for a, b in compare(key, home, fp, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", F.desc("home")).mapInArrow(meet, "a long, b long")


def classes(found: DataFrame, *, threshold: int = THRESHOLD, homes: int = HOMES) -> DataFrame:
    """fingerprint, n (its documents), component_id (its component's smallest doc_id) and root (its smallest fingerprint).

    ``found`` has doc_id and fingerprint.
    """
    distinct = stage(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = stage(components(links(distinct.select("fingerprint"), threshold=threshold, homes=homes)).toDF("fingerprint", "root"))
    tied = distinct.select("fingerprint", "first").join(roots, "fingerprint")
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = attach(tied.select("fingerprint", "root"), least, "root", roots.count())
    joined = distinct.join(named, "fingerprint", "left")
    return joined.select("fingerprint", "n", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach) of each document.

    Null and blank texts have fingerprint 0 and are linked like any other. Repeated rows
    are returned each. Null doc_ids take part but are never the smallest, unless a
    component has no other. An empty table gives no rows; other columns aren't read.
    """
    found = stage(fingerprint(only(docs, doc_id=id_col, text=text_col), shingle=shingle).select("doc_id", "fingerprint"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    named = stage(classes(found, **how))
    return attach(found, named, "fingerprint", found.count()).select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, **how) -> DataFrame:
    """One document of each component, with all columns: the one with the smallest id.

    Of several rows of a component with that id one stays, and of a component without any
    id one row. An id that other components hold as well stays in each where it is the smallest.
    """
    fp, row = fresh(docs, "near_fp"), fresh(docs, "near_row")
    # staged, so that a row's number stays the same
    marked = stage(fingerprint(docs, text_col, shingle=shingle, out=fp).withColumn(row, F.monotonically_increasing_id()))
    found = only(marked, doc_id=id_col, fingerprint=fp, row=row)
    named = stage(classes(found.select("doc_id", "fingerprint"), **how))
    least = attach(found, named, "fingerprint", found.count()).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = stage(least.groupBy("root").agg(F.min("row").alias(row)).select(row))
    # a shuffle join at every size: what stays grows with the table
    return marked.join(stays.hint("merge"), row, "left_semi").select(*[marked[f"`{c}`"] for c in docs.columns])
