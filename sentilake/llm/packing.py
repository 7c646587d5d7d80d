"""First-fit-decreasing packing of documents into sequences.

Pieces of documents are dealt into groups at random (by a hash of their place in the
input), and each group is packed on its own, so groups are as many as the input needs and
no task sees more than one. Within a group a tournament tree over the bins' free
room finds the first bin that fits. Then the emptiest bins are cut up to top up
bins whose gap exceeds a tolerance, and the last one is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, total_bytes
from .tokens import token_pieces

#: Bytes of text for a group.
GROUP_BYTES = 4 << 20


class FirstFit:
    """A tournament tree: each node holds the most free room of the bins below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """The first bin with room for ``size``, which it then takes."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found, at = at - self.leaves, at >> 1
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at >>= 1
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; ``sizes`` fall and none exceeds ``capacity``."""
    tree, bins = FirstFit(max(1, len(sizes)), capacity), []
    for i, size in enumerate(sizes):
        at = tree.put(size)
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def top_up(bins: list[list[tuple[int, int, int]]], capacity: int, tolerance: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, from, length) with gaps of ``tolerance`` at most and no padded rest.

    The emptiest bins give, cut where a gap ends; what stays in the last giver is cut
    into sequences whose lengths are powers of two.
    """
    fill = lambda b: sum(x[2] for x in b)
    order = sorted(bins, key=fill, reverse=True)
    full, left = 0, len(order) - 1
    while full < left:
        gap = capacity - fill(order[full])
        if gap > tolerance:
            while gap and full < left:
                item, begin, length = order[left].pop()
                order[full].append((item, begin, min(length, gap)))
                if length > gap:
                    order[left].append((item, begin + gap, length - gap))
                gap -= min(length, gap)
                if not order[left]:
                    order.pop()
                    left -= 1
        full += 1
    if order and capacity - fill(order[-1]) > tolerance:
        rest, out = order.pop(), []
        while rest:
            room, taken = 1 << (fill(rest).bit_length() - 1), []
            while room:
                item, begin, length = rest.pop()
                taken.append((item, begin, min(length, room)))
                if length > room:
                    rest.append((item, begin + room, length - room))
                room -= min(length, room)
            out.append(taken)
        order += out
    return order


def grouped(pieces: DataFrame, groups: int, seed: int) -> DataFrame:
    """Pieces with their group, by a hash of what they are and of their place in the input, in runs of 64, so that null ids and copies of a row spread too.

    The place is the same whenever the input is read, so a lost task's pieces keep their groups.
    """
    run = F.shiftright(F.monotonically_increasing_id(), 6)
    return pieces.withColumn("pack", F.pmod(F.xxhash64("doc_id", "start", run, F.lit(seed)), F.lit(groups)))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", tolerance: int = 16, group_bytes: int = GROUP_BYTES, seed: int = 4) -> DataFrame:
    """All ids of all documents in sequences of at most ``capacity`` ids.

    Returns a row for each piece: doc_id, start and length (in the document),
    doc_tokens, sequence_id, offset (in the sequence) and ids (little-endian, unsigned
    32-bit). Null texts are empty and hold ``end_id`` alone; repeated rows are packed
    each; an empty table gives no rows. Other columns of ``docs`` aren't read.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    kind = pieces.schema["doc_id"].dataType.simpleString()
    groups = parts(total_bytes(docs, f"`{text_col}`"), group_bytes)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        sizes = table.column("length").to_pylist()
        bins = [[(i, 0, sizes[i]) for i in b] for b in first_fit_decreasing(sizes, capacity)]
        ids, starts = table.column("ids").to_pylist(), table.column("start").to_pylist()
        base = table.column("pack")[0].as_py() << 31 if table.num_rows else 0
        owner, out = [], {"start": [], "length": [], "sequence_id": [], "offset": [], "ids": []}
        for number, content in enumerate(top_up(bins, capacity, tolerance)):
            offset = 0
            for item, begin, length in content:
                owner.append(item)
                for k, v in zip(out, (starts[item] + begin, length, base + number, offset, ids[item][4 * begin : 4 * (begin + length)]), strict=True):
                    out[k].append(v)
                offset += length
        of = pa.array(owner, pa.int64())
        return pa.table({"doc_id": table.column("doc_id").take(of), "doc_tokens": table.column("doc_tokens").take(of)} | {k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    return grouped(pieces, groups, seed).groupBy("pack").applyInArrow(pack, f"doc_id {kind}, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary")


def padding(sequence_lengths: np.ndarray, capacity: int) -> int:
    """Padding of sequences: up to ``capacity``, none at a power of two."""
    n = np.asarray(sequence_lengths, np.int64)
    return int(np.where(n & (n - 1), capacity - n, 0).sum())
