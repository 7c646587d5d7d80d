"""Token ids as packed binary sequences: best-fit decreasing with a segment tree.

Each sequence is one row of an id matrix: ids padded to the capacity, cumulative
segment lengths, and positions that start again at each segment. Documents longer
than a sequence are split without loss. Pieces are dealt into groups by hash and
packed group by group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packing import GROUP_BYTES, grouped
from .shared import parts, total_bytes
from .tokens import token_pieces


class BestFit:
    """A segment tree over free room 0..capacity that counts the bins with each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.with_room: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def least_room(self, size: int) -> int | None:
        """The least free room of ``size`` or more that a bin has."""
        at, count = size + self.leaves, self.count
        if count[at]:
            return size
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at *= 2
                    if not count[at]:
                        at += 1
                return at - self.leaves
            at >>= 1
        return None

    def add(self, bin_number: int, room: int) -> None:
        self.with_room.setdefault(room, []).append(bin_number)
        self._add(room, 1)

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.with_room[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; ``sizes`` fall and none exceeds ``capacity``."""
    tree, bins = BestFit(capacity), []
    for i, size in enumerate(sizes):
        room = tree.least_room(size)
        if room is None:
            room, at = capacity, len(bins)
            bins.append([])
        else:
            at = tree.take(room)
        bins[at].append(i)
        tree.add(at, room - size)
    return bins


def token_matrices(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int | None = 1, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, seed: int = 1) -> DataFrame:
    """A row for each packed sequence.

    Returns sequence_id, n_tokens, doc_ids and starts (arrays, by segment), cu_seqlens
    (array, from 0), input_ids (``capacity`` little-endian unsigned 32-bit ids) and
    position_ids (``capacity`` little-endian 32-bit numbers; padding has 0). Null texts
    are empty and hold ``end_id`` alone; repeated rows are packed each; an empty table
    gives no rows. Other columns of ``docs`` aren't read.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    kind = pieces.schema["doc_id"].dataType.simpleString()
    groups = parts(total_bytes(docs, f"`{text_col}`"), group_bytes)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        sizes, docs_of, starts, ids = (table.column(c).to_pylist() for c in ("length", "doc_id", "start", "ids"))
        base = table.column("pack")[0].as_py() << 31 if table.num_rows else 0
        cols: dict[str, list] = {k: [] for k in ("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids")}
        pad = np.asarray([pad_id], "<u4").tobytes()
        for number, items in enumerate(best_fit_decreasing(sizes, capacity)):
            lengths = np.asarray([sizes[i] for i in items], np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            positions = np.zeros(capacity, "<i4")
            positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)
            row = (base + number, int(ends[-1]), [docs_of[i] for i in items], [starts[i] for i in items], ends.tolist(), b"".join([ids[i] for i in items]) + pad * int(capacity - ends[-1]), positions.tobytes())
            for k, v in zip(cols, row, strict=True):
                cols[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.list_(table.schema.field("doc_id").type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(cols.items(), kinds, strict=True)})

    return grouped(pieces, groups, seed).groupBy("pack").applyInArrow(pack, f"sequence_id long, n_tokens long, doc_ids array<{kind}>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary")


def write_token_matrices(sequences: DataFrame, path: str) -> None:
    """Write the binary rows; each file holds an id matrix in its input_ids column."""
    sequences.write.mode("overwrite").parquet(path)


def read_documents(sequences: DataFrame) -> DataFrame:
    """The documents' ids again, from packed sequences whose doc_ids are distinct: doc_id, ids (array)."""
    from pyspark.sql import functions as F

    def cut(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out: dict[str, list] = {"doc_id": [], "start": [], "part": []}
            for docs_of, starts, ends, data in zip(rows["doc_ids"], rows["starts"], rows["cu_seqlens"], rows["input_ids"], strict=True):
                ids = np.frombuffer(data, "<u4")
                for d, s, a, b in zip(docs_of, starts, ends[:-1], ends[1:], strict=True):
                    for k, v in zip(out, (d, s, ids[a:b].tolist()), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], batch.schema.field("doc_ids").type.value_type), pa.array(out["start"], pa.int64()), pa.array(out["part"], pa.list_(pa.int64()))], names=list(out))

    kind = sequences.schema["doc_ids"].dataType.elementType.simpleString()
    pieces = sequences.select("doc_ids", "starts", "cu_seqlens", "input_ids").mapInArrow(cut, f"doc_id {kind}, start long, part array<long>")
    return pieces.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x.part)).alias("ids"))
