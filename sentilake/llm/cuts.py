"""Words of many texts at once: numpy arrays over the texts' own bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut together.
TOGETHER = 8 << 20
GAP, WORD, BREAK = 0, 1, 2
#: Every byte, A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """What each byte is: a gap between words, a break between pieces, or part of a word."""
    table = np.full(256, WORD, np.uint8)
    table[list(gaps)] = GAP
    table[list(breaks)] = BREAK
    return table


@dataclass
class Cut:
    """The words of some texts in order: distinct ``words``, and for each place its word, text and piece."""

    words: pa.Array
    codes: np.ndarray
    text: np.ndarray
    piece: np.ndarray


def cut(texts: pa.Array, table: np.ndarray) -> Cut:
    """The words of texts, A-Z in lower case. Pieces end at breaks and with a text; null is empty."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    begin, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begin : begin + size]]
    kind = table[data]
    inside = kind == WORD
    edge = np.zeros(size + 1, bool)
    edge[offsets - begin] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends_packed = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=ends_packed[1:])
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends_packed), pa.py_buffer(data[inside])])
    coded = packed.dictionary_encode()
    text = np.searchsorted(offsets - begin, starts, side="right") - 1
    turns = (kind == BREAK) | edge[:-1]
    return Cut(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), text.astype(np.int32), np.cumsum(turns, dtype=np.int32)[starts] if size else np.zeros(0, np.int32))


def gathered(batches: Iterable[pa.RecordBatch], column: str, most: int = TOGETHER) -> Iterator[pa.Table]:
    """The rows of batches, put together or cut to about ``most`` bytes of a text column; a longer text comes alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            upto = at + max(1 if not held else 0, int(np.searchsorted(np.cumsum(lengths[at:]), most - size, side="right")))
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(lengths[at:upto].sum())
                at = upto
            if at < batch.num_rows or size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def one(column: pa.ChunkedArray) -> pa.Array:
    """A column of a table as a single array."""
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def batches_of(table: pa.Table, rows: int = 32_768) -> Iterator[pa.RecordBatch]:
    """A result in batches that the JVM takes one at a time."""
    yield from table.combine_chunks().to_batches(max_chunksize=rows)
