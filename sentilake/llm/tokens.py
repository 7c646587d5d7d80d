"""Token ids of whole texts by a public tokenizer, cut into bounded pieces.

The tokenizer file drops white space before it merges, so a text's ids are the ids
of its words one after another. Each Python worker therefore keeps the ids of the
words it has met, up to a fixed number, and asks the tokenizer only for new ones.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, text_batches

#: Words that a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 700_000, 64

PIECES = "doc_tokens long, start long, length long, ids binary"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, worked out when first asked for.

    Words of plain letters, and printable ASCII words without apostrophes, are cut into runs here
    and go straight to the tokenizer's merges; any other word takes its whole path.
    """

    _of: dict[str, WordIds] = {}
    RUNS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()

    @classmethod
    def of(cls, path: str) -> WordIds:
        """This worker's only one for a file, kept from task to task."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        lower = text.lower()
        if text.isascii() and text.isprintable() and "'" not in text and "<|" not in text:
            ids = [t.id for run in self.RUNS.findall(lower) for t in self.model.tokenize(run)]
        elif lower == text and text.isalpha() and is_normalized("NFC", text):
            ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        found = array("I", ids).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        """All ids of a text."""
        return b"".join(map(self.__getitem__, text.split()))


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, in its order and without loss.

    Returns doc_id, doc_tokens, start, length and ids (little-endian, unsigned 32-bit).
    ``end_id`` follows each document. Null texts count as empty; a document without
    any id has no piece. Repeated rows are cut alike.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    step, tail = 4 * capacity, b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds.of(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                batch = whole.slice(at, 32)
                owner, total, start, ids = [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    data = encoder.encode(text or b"") + tail
                    for k in range(0, len(data), step):
                        owner.append(i)
                        total.append(len(data) // 4)
                        start.append(k // 4)
                        ids.append(data[k : k + step])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(total, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "doc_tokens", "start", "length", "ids"],
                )
        pa.default_memory_pool().release_unused()

    return text_batches(rows).withColumn("text", F.col("text").cast("binary")).mapInArrow(cut, f"doc_id {kind}, {PIECES}")
