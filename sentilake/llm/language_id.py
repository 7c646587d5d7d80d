"""Language identification by compression.

One zstandard raw-content dictionary is kept for each language, made of a bounded
sample of its labelled texts. A whole text, in lower case and without ASCII
punctuation and digits, is cut into blocks; each block is compressed with every
dictionary, and the language with the fewest bytes wins. The margin between the best
and the second-best language, as a share of the latter's bytes, is the score; a
narrow one rejects. Blocks are small, so that a dictionary and not the text's own
repetitions decides.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
rejected. Without any learned language every text is ``und``. Equal sizes go to
the language that comes first by code point. Repeated rows are judged alike. Only
the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import add_column, fresh, only, stage

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Bytes that tell no language apart.
NOISE = (string.punctuation + string.digits).encode()
#: Bytes of an empty frame, the same for all.
FRAME = 9
#: What ``identify`` adds.
FOUND = "struct<lang_pred:string,score:double,accepted:boolean>"


def letters(text: str) -> bytes:
    """A text in lower case, without punctuation and digits."""
    return text.lower().encode("utf-8", "replace").translate(None, NOISE)


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, in code-point order, and how texts meet them."""

    dictionaries: dict[str, bytes]
    level: int = 5
    block: int = 2048
    margin: float = 0.005
    _ready: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_ready": {}}

    def compressors(self) -> list:
        if not self._ready:
            for name, content in sorted(self.dictionaries.items()):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._ready[name] = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return list(self._ready.items())

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its margin, 0 to 1, of one whole text."""
        if not text or not self.dictionaries or not LETTER.search(text):
            return UNKNOWN, 0.0
        data = letters(text)
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        sizes = [(max(1, sum(len(c.compress(b)) - FRAME for b in blocks)), name) for name, c in self.compressors()]
        best, name = min(sizes)
        rest = min((s for s, other in sizes if other != name), default=len(data) + best)
        return name, (rest - best) / rest


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, texts_per_language: int = 128, chunks: int = 4, chunk_chars: int = 256, most_languages: int = 1000, **model) -> LanguageModel:
    """Fit dictionaries on a bounded sample of labelled rows.

    ``texts_per_language`` hash buckets give one text each, chosen by the smallest hash of
    its id. ``chunks`` pieces of ``chunk_chars`` characters, spread evenly from the start to
    the end of the whole text, enter the dictionary; a shorter text enters whole. These and
    ``most_languages`` bound the driver's share whatever the table's size; labels with more
    different languages than that are an error, not cut. Null languages teach nothing.
    """
    rows = only(labelled, id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("id").isNotNull())
    mixed = F.xxhash64(F.col("id").cast("string"), F.lit("language"))
    chosen = stage(rows.groupBy("lang", F.pmod(mixed, F.lit(texts_per_language)).alias("bucket")).agg(F.min_by("id", mixed).alias("id")).select("lang", "id"))
    n = chosen.select("lang").distinct().count()
    if n > most_languages:
        raise ValueError(f"{n} languages are labelled; most_languages is {most_languages}")
    long, length = chunks * chunk_chars, F.length("text")
    # the first piece begins the text and the last one ends it
    start = lambda i: 1 + F.floor(i * (length - chunk_chars) / max(1, chunks - 1)).cast("int")
    spread = F.array_join(F.array(*[F.substring("text", start(i), F.lit(chunk_chars)) for i in range(chunks)]), " ")
    texts = rows.join(F.broadcast(chosen), ["lang", "id"]).groupBy("lang", "id").agg(F.min(F.when(length <= long, F.col("text")).otherwise(spread)).alias("text"))
    content: dict[str, list[bytes]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r.lang, str(r.id))):
        content.setdefault(r.lang, []).append(letters(r.text or ""))
    # a dictionary has 8 bytes at least
    return LanguageModel({k: b"\n".join(v).ljust(8) for k, v in content.items()}, **model)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", *, out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang_pred, score, accepted. ``docs`` has no column of that name."""
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"a column {out} is there already")

    def judge(texts: list[bytes | None]) -> pa.Array:
        got = [model.predict(None if t is None else t.decode("utf-8", "replace")) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] != UNKNOWN and g[1] >= model.margin for g in got], pa.bool_())],
            names=["lang_pred", "score", "accepted"],
        )

    return add_column(docs, text_col, out, FOUND, judge)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents whose language is clear, with that language; the rest go."""
    found = fresh(docs, "language")
    judged = identify(docs, model, text_col, out=found).where(F.col(f"`{found}`.accepted"))
    return judged.withColumn(lang_col, F.col(f"`{found}`.lang_pred")).select(*[f"`{c}`" for c in docs.columns])
