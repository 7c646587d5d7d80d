"""Token counts by unigram segmentation, computed once for each shared prefix.

Texts are cut into pre-tokens at white space. The corpus's distinct pre-tokens are
gathered by a shuffle and dealt out by their prefixes, so that each part holds whole
branches of the corpus's trie; a prefix that very many pre-tokens share is dealt out by
a longer one. Within a part they come in order, which walks its trie depth first: the
forward scores of a path are kept while the path lasts, so each node is scored once in
the corpus, and a pre-token's token count is what its terminal node stores.

The counts then meet the texts. The most frequent pre-tokens, a bounded number, are
broadcast, and a text adds up its own; only the rarer ones that it holds meet their
counts in a join.

Scores. No published unigram scores come with the public files, and tokenizers are not
trained here. The pieces are those of a public vocabulary in its own order of merit; a
piece of rank r gets -log(r + 2), Zipf's law, normalised. So the counts are those of the
best segmentation under these scores, not those of the file's own merges.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import bucket
from .shared import SMALL, only, parts, stage, text_batches

#: What stands for the white space before a word.
MARK = "▁"
#: Pre-tokens that are broadcast at most, and the bytes of the longest of them; these bound the broadcast by 20 MB.
HEAD, LONGEST = 200_000, 64
#: Distinct pre-tokens that a worker adds up before it passes them on.
HELD = 500_000
#: Distinct pre-tokens in a part of the trie, and the lengths of prefix by which they are dealt out.
PART, PREFIXES = 200_000, (2, 4, 8, 16, 32)


@dataclass
class Unigram:
    """Pieces with log scores. A character without a piece costs its UTF-8 bytes, a token each."""

    scores: dict[str, float]
    byte_score: float = -20.0

    def __post_init__(self):
        self.longest = max(map(len, self.scores), default=1)
        #: pieces by last character, to extend a prefix by one node
        self.lengths = {}
        for piece in self.scores:
            self.lengths.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(n) for c, n in self.lengths.items()}


class Walk:
    """A walk through a trie, depth first: pre-tokens come in order of their characters."""

    def __init__(self, model: Unigram):
        self.model, self.path = model, ""
        #: (score, -tokens) of the best segmentation up to each node of the path; on ties, fewer tokens
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.nodes = 0

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of ``word``, from the last node that it shares with the path."""
        path, best, scores, lengths = self.path, self.best, self.model.scores, self.model.lengths
        shared, limit = 0, min(len(path), len(word))
        while shared < limit and path[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            c = word[end - 1]
            top = None
            for n in lengths.get(c, ()):
                if n > end:
                    break
                score = scores.get(word[end - n : end])
                if score is not None:
                    s, k = best[end - n]
                    if top is None or (s + score, k - 1) > top:
                        top = (s + score, k - 1)
            if c not in scores:
                n_bytes = len(c.encode("utf-8", "replace"))
                s, k = best[end - 1]
                bytes_ = (s + self.model.byte_score * n_bytes, k - n_bytes)
                top = bytes_ if top is None or bytes_ > top else top
            best.append(top)
        self.path, self.nodes = word, self.nodes + len(word) - shared
        return -best[-1][1]


def public_vocabulary(path: str) -> Unigram:
    """Pieces of a public SentencePiece file, in their order of merit, with Zipf scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    norm = math.log(sum(1 / (r + 2) for r in range(len(ids))))
    return Unigram({model.id_to_piece(i): -math.log(r + 2) - norm for r, i in enumerate(ids)})


_models: dict[str, Unigram] = {}
_heads: dict[str, dict[bytes, int]] = {}


def _model(path: str) -> Unigram:
    """This worker's only one for a file."""
    if path not in _models:
        _models[path] = public_vocabulary(path)
    return _models[path]


def distinct_pretokens(texts: DataFrame) -> DataFrame:
    """word (bytes) and n of the pre-tokens of a table of one binary column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: Counter) -> Iterator[pa.RecordBatch]:
            pairs = list(found.items())
            for at in range(0, len(pairs), 50_000):
                some = pairs[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])

        found: Counter[bytes] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(at, 64).to_pylist():
                    found.update((text or b"").split())
                if len(found) > HELD:
                    yield from out(found)
                    found = Counter()
        yield from out(found)

    return text_batches(texts).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _dealt(words: DataFrame, part: int, prefixes: tuple[int, ...]) -> DataFrame:
    """Words with ``branch``, the prefix that they are dealt out by: longer where a shorter one has more than ``part`` of them.

    Where the longest has too many as well, they are dealt out by hash, and the parts walk its path each.
    """
    out = words.withColumn("branch", F.substring("word", 1, prefixes[0]))
    for longer in (*prefixes[1:], None):
        # one row at most for each ``part`` words of the corpus
        large = stage(out.groupBy("branch").count().where(F.col("count") > part).select("branch", F.ceil(F.col("count") / part).cast("int").alias("dealt")))
        n = large.count()
        if not n:
            return out
        large = F.broadcast(large) if n <= SMALL else large
        finer = F.substring("word", 1, longer) if longer else F.concat("branch", F.pmod(F.xxhash64("word"), F.col("dealt")).cast("string").cast("binary"))
        out = out.join(large, "branch", "left").withColumn("branch", F.when(F.col("dealt").isNotNull(), finer).otherwise(F.col("branch"))).drop("dealt")
    return out


def token_table(words: DataFrame, vocabulary_path: str, *, part: int = PART, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """word, n and tokens of distinct pre-tokens (word, n): the trie's terminal counts."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Walk(_model(vocabulary_path))
        for batch in batches:
            tokens = [trie.count(MARK + w.decode("utf-8", "replace")) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], names=["word", "n", "tokens"])

    dealt = _dealt(words, part, prefixes).repartition(parts(words.count(), part), "branch").sortWithinPartitions("word")
    return dealt.select("word", "n").mapInArrow(walk, "word binary, n long, tokens long")


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", *, head: int = HEAD, part: int = PART, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each whole text.

    Null and blank texts count 0. Repeated rows are counted each; an empty table gives
    no rows; other columns aren't read. Bytes that are no UTF-8 count as replacement
    characters.
    """
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    words = stage(distinct_pretokens(rows.select("text")))
    table = stage(token_table(words, vocabulary_path, part=part, prefixes=prefixes))
    # the most frequent words: whole buckets of counts, as many as stay within ``head``
    short, least, held = F.octet_length("word") <= LONGEST, None, 0
    for r in sorted(table.where(short).groupBy(bucket(F.col("n")).alias("bucket")).count().collect(), key=lambda r: -r.bucket):
        if held + r["count"] > head:
            break
        least, held = r.bucket, held + r["count"]
    most = table.where(short & (bucket(F.col("n")) >= (1 << 30 if least is None else least))).select("word", "tokens").toArrow()
    known, name = docs.sparkSession.sparkContext.broadcast(most.to_pydict()), table.staged_at

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _heads:
            _heads.clear()
            _heads[name] = dict(zip(known.value["word"], known.value["tokens"], strict=True))
        tokens = _heads[name]
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                n_words, n_tokens, rare = [], [], []
                for text in batch.column(1).to_pylist():
                    ws = (text or b"").split()
                    got = [tokens.get(w) for w in ws]
                    missing = Counter(w for w, t in zip(ws, got, strict=True) if t is None) if None in got else {}
                    n_words.append(len(ws))
                    n_tokens.append(sum(t for t in got if t is not None) if missing else sum(got))
                    rare.append([{"word": w, "times": k} for w, k in missing.items()])
                rest = pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), rest], names=["doc_id", "n_pretokens", "n_tokens", "rare"])

    found = rows.mapInArrow(add, f"doc_id {kind}, n_pretokens long, n_tokens long, rare array<struct<word:binary,times:bigint>>")
    # staged, so that a row's number stays the same
    found = stage(found.withColumn("row", F.monotonically_increasing_id()))
    counts = found.select("doc_id", "n_pretokens", "n_tokens")
    if table.count() == held:
        return counts  # every word was among the most frequent ones
    rest = found.select("row", F.explode("rare").alias("r")).join(table.select(F.col("word").alias("rare_word"), "tokens"), F.col("r.word") == F.col("rare_word"))
    rest = rest.groupBy("row").agg(F.sum(F.col("r.times") * F.col("tokens")).alias("more"))
    joined = found.select("row", *counts.columns).join(rest, "row", "left")
    return joined.select("doc_id", "n_pretokens", (F.col("n_tokens") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def corpus_counts(counts: DataFrame) -> Counter:
    """The whole table's totals."""
    r = counts.agg(F.coalesce(F.sum("n_pretokens"), F.lit(0)).alias("p"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).head()
    return Counter(pretokens=r.p, tokens=r.t)
