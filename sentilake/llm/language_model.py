"""Scoring by a trigram language model, walked as a weighted backoff automaton.

States are what training has seen as a history: the empty one, single tokens, and pairs
of tokens. A seen token after a history is an arc, with the smoothed probability of the
token, to the longest history that the token ends. Whatever has no arc takes the state's
failure arc, with its backoff weight, to the state without the oldest token; the empty
state has an arc for every token. One walk from left to right carries the state and adds
log probabilities. It begins in the state of the end token. A state depends on the last
two tokens alone, so a long text is walked as segments side by side, each begun in the
state that the two tokens before it lead to.

Smoothing: a token alone has p(w) = (c(w) - D) / N, and D V / N goes to one class of
unknown tokens, with D = n1 / (n1 + 2 n2). After a history h, with h' without its oldest
token, p(w|h) = (c(h, w) + K p(w|h')) / (c(h) + K), K by the length of h; where c(h, w) is
0 this is the backoff weight K / (c(h) + K) times p(w|h'). All sum to 1.

No counts are capped and no model is broadcast. Documents are dealt into groups of a
bounded size, and each group learns the whole corpus's counts of just what it holds, in
two exchanges with buckets of hashes. In the first it sends its tokens with their
training counts, and 32 bits of the hash of each pair and triple that it holds; a bucket
adds up the tokens and says which of the short hashes several groups have. What no other
group has is counted already. In the second it sends the others, with all 64 bits of
their hashes and their counts, and the bucket adds up these. Messages go only to buckets
of which a group holds anything, and a group sends no more of them than it has tokens,
pairs and triples. The totals of the training tokens come from a count of their hashes
beforehand; they reach the driver as one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import gathered
from .cuts import one as one_array
from .shared import only, parts, text_batches, total_bytes

#: Bytes of text in a group, and of text for a bucket of hashes.
GROUP_BYTES, BUCKET_BYTES = 10 << 20, 24 << 20
#: Weight of the shorter history beside the counts after one token; after two that came once; after two that came more often.
CONCENTRATION = (100.0, 400.0, 1.0)
#: The end token, which isn't a word.
END = b"\n"
#: Tokens of a text that are walked in a row.
SEGMENT = 1024
#: Bytes of text whose tokens are counted together before they are passed on.
COUNTED_BYTES = 16 << 20
#: Bytes of text that are compressed together.
BLOB_BYTES = 256 << 10


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens, repeat(7)), np.uint64, len(tokens))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, none negative, and the place of each value among them. Places travel in the low bits of one plain sort where they fit."""
    bits = len(values).bit_length()
    if not len(values) or int(values.max()).bit_length() + bits > 63:
        found, at = np.unique(values, return_inverse=True)
        return found, at.astype(np.int32)
    keys = np.sort(values << bits | np.arange(len(values)))
    rising = keys >> bits
    first = np.ones(len(keys), bool)
    first[1:] = rising[1:] != rising[:-1]
    at = np.empty(len(keys), np.int32)
    at[keys & ((1 << bits) - 1)] = np.cumsum(first, dtype=np.int32) - 1
    return rising[first], at


def sorted_order(codes: np.ndarray) -> np.ndarray:
    """What sorts numbers: places travel in the low bits of one plain sort; bits of the numbers that this pushes out only tell neighbours apart, which are put right then."""
    bits = len(codes).bit_length()
    out = max(0, int(codes.max(initial=0)).bit_length() + bits - 64)
    order = (np.sort((codes >> np.uint64(out)) << np.uint64(bits) | np.arange(len(codes), dtype=np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    high = codes[order] >> np.uint64(out) if out else codes[:0]
    for begin in np.flatnonzero(high[1:] == high[:-1]).tolist():
        end = begin + int(np.searchsorted(high[begin:], high[begin], side="right"))
        order[begin:end] = order[begin:end][np.argsort(codes[order[begin:end]], kind="stable")]
    return order


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes, in order."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, A-Z in lower case, as bytes one after another, and how many each text has; null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())))
    words, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    # white space at either end of a text makes an empty piece
    full = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full).view(pa.binary()), np.diff(upto[ends - ends[0]])


class Texts:
    """The tokens of a group's texts: word numbers in a row, how the texts cut it, and the distinct n-grams."""

    def __init__(self, texts: pa.Array):
        tokens, self.lengths = tokens_of(texts)
        self.lengths += 1  # the end token
        self.starts = np.cumsum(self.lengths) - self.lengths
        coded = tokens.dictionary_encode()
        hashes = token_hashes([END, *coded.dictionary.to_pylist()])
        number = np.zeros(int(self.lengths.sum()), np.int32)
        inside = np.ones(len(number), bool)
        inside[self.starts + self.lengths - 1] = False
        number[inside] = coded.indices.to_numpy(zero_copy_only=False) + 1
        # in the order of their hashes, so that the rows' order makes no difference
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.hash, self.end = hashes[order], int(place[0])
        self.ids = place[number]
        n = len(self.hash)
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.starts] = self.end  # the end token comes before a text
        pairs, self.pair = distinct(before.astype(np.int64) * n + self.ids)
        self.heads, self.tails = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        self.later = np.ones(len(self.ids), bool)  # all but the first token of each text follow a pair
        self.later[self.starts] = False
        at = np.flatnonzero(self.later)
        triples, self.triple = distinct(self.pair[at - 1].astype(np.int64) * n + self.ids[at])
        self.first_pair, self.last = (triples // n).astype(np.int32), (triples % n).astype(np.int32)
        # the pair that a triple ends in: the one at any place where the triple is
        self.last_pair = np.zeros(len(triples), np.int32)
        self.last_pair[self.triple] = self.pair[at]
        pair_hash = mix(self.hash[self.heads], self.hash[self.tails])
        #: hashes of pairs, then of triples
        self.gram_hash = np.concatenate([pair_hash, mix(pair_hash[self.first_pair], self.hash[self.last])])

    def counts(self, held_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often texts that aren't held out have each token, and each pair and triple."""
        train = np.repeat(~held_out, self.lengths)
        pairs = np.bincount(self.pair[train], minlength=len(self.heads))
        triples = np.bincount(self.triple[train[self.later]], minlength=len(self.last))
        return np.bincount(self.ids[train], minlength=len(self.hash)), np.concatenate([pairs, triples])


class Automaton:
    """States: 0 is the empty one, then tokens, then pairs. Arcs: of the empty state by token, of tokens by pair, of pairs by triple."""

    def __init__(self, texts: Texts, one: np.ndarray, grams: np.ndarray, total: int, distinct: int, discount: float, concentration: tuple[float, float, float]):
        n, m = len(texts.hash), len(texts.heads)
        two, three = grams[:m], grams[m:]
        alone = np.where(one > 0, (one - discount) / max(total, 1), discount * distinct / total if total else 1.0)
        after = (two + concentration[0] * alone[texts.tails]) / (one[texts.heads] + concentration[0])
        prior = np.where(two > 1, concentration[2], concentration[1])
        after2 = (three + prior[texts.first_pair] * after[texts.last_pair]) / (two + prior)[texts.first_pair]
        self.n = n
        with np.errstate(divide="ignore"):
            self.weight = [np.log10(x) for x in (alone, after, after2)]
        #: whether the arc is there; the empty state has one for each token
        self.arc = [np.ones(n, bool), two > 0, three > 0]
        self.token_state = np.where(one > 0, 1 + np.arange(n), 0)
        self.failure = np.concatenate([[0], np.zeros(n, np.int64), self.token_state[texts.tails]])
        self.backoff = np.concatenate([[0.0], np.log10(concentration[0] / (one + concentration[0])), np.log10(prior / (two + prior))])

    def step(self, state: np.ndarray, token: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state that each token leads to from each state, and what it adds; an arc's number is that of the n-gram read."""
        gain, open_ = np.zeros(len(state)), np.ones(len(state), bool)
        target = self.token_state[token]
        for least, number, weight, arc in ((self.n + 1, triple, self.weight[2], self.arc[2]), (1, pair, self.weight[1], self.arc[1])):
            here = np.flatnonzero(open_ & (state >= least))
            hit = arc[number[here]]
            done, fails = here[hit], here[~hit]
            gain[done] += weight[number[done]]
            target[done] = 1 + self.n + pair[done]
            open_[done] = False
            gain[fails] += self.backoff[state[fails]]
            state[fails] = self.failure[state[fails]]
        gain[open_] += self.weight[0][token[open_]]
        return target, gain


def walk(machine: Automaton, texts: Texts, segment: int = SEGMENT) -> np.ndarray:
    """log10 probability of each text, read from left to right."""
    cuts = -(-texts.lengths // segment)
    owner = np.repeat(np.arange(len(cuts)), cuts)
    begin = texts.starts[owner] + segment * (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    end = np.minimum(begin + segment, (texts.starts + texts.lengths)[owner])
    order = np.argsort(begin - end, kind="stable")  # the longest first
    owner, begin, end = owner[order], begin[order], end[order]
    triple = np.zeros(len(texts.ids), np.int32)
    triple[texts.later] = texts.triple
    # the state that the tokens before a segment lead to; before a text that is the end token
    last = np.where(begin > texts.starts[owner], begin - 1, 0)
    inner = np.where(machine.arc[1][texts.pair[last]], 1 + machine.n + texts.pair[last], machine.token_state[texts.ids[last]]) if len(last) else last
    state, score = np.where(begin > texts.starts[owner], inner, machine.token_state[texts.end]), np.zeros(len(begin))
    length = end - begin
    for t in range(int(length.max(initial=0))):
        n = int(np.searchsorted(-length, -t, "left"))  # segments that are longer than t
        at = begin[:n] + t
        state[:n], gain = machine.step(state[:n], texts.ids[at], texts.pair[at], triple[at])
        score[:n] += gain
    return np.bincount(owner, weights=score, minlength=len(cuts))


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by bucket and then 32 more bits, and where each bucket begins."""
    code = (hashes % np.uint64(buckets)) << np.uint64(32) | short(hashes, buckets)
    order = sorted_order(code)
    return order, np.searchsorted(code[order], np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def short(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """32 more bits of each hash than its bucket has."""
    return ((hashes // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def thin(rising: np.ndarray) -> bytes:
    """Rising 32-bit numbers: how many, the low bytes of each, and the high ones as steps in a row of bits."""
    n = len(rising)
    low = 2 if n >= 1 << 14 else 3 if n >= 1 << 6 else 4
    lows = rising.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :low].T.tobytes()
    bits = np.zeros(n + (1 << 8 * (4 - low)), bool)
    bits[(rising.astype(np.int64) >> 8 * low) + np.arange(n)] = True
    return n.to_bytes(4, "little") + lows + (np.packbits(bits).tobytes() if low < 4 else b"")


def thick(data: bytes) -> np.ndarray:
    """What ``thin`` made small."""
    n = int.from_bytes(data[:4], "little")
    low = 2 if n >= 1 << 14 else 3 if n >= 1 << 6 else 4
    out = np.zeros((n, 4), np.uint8)
    out[:, :low] = np.frombuffer(data, np.uint8, n * low, 4).reshape(low, n).T
    found = out.reshape(-1).view("<u4").copy()
    if low < 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + n * low))
        found += ((np.flatnonzero(bits) - np.arange(n)) << 8 * low).astype(np.uint32)
    return found


def keys_out(hashes: np.ndarray, buckets: int) -> bytes:
    """All bits of a bucket's hashes that their bucket doesn't tell, in the order of ``dealt``."""
    rest = ((hashes // np.uint64(buckets)) >> np.uint64(32)).astype("<u4").tobytes()
    return thin(short(hashes, buckets)) + rest


def keys_in(data: bytes) -> np.ndarray:
    """What ``keys_out`` wrote, as one number for each hash of the bucket."""
    n = int.from_bytes(data[:4], "little")
    rest = np.frombuffer(data, "<u4", offset=len(data) - 4 * n).astype(np.uint64)
    return rest << np.uint64(32) | thick(data[: len(data) - 4 * n]).astype(np.uint64)


def squeeze(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow, in eight."""
    large = counts[counts >= 255]
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<i8").tobytes() + len(large).to_bytes(4, "little")


def loosen(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[-4:], "little")
    large = np.frombuffer(data[len(data) - 4 - 8 * n : len(data) - 4], "<i8")
    counts = np.frombuffer(data, np.uint8, len(data) - 4 - 8 * n).astype(np.int64)
    counts[counts == 255] = large
    return counts


def training_totals(rows: DataFrame, buckets: int) -> tuple[int, int, int, int]:
    """Of the training tokens of text and held_out: all, distinct ones, those seen once and those seen twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in gathered(batches, "text", COUNTED_BYTES):
            coded = tokens_of(one_array(some["text"]))[0].dictionary_encode()
            hashes = token_hashes([*coded.dictionary.to_pylist(), END])
            n = np.append(np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary)), some.num_rows)
            order, at = dealt(hashes, buckets)
            hashes, n = hashes[order], n[order]
            full = np.flatnonzero(np.diff(at)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([keys_out(hashes[at[b] : at[b + 1]], buckets) for b in full], pa.binary()), pa.array([squeeze(n[at[b] : at[b + 1]]) for b in full], pa.binary())], names=["bucket", "a", "b"])
        pa.default_memory_pool().release_unused()

    def add(table: pa.Table) -> pa.Table:
        keys, counts = [keys_in(x) for x in table.column("a").to_pylist()], [loosen(x) for x in table.column("b").to_pylist()]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        return pa.table({"n": [int(n.sum())], "distinct": [len(n)], "once": [int((n == 1).sum())], "twice": [int((n == 2).sum())]})

    told = text_batches(rows).where(~F.col("held_out")).select("text").mapInArrow(count, "bucket int, a binary, b binary")
    n = told.groupBy("bucket").applyInArrow(add, "n long, distinct long, once long, twice long")
    return tuple(n.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in n.columns]).head())


def in_blobs(rows: DataFrame, blob_bytes: int = BLOB_BYTES) -> DataFrame:
    """Rows of doc_id, text and held_out, compressed some at a time: place and rows (an Arrow stream)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(sizes + 64) // blob_bytes
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(a, b))) for c in batch.columns], schema=batch.schema))
                    yield pa.RecordBatch.from_arrays([pa.array([press.compress(sink.getvalue())], pa.binary())], names=["rows"])

    return text_batches(rows).mapInArrow(pack, "rows binary")


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", *, smooth: float = 0.1, concentration: tuple[float, float, float] = CONCENTRATION, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scores of whole texts by a model of those that aren't held out.

    ``held_out`` is a condition on columns doc_id and text. Returns doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score (add-``smooth`` unigrams) and score, log10
    probabilities both. Null texts are empty and have the end token alone; repeated rows
    count and are scored each; a null condition counts as not held out. Without training
    texts every token is unknown and scores 0. An empty table gives no rows; other
    columns aren't read.
    """
    rows = only(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = total_bytes(rows, "text")
    groups, buckets = max(parts(size, group_bytes), min(32, parts(size, group_bytes // 8))), parts(size, bucket_bytes)
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    total, distinct, n1, n2 = training_totals(rows, buckets)
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    # a place in the input, which is the same whenever that is read, deals out copies as well
    blobs = in_blobs(rows, min(BLOB_BYTES, max(1, group_bytes // 8))).withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def read(table: pa.Table) -> tuple[Texts, np.ndarray, pa.Array]:
        open_ = zstandard.ZstdDecompressor()
        found = pa.concat_tables([pa.ipc.open_stream(open_.decompress(x)).read_all() for x in table.column("rows").to_pylist()])
        return Texts(found.column("text").combine_chunks()), found.column("held_out").to_numpy(), found.column("doc_id")

    def messages(group: int, cuts: list[np.ndarray], content: list) -> pa.Table:
        """A row for each bucket that any of ``cuts`` has something for; ``content`` makes its columns of the parts' ends."""
        some = np.flatnonzero(sum(np.diff(c) for c in cuts)).tolist()
        cols = [[make(b) for b in some] for make in content]
        return pa.table([pa.array(some, pa.int32()), pa.array([group] * len(some), pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["bucket", "group", "a", "b", "c"][: 2 + len(cols)])

    def probe(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        texts, out, _ = read(table)
        one, _ = texts.counts(out)
        (order, at), (order2, at2) = dealt(texts.hash, buckets), dealt(texts.gram_hash, buckets)
        tokens, one, grams = texts.hash[order], one[order], short(texts.gram_hash[order2], buckets)
        return messages(group, [at, at2], [lambda b: keys_out(tokens[at[b] : at[b + 1]], buckets), lambda b: squeeze(one[at[b] : at[b + 1]]), lambda b: thin(grams[at2[b] : at2[b + 1]])])

    def added(keys: list[bytes], counts: list[bytes]) -> list[bytes]:
        """The counts of each message's keys, added up over all messages."""
        found = [keys_in(k) for k in keys]
        _, at = np.unique(np.concatenate(found), return_inverse=True)
        whole = np.bincount(at, weights=np.concatenate([loosen(c) for c in counts])).astype(np.int64)  # exact below 2**53
        return [squeeze(whole[i]) for i in np.split(at, np.cumsum([len(k) for k in found])[:-1])]

    def compare(table: pa.Table) -> pa.Table:
        grams = [thick(x) for x in table.column("c").to_pylist()]
        rising = np.sort(np.concatenate(grams))
        twice = np.append(rising[1:][rising[1:] == rising[:-1]], np.uint32(0))
        found = [g == twice[np.minimum(np.searchsorted(twice[:-1], g), len(twice) - 1)] for g in grams]
        shared = [np.packbits(f).tobytes() for f in found]
        return pa.table([table.column("bucket"), table.column("group"), pa.array(added(table.column("a").to_pylist(), table.column("b").to_pylist()), pa.binary()), pa.array(shared, pa.binary())], names=["bucket", "group", "a", "b"])

    def flags(told: list[dict], at2: np.ndarray) -> np.ndarray:
        """Whether another group has them too, of pairs and triples in their order."""
        shared = np.zeros(at2[-1], bool)
        for r in told:
            lo, hi = at2[r["bucket"]], at2[r["bucket"] + 1]
            shared[lo:hi] = np.unpackbits(np.frombuffer(r["b"], np.uint8), count=hi - lo)
        return shared

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, out, _ = read(left)
        group, told = left.column("group")[0].as_py(), right.to_pylist()
        order2, at2 = dealt(texts.gram_hash, buckets)
        some = flags(told, at2)
        # the answers of the first exchange come back with those of the second
        first = {r["bucket"]: len(r["a"]).to_bytes(8, "little") + r["a"] + r["b"] for r in told}
        cuts = np.concatenate([[0], np.cumsum(some)])[at2]
        keys, two = texts.gram_hash[order2][some], texts.counts(out)[1][order2][some]
        every = np.zeros(buckets + 1, np.int64)
        every[1 + np.fromiter(first, np.int64, len(first))] = 1
        return messages(group, [np.cumsum(every)], [lambda b: keys_out(keys[cuts[b] : cuts[b + 1]], buckets), lambda b: squeeze(two[cuts[b] : cuts[b + 1]]), first.__getitem__])

    def answer(table: pa.Table) -> pa.Table:
        whole = added(table.column("a").to_pylist(), table.column("b").to_pylist())
        return pa.table([table.column("bucket"), table.column("group"), pa.array(whole, pa.binary()), table.column("c")], names=["bucket", "group", "a", "c"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, out, ids = read(left)
        told = right.to_pylist()
        (order, at), (order2, at2) = dealt(texts.hash, buckets), dealt(texts.gram_hash, buckets)
        one, grams = texts.counts(out)
        counts, placed = one[order], grams[order2]
        for r in told:
            size = 8 + int.from_bytes(r["c"][:8], "little")
            counts[at[r["bucket"]] : at[r["bucket"] + 1]] = loosen(r["c"][8:size])
            r["b"] = r["c"][size:]
        some = flags(told, at2)
        cuts = np.concatenate([[0], np.cumsum(some)])[at2]
        asked = np.zeros(cuts[-1], np.int64)
        for r in told:
            asked[cuts[r["bucket"]] : cuts[r["bucket"] + 1]] = loosen(r["a"])
        placed[some] = asked
        one[order], grams[order2] = counts, placed
        got = walk(Automaton(texts, one, grams, total, distinct, discount, concentration), texts)
        base = np.log10((one + smooth) / (total + smooth * (distinct + 1)))[texts.ids]
        per = lambda x: np.add.reduceat(x, texts.starts) if len(x) else np.zeros(0)
        known = per((one[texts.ids] > 0).astype(np.int64)).astype(np.int64)
        cols = {"doc_id": ids, "held_out": pa.array(out), "n_tokens": pa.array(texts.lengths), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(known), total)), "base_score": pa.array(per(base)), "score": pa.array(got)}
        return pa.table(cols)

    sent = "bucket int, group int, a binary, b binary"
    probed = blobs.groupBy("group").applyInArrow(probe, f"{sent}, c binary")
    shared = probed.groupBy("bucket").applyInArrow(compare, sent)
    asked = blobs.groupBy("group").cogroup(shared.groupBy("group")).applyInArrow(ask, f"{sent}, c binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "bucket int, group int, a binary, c binary")
    return blobs.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
