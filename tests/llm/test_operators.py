"""Each operator against a brute-force version, with nulls, blanks, repeats, ties and clashing names."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from sentilake.llm import knn, language_id, language_model, mixing, packing, quality, simhash, token_counts, token_output, tokens, url_filter
from sentilake.llm.components import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t ", "a", "b c", "The cat's <|endoftext|> É, sat\x85on...", "ΣΟΣ Σ", "word " * 700 + "end"]


def words(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", ",", ".", "\n"]) for _ in range(n))


def documents(spark, n=120, seed=1):
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([3, 20, 90, 400])) for _ in range(n)] + ODD
    texts += [texts[0], texts[0], texts[3] + " tail", texts[3] + " tail "]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "a", 1), (5, texts[5], "en", "a", 1), (None, "no id here", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("group", F.lit("clash")).withColumn("Fingerprint", F.lit(1)).withColumn("words", F.lit(1)), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- tokens, 1, 4, 6 ---


def true_ids(text, end=1):
    from tokenizers import Tokenizer

    true_ids.t = getattr(true_ids, "t", None) or Tokenizer.from_file(TOKENIZER)
    return true_ids.t.encode(text or "", add_special_tokens=False).ids + [end]


def test_word_ids_equal_the_tokenizer():
    rng, own = random.Random(3), tokens.WordIds(TOKENIZER)
    letters = "aBz'sé́éÉ0½ßſ²ª,,..   \t\n\x0b\x1c\x85ΣςİK🙂ﬁ-_|<>"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30))) + rng.choice(["", " <|endoftext|> x"])
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == true_ids(text)[:-1], text


def test_packing_loses_nothing(spark):
    docs, rows = documents(spark)
    pieces = packing.pack_documents(docs, TOKENIZER, capacity=256, group_bytes=20_000).collect()
    parts = collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        parts[p.doc_id].append(p)
    want = collections.defaultdict(collections.Counter)
    for doc_id, text, *_ in rows:
        want[doc_id][tuple(true_ids(text))] += 1
    assert parts.keys() == want.keys()
    for doc_id, counter in want.items():
        if sum(counter.values()) == 1:
            got = sorted(parts[doc_id], key=lambda p: p.start)
            assert [p.start for p in got] == [0, *np.cumsum([p.length for p in got])[:-1].tolist()]
            assert tuple(np.frombuffer(b"".join(p.ids for p in got), "<u4").tolist()) in counter
            assert {p.doc_tokens for p in got} == {len(next(iter(counter)))}
        assert sum(p.length for p in parts[doc_id]) == sum(len(k) * n for k, n in counter.items())
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    sizes = []
    for content in sequences.values():
        content.sort(key=lambda p: p.offset)
        assert [p.offset for p in content] == [0, *np.cumsum([p.length for p in content])[:-1].tolist()]
        sizes.append(sum(p.length for p in content))
    assert max(sizes) <= 256
    assert packing.padding(np.array(sizes), 256) < 0.07 * sum(sizes)
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0


def test_first_fit_and_best_fit_are_what_they_say():
    rng = random.Random(5)
    for _ in range(200):
        sizes = sorted((rng.randrange(1, 65) for _ in range(rng.randrange(40))), reverse=True)
        first, room = [], []
        for i, s in enumerate(sizes):
            at = next((b for b, r in enumerate(room) if r >= s), len(room))
            if at == len(room):
                room.append(64)
                first.append([])
            room[at] -= s
            first[at].append(i)
        assert packing.first_fit_decreasing(sizes, 64) == first
        best = token_output.best_fit_decreasing(sizes, 64)
        room = []
        where = {i: b for b, items in enumerate(best) for i in items}
        for i, s in enumerate(sizes):
            fits = [r for r in room if r >= s]
            if where[i] == len(room):
                assert not fits
                room.append(64)
            else:
                assert room[where[i]] == min(fits)
            room[where[i]] -= s
        assert sorted(where) == list(range(len(sizes)))


def test_token_matrices_round_trip(spark):
    docs, rows = documents(spark)
    rows = [r for r in rows if r[0] not in (5, None)]
    once = spark.createDataFrame(rows, DOCS)
    out = token_output.token_matrices(once, TOKENIZER, capacity=256, group_bytes=20_000)
    for r in out.collect():
        ends, positions = r.cu_seqlens, np.frombuffer(r.position_ids, "<i4")
        assert ends[0] == 0 and ends[-1] == r.n_tokens <= 256 and len(r.input_ids) == 1024 and len(positions) == 256
        assert all(positions[a:b].tolist() == list(range(b - a)) for a, b in zip(ends, ends[1:]))
    assert {r.doc_id: r.ids for r in token_output.read_documents(out).collect()} == {i: true_ids(t) for i, t, *_ in rows}
    assert token_output.token_matrices(docs, TOKENIZER).agg(F.sum("n_tokens")).head()[0] == sum(len(true_ids(t)) for _, t, *_ in documents(spark)[1])
    assert token_output.token_matrices(empty(spark), TOKENIZER).count() == 0


def test_token_counts_equal_a_plain_viterbi(spark):
    model = token_counts.public_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))

    def viterbi(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            found = [(best[a][0] + model.scores[word[a:end]], best[a][1] - 1) for a in range(max(0, end - model.longest), end) if word[a:end] in model.scores]
            if word[end - 1] not in model.scores:
                n = len(word[end - 1].encode())
                found.append((best[end - 1][0] + n * model.byte_score, best[end - 1][1] - n))
            best.append(max(found))
        return -best[-1][1]

    docs, rows = documents(spark)
    rows = rows + [(800, "x" * 5000 + " " + "y" * 70 + " 😀😀 a😀b ￿ 𝔘𝔫𝔦", "en", "a", 1), (801, " ".join(f"https://example.org/very/long/path/{i}" for i in range(300)), "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit(1)).withColumn("row", F.lit(1))
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = [sorted((r.doc_id is None, r.doc_id or 0, r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(docs, path, **how).collect()) for how in ({}, {"head": 20, "part": 50}, {"head": 0, "part": 7, "prefixes": (1, 2)})]
    got = found[0]
    assert found[1] == got and found[2] == got
    split = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t, *_ in rows]
    assert got == sorted((i is None, i or 0, len(ws), sum(viterbi(token_counts.MARK + w) for w in ws)) for i, ws in split)
    assert token_counts.corpus_counts(token_counts.count_tokens(empty(spark), public_tokenizers.path("piece_bpe_32k.model")))["tokens"] == 0


# --- 2 ---


def test_urls(spark):
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"))
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x#y", "http://example.net", "http://example.net/", "http://badexample.net/en/", "x://net#/a", "http://h/a b/Ä", "http://h/2024-01-02/" + "a" * 5000]
    urls += [f"http://bad.org/spam/{i}" for i in range(200)] + [f"http://bad.org/good/{i}" for i in range(200)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, None), (None, "http://h/")], "page_id long, url string").withColumn("host", F.lit(1))
    labels = spark.createDataFrame([(i, 0 if "spam" in (u or "") else 1) for i, u in enumerate(urls) if i % 2] + [(None, 0), (3, None)], "doc_id long, quality int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, labels, rules).collect()}
    assert len(got) == len(urls) + 1
    for i in (0, 1, 2):
        assert (got[i].host, got[i].path, got[i].rule) == ("", "", None)
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5].rule is None and (got[6].rule, got[6].verdict) == ("net/", "block")
    assert got[7].rule == "net/" and (got[8].host, got[8].path) == ("net", "")
    for i, u in enumerate(urls):
        if u and "bad.org" in u:
            assert got[i].verdict == ("block" if "spam" in u else "allow"), u
    assert url_filter.judge_urls(pages.limit(0), labels, rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, labels.limit(0), ()).collect()} == {"allow"}


def test_a_rare_bad_branch_keeps_its_template(spark):
    rows = [(100 * s + i, f"http://h.org/s{chr(97 + s)}/x{chr(97 + i % 26)}") for s in range(25) for i in range(40)]
    rows += [(9000, "http://h.org/lone/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i // 100 == 7 or i == 9000 else 1) for i, _ in rows], "doc_id long, quality int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, labels, ()).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].verdict == ("block" if i // 100 == 7 else "allow"), i
    assert got[700].template.startswith("/sh/") and got[0].template.startswith("/(sa..sy)/") and got[9000].template == "/lone/**"


def test_templates_keep_static_segments_and_find_a_bad_deep_one(spark):
    rng = random.Random(4)
    slug = lambda: "".join(rng.choice("ghijklmnop") for _ in range(9))
    urls = [f"http://h.org/blog/2024-01-0{i % 9 + 1}/{slug()}/post" for i in range(300)] + [f"http://h.org/a/b/c/d/e/f/{'cheap' if i % 3 == 0 else 'good'}/{slug()}/x.html" for i in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if "cheap" in u and i % 20 else 1) for i, u in enumerate(urls) if i % 2], "doc_id long, quality int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, labels, ()).collect()}
    for i, u in enumerate(urls):
        assert got[i].verdict == ("block" if "cheap" in u else "allow"), u
    assert {r.template for r in got.values()} == {"/blog/{date}/*/post", "/a/b/c/d/e/f/cheap/*/x.html", "/a/b/c/d/e/f/good/*/x.html"}
    # the same labels at random reject nothing
    noise = spark.createDataFrame([(i, int(rng.random() < 0.86)) for i in range(len(urls))], "doc_id long, quality int")
    assert {r.verdict for r in url_filter.judge_urls(pages, noise, ()).collect()} == {"allow"}


# --- 3 ---


def test_language_is_found_on_held_out_texts(spark):
    stems = {"en": ["the", "of", "ing", "tion", "and", "er"], "de": ["der", "und", "sch", "ein", "ung", "ich"], "fr": ["le", "eau", "oux", "ment", "que", "é"]}
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(40)), lang) for i in range(600) for lang in [rng.choice(list(stems))]]
    docs = spark.createDataFrame(rows + [(None, "x", "en"), (1000, None, "en"), (1001, "12 !!", "de"), (1002, "", None)], "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.learn(docs.where(~held))
    got = {r.doc_id: r.language for r in language_id.identify(docs, model).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang in test) > 0.97 * len(test)
    assert all(got[i].lang_pred == "und" and not got[i].accepted for i in (1000, 1001, 1002))
    assert all(0 <= x.score <= 1 for x in got.values())
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() > 590
    nothing = language_id.learn(docs.limit(0))
    assert {r.language.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


# --- 5 ---


def plain_simhash(text, n=3):
    ws = [w for w in (text or "").encode().lower().split()]
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or [b" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, close):
    root = list(range(n))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in close:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return [up(x) for x in range(n)]


def test_anchors_cover_every_close_pair(spark):
    rng = random.Random(8)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(10):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            values.add(x)
    base = rng.getrandbits(64)
    values |= {base ^ (1 << i) for i in range(64)} | {0, (1 << 64) - 1, (1 << 31), (1 << 63), base}
    values = sorted(values)
    want = plain_components(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3])
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for homes in (4096, 2):  # with 2 homes a chunk, crowded anchors are split
        links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), homes=homes).collect()
        at = {v: i for i, v in enumerate(signed)}
        assert all((values[at[r.a]] ^ values[at[r.b]]).bit_count() >= 1 for r in links)
        assert plain_components(len(values), [(at[r.a], at[r.b]) for r in links]) == want


def test_near_duplicates(spark):
    docs, rows = documents(spark)
    long = words(random.Random(4), 900, 5000)
    extra = [(900 + i, long.replace("w17", f"v{i}", 1), "en", "a", 1) for i in range(6)]
    docs = docs.unionByName(spark.createDataFrame(extra, DOCS), allowMissingColumns=True)
    rows = rows + extra
    prints = [plain_simhash(r[1]) for r in rows]
    root = plain_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[root[i]] += [r[0]] if r[0] is not None else []
    want = collections.Counter((r[0], f"{p:016x}", min(least[root[i]], default=None)) for i, (r, p) in enumerate(zip(rows, prints)))
    assert collections.Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(min(v, default=None) for v in (least[x] for x in set(root)))
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def test_each_component_of_a_shared_id_keeps_one(spark):
    a, b, c, d = (words(random.Random(i), 300, 5000) for i in range(4))
    rows = [(7, a), (7, b), (1, b), (7, b), (9, c), (9, d), (9, d), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == sorted([(7, a), (1, b), (9, c), (9, d)])
    hot = spark.createDataFrame([(5, words(random.Random(i), 200, 5000), "en", "s", 0) for i in range(40)] + [(5, a, "en", "s", 0)] * 20, DOCS)
    assert simhash.keep_one(hot).count() == 41


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (60, 61), (61, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(30)} | {60: 60, 61: 60}


# --- 7 ---


def plain_scores(texts):
    """(n_tokens, n_known, train_tokens, base_score, score) of (held_out, words), by a walk over plain dictionaries."""
    end = language_model.END
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for out, ws in texts:
        if not out:
            one.update(ws)
            two.update(zip([end, *ws], ws))
            three.update(zip([end, *ws], ws, ws[1:]))
    total, distinct = sum(one.values()), len(one)
    n1, n2 = sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values())
    d, (k, once, often) = n1 / (n1 + 2 * n2), language_model.CONCENTRATION
    k2 = lambda h: often if two[h] > 1 else once
    alone = lambda w: (one[w] - d) / total if one[w] else d * distinct / total
    after = lambda v, w: (two[v, w] + k * alone(w)) / (one[v] + k)
    after2 = lambda u, v, w: (three[u, v, w] + k2((u, v)) * after(v, w)) / (two[u, v] + k2((u, v)))
    assert abs(sum(alone(w) for w in one) + alone(None) - 1) < 1e-9
    assert all(abs(sum(after(v, w) for w in one) + after(v, None) - 1) < 1e-9 for v in list(one)[:5])
    assert all(abs(sum(after2(u, v, w) for w in one) + after2(u, v, None) - 1) < 1e-9 for u, v in [p for p in two if p[1] != end][:5])
    for out, ws in texts:
        state, score = (end,), 0.0
        for w in ws:
            while True:
                if len(state) == 2 and three[(*state, w)]:
                    score += np.log10(after2(*state, w))
                elif len(state) == 1 and two[(*state, w)]:
                    score += np.log10(after(*state, w))
                elif not state:
                    score += np.log10(alone(w))
                else:
                    score += np.log10(k2(state) / (two[state] + k2(state)) if len(state) == 2 else k / (one[state[0]] + k))
                    state = state[1:]
                    continue
                break
            state = (*state, w)[-2:]
            while state and not (two[state] if len(state) == 2 else one[state[0]]):
                state = state[1:]
        base = sum(np.log10((one[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        yield len(ws), sum(one[w] > 0 for w in ws), total, round(float(base), 6), round(float(score), 6)


def test_language_model_equals_a_sequential_walk(spark):
    docs, rows = documents(spark)
    rng = random.Random(9)
    rows = rows + [(700, words(rng, 5000, 30), "en", "a", 1), (701, "w1 " * 4000, "en", "a", 1), (702, words(rng, 3000, 900), "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("group", F.lit("clash")).withColumn("score", F.lit(1))
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in language_model.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, group_bytes=9000, bucket_bytes=9000).collect())
    texts = [(i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, [*(t or "").encode().lower().split(), language_model.END]) for i, t, *_ in rows]
    want = collections.Counter((i, out, *found) for (i, out, _), found in zip(texts, plain_scores([x[1:] for x in texts])))
    near = lambda c: sorted(((*map(repr, x[:5]), round(x[5], 4), round(x[6], 4)) for x in c.elements()))
    assert near(got) == near(want)
    assert language_model.score_texts(empty(spark), F.lit(False)).count() == 0
    assert {r.score for r in language_model.score_texts(docs, F.lit(True)).collect()} == {0.0}


def test_short_hashes_come_back(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000, 1 << 14, 40_000):
        x = np.sort(rng.integers(0, 1 << 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (language_model.thick(language_model.thin(x)) == x).all()


# --- 8 ---


@pytest.mark.parametrize("pivots,group,block", [(8, 4, 50), (128, 1024, 16_384)])
def test_top_k_is_exact(spark, pivots, group, block):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)))]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400, None), (401, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (460, []), (405, [1e300, 0.0, 0.0, 0.0, 0.0, 0.0]), (None, rows[1][1]), (420, [1.0, 2.0]), (421, [3.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    held = lambda x: max(-knn.MOST, min(knn.MOST, x))
    usable = [(i, [int(np.floor(held(64 * x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in usable:
        if q % 20 == 0:
            dot = lambda w: max(knn.LEAST + 1, min(-knn.LEAST, sum(a * b for a, b in zip(v, w))))
            found = sorted((-dot(w), c) for c, w in usable if c != q and len(w) == len(v))[:20]
            want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(found)}
    got = knn.top_k(frame, F.col("vec_id") % 20 == 0, pivots=pivots, group_queries=group, block=block).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert knn.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_clustered_vectors_are_pruned(spark):
    rng = np.random.default_rng(5)
    centres = 40 * rng.normal(size=(30, 8))
    spread = {"clustered": centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 8)), "even": rng.normal(size=(6000, 8))}
    share = {}
    for name, x in spread.items():
        rows = [(int(i), [float(y) for y in v]) for i, v in enumerate(x)]
        computed = spark.sparkContext.accumulator(0)
        got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, computed=computed, block=1000, group_queries=100).collect()
        share[name] = computed.value / (300 * 6000)
        z = np.floor(64 * x).astype(np.int64)
        for q in range(0, 6000, 600):
            s = z @ z[q]
            s[q] = -(1 << 60)
            order = np.lexsort((np.arange(6000), -s))[:20]
            assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(int(i), int(s[i])) for i in order]
    print("share of pairs computed", share)
    assert share["clustered"] < 0.2 and share["clustered"] < share["even"] <= 1


def plain_top_k(rows, k):
    want = set()
    for q, v in {(i, len(v)): min(w for j, w in rows if j == i and len(w) == len(v)) for i, v in rows if i % 20 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q[0] and len(w) == len(v))[:k]
        want |= {(q[0], n + 1, c, -s) for n, (s, c) in enumerate(found)}
    return want


@pytest.mark.parametrize("size", [1e6, 1e8, 3e12])
def test_top_k_of_large_components(spark, size):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-size, size) for _ in range(4)]) for i in range(200)]
    held = {i: [int(np.floor(64.0 * x)) for x in v] for i, v in rows}
    dot = lambda a, b: max(knn.LEAST + 1, min(-knn.LEAST, sum(x * y for x, y in zip(held[a], held[b]))))
    want = {(q, rank, v, -s) for q in range(0, 200, 20) for rank, (s, v) in enumerate(sorted((-dot(q, v), v) for v in held if v != q)[:20], 1)}
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_top_k_of_many_lengths_and_repeated_ids(spark):
    many = [(20 * n + i, [(n * 7 + i * j) % 5 - 2 for j in range(n)]) for n in range(1, 1106) for i in range(3)]
    assert len({len(v) for _, v in many}) == 1105
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in many], "vec_id long, embedding array<double>")
    got = knn.top_k(frame, F.col("vec_id") % 20 == 0, scale=1.0, lengths=1).collect()
    # ids are apart, so each query meets the other two of its length
    at = {i: v for i, v in many}
    assert len(got) == 2 * 1105 and {r.query_id for r in got} == {20 * n for n in range(1, 1106)}
    assert all(len(at[r.query_id]) == len(at[r.vec_id]) and r.score == sum(a * b for a, b in zip(at[r.query_id], at[r.vec_id])) for r in got)
    rng = random.Random(3)
    tight = [(20, [100, 0])] * 25 + [(1000 + i, [rng.randrange(-9, 10), rng.randrange(-9, 10)]) for i in range(61) if i % 20]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in tight], "vec_id long, embedding array<double>")
    got = knn.top_k(frame, F.col("vec_id") % 20 == 0, scale=1.0).collect()
    assert {tuple(r) for r in got} == plain_top_k(tight, 20) and len(got) == 20


# --- 9, 10 ---


def test_quality_counts_and_verdicts(spark):
    docs, rows = documents(spark)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        ws = [w.decode() for w in (t or "").encode().split()]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        seen = collections.Counter(zip(ws, ws[1:], ws[2:]))
        covered = {j + d for j, g in enumerate(zip(ws, ws[1:], ws[2:])) if seen[g] > 1 for d in range(3)}
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        want[i, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert got == want
    clash = docs.withColumn("n_words", F.lit("mine")).withColumn("key", F.lit(1)).withColumn("kept", F.lit(True)).withColumn("row", F.lit(2))
    kept = quality.keep_good(clash)
    assert kept.columns == clash.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r.doc_id for r in quality.judge(docs).where("kept").collect())
    assert quality.judge(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0


def test_junk_is_beyond_the_fences(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 100, 10_000), "en", "s", 0) for i in range(400)] + [(1000 + i, " ".join(f"w{rng.randrange(10_000)}###$$$" for _ in range(100)), "en", "s", 0) for i in range(5)]
    out = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, DOCS)).where("not kept and not base_failed").collect()}
    assert {1000 + i for i in range(5)} <= out and len(out) <= 4 * 0.02 * len(rows)


def test_fences_are_the_groups_own(spark):
    rng = random.Random(7)
    text = lambda share: " ".join(f"w{rng.randrange(10_000)}" + "#" * (rng.random() < share) for _ in range(200))
    same = text(0.08)
    rows = [(i, text(0.02 * rng.random()), "en", "plain", 0) for i in range(300)] + [(1000 + i, text(0.2 * rng.random()), "en", "code", 0) for i in range(300)]
    rows += [(5000, same, "en", "plain", 0), (5001, same, "en", "code", 0), (5002, same, "en", "few", 0), (5003, same, None, None, 0)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[5000].kept and got[5001].kept
    assert got[5000].max_symbols < got[5002].max_symbols <= got[5001].max_symbols
    # each fence leaves the stated share of its group beyond, or less
    for name, ids in (("plain", range(300)), ("code", range(1000, 1300))):
        assert sum(1000 * got[i].n_symbols // got[i].word_chars > got[i].max_symbols for i in ids) <= 0.03 * 300, name


def test_sketch_buckets_are_close(spark):
    values = [0, 1, 31, 32, 33, 63, 64, 1000, 12_345, 10**12]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.value_of(quality.bucket(F.col("v"))).alias("low")).collect()
    assert all(r.low <= r.v <= r.low * 17 / 16 for r in got) and [r.low for r in got[:4]] == values[:4]


def test_mixing(spark):
    docs, rows = documents(spark, 400)
    size = lambda t: len((t or "").encode().split())
    got = mixing.mix(docs).collect()
    total = sum(size(t) for _, t, *_ in rows)
    own = collections.Counter()
    for r in rows:
        own[r[3]] += size(r[1])
    order = sorted((s for s in own if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, fixed = {}, {}
    while True:
        rest = 1.5 * total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} | fixed
        over = [s for s in free if target[s] > 2 * own[s]]
        if not over:
            break
        fixed |= {s: 2 * own[s] for s in over}
    taken = collections.Counter()
    assert sorted(r.size for r in got) == sorted(size(r[1]) for r in rows)
    for r in got:
        s = next(s for s in order if own[s] == r.source_size)
        taken[s] += r.taken
        assert r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
    largest = max(size(r[1]) for r in rows)
    assert all(abs(taken[s] - target[s]) <= 3 * largest for s in order)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert sum(size(r.text) for r in mixed.collect()) == sum(taken.values())
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.apply_mix(empty(spark)).count() == 0


def test_null_and_repeated_ids_come_near_their_target(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, 10), "en", "a", 0) for i in range(300)] + [(None, words(rng, 10), "en", "b", 0) for _ in range(300)] + [(1007, words(rng, 10), "en", "c", 0) for _ in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    for i, target in ((None, 5000), (1007, 2500)):
        mine = [r for r in got if r.doc_id == i]
        assert len(mine) == 300 and {r.target for r in mine} == {target} and abs(sum(r.taken for r in mine) - target) <= 10


def test_mixing_of_many_sources_is_the_same(spark, monkeypatch):
    docs, _ = documents(spark, 200)
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=repr), sorted((repr(r) for r in mixing.apply_mix(docs).collect()))
    monkeypatch.setattr(mixing, "SMALL", 1)
    assert (sorted(map(tuple, mixing.mix(docs).collect()), key=repr), sorted((repr(r) for r in mixing.apply_mix(docs).collect()))) == want


def test_sums_of_what_comes_before(spark):
    rng = random.Random(3)
    rows = [(None if i == 7 else f"s{rng.randrange(1000):04d}-{i}", rng.randrange(100)) for i in range(500)]
    got = mixing.before(spark.createDataFrame(rows, "k string, v long"), [F.col("k").asc_nulls_last()], {"n": F.lit(1).cast("long"), "s": F.col("v")}, each=40).collect()
    total = 0
    for i, r in enumerate(sorted(got, key=lambda r: (r.k is None, r.k or ""))):
        assert (r.n, r.s) == (i, total)
        total += r.v
