"""Phrases, divergence and decontamination against plain Python, with nulls, blanks, repeats, ties and clashing names."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from sentilake.llm import cuts, decontaminate, divergence, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t ", "a", "b c", "Hello, WORLD! É ÉÈ été\x85x", "ΣΟΣ Σ", "x" * 5000, "one two.three four;;five \x00 six\x0bseven", "A b a B a b. a b"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, n=150, seed=3, vocabulary=12):
    rng = random.Random(seed)
    word = lambda: f"{'wÉß'[rng.randrange(3)]}{'abcdefghijkl'[min(rng.randrange(vocabulary), rng.randrange(vocabulary))]}"
    texts = [" ".join(word() + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(rng.choice([3, 30, 120]))) for _ in range(n)] + ODD
    texts += [texts[0], texts[0], "The hot phrase stays whole. " * 60]
    rows = [(i, t, rng.choice(["en", "en", "de", None, "und"]), rng.choice(["a", "b", "c", "É", None]), 1) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "a", 1)] * 2 + [(None, "no id here", None, None, None), (None, None, "xx", "alone", None), (None, "1 2 3", "yy", "p", 0), (None, None, "yy", "q", 0)]
    return spark.createDataFrame(rows, DOCS).withColumn("phrase", F.lit("clash")).withColumn("Row", F.lit(1)).withColumn("term", F.lit(1)), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_are_cut_as_a_plain_loop_cuts_them():
    texts = [*ODD, "Tail", "", None, ".", "x"]
    got = cuts.cut(pa.array(texts, pa.string()).slice(1), phrases.KINDS)
    want = []
    for i, t in enumerate(texts[1:]):
        for j, piece in enumerate(re.split("[.,;:!?\x0a-\x0d]", lower(t))):
            want += [(i, (i, j), w) for w in re.findall("[^\x20\x09]+", piece)]
    assert [got.words[int(c)].as_py().decode() for c in got.codes] == [w for *_, w in want]
    assert got.text.tolist() == [i for i, *_ in want]
    assert len(set(zip(got.piece.tolist(), [p for _, p, _ in want]))) == len(set(got.piece.tolist())) == len({p for _, p, _ in want})
    assert len(cuts.cut(pa.array([], pa.string()), phrases.KINDS).codes) == 0


def test_rows_are_gathered_whole():
    texts = ["x" * n for n in (0, 5, 30, 2, 2, 2, 100, 0, 1)] + [None]
    batches = pa.table({"text": texts, "i": range(len(texts))}).to_batches(max_chunksize=3)
    got = list(cuts.gathered(batches, "text", most=10))
    assert [r for t in got for r in t["i"].to_pylist()] == list(range(len(texts)))
    assert all(t.num_rows == 1 or sum(len(x or "") for x in t["text"].to_pylist()) <= 10 for t in got)


def plain_phrases(rows, least, longest, absorb, top):
    n, f = collections.Counter(), collections.Counter()
    for _, t, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(t)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    some = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in some.items():
        if any(100 * b >= absorb * a for (x, q), b in some.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


def phrase_rows(df):
    return [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()]


def test_phrases(spark, monkeypatch):
    docs, rows = documents(spark)
    for how in (dict(least=8, longest=5, absorb=100, top=2000), dict(least=5, longest=3, absorb=60, top=7)):
        got = phrase_rows(phrases.collocations(docs.repartition(3), **how))
        assert len(got) == len(set(got)) and set(got) == plain_phrases(rows, **how) and got
    # a table of bits that is nearly full admits more, and counts decide
    monkeypatch.setattr(phrases, "TABLE_BITS", 16)
    monkeypatch.setattr(phrases, "bit_table", lambda frequent, n: b"\xff" * (1 << 13))
    assert set(phrase_rows(phrases.collocations(docs, least=8))) == plain_phrases(rows, 8, 5, 100, 2000)
    assert phrases.collocations(empty(spark)).count() == 0 and phrases.collocations(docs, least=10**6).count() == 0


def test_scores_of_products_beyond_64_bits(spark):
    big = 10**13
    level = lambda rows: spark.createDataFrame([("en", p, n) for p, n in rows], "lang string, phrase string, n long")
    levels = [level([("", 7 * big), ("a", 3 * big + 1), ("b", 2 * big + 1), ("c", 2 * big)]), level([("a b", 2 * big), ("b c", big + 3)]), level([("a b c", big + 1)])]
    got = {r.phrase: (r.l, r.r, r.score) for r in phrases.scored(levels, absorb=101).collect()}
    n, f = 7 * big, {"a": 3 * big + 1, "b": 2 * big + 1, "c": 2 * big, "a b": 2 * big, "b c": big + 3}
    assert got["a b"] == (f["a"], f["b"], 1000 * 2 * big * n // (f["a"] * f["b"]))
    score, l, r = min((1000 * (big + 1) * n // (x * y), x, y) for x, y in ((f["a"], f["b c"]), (f["a b"], f["c"])))
    assert got["a b c"] == (l, r, score)


def test_a_hash_shared_by_unlike_phrases():
    rows = [np.array([0, 0, 1, 1, 0]), np.array([5, 6, 5, 5, 5])]
    first, n = phrases.alike(rows, np.zeros(5, np.uint64))
    assert sorted((rows[0][i], rows[1][i], c) for i, c in zip(first, n)) == [(0, 5, 2), (0, 6, 1), (1, 5, 2)]


def plain_audit(rows, least, top):
    count, docs, groups = collections.Counter(), collections.Counter(), set()
    for _, t, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
        groups.add((lang, source))
        count.update((lang, source, x) for x in terms)
        docs.update((lang, x) for x in set(terms))
    out = set()
    for lang in {x for x, _ in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = sorted((t for (x, t), n in docs.items() if x == lang and n >= least), key=str.encode)
        def share(names):
            c = [sum(count[lang, s, t] for s in names) for t in kept]
            return c, [1 + 10**9 * (n + 1) // (sum(c) + len(kept)) for n in c]
        own = {s: share([s]) for s in sources}
        base = share(sources)[1]
        for s in sources:
            pairs = [(-sum((p - q) ** 2 // q for p, q in zip(own[s][1], own[o][1])), o.encode()) for o in sources if o != s]
            terms = [(-((p - q) ** 2 // q), t.encode()) for t, n, p, q in zip(kept, *own[s], base) if n > 0 and p > q]
            out |= {(lang, s, part, x.decode(), -v, i) for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])) for i, (v, x) in enumerate(found, 1)}
    return out


def audit_rows(df):
    return [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]


def test_divergence(spark, monkeypatch):
    docs, rows = documents(spark, 200)
    got = audit_rows(divergence.audit(docs))
    want = plain_audit(rows, 3, 200)
    assert len(got) == len(set(got)) and set(got) == want and {r[2] for r in got} == {"pair", "term"}
    assert ("yy", "p", "pair", "q", 0, 1) in want  # a language that keeps no term
    # small chunks, blocks, ranges and slabs give the same
    for name, value in (("BLOCK", 2), ("RANGE_ROWS", 40), ("SLAB_ROWS", 7)):
        monkeypatch.setattr(divergence, name, value)
    encode = divergence.encode
    monkeypatch.setattr(divergence, "encode", lambda counts, least: encode(counts, least=least, chunk=5))
    assert set(audit_rows(divergence.audit(docs.repartition(5), least=3, top=4))) == plain_audit(rows, 3, 4)
    assert divergence.audit(empty(spark)).count() == 0


def test_shares_of_large_counts_are_exact():
    counts = np.array([[0, 1, 12_345_678_901_234, 10**15]])
    total = np.array([[3 * 10**15]])
    assert divergence.share(counts, total, 7).tolist() == [[1 + 10**9 * (c + 1) // (3 * 10**15 + 7) for c in counts[0].tolist()]]


GAPS = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def plain_hits(text, items, size):
    w = re.findall(GAPS, lower(text))
    hit, names = set(), set()
    for item, t in items:
        x = re.findall(GAPS, lower(t))
        k = min(len(x), size)
        for window in {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else ():
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) == window:
                    hit |= set(range(i, i + k))
                    names.add("" if item is None else str(item))
    return w, hit, sorted(names)


def leaky(spark, seed=5):
    rng = random.Random(seed)
    say = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    items = [(i, say(rng.choice([4, 12, 30]))) for i in range(12)] + [(12, "Two words"), (13, None), (14, " .. "), (3, "another text of item three, ten words or more it has"), (None, say(15)), (20, "É été Œuvre")]
    items += [(15, items[0][1]), (9, items[0][1])]
    texts = [say(rng.choice([2, 40, 150])) for _ in range(40)] + ODD
    for _ in range(40):
        t = (items[rng.randrange(len(items))][1] or "").split()
        texts.append(say(20) + " -- " + rng.choice([", ", " ", "\n"]).join(t[rng.randrange(2) :]).upper() + ". " + say(20))
    texts += ["two WORDS", "É été œuvre", "É ÉTÉ Œuvre é", items[1][1] + " " + items[1][1], (items[0][1] + " ") * 3, texts[-1], texts[-1]]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, texts[-1], "en", "s", 1), (7, texts[-2], "en", "s", 1)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    return spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash")).withColumn("leak_row", F.lit(2)), rows, bench, items


def test_contamination(spark, monkeypatch):
    docs, rows, bench, items = leaky(spark)
    for size, most in ((10, decontaminate.MOST), (3, 20)):
        got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs.repartition(3), bench, size=size, most=most).collect())
        want = collections.Counter()
        for i, t, *_ in rows:
            w, hit, names = plain_hits(t, items, size)
            want[i, len(w), len(hit), len(names), tuple(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
        assert got == want
    plan = decontaminate._looked_up
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect()) and plan


def test_equal_hashes_of_unlike_windows(spark, monkeypatch):
    docs, rows, bench, items = leaky(spark)
    monkeypatch.setattr(decontaminate.F, "xxhash64", lambda *c: F.length(F.concat_ws("", *[F.lit("") if isinstance(x, str) else x for x in c])).cast("long") % 7)
    got = collections.Counter((r.doc_id, r.n_hit) for r in decontaminate.contamination(docs, bench).collect())
    assert got == collections.Counter((i, len(plain_hits(t, items, 10)[1])) for i, t, *_ in rows)


def test_hit_words_or_documents_are_removed(spark):
    docs, rows, bench, items = leaky(spark)
    whole = decontaminate.decontaminate(docs, bench, spans=False)
    assert whole.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in whole.collect()) == collections.Counter((i, t) for i, t, *_ in rows if not plain_hits(t, items, 10)[1])
    want = collections.Counter()
    for i, t, *_ in rows:
        hit = plain_hits(t, items, 10)[1]
        pieces = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*", t or "")
        lead = re.match("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*", t or "")[0]
        want[i, lead + "".join(p for k, p in enumerate(pieces) if k not in hit) if hit else t] += 1
    spans = decontaminate.decontaminate(docs, bench)
    assert collections.Counter((r.doc_id, r.text) for r in spans.collect()) == want and spans.columns == docs.columns
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0


def test_sorts_with_places_in_low_bits():
    from sentilake.llm import language_model

    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 5), (1000, 10), (1000, 1 << 62), (200_000, 1 << 63), (5000, 3)):
        codes = rng.integers(0, top, n).astype(np.uint64)
        if top > 1 << 60:  # some share all but their lowest bits
            codes[: n // 3] = codes[: n // 3] & np.uint64(1023) | np.uint64(1 << 63)
        order = language_model.sorted_order(codes)
        assert (codes[order] == np.sort(codes)).all() and sorted(order.tolist()) == list(range(n))
        values = codes.astype(np.int64) & ((1 << 62) - 1)
        found, at = language_model.distinct(values)
        want, places = np.unique(values, return_inverse=True)
        assert (found == want).all() and (at == places).all()
