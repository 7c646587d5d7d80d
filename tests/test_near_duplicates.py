"""The fuzzy join against brute force: nothing that is similar enough is missed."""

import random

import pytest
from sentilake.functions import plan
from sentilake.functions import texts as T
from sentilake.operators import cleaning, stores

KINDS = "doc_id long, topic string, cleaned string, status string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def documents(n=160):
    rng = random.Random(6)
    out = []
    for i in range(n):
        words = [f"{'wé'[rng.randrange(2)]}{min(rng.randrange(300), rng.randrange(300))}" for _ in range(rng.choice([1, 4, 12, 30]))]
        if out and rng.random() < 0.6:
            words = (rng.choice(out)[2] or "x").split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(99)}"
            if rng.random() < 0.2:
                words = words[1:] or ["y"]
        out.append((i, rng.choice(["t", "t", "u", None]), " ".join(words), rng.choice(["accepted"] * 5 + ["failed"])))
    return out + [(n, "t", "  ", "accepted"), (n + 1, "t", None, "accepted"), (n + 2, "t:1", "a b", "accepted"), (n + 3, "t", "1:a b", "accepted")]


@pytest.mark.parametrize("candidates", [250, 15])
def test_equal_to_brute_force(spark, monkeypatch, candidates):
    rows = documents()
    ok = [(i, t, c, set(c.split(" "))) for i, t, c, s in rows if s == "accepted" and (c or "").strip()]
    want, compared = {}, 0
    for i, t, c, w in ok:
        found = []
        for j, _, d, x in [r for r in sorted(ok, reverse=True, key=lambda r: r[0]) if r[1] == t][:candidates]:
            compared += i != j
            if i != j and 2 * len(w & x) >= 0.8 * (len(w) + len(x)):
                score = 100 - 100 * distance(c, d) / max(len(c), len(d))
                if score >= 93:
                    found.append((score, j))
        if found:
            want[i] = (max(found)[1], round(max(found)[0], 4))
    verified = []
    matches = stores.word_matches

    def counted(*given):
        out = plan.staged(matches(*given))
        verified.append(out.count())
        return out

    monkeypatch.setattr(stores, "word_matches", counted)
    got = {r.doc_id: (r.match_id, pytest.approx(r.score)) for r in stores.near_duplicates(spark.createDataFrame(rows, KINDS), candidates=candidates).collect()}
    assert got == want and len(want) > 10
    assert 0 < verified[0] < 0.15 * compared
    # without broadcasts, and with hot keys kept where they are
    monkeypatch.setattr(plan, "SMALL", 1)
    monkeypatch.setattr(stores, "INDEX_ROWS", 1)
    assert {r.doc_id: (r.match_id, pytest.approx(r.score)) for r in stores.near_duplicates(spark.createDataFrame(rows, KINDS), candidates=candidates).collect()} == want


def test_a_page_in_a_third_of_all_rows_is_marked_where_it_lies(spark, monkeypatch):
    monkeypatch.setattr(plan, "SMALL", 1)
    rows = [(i, "t", "the same page" if i % 3 == 0 else f"page {i}", "accepted") for i in range(3000)] + [(5000, None, "the same page", "accepted"), (5001, None, "the same page", "accepted"), (5002, "t", "the same page", "failed"), (5003, "t", " ", "accepted")]
    got = {r.doc_id: (r.status, r.duplicate_of) for r in cleaning.mark_duplicates(spark.createDataFrame(rows, KINDS)).collect()}
    assert len(got) == len(rows) and all(got[i] == ((("duplicate", 0) if i else ("accepted", None)) if i % 3 == 0 else ("accepted", None)) for i in range(3000))
    assert got[5000] == ("accepted", None) and got[5001] == ("duplicate", 5000) and got[5002] == ("failed", None) and got[5003] == ("accepted", None)


def test_texts_of_one_vocabulary_are_not_compared(spark, monkeypatch):
    """Words that all texts draw from put no pair of them to the test; pairs that share enough are all there."""
    rng = random.Random(3)
    rows = [(i, "t", " ".join(rng.sample([f"w{k}" for k in range(600)], 60)), "accepted") for i in range(60)]
    rows += [(100 + i, "t", c.replace("w1 ", "x "), "accepted") for i, _, c, _ in rows[:5]]
    verified = []
    matches = stores.word_matches

    def counted(*given):
        out = plan.staged(matches(*given))
        verified.extend(out.where("text is not null").collect())
        return out

    monkeypatch.setattr(stores, "word_matches", counted)
    got = {(r.doc_id, r.match_id) for r in stores.near_duplicates(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == {p for i in range(5) for p in ((i, 100 + i), (100 + i, i))}
    # each text meets itself; of the others nearly none
    assert len(verified) < 2 * len(rows)
    # the same where pairs and candidates are too many to be broadcast
    monkeypatch.setattr(stores, "PAIR_ROWS", 0)
    monkeypatch.setattr(stores, "OTHER_BYTES", 0)
    assert {(r.doc_id, r.match_id) for r in stores.near_duplicates(spark.createDataFrame(rows, KINDS)).collect()} == got


def test_distance_in_a_band():
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abé\U0001f600") for _ in range(n))
    for _ in range(2000):
        a = some(rng.randrange(14))
        b = list(a if rng.random() < 0.7 else some(rng.randrange(14)))
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "a", "bé"])
        want, most = distance(a, "".join(b)), rng.randrange(12)
        assert T.distance(a, "".join(b), most) == (want if want <= most else -1), (a, b, most)
    a = some(700)
    b = a[:50] + "x" + a[90:400] + "yé" + a[398:]
    assert T.distance(a, b, 80) == T.distance(b, a, 700) == distance(a, b) and T.distance(a, b, 20) == -1


def test_no_distance_over_all_pairs_of_letters(spark, monkeypatch):
    """Spark's own distance walks over all of them, whatever its bound."""
    plans, staged = [], stores.staged
    monkeypatch.setattr(stores, "staged", lambda df: plans.append(df._jdf.queryExecution().toString()) or staged(df))
    rows = [(i, "t", f"long text of number {i} " + "and so on " * 30, "accepted") for i in range(3)]
    assert {(r.doc_id, r.match_id) for r in stores.near_duplicates(spark.createDataFrame(rows, KINDS)).collect()} == {(0, 2), (1, 2), (2, 1)}
    assert plans and not any("levenshtein(" in p for p in plans)
