"""Trees by pointer doubling, and nested threads."""

import json
import random

from sentilake.operators import trees

NODES = "c long, n long, p long, o long"


def plain(rows):
    """depth and position by a walk from each root."""
    out = {}
    for root in [r for r in rows if r[2] is None]:
        stack, i = [(root, 0)], 0
        while stack:
            r, depth = stack.pop()
            out[r[0], r[1]] = (depth, i)
            i += 1
            below = [x for x in rows if x[0] == r[0] and x[2] == r[1]]
            stack += [(x, depth + 1) for x in sorted(below, key=lambda x: (x[3], x[1]), reverse=True)]
    return out


def test_depth_and_preorder(spark):
    rng = random.Random(2)
    rows = [(c, n, rng.randrange(max(0, n - 4), n) if n else None, rng.randrange(3)) for c in range(4) for n in range(rng.choice([1, 30, 60]))]
    rows += [(None, 1, None, 0), (None, 2, 1, 0), (9, 1, None, 0), (9, 2, None, 1), (9, 3, 2, 0)]
    lost = [(1, 900, 901, 0), (1, 902, 900, 0), (2, 910, 911, 0), (2, 911, 910, 0), (2, 912, 912, 0), (2, 913, 912, 0)]
    frame, want = spark.createDataFrame(rows + lost, NODES), plain(rows)
    assert {(r.c, r.n): r.depth for r in trees.depths(frame, "c", "n", "p").collect()} == {k: d for k, (d, _) in want.items()}
    assert {(r.c, r.n): (r.depth, r.position) for r in trees.preorder(frame, "c", "n", "p", "o").collect()} == want
    assert trees.depths(frame.limit(0), "c", "n", "p").count() == 0 and trees.preorder(frame.limit(0), "c", "n", "p", "o").count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    stage = trees.staged
    monkeypatch.setattr(trees, "staged", lambda df: (written.append(1), stage(df))[1])
    rows = spark.range(10_000).selectExpr("1L as c", "id as n", "nullif(id - 1, -1) as p")
    got = trees.depths(rows, "c", "n", "p")
    assert got.where("depth = n").count() == 10_000 and len(written) < 20


def test_listings_are_flattened_in_preorder(spark):
    node = lambda body, *below, kind="t1": {"kind": kind, "data": {"body": body, "author": "a", "score": 3, "replies": {"data": {"children": list(below)}} if below else ""}}
    thread = [node("one", node("two", node("three")), node(" ")), node("gone", node("with it"), kind="more"), node("four\n x"), 7, node(None)]
    deep = node("end")
    for _ in range(200):
        deep = node("d", deep)
    rows = spark.createDataFrame([(1, json.dumps(thread)), (2, "[]"), (3, None), (4, "not json"), (5, "[" * 200_000), (6, json.dumps([deep])), (7, '{"x": 1}')], "id long, json string")
    got = [(r.id, r.position, r.depth, r.text) for r in trees.flatten_threads(rows, "json", "listing").orderBy("id", "position").collect()]
    assert got[:4] == [(1, 0, 0, "one"), (1, 1, 1, "two"), (1, 2, 2, "three"), (1, 3, 0, "four x")]
    assert [r[0] for r in got[4:]] == [6] * 201 and got[-1] == (6, 200, 200, "end")
    assert trees.flatten_threads(rows.limit(0), "json", "listing").count() == 0


def test_posts_with_replies_are_flattened(spark):
    post = lambda text, *below, **more: {"post": {"record": {"text": text, "createdAt": "c"}, "author": {"handle": "h"}, "uri": "u", "likeCount": 2} | more, "replies": list(below)}
    thread = {"post": {"record": {"text": "the post itself"}}, "replies": [post("a", post("b"), post("", post("c"))), {"post": None, "replies": [post("d", indexedAt="i")]}, "text", post("e", author=None)]}
    rows = spark.createDataFrame([(1, json.dumps(thread))], "id long, json string")
    got = [(r.depth, r.text, r.author, r.published_at, r.score, r.link) for r in trees.flatten_threads(rows, "json", "replies").orderBy("position").collect()]
    assert got == [(0, "a", "h", "c", 2, "u"), (1, "b", "h", "c", 2, "u"), (2, "c", "h", "c", 2, "u"), (1, "d", "h", "i", 2, "u"), (0, "e", None, "c", 2, "u")]


def test_items_name_their_kids(spark):
    items = [(i, "comment", f"<p>text &amp; {i}</p>", [i * 10 + 1, i * 10 + 2]) for i in (1, 2, 11, 12, 111, 1111)] + [(3, "job", "x", [31]), (31, "comment", "y", None), (4, "comment", " ", [41]), (41, "comment", "below a blank one", None), (5, "comment", "beyond", None)]
    got = trees.item_comments(spark.createDataFrame([(0, [1, 2, 3, 4, 5]), (9, None)], "id long, kids array<long>"), spark.createDataFrame(items, "id long, type string, text string, kids array<long>"), kids=4)
    assert {(r.story, r.id, r.depth) for r in got.collect()} == {(0, 1, 0), (0, 2, 0), (0, 11, 1), (0, 12, 1), (0, 41, 1), (0, 111, 2)}
    assert {r.text for r in got.where("id = 1").collect()} == {"text & 1"}
