"""Trees of rows with a parent, by pointer doubling, and threads that come as nested JSON.

Every node follows its parent; in each round it follows instead whom that one followed, so
that a tree of depth d takes about log2(d) rounds, each one written table. For pre-order
the pointers run along the Euler tour, which enters and leaves each node once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions.plan import staged


def follow(links: DataFrame, *sums: str) -> DataFrame:
    """Where each pointer leads in the end, and what lies on the way.

    ``links`` has tree, node (unique in its tree), next (null at an end) and numbers; a result
    row has tree, node, the end it reaches as ``last``, and of each number the sum over
    the nodes from this one to the end, itself included. Nodes that reach no end, since
    a pointer leads nowhere or round in a circle, are left out.
    """
    rows = staged(links.select("tree", "node", "next", F.col("node").alias("last"), *sums))
    open_ = rows
    names = ["next", "last", *sums]
    for _ in range(max(rows.count(), 1).bit_length()):  # no way to an end is longer
        ahead = open_.select(F.col("tree").alias("__tree"), F.col("node").alias("__node"), *[F.col(c).alias(f"__{c}") for c in names])
        going = open_.where("next is not null").join(ahead, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("next") == F.col("__node")))
        further = going.select("tree", "node", F.col("__next").alias("next"), F.col("__last").alias("last"), *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in sums])
        # ends stay for those who come to follow them
        open_ = staged(further.unionByName(open_.where("next is null")))
        if open_.where("next is not null").isEmpty():
            return open_.drop("next")
    return open_.where("next is null").drop("next")


def depths(nodes: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """Tree, node, parent and depth of all nodes that hang on a root, whose parent is null. What hangs on nothing or in a circle is left out."""
    links = nodes.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("next"), F.lit(1).cast("long").alias("n"))
    found = follow(links, "n").select(F.col("tree").alias("__tree"), F.col("node").alias("__node"), (F.col("n") - 1).alias("depth"))
    return nodes.select(tree, node, parent).join(found, F.col(tree).eqNullSafe(F.col("__tree")) & (F.col(node) == F.col("__node"))).select(tree, node, parent, "depth")


def preorder(nodes: DataFrame, tree: str, node: str, parent: str, order: str) -> DataFrame:
    """Tree, node, parent, depth and ``position``, from 0, in pre-order; children go by ``order``, then by node, and several roots of a tree each count from 0.

    The tour enters a node, then goes through its children, and leaves it; what comes next
    is told by the first child or the next one of its parent. Doubled pointers along it
    count the nodes still to be entered.
    """
    rows = nodes.select(F.col(tree).alias("tree"), F.col(node).alias("id"), F.col(parent).alias("up"), F.struct(F.col(order).alias("o"), F.col(node).alias("id")).alias("place"))
    siblings = Window.partitionBy("tree", "up").orderBy("place")
    rows = staged(rows.withColumn("after", F.when(F.col("up").isNotNull(), F.lead("id").over(siblings))))
    first = rows.where("up is not null").groupBy(F.col("tree").alias("__tree"), F.col("up").alias("__up")).agg(F.min("place").alias("first"))
    met = rows.join(first, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("id") == F.col("__up")), "left")
    at = lambda i, leaves: F.struct(F.col(i).alias("id"), F.lit(leaves).alias("leaves"))
    enter = F.struct(at("id", False).alias("node"), F.when(F.col("first").isNotNull(), at("first.id", False)).otherwise(at("id", True)).alias("next"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("deeper"))
    leave = F.struct(at("id", True).alias("node"), F.when(F.col("after").isNotNull(), at("after", False)).when(F.col("up").isNotNull(), at("up", True)).alias("next"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("deeper"))
    tour = follow(met.select("tree", F.explode(F.array(enter, leave)).alias("e")).select("tree", "e.*"), "n", "deeper").where("not node.leaves")
    # the root's own entry has all entries of the tour before it
    whole = tour.where("node.id = last.id").select(F.col("tree").alias("__tree"), F.col("last.id").alias("__root"), F.col("n").alias("entries"))
    placed = tour.join(whole, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("last.id") == F.col("__root")))
    placed = placed.select(F.col("tree").alias("__t"), F.col("node.id").alias("__id"), (-F.col("deeper")).alias("depth"), (F.col("entries") - F.col("n")).alias("position"))
    return nodes.select(tree, node, parent).join(placed, F.col(tree).eqNullSafe(F.col("__t")) & (F.col(node) == F.col("__id"))).select(tree, node, parent, "depth", "position")


# --- threads as services write them ---

COMMENT = "position long, depth long, author string, text string, published_at string, score long, link string"


def _listed(node) -> Iterator[tuple]:
    """Of a node of a listing: what it says, and the nodes below it; None if it is no comment."""
    data = node.get("data") if isinstance(node, dict) and node.get("kind") == "t1" else None
    if isinstance(data, dict):
        replies = data.get("replies")
        below = (replies.get("data") or {}).get("children") if isinstance(replies, dict) else None
        yield (data.get("author"), data.get("body"), data.get("created_utc"), data.get("score"), data.get("permalink")), below


def _posted(node) -> Iterator[tuple]:
    """The same of a reply with a post and a record."""
    if isinstance(node, dict):
        post = node["post"] if isinstance(node.get("post"), dict) else {}
        record = post["record"] if isinstance(post.get("record"), dict) else {}
        author = post["author"] if isinstance(post.get("author"), dict) else {}
        yield (author.get("handle"), record.get("text"), post.get("indexedAt") or record.get("createdAt"), post.get("likeCount"), post.get("uri")), node.get("replies")


SHAPES = {"listing": _listed, "replies": _posted}


def flatten_threads(threads: DataFrame, json_col: str, shape: str) -> DataFrame:
    """The other columns of ``threads`` and, for each comment of the nested JSON, COMMENT in pre-order.

    The JSON is a list of nodes, or one with ``replies``; ``shape`` names how its nodes look.
    Nodes that aren't comments are left out with all below them, blank comments alone.
    What can't be read has no comments.
    """
    read, kept = SHAPES[shape], [c for c in threads.columns if c != json_col]

    def comments(text: str | None) -> Iterator[dict]:
        try:
            whole = json.loads(text or "null")
        except (ValueError, RecursionError):
            return
        top = whole if isinstance(whole, list) else whole.get("replies") if isinstance(whole, dict) else None
        stack = [(n, 0) for n in reversed(top)] if isinstance(top, list) else []
        position = 0
        while stack:
            node, depth = stack.pop()
            for (author, said, at, score, link), below in read(node):
                body = " ".join(str(said or "").split())
                if body:
                    yield {"position": position, "depth": depth, "author": None if author is None else str(author), "text": body, "published_at": None if at is None else str(at), "score": score if isinstance(score, int) else None, "link": None if link is None else str(link)}
                    position += 1
                if isinstance(below, list):
                    stack += [(n, depth + 1) for n in reversed(below)]

    kinds = [("position", pa.int64()), ("depth", pa.int64()), ("author", pa.string()), ("text", pa.string()), ("published_at", pa.string()), ("score", pa.int64()), ("link", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for i, text in enumerate(batch.column(json_col).to_pylist()):
                for c in comments(text):
                    of.append(i)
                    found.append(c)
            rows = batch.select(kept).take(pa.array(of, pa.int64())) if kept else None
            own = [pa.array([c[k] for c in found], t) for k, t in kinds]
            yield pa.RecordBatch.from_arrays([*(rows.columns if kept else []), *own], names=[*kept, *[k for k, _ in kinds]])

    from pyspark.sql.types import StructType

    return threads.mapInArrow(run, StructType([*[f for f in threads.schema.fields if f.name != json_col], *StructType.fromDDL(COMMENT).fields]))


def item_comments(stories: DataFrame, items: DataFrame, *, kids: int = 80, levels: int = 3) -> DataFrame:
    """story, id, depth and text of the comments below stories (id, kids), from items (id, type, text, kids) that name their own.

    The first ``kids`` of an item are looked at, down to depth ``levels`` - 1; other items
    than comments are left out with all below them, blank ones alone. Texts lose their tags.
    """
    level, out = stories.select(F.col("id").alias("story"), F.posexplode(F.slice("kids", 1, kids)).alias("pos", "id")).withColumn("place", F.array("pos")), None
    for depth in range(levels):
        here = level.join(items.where("type = 'comment'"), "id")
        rows = here.select("story", "id", F.lit(depth).cast("long").alias("depth"), "place", T.strip_html(F.coalesce("text", F.lit(""))).alias("text"))
        out = rows if out is None else out.unionByName(rows)
        level = here.select("story", "place", F.posexplode(F.slice("kids", 1, kids)).alias("pos", "below")).select("story", F.col("below").alias("id"), F.concat("place", F.array("pos")).alias("place"))
    return out.where("text <> ''")
