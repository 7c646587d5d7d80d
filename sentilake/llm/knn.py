"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots, a bounded sample of the vectors whose number grows with the square root of the
table, cut the space into cells; executors find each row's cell, and each cell is summed
up by its number of rows, its radius and its longest vector.

1. A first local pass scores each query against the rows of its home, its own cell and as
   many neighbours as hold enough candidates. The k-th best of these real scores is a bound
   that the query's results are sure to reach.
2. A query q with bound b needs a cell with pivot p, radius r and longest vector m only if
   <p, q> + r |q| >= b and m |q| >= b. Queries form groups by cells, and a cell's rows are
   sent to a group only if one of its queries needs them; no other row is sent.
3. Groups are solved locally, cell by cell, and each query meets only the cells that it
   needs itself. A group with much data is solved in parts, and the parts' best are merged.

Where vectors are spread evenly in many dimensions nothing can be excluded, and every
query meets all rows, in parts; on clustered ones most cells are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import only, parts, stage

#: The most pivots; queries in a group; data rows in a part.
PIVOTS, GROUP_QUERIES, BLOCK = 4096, 4096, 16_384
#: Queries that are scored at once, and candidates that a task holds before it keeps the best.
SLAB, HELD = 512, 1 << 21
#: Lengths of vectors that get cells of their own, the commonest; the others are compared without bounds, in one plan.
LENGTHS = 16
#: Products below this are exact in doubles.
EXACT = float(1 << 53)
#: The largest components, as doubles below 2**63.
MOST = float((1 << 63) - 1024)
#: Below every score, and with a negative.
LEAST = -(1 << 63) + 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and floor(scale * x) of each usable vector: no null and no non-finite component.

    Components beyond 64 bits are held at the ends of their range.
    """
    v = only(vectors, vec_id=id_col, v=vector_col).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    whole = lambda x: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.lit(float(scale)) * x.cast("double")))).cast("long")
    return v.where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("v", whole).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if queries.size == 0 or data.size == 0:
        return np.zeros((len(queries), len(data)), np.int64)
    a, b = float(np.abs(queries).max()), float(np.abs(data).max())
    if a * b * queries.shape[1] < EXACT:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ data.astype(object).T  # Python's integers, for huge components
    return np.clip(exact, LEAST + 1, -LEAST).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k highest scores, ties to smaller ids, in order."""
    if score.shape[1] > 4 * k:
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        return [(c := np.flatnonzero(row >= e))[np.lexsort((ids[c], -row[c]))[:k]] for row, e in zip(score, edge, strict=True)]
    return [np.lexsort((ids, -row))[:k] for row in score]


def _cells(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """Rows with their nearest pivot, the distance to it, and their length."""
    half = (pivots**2).sum(axis=1) / 2

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width).astype(np.float64)
            cell = (x @ pivots.T - half).argmax(axis=1) if len(x) else np.zeros(0, int)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((x**2).sum(axis=1)))], names=["vec_id", "v", "cell", "far", "norm"])

    return rows.mapInArrow(near, "vec_id long, v array<long>, cell int, far double, norm double")


def top_k(vectors: DataFrame, is_query, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, block: int = BLOCK, lengths: int = LENGTHS, computed=None) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of each query.

    ``is_query`` is a condition on vec_id. Every other usable row is a candidate, ties go
    to the smaller vec_id, and a query with fewer than k candidates returns them all.
    Vectors that are null, or hold null or non-finite components, take no part, nor do null
    ids; empty vectors score 0 with each other. Only vectors of one length are compared with each other. Of rows with
    one vec_id each is a candidate (but not of its own id), and the least vector is the
    query. An empty table gives no rows; other columns aren't read.
    Components and scores beyond 64 bits are held at the ends of their range. ``computed``,
    an accumulator, adds up the pairs that were scored in the last step.
    """
    rows = stage(quantised(vectors, id_col, vector_col, scale))
    spark = rows.sparkSession
    widths = [r.width for r in rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(lengths).collect()]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for width in sorted(widths):
        out = out.unionByName(_top_k(rows.where(F.size("v") == width), width, is_query, k, pivots, group_queries, block, computed))
    rest = rows.where(~F.size("v").isin(widths))
    return out if rest.isEmpty() else out.unionByName(_unbounded(rest, is_query, k, group_queries, block))


def _solver(k: int):
    def solve(ask: pa.Table, have: pa.Table) -> pa.Table:
        out: dict[str, list] = {"width": [], "query_id": [], "vec_id": [], "score": []}
        if ask.num_rows and have.num_rows:
            width = len(ask.column("v")[0])
            q, ids = matrix(ask.column("v"), width), have.column("vec_id").to_numpy()
            x, own = matrix(have.column("v"), width), ask.column("vec_id").to_numpy()
            for at in range(0, len(q), 256):
                s = scores(q[at : at + 256], x)
                for i, columns in enumerate(best(np.where(ids == own[at : at + 256, None], LEAST, s), ids, k)):
                    columns = columns[ids[columns] != own[at + i]]
                    out["width"].append(np.full(len(columns), width))
                    out["query_id"].append(np.full(len(columns), own[at + i]))
                    out["vec_id"].append(ids[columns])
                    out["score"].append(s[i, columns])
        return pa.table({n: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for n, v in out.items()})

    return solve


def _solve(asking: DataFrame, candidates: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each query of a length among the candidates that share its keys."""
    local = asking.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_solver(k), "width long, query_id long, vec_id long, score long")
    order = Window.partitionBy("width", "query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unbounded(rows: DataFrame, is_query, k: int, group_queries: int, block: int) -> DataFrame:
    """All queries with all data of their length, whatever the number of lengths."""
    rows = rows.withColumn("width", F.size("v"))
    queries = rows.where(is_query).groupBy("width", "vec_id").agg(F.min("v").alias("v"))
    deals = queries.groupBy("width").agg(F.ceil(F.count("*") / (2 * group_queries)).cast("int").alias("deals"))
    sizes = stage(rows.groupBy("width").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(deals, "width"))
    candidates = rows.join(sizes, "width").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    asking = queries.join(sizes, "width").withColumn("deal", F.pmod(F.xxhash64("vec_id"), "deals").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    few = ["width", "deal", "block", "vec_id", "v"]
    return _solve(stage(asking.select(*few)), candidates.select(*few), few[:3], k)


def _groups(n_queries: dict[int, int], pivots: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(cell, group, deals): neighbouring cells share a group up to ``most`` queries; a cell with more is dealt out."""
    out, group, size = [], 0, 0
    for c in sorted(n_queries, key=lambda c: pivots[c].tolist()):
        if size and size + n_queries[c] > most:
            group, size = group + 1, 0
        out.append((c, group, parts(n_queries[c], most)))
        size += n_queries[c]
    return out


def _homes(cells: dict, copies: dict[int, int], pivots: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(cell, home): its own cell and the next ones that its queries score high with, until these hold enough rows."""
    out, found = [], sorted(cells)
    for c, n_own in copies.items():
        held = 0
        for d in [c, *(found[i] for i in np.argsort(-(pivots[found] @ pivots[c]), kind="stable") if found[i] != c)]:
            out.append((c, d))
            held += cells[d].n
            if held >= 2 * k + n_own:
                break
    return out


def _top_k(rows: DataFrame, width: int, is_query, k: int, most_pivots: int, group_queries: int, block: int, computed) -> DataFrame:
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_pivots = max(1, min(most_pivots, math.isqrt(rows.count())))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()  # a bounded sample
    pivots = np.unique(np.asarray([r.v for r in sample], np.float64).reshape(len(sample), width), axis=0)
    placed = stage(_cells(rows, pivots, width))
    # one row for each of at most n_pivots cells
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()}
    first = F.min(F.struct("v", "cell", "far", "norm")).alias("q")
    queries = stage(placed.where(is_query).groupBy("vec_id").agg(first, F.count("*").alias("copies")).select("vec_id", "q.v", "q.cell", "q.norm", "copies"))
    asked = {r.cell: r for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("copies").alias("copies")).collect()}
    if not asked:
        return nothing
    # tables of a few numbers for each cell
    summary = F.broadcast(spark.createDataFrame([(c, r.n, parts(r.n, block)) for c, r in cells.items()], "cell int, n long, blocks int"))
    groups = F.broadcast(spark.createDataFrame(_groups({c: r.n for c, r in asked.items()}, pivots, group_queries), "cell int, group int, deals int"))
    homes = _homes(cells, {c: r.copies for c, r in asked.items()}, pivots, k)
    visits: dict[int, int] = {}
    for c, d in homes:
        visits[d] = visits.get(d, 0) + asked[c].n
    home = F.broadcast(spark.createDataFrame([(c, d, parts(visits[d], group_queries)) for c, d in homes], "cell int, home int, turns int"))
    turns = F.broadcast(spark.createDataFrame([(d, parts(n, group_queries)) for d, n in visits.items()], "cell int, turns int"))
    blocked = placed.join(summary, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int"))

    # 1. the k-th best real score at home; of a large cell one block is enough for a bound
    going = queries.join(home, "cell").select(F.col("home").alias("cell"), F.pmod(F.xxhash64("vec_id"), "turns").cast("int").alias("turn"), "vec_id", "v")
    there = blocked.where("block = 0").join(turns, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "vec_id", "v")

    def meet(ask: pa.Table, have: pa.Table) -> pa.Table:
        ids, tops = [], []
        if ask.num_rows and have.num_rows:
            own, other = ask.column("vec_id").to_numpy(), have.column("vec_id").to_numpy()
            q, x = matrix(ask.column("v"), width), matrix(have.column("v"), width)
            for at in range(0, len(q), SLAB):
                s = np.where(other == own[at : at + SLAB, None], LEAST, scores(q[at : at + SLAB], x))
                top = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                ids.extend(own[at : at + SLAB].tolist())
                tops.extend([t[t != LEAST].tolist() for t in top])
        return pa.table({"vec_id": pa.array(ids, pa.int64()), "top": pa.array(tops, pa.list_(pa.int64()))})

    met = going.groupBy("cell", "turn").cogroup(there.groupBy("cell", "turn")).applyInArrow(meet, "vec_id long, top array<long>")
    # a few lists of k scores for each query
    bound = met.groupBy("vec_id").agg(F.get(F.sort_array(F.flatten(F.collect_list("top")), asc=False), F.lit(k - 1)).alias("least"))
    bounded = stage(queries.join(bound, "vec_id", "left").join(groups, "cell").select("group", F.pmod(F.xxhash64("vec_id"), "deals").cast("int").alias("deal"), "vec_id", "v", "norm", "least"))

    # 2. the cells that a group needs
    numbers = np.asarray(sorted(cells), np.int32)
    centre = pivots[numbers]
    far, longest = (np.asarray([getattr(cells[c], f) for c in numbers.tolist()], np.float64) for f in ("far", "norm"))

    def needs(q: np.ndarray, norm: np.ndarray, least: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Which queries may find what they lack in which of some cells; rounding must not lose a vector."""
        reach = np.minimum(q @ centre[some].T + norm[:, None] * far[some], norm[:, None] * longest[some])
        return reach + 1e-6 * (1 + np.abs(reach)) >= least[:, None]

    def lacking(column: pa.Array) -> np.ndarray:
        """Bounds as doubles, rounded beyond 2**53, for which ``needs`` leaves room; a query without one needs all."""
        return column.cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)

    def want(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(numbers))
        for whole in batches:
            for at in range(0, whole.num_rows, SLAB):
                batch = whole.slice(at, SLAB)
                need = needs(matrix(batch.column(2), width).astype(np.float64), batch.column(3).to_numpy(), lacking(batch.column(4)), every)
                key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
                for one in np.unique(key).tolist():
                    found = numbers[need[key == one].any(axis=0)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), one >> 32, np.int32)), pa.array(np.full(len(found), one & 0xFFFFFFFF, np.int32)), pa.array(found)], names=["group", "deal", "cell"])

    wanted = stage(bounded.select("group", "deal", "v", "norm", "least").mapInArrow(want, "group int, deal int, cell int").distinct().join(summary, "cell"))
    # a group's data are dealt into parts of about a block
    split = stage(wanted.groupBy("group", "deal").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts")))
    by_block = wanted.join(split, ["group", "deal"]).select("group", "deal", "parts", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    by_block = by_block.select("group", "deal", "cell", "block", F.pmod(F.xxhash64("cell", "block"), "parts").cast("int").alias("part"))
    data = blocked.join(by_block, ["cell", "block"]).select("group", "deal", "part", "vec_id", "v", "cell")
    asking = bounded.join(split, ["group", "deal"]).select("group", "deal", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v", "norm", "least")

    # 3. each query with the cells it needs
    def solve(ask: pa.Table, have: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if ask.num_rows and have.num_rows:
            have = have.sort_by("cell")
            cell, ids, x = have.column("cell").to_numpy(), have.column("vec_id").to_numpy(), matrix(have.column("v"), width)
            own, q, norm, least = ask.column("vec_id").to_numpy(), matrix(ask.column("v"), width), ask.column("norm").to_numpy(), lacking(ask.column("least").combine_chunks())
            present, begins = np.unique(cell, return_index=True)
            ends, pairs = np.append(begins[1:], len(cell)), 0
            some = np.searchsorted(numbers, present)
            for at in range(0, len(q), SLAB):
                us = np.arange(at, min(at + SLAB, len(q)))
                need = needs(q[us].astype(np.float64), norm[us], least[us], some)
                found, held = [], 0

                def keep(found: list) -> list:
                    """The k best of each query, by score and then id."""
                    who, at_row, score = (np.concatenate(c) for c in zip(*found, strict=True))
                    order = np.lexsort((ids[at_row], -score, who))
                    who, at_row, score = who[order], at_row[order], score[order]
                    first = np.searchsorted(who, who, "left")
                    few = np.arange(len(who)) - first < k
                    return [(who[few], at_row[few], score[few])]

                for j, (lo, hi) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
                    mine = us[need[:, j]]
                    if not len(mine):
                        continue
                    s = scores(q[mine], x[lo:hi])
                    pairs += s.size
                    row, col = np.nonzero((s >= least[mine, None]) & (ids[lo:hi] != own[mine, None]))
                    found.append((mine[row], lo + col, s[row, col]))
                    held += len(row)
                    if held > HELD:
                        found = keep(found)
                        held = len(found[0][0])
                if found:
                    who, at_row, score = keep(found)[0]
                    out.append((own[who], ids[at_row], score))
            if computed is not None:
                computed.add(pairs)
        q_id, v_id, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(q_id, pa.int64()), "vec_id": pa.array(v_id, pa.int64()), "score": pa.array(score, pa.int64())})

    keys = ["group", "deal", "part"]
    local = asking.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
