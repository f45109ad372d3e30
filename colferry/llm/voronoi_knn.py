"""Exact top-k by inner product as a Voronoi join.

Pivots divide queries and data into cells. Of a query cell the summary is its count and radius r about its pivot c, of
a data cell the count, radius and longest vector. For a query of the cell and any vector x,
<c,x> - r|x| <= score <= <c,x> + r|x|. The k-th largest lower bound over vectors of the most promising data cells is a
floor t of every k-th score in the query cell. A pair of cells whose summaries keep all scores below t is out; of the
other data cells, only those vectors are sent whose own upper bound reaches t. Query cells are grouped greedily so
that a group's cells want the same data, and each group is solved by itself, in blocks of bounded size. What is sent
shrinks as cells get tight; where the data have no structure, each group gets nearly all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colferry.llm.common import Scratch, small_batches

TOP, SCALE, EVERY = 5, 256, 50
#: Pivots (square root of the number of vectors) at most; queries to a group aimed at; queries and vectors to a block.
MAX_PIVOTS, GROUP_QUERIES, BLOCK_QUERIES, BLOCK_ROWS = 1024, 1024, 2048, 16384
#: Vectors that a query cell's floor is taken from, at least, where there are so many.
FLOOR_ROWS = 512
SLACK = 1e-6
LARGEST = float(1 << 53)


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, dim and the components floor(256 x) as int64 bytes, of vectors without nulls and non-finite numbers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, data = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or v is None or None in v:
                    continue
                x = np.floor(np.asarray(v, np.float64) * SCALE)
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                dims.append(len(x))
                data.append(np.clip(x, -LARGEST, LARGEST).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "dim", "v"])

    return small_batches(vectors).select(vectors[id_col].cast("long").alias("i"), vectors[vec_col].alias("v")).mapInArrow(convert, "vec_id long, dim int, v binary")


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(-1, dim)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where that is exact, else by (slower) 64-bit integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < LARGEST:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, ids, scores) of the k highest of each row, smaller ids first among equals; own: the id left out."""
    for r in range(len(scores)):
        s = scores[r]
        at = np.flatnonzero(ids != own[r])
        if len(at) > k:
            least = np.partition(s[at], len(at) - k)[len(at) - k]
            at = at[s[at] >= least]
        at = at[np.lexsort((ids[at], -s[at]))][:k]
        yield r, ids[at], s[at]


def knn_join(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query's vector.

    Queries are the rows whose id is divisible by every; candidates all rows with another id and as many components.
    Null ids, null or empty vectors and vectors with null or non-finite components take no part; a repeated query id
    is answered once, from its smallest vector; repeated candidates count each. Components beyond 2^53 count as 2^53,
    and scores beyond 64 bits wrap. Ties go to the smaller id. Empty table: empty result. Other columns aren't read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    data = scratch.write(integers(vectors, id_col, vec_col).where("dim > 0"), "data")
    queries = scratch.write(data.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("v").alias("v")), "queries")
    sizes = {r["dim"]: r["n"] for r in data.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per number of components
    asked = sorted(r["dim"] for r in queries.select("dim").distinct().collect())
    parts = [_solve(plan(scratch, data.where(F.col("dim") == d), queries.where(F.col("dim") == d), d, sizes[d], k), d, k) for d in asked]
    found = parts[0] if parts else spark.createDataFrame([], "query_id long, vec_id long, score long")
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


@dataclass
class Plan:
    """asked (g, chunk, salt, vec_id, v): queries by block; sent (g, chunk, salt, vec_id, v): the vectors they need."""

    asked: DataFrame
    sent: DataFrame
    groups: int


def grouped(wants: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The group of each query cell (-1 without queries). wants[i, j]: cell i needs data cell j. A group starts with the
    first cell left and takes the cell that adds fewest vectors to what it is sent, up to GROUP_QUERIES queries."""
    out = np.full(len(queries), -1)
    left = queries > 0
    g = 0
    while left.any():
        i = int(np.argmax(left))
        have, held = wants[i].copy(), queries[i]
        out[i], left[i] = g, False
        while held < GROUP_QUERIES:
            fits = np.flatnonzero(left & (queries + held <= GROUP_QUERIES))
            if not len(fits):
                break
            added = (wants[fits] & ~have) @ rows
            i = int(fits[added.argmin()])
            have |= wants[i]
            held += queries[i]
            out[i], left[i] = g, False
        g += 1
    return out


def plan(scratch: Scratch, data: DataFrame, queries: DataFrame, dim: int, total: int, k: int) -> Plan:
    """Cells, their summaries and floors, and what follows of who is sent where."""
    context = data.sparkSession.sparkContext
    wanted = min(MAX_PIVOTS, isqrt(total))
    drawn = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).collect()  # at most MAX_PIVOTS vectors
    pivots = np.unique(matrix([r["v"] for r in drawn], dim), axis=0).astype(np.float64)
    shared = context.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = matrix(batch.column("v").to_pylist(), dim).astype(np.float64)
            norm = (x * x).sum(1)
            cell = ((c * c).sum(1) - 2 * x @ c.T).argmin(1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(np.square(x - c[cell]).sum(1))
            cols = [batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(far, pa.float64()), pa.array(np.sqrt(norm), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "cell", "far", "norm"])

    def cells(rows: DataFrame, name: str) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        """Rows with their cells; count, radius and longest vector of each cell."""
        out = scratch.write(rows.select("vec_id", "v").mapInArrow(assign, "vec_id long, v binary, cell int, far double, norm double"), f"{name}{dim}")
        n, r, norm = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
        for x in out.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.max("norm").alias("norm")).collect():  # by pivot
            n[x["cell"]], r[x["cell"]], norm[x["cell"]] = x["n"], x["r"] * (1 + SLACK) + SLACK, x["norm"]
        return out, n, r, norm

    asked, n_asked, radius, _ = cells(queries, "asked")
    held, n_held, spread, longest = cells(data, "cells")
    middle, size = pivots @ pivots.T, np.sqrt((pivots * pivots).sum(1))  # [query cell, data cell]

    # each query cell's floor comes from the data cells that promise most
    near = np.zeros_like(middle, bool)
    for i in np.flatnonzero(n_asked):
        order = np.argsort(-np.where(n_held > 0, middle[i] - radius[i] * longest, -np.inf), kind="stable")
        near[i, order[: int(np.searchsorted(np.cumsum(n_held[order]), max(FLOOR_ROWS, 8 * k))) + 1]] = True
    looked = context.broadcast([np.flatnonzero(near[:, j]) for j in range(len(pivots))])

    def lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 highest lower bounds of different ids by query cell (one of the ids may be the query's own)."""
        low, who = np.full((k + 1, len(pivots)), -np.inf), np.zeros((k + 1, len(pivots)), np.int64)
        for batch in batches:
            for j, ids, x, norm in _by_cell(batch, dim):
                at = looked.value[j]
                if not len(at):
                    continue
                ids, first = np.unique(ids, return_inverse=True)
                mid = x @ shared.value[at].T
                bound = mid - radius[at] * norm[:, None] - SLACK * (1 + np.abs(mid) + radius[at] * norm[:, None])
                each = np.full((len(ids), len(at)), -np.inf)
                np.maximum.at(each, first, bound)
                some = np.argsort(-each, axis=0, kind="stable")[: k + 1]
                both, names = np.concatenate([low[:, at], np.take_along_axis(each, some, 0)]), np.concatenate([who[:, at], ids[some]])
                order = np.lexsort((-both, names), axis=0)
                both, names = np.take_along_axis(both, order, 0), np.take_along_axis(names, order, 0)
                both[1:][names[1:] == names[:-1]] = -np.inf
                order = np.argsort(-both, axis=0, kind="stable")[: k + 1]
                low[:, at], who[:, at] = np.take_along_axis(both, order, 0), np.take_along_axis(names, order, 0)
        _, cell = np.nonzero(np.isfinite(low))
        ok = np.isfinite(low)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(who[ok], pa.int64()), pa.array(low[ok], pa.float64())], names=["cell", "vec_id", "low"])

    found = held.mapInArrow(lows, "cell int, vec_id long, low double").groupBy("cell", "vec_id").agg(F.max("low").alias("low"))
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("low"))))  # k + 1 rows a task and cell at most
    floor = np.full(len(pivots), -np.inf)
    for r in ranked.where(F.col("n") == k + 1).collect():  # by pivot
        floor[r["cell"]] = r["low"]

    reach = spread * size[:, None] + radius[:, None] * np.minimum(longest, size + spread)
    wants = (middle + reach + SLACK * (1 + np.abs(middle) + reach) >= floor[:, None]) & (n_asked > 0)[:, None] & (n_held > 0)
    group = grouped(wants, n_held, n_asked)
    groups = int(group.max()) + 1
    n_group = np.bincount(group[group >= 0], n_asked[group >= 0], groups).astype(np.int64)
    bound = np.array([n_held[wants[group == g].any(0)].sum() for g in range(groups)], np.int64)  # of the vectors sent
    chunks, salts = -(-n_group // BLOCK_QUERIES), np.maximum(1, -(-bound // BLOCK_ROWS))
    by_group = np.argsort(group, kind="stable")
    routes = context.broadcast([by_group[wants[by_group, j]] for j in range(len(pivots))])  # query cells of each data cell, by group

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for j, ids, x, norm in _by_cell(batch, dim):
                at = routes.value[j]
                if not len(at):
                    continue
                mid = x @ shared.value[at].T
                reach = radius[at] * norm[:, None]
                ok = mid + reach + SLACK * (1 + np.abs(mid) + reach) >= floor[at]
                starts = np.flatnonzero(np.append(True, group[at][1:] != group[at][:-1]))
                rows, g = np.nonzero(np.logical_or.reduceat(ok, starts, axis=1))
                g = group[at][starts][g]
                times = chunks[g]
                rows, g = np.repeat(rows, times), np.repeat(g, times)
                chunk = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                salt = (turn + rows) % salts[g]  # by place: copies of a vector are spread
                turn += len(x)
                vectors = x.astype(np.int64)
                for cut in range(0, len(rows), 8192):
                    part = slice(cut, cut + 8192)
                    cols = [pa.array(c[part], t) for c, t in ((g, pa.int32()), (chunk, pa.int32()), (salt, pa.int32()), (ids[rows], pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([vectors[r].tobytes() for r in rows[part]], pa.binary())], names=["g", "chunk", "salt", "vec_id", "v"])

    sent = held.mapInArrow(send, "g int, chunk int, salt int, vec_id long, v binary")
    by_cell = data.sparkSession.createDataFrame([(i, int(group[i]), int(chunks[group[i]]), int(salts[group[i]])) for i in range(len(pivots)) if group[i] >= 0], "cell int, g int, chunks int, salts int")
    spread_out = asked.join(F.broadcast(by_cell), "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), "chunks").cast("int"))
    spread_out = spread_out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return Plan(spread_out.select("g", "chunk", "salt", "vec_id", "v"), sent, groups)


def _by_cell(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, ids, vectors, norms) of a batch, cell by cell."""
    x, cell = matrix(batch.column("v").to_pylist(), dim).astype(np.float64), batch.column("cell").to_numpy()
    ids, norm = batch.column("vec_id").to_numpy(), batch.column("norm").to_numpy()
    order = np.argsort(cell, kind="stable")
    cuts = np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1])) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        at = order[a:b]
        yield int(cell[at[0]]), ids[at], x[at], norm[at]


def _solve(p: Plan, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each block."""

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(d):
            x, ids = matrix(d["v"], dim), d["vec_id"].to_numpy()
            for at in range(0, len(q), 64):
                part = q.iloc[at : at + 64]
                own = part["vec_id"].to_numpy()
                for r, found, scores in best(dots(matrix(part["v"], dim), x), own, ids, k):
                    out += zip([own[r]] * len(found), found.tolist(), scores.tolist())
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["g", "chunk", "salt"]
    return p.asked.groupBy(*keys).cogroup(p.sent.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
