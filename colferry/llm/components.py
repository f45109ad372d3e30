"""Connected components of a graph of long ids, by contraction in written rounds.

In a round every node points to the smallest of itself and its neighbours, pointers are followed twice, and edges are
redrawn between what they point to; the nodes that still have edges at least halve. Nothing is collected: a hub's
edges meet only in a map-side minimum and in joins that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colferry.llm.common import Scratch

#: Edges whose forest a task keeps at once.
CHUNK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each chunk of edges: every node with the smallest node it is linked to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(n, r) for n in list(parent) if (r := root(n)) != n]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > CHUNK:
            yield flush()
    yield flush()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) of every node that an edge (a, b) touches with a != b; null ends are no edges."""
    edges = edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long")
    edges = scratch.write(edges, f"{name}-edges0")
    maps: list[DataFrame] = []
    n = 0
    while edges.head(1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        for k in range(2):  # roots that are no nodes here cannot occur: every root is an end of an edge
            up = scratch.write(up, f"{name}-up{n}-{k}")
            far = up.select(F.col("node").alias("root"), F.col("root").alias("far"))
            up = up.join(far, "root").select("node", F.col("far").alias("root"))
        up = scratch.write(up, f"{name}-up{n}")
        maps.append(up)
        a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct()
        n += 1
        edges = scratch.write(edges.mapInArrow(_forest, "a long, b long"), f"{name}-edges{n}")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[-1]
    for up in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = up.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return found
