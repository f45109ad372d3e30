"""kNN joins: repeated query ids, pruning, grouping."""

from collections import defaultdict

import numpy as np
import pytest

from colferry.llm import voronoi_knn as V
from colferry.llm.common import Scratch


def test_copies_of_a_query_do_not_hide_the_rest(spark):
    rows = [(0, [1.0, 0.0])] * 10 + [(i, [0.5, 0.0]) for i in range(1, 8)]
    got = V.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, i, 256 * 128) for i in range(1, 6)]


def test_repeated_candidates_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 10)
    rows = [(7, [1.0, 1.0])] * 40 + [(50 * i, [1.0, float(i)]) for i in range(4)] + [(7 + i, [0.1 * i, 0.3]) for i in range(1, 40)]
    got = defaultdict(list)
    for r in V.knn_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ints = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in rows]
    for q, x in ints[40:44]:
        want = sorted((-int(x @ y), i) for i, y in ints if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in want]


def clustered(n, dim=8, centers=12, seed=3):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(centers, dim)) * 4
    return [(i, (c[rnd.integers(centers)] + rnd.normal(size=dim) * 0.1).tolist()) for i in range(n)]


def test_clusters_prune(spark, monkeypatch):
    """On clustered data, far fewer than half of all (vector, group) pairs are sent, and results stay exact."""
    monkeypatch.setattr(V, "GROUP_QUERIES", 60)
    rows = clustered(4000)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    data = Scratch(spark).write(V.integers(df, "vec_id", "embedding"), "data")
    p = V.plan(Scratch(spark), data, data.where("vec_id % 10 = 0").select("vec_id", "dim", "v"), 8, 4000, 5)
    assert p.groups >= 6
    sent = p.sent.select("g", "vec_id").distinct().count()
    assert sent < 0.5 * p.groups * 4000
    ints = np.floor(np.array([v for _, v in rows]) * 256).astype(np.int64)
    got = defaultdict(list)
    for r in V.knn_join(df, every=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, 4000, 10):
        score = ints @ ints[q]
        score[q] = -(10**15)
        want = np.lexsort((np.arange(4000), -score))[:5]
        assert got[q] == [(int(i), int(score[i])) for i in want]


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_grouping(monkeypatch, size):
    monkeypatch.setattr(V, "GROUP_QUERIES", size)
    rnd = np.random.default_rng(5)
    wants, rows, queries = rnd.random((20, 20)) < 0.3, rnd.integers(1, 9, 20), rnd.integers(0, 3, 20)
    group = V.grouped(wants, rows, queries)
    assert ((group < 0) == (queries == 0)).all()
    for g in range(group.max() + 1):
        assert queries[group == g].sum() <= max(size, queries[group == g].max())
