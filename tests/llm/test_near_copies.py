"""Near copies of the pipeline, against brute force."""

import random

import corpus_pipeline
from colferry.llm import near_copies
from colferry.llm.common import Scratch


def words(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def texts_of(rnd):
    out = [None, "", " ", "a b c", "A  b c", "a b d"]
    shared = " ".join(f"s{i}" for i in range(30))
    for k in range(25):
        base = [f"w{rnd.randrange(40)}" for _ in range(rnd.choice([6, 12, 60, 300]))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(len(copy))] = f"new{rnd.randrange(1000)}"
            out.append(" ".join(copy) + (f" {shared}" if k % 2 else ""))
    return out


def expected(sets):
    root = {i: i for i in sets}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    pairs = 0
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                pairs += a != b
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}, pairs


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HOT", 20)
    texts = texts_of(random.Random(7))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b c", "x")], "doc_id long, text string, lang string").repartition(3)
    want, pairs = expected({i: words(t) for i, t in enumerate(texts)})
    assert pairs > 20
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and None in got
    assert {i for i in got if i is not None} == want and len(got) == len(want) + 1
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = near_copies.links(near_copies._texts(docs, "doc_id", "text"), Scratch(spark)).distinct().count()
    sets = {frozenset(words(r["text"])) for r in docs.select("text").collect()}
    sets = sorted(sets, key=len)
    want = 0
    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            if 5 * len(a) < 4 * len(b):
                break
            want += 5 * len(a & b) >= 4 * len(a | b)
    assert found == want > 0


def test_blocks_cut_again(spark, monkeypatch):
    """Every shared block is cut again as often as may be; no pair is lost, and copies are linked."""
    monkeypatch.setattr(near_copies, "HOT", 0)
    monkeypatch.setattr(near_copies, "LEVELS", 1)
    monkeypatch.setattr(near_copies, "HUB_ROWS", 2)
    texts = texts_of(random.Random(9))[:46]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    sets = sorted({frozenset(words(t)) for t in texts}, key=len)
    want = sum(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :])
    assert near_copies.links(near_copies._texts(docs, "doc_id", "text"), Scratch(spark)).distinct().count() == want >= 5
