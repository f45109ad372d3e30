"""Mixing with more sources than are broadcast gives the same rows."""

import random

from colferry.llm import mixing


def test_ranges_of_sources(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randrange(30)), rnd.choice([None, *(f"s{k}" for k in range(40))])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    assert sorted(map(str, mixing.mix(docs).collect())) == few
    assert mixing.mix(docs.limit(0)).count() == 0
