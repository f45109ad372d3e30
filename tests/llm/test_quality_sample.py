"""Repeated rows and the classifier's sample."""

import numpy as np

from colferry.llm import quality_bayes


def test_repeated_rows_do_not_displace_a_label(spark):
    good = [(i, f"A calm sentence about rivers and hills number {i}.") for i in range(20)]
    bad = [(100 + i, f"BUY $$$ {i} ### WIN *** {i} now!!!") for i in range(20)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    once = quality_bayes.train(docs, labels, sample_rows=40)
    often = quality_bayes.train(docs.union(spark.createDataFrame([bad[0]] * 60, docs.schema)), labels, sample_rows=40)
    assert np.array_equal(once, often)
    versions = spark.createDataFrame([(100, f"BUY $$$ version {k}") for k in range(60)], docs.schema)
    mixed = quality_bayes.train(docs.union(versions), labels, sample_rows=40)
    assert mixed[-1] != -4 and quality_bayes.features(good[0][1]) @ mixed[:-1] + mixed[-1] > 0
