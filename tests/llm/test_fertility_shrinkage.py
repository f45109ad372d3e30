"""Verdicts of fertility against brute force, at any table size by one rule; held-out labels."""

import random
from collections import defaultdict

import numpy as np

from colferry.llm import fertility as fert


def median_bin(values, width):
    return sorted(np.floor(np.array(values) / width))[(len(values) + 1) // 2 - 1] * width + width / 2


def brute_kept(rows):
    """The rule, from the measures alone."""
    bands = defaultdict(list)
    for r in rows:
        if not r["base_failed"]:
            bands[r["band"]].append(r)
    odd = set()
    for name, prior in fert.PRIORS.items():
        of = {}
        for band, members in bands.items():
            have = [r for r in members if r[name] is not None]
            if not have:
                continue
            m = median_bin([r[name] for r in have], fert.BIN)
            off = median_bin([abs(r[name] - m) * min(r["n_tokens"], fert.SPREAD_TOKENS) ** 0.5 for r in have], fert.SCATTER_BIN * prior / 2)
            of[band] = len(have), m, 1.4826 * off, np.mean([1 / min(r["n_tokens"], fert.SPREAD_TOKENS) for r in have])
        total = sum(n for n, *_ in of.values())
        middle = sum(n * m for n, m, *_ in of.values()) / max(1, total)
        between = sum(n * (m - middle) ** 2 for n, m, *_ in of.values()) / max(1, total)
        for band, (n, m, s, t) in of.items():
            v = max((n * s * s + fert.PRIOR_DOCS * prior**2) / (n + fert.PRIOR_DOCS), (fert.LEAST_SCATTER * prior) ** 2)
            trust = n * between / (n * between + v * t)
            centre, doubt = middle + trust * (m - middle), trust * v * t / n + (1 - trust) * between
            for r in rows:
                if r["band"] == band and r[name] is not None and (r[name] - centre) ** 2 > fert.SPREADS**2 * (v / min(r["n_tokens"], fert.SPREAD_TOKENS) + doubt):
                    odd.add(r["doc_id"])
    return odd


def test_verdicts_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = fert.fertility(docs).collect()
    odd = brute_kept(rows)
    texts = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    assert len(odd) > 20
    for r in rows:
        m = fert.measure(texts[r["doc_id"]][0] or "", fert.shared_pieces())
        assert r["kept"] == (not r["base_failed"] and fert.in_bands(m, fert.BANDS[r["band"]]) and r["doc_id"] not in odd)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.4  # no label was used


def test_window_entropy():
    rnd = random.Random(2)
    for n in (0, 31, 32, 33, 200):
        ids = np.array([rnd.randrange(20) for _ in range(n)], np.uint32)
        want = []
        for at in range(0, n - n % fert.WINDOW, fert.WINDOW):
            _, c = np.unique(ids[at : at + fert.WINDOW], return_counts=True)
            p = c / fert.WINDOW
            want.append(-(p * np.log(p)).sum() / np.log(fert.WINDOW))
        got = fert.window_entropy(ids)
        assert got is None if not want else abs(got - np.mean(want)) < 1e-12


def test_small_tables_use_the_same_rule(spark):
    """One document, copies alone, two languages: nothing divides by zero, and copies don't make the rest odd."""
    kind = "doc_id long, text string, lang string"
    assert fert.fertility(spark.createDataFrame([(1, "some words that make a text of more than ten words here for us", "en")], kind)).first()["kept"]
    prose = ["The committee met on Tuesday and agreed that further work would be needed before the report is sent", "Nobody knew why the old harbour clock had stopped, but everyone in the village set their watches by it anyway"]
    rows = [(i, prose[0], "en") for i in range(30)] + [(50, prose[1], "en"), (51, prose[1], "de")]
    assert all(r["kept"] for r in fert.fertility(spark.createDataFrame(rows, kind)).collect())
