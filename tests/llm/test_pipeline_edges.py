"""The pipeline's stages with nulls, empty and repeated rows, empty tables and clashing names, against brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from colferry.llm import mixing
from colferry.llm.packing import token_bytes

#: Names that operators use themselves.
CLASH = ["__row", "__kept", "__evidence", "__posterior", "__spans", "__doc", "__dropped", "__id", "__times", "row", "verdict", "mixed", "fp", "key", "part", "size", "taken", "root", "ids", "copy", "n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)


def rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    prose = [" ".join(word() for _ in range(rnd.randint(20, 90))) for _ in range(40)]
    out = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])) for i, t in enumerate(prose)]
    out += [(None, prose[3] + " end", "en", "a"), (None, "other " + prose[5], None, None), (60, None, "en", "a"), (61, "", "en", "b"), (62, "  \n", None, "b")]
    out += [out[7]] * 3 + [(70, prose[8], "en", "a"), (None, None, None, None)]
    return [(*r, len(r[1] or ""), *range(len(CLASH))) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(i, int(i % 9 != 0)) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    return root


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_columns(spark, docs, sf_dir):
    whole = plain(docs)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        found = plain(out)
        if name in ("quality", "near_duplicates"):
            assert not found - whole and sum(found.values()) > 0
        assert all(tuple(r)[5:] == tuple(range(len(CLASH))) for r in found), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert cp.packed(spark, docs.limit(0), sf_dir).count() == 0


def test_near_duplicates_keep_null_ids(spark, docs, sf_dir):
    kept = Counter(r["doc_id"] for r in cp.near_duplicates(spark, docs, sf_dir).collect())
    assert kept[None] == 3 and kept[7] == 4 and kept[70] == 0 and kept[8] == 1
    assert kept[60] == 1 and not kept[61] and not kept[62]  # texts without words are one group


def test_source_weights_follow_the_mix(spark, docs, sf_dir):
    taken = {(r["doc_id"], r["source"]): r["taken"] / r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    assert len(set(taken.values())) > 1
    want = Counter()
    for r, n in plain(docs).items():
        want[r] = n * int(taken[r[0], r[3]] if r[1] and r[1].split() else 1)
    assert plain(cp.source_weights(spark, docs, sf_dir)) == +want


def test_packed_holds_the_tokens(spark, docs, sf_dir):
    out = cp.packed(spark, docs, sf_dir).collect()
    keys = Counter((r["doc_id"], r["piece"], r["ids_crc32"], r["copy"]) for r in out)
    assert max(keys.values()) == 1  # copies can be told apart
    found, used = Counter(), Counter()
    for r in out:
        assert r["start"] == 0 and len(r["ids"]) == 4 * r["length"]
        found[r["doc_id"], bytes(r["ids"])] += 1
        used[r["sequence_id"]] += r["length"]
    assert found == Counter((r[0], token_bytes(r[1] or "")) for r in rows())
    assert max(used.values()) <= 2048
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    for a, b in zip(spans, spans[1:]):
        assert b[1] == (a[1] + a[2] if a[0] == b[0] else 0)


def test_run_is_the_stages(spark, docs, sf_dir):
    docs.write.mode("overwrite").parquet(f"{sf_dir}/documents.parquet")
    step = docs
    for _, stage in cp.STAGES:
        step = stage(spark, step, sf_dir)
    key = lambda df: Counter((r["doc_id"], r["piece"], r["ids_crc32"], r["copy"]) for r in df.collect())
    assert key(cp.run(spark, sf_dir)) == key(step)
