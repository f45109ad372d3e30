"""kNN join, SimHash, URL rules, wrappers, suffix arrays and the pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colferry.llm import components as comp
from colferry.llm import simhash, suffix_dedup, suffix_sort, url_rules, voronoi_knn, wrapper
from colferry.llm.common import Scratch

# --- 4 kNN ---


def brute_knn(rows, k, every):
    ok = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, np.float64)).all()]
    out = {}
    for q, x in ok:
        if q % every == 0:
            found = sorted(((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x)))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


@pytest.mark.parametrize("group, block", [(256, 16384), (4, 30)])
def test_knn(spark, monkeypatch, group, block):
    monkeypatch.setattr(voronoi_knn, "GROUP_QUERIES", group)
    monkeypatch.setattr(voronoi_knn, "BLOCK_ROWS", block)
    monkeypatch.setattr(voronoi_knn, "BLOCK_QUERIES", 5)
    rnd = np.random.default_rng(1)
    centers = rnd.normal(size=(4, 6)) * 3
    rows = [(int(i), [float(x) for x in centers[i % 4] + rnd.normal(size=6) * 0.2]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(12)]  # ties
    rows += [(1000, None), (1005, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1010, [float("nan")] * 6), (1015, [float("inf")] * 6), (1020, []), (None, [1.0] * 6), (1025, [1.0, 2.0]), (1026, [3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, g string")
    got = defaultdict(list)
    for r in voronoi_knn.knn_join(df, every=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_knn(rows, 5, 5)
    assert dict(got) == {q: v for q, v in want.items() if v}
    assert voronoi_knn.knn_join(df.limit(0)).count() == 0


def test_knn_prunes(spark, monkeypatch):
    """Far groups are not sent to each other."""
    monkeypatch.setattr(voronoi_knn, "GROUP_QUERIES", 1)
    bound = voronoi_knn.dots(np.array([[1 << 40, 1]]), np.array([[1 << 10, 3]]))
    assert bound.tolist() == [[(1 << 50) + 3]]


# --- 8 SimHash ---


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("AbcÉß \n\t\u00a0\x0b"), max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("key_rows", [64, 3])
def test_links(spark, key_rows):
    """All pairs within two bits, also under keys that many fingerprints share."""
    rnd, fps = random.Random(3), set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        for _ in range(4):
            fps.add(base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    hot = rnd.getrandbits(64)
    fps |= {hot ^ x for x in range(300)}  # one key for all of them
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    u = np.array(fps, np.int64).view(np.uint64)
    want = {(fps[i], fps[j]) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(int(u[i] ^ u[j])).count("1") <= 2}
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), Scratch(spark), key_rows).collect()}
    assert got == want


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 60)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long").repartition(5)
    got = {r["node"]: r["root"] for r in comp.components(df, Scratch(spark)).collect()}
    want = roots({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    groups = defaultdict(set)
    for n, r in got.items():
        groups[r].add(n)
    expected = defaultdict(set)
    for n, r in want.items():
        expected[r].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert comp.components(df.limit(0), Scratch(spark)).count() == 0


def test_near_duplicates(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(4000))
    texts = [None, "", " \n", "One two THREE", "one  two\tthree", "a b", long, long.replace("w5x5 ", "changed "), "other words entirely here", None]
    df = spark.createDataFrame([(i + 10, t, 1, 2) for i, t in enumerate(texts)] + [(None, "One two THREE", 1, 2), (10, None, 1, 2)], "doc_id long, text string, fp int, component_id int")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(texts) + 2
    fps = {i + 10: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2])
    for r in out:
        if r["doc_id"] is not None:
            assert np.int64(r["fp"]).view(np.uint64) == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted([*set(want.values()), 10])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# --- 9 URLs ---


def regex_of(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + "(?s:.*)", i + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
        i += 1
    return re.compile(out, re.S)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab/*?."), max_size=40), min_size=1, max_size=8), st.lists(st.text(st.sampled_from("ab/."), max_size=40), max_size=12))
def test_automaton(globs, strings):
    got = url_rules.WildcardAutomaton(globs).run([s.encode() for s in strings])
    for r, s in enumerate(strings):
        for g, glob in enumerate(globs):
            assert got[r, g] == bool(regex_of(glob).fullmatch(s)), (glob, s)


def test_urls(spark):
    urls = ["http://a.example.NET/en/1?x#y", "https://net/", "http://net", "http://xnet/", "https://example.net/en/", "http://b.example.com/de/x", "http://example.org/fr/", "http://fork.org/fr/x", "http://u.org/de/", None, "", "no scheme", "http://spam-farm.example.org/en/", "HTTP://x.org?http://net/", "http://x.org/" + "a" * 100_000, "http://é.net/ü", "a://b://net/"]
    df = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)] + [(None, urls[0], 1, "x"), (0, urls[0], 1, "x")], "page_id long, url string, rule int, verdict string")
    out = url_rules.judge_urls(df).collect()
    assert len(out) == len(urls) + 2
    for r in out:
        u = urls[r["page_id"] or 0]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].encode().lower().decode(), m[2]) if m else ("", "")
        assert (r["host"], r["path"]) == (host, path)
        fits = [(rule, v) for rule, v in url_rules.HOST_RULES for h, p in [rule.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert r["rule"] == best[0]
        assert r["verdict"] == (best[1] or ("block" if "spam-farm" in (u or "") else "allow"))
    assert url_rules.judge_urls(df.limit(0)).count() == 0


# --- 6 wrappers ---

HEAD = '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>'
NAV = '<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="ad">buy {n}</div>'
TAIL = '<div id="comments"><p>first {n}!</p></div><form><p>mail</p><button>go</button></form><aside><p>see {n}</p></aside><footer>&copy; x {n}</footer></body></html>'


def page(n, body):
    return HEAD + (NAV + body + TAIL).replace("{n}", str(n))


def test_wrapper_extracts(spark):
    bodies = {
        1: ("<article><h1>T &amp; 1</h1><p>One  two<br>three</p><p><b>bold <p>next</article>", "T & 1\nOne two three\nbold\nnext"),
        2: ("<article><h1>T2</h1><p>Solo &nbsp; x</p><footer>sign</footer></article>", "T2\nSolo x"),
        3: ("<article><h1>T3</h1></article>", "T3"),
    }
    rows = [(i, f"http://h.org/{i}", page(i, b), 1, "x") for i, (b, _) in bodies.items()]
    rows += [(9, None, None, 1, "x"), (10, "http://h.org/x", "", 1, "x"), (11, "x", "plain &lt; text", 1, "x"), (None, "http://h.org/1", page(1, bodies[1][0]), 1, "x"), (12, "http://d.org/", "<div>" * 5000 + "deep" + "</div>" * 5000, 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int, wrapper string")
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main(df).collect()}
    assert {i: got[i] for i in bodies} == {i: t for i, (_, t) in bodies.items()}
    assert got[9] == "" and got[10] == "" and got[11] == "plain < text" and got[None] == bodies[1][1] and got[12] == "deep"
    assert wrapper.extract_main(df.limit(0)).count() == 0


def test_wrapper_without_article(spark):
    """The wrapper finds the main element, and constant slots are template."""
    rows = [(i, f"http://w.org/{i}", f"<body><div class='top'>Site name</div><div class='x'><div class='y'><p>text {i} of the page, long enough</p><p>more {i * i}</p></div><p>Read on</p></div></body>", None) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string, z string")).collect()}
    assert got == {i: f"text {i} of the page, long enough\nmore {i * i}" for i in range(6)}


def test_wrapper_groups():
    one = wrapper.wrapper(wrapper.parse("<ul><li>a</li><li>b</li></ul><h2>x</h2><p>1</p><h2>y</h2><p>2</p>"))
    assert [(k[0][0], k[2]) for k in one[1]] == [("ul", False), ("h2", True), ("p", True)]
    two = wrapper.merge(one, wrapper.wrapper(wrapper.parse("<ul><li>a</li></ul><div>new</div><h2>x</h2><p>1</p>")))
    assert [(k[0][0], k[1]) for k in two[1]] == [("ul", False), ("div", True), ("h2", False), ("p", False)]
    assert "&".join(wrapper.parse("<p>a<b>b</b> c &lt;d&gt; <")[1][0][1]) == "ab c <d> <"


# --- 10 suffix arrays ---


@pytest.mark.parametrize("budget, limit, block", [(1 << 30, 1 << 21, 1 << 18), (0, 3, 16), (500, 20, 64)])
def test_suffix_sort(monkeypatch, tmp_path, budget, limit, block):
    monkeypatch.setattr(suffix_sort, "BLOCK", block)
    rnd = random.Random(budget + limit)
    for trial in range(40):
        alphabet = rnd.choice([b"ab", b"abc", b"a", bytes(range(256)), b"\x00\x01"])
        text = bytes(rnd.choice(alphabet) for _ in range(rnd.randint(1, 250)))
        text += text[: len(text) // 2] if trial % 2 else b""
        depth = rnd.choice([8, 16, 100])
        with suffix_sort.Store(str(tmp_path), budget) as store:
            found = np.concatenate(list(suffix_sort.suffixes(text, depth, store, limit)))
        pos, lcp = found["pos"].tolist(), found["lcp"].tolist()
        assert sorted(pos) == list(range(len(text)))
        padded = text + bytes(depth)
        for p, q, n in zip(pos, pos[1:], lcp[1:]):
            a, b = padded[p : p + depth], padded[q : q + depth]
            assert a >= b
            if max(p, q) + depth <= len(text):
                assert n == next((k for k in range(depth) if a[k] != b[k]), depth)


def brute_repeats(rows):
    """rows: (order, text); digest of each as the contract says."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                cover[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        spans = sum(bool(c) and (not k or not cover[k - 1]) for k, c in enumerate(cover))
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        out[key] = (len(raw), sum(cover), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def repeated_rows():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rnd.randint(10, 60))) for _ in range(6)]
    rows = [(i, " ".join(rnd.choice(shared) if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 8)))) for i in range(60)]
    return rows + [(200, None), (201, ""), (202, "x" * 1000), (203, "x" * 5000), (204, "ab" * 400), (205, rows[3][1]), (206, rows[3][1] + rows[3][1]), (207, "x" * 99), (208, "x" * 100)]


@pytest.mark.parametrize("memory", [suffix_dedup.MEMORY_BYTES, 500])
def test_suffix_dedup(spark, monkeypatch, memory):
    monkeypatch.setattr(suffix_dedup, "MEMORY_BYTES", memory)
    monkeypatch.setattr(suffix_dedup, "KNOWN", suffix_dedup.KNOWN if memory > 500 else 4)
    rows = repeated_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, version int, spans string")
    want = brute_repeats(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.digest(df).collect()} == {k: v[:4] for k, v in want.items()}
    cut = suffix_dedup.remove_repeats(df)
    assert cut.schema == df.schema
    for r in cut.collect():
        assert r["text"] == (want[r["doc_id"]][4].decode("utf-8", "ignore") if rows_text(rows, r["doc_id"]) is not None else None)


def rows_text(rows, key):
    return dict(rows)[key]


def test_suffix_dedup_edges(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (4, "short"), (7, "y" + text)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in suffix_dedup.digest(df).collect()), key=str)
    n = len(text)
    # the null id comes last; the repeated row is one document with its double
    assert got == sorted([(None, n), (5, 0), (5, 0), (4, 0), (7, n)], key=str)
    assert suffix_dedup.digest(df.limit(0)).count() == 0


def test_anchors_are_shared():
    """Equal strings of MATCH bytes have equal anchors, whatever stands around them."""
    rnd = random.Random(2)
    core = bytes(rnd.randrange(256) for _ in range(130))
    found = []
    for _ in range(3):
        before, after = (bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 90))) for _ in range(2))
        h, at = suffix_dedup.anchors(np.frombuffer(before + core + after, np.uint8))
        low, high = suffix_dedup.reach(h, at)
        own = set()
        for s in range(len(before), len(before) + 31):
            own.add((s - len(before), tuple(sorted(h[p] for p, a, b in zip(at, low, high) if a <= s <= b))))
        found.append(own)
    assert found[0] == found[1] == found[2] and all(names for _, names in found[0])


def test_short_lines_bring_no_segments(spark):
    """A line below MATCH bytes in every document is no candidate; one of MATCH bytes is."""
    rnd = random.Random(6)
    noise = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(300))
    for line, found in (("Released under some licence to all.", False), ("x" + noise()[:140], True)):
        docs = spark.createDataFrame([(i, noise() + line + noise()) for i in range(30)], "doc long, text string")
        assert (suffix_dedup.repeated_places(docs, 8).count() > 0) == found


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(120)) for _ in range(60)]
    junk = [" ".join(word() + "***" for _ in range(120)) for _ in range(30)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, *[t + " " + passage for t in texts[:4]], *[x + " " + passage for x in junk[:1]], *junk, texts[7]])]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int("***" not in r[1])) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES]
    step, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), docs.schema)
        assert step.columns == docs.columns
        sizes.append({r["doc_id"]: r["text"] for r in step.collect()})
    assert not any("***" in t for t in sizes[0].values()) and len(sizes[0]) == 65
    assert rows[-1][0] not in sizes[1] and 7 in sizes[1]
    assert sum(passage in t for t in sizes[2].values()) == 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(sizes[2])
    assert max(r["offset"] + r["length"] for r in out) <= 2048


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
