"""Fertility, quality classifier, chat format, packing and mixing."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colferry.llm import chat_format as chat
from colferry.llm import fertility as fert
from colferry.llm import mixing, packing, quality_bayes
from colferry.llm.common import byte_bpe, byte_bpe_json

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " \t\n", "a", "word", "x" * 50_000, "the cat sat on the mat " * 400, "é ü\u00a0ñ 漢字 \U0001f600", "same text here", "same text here"]
#: Clashing names that no operator may trip over.
EXTRA = "doc_id long, text string, lang string, source string, hash long, n long, size long, kept boolean, bucket int, length long, row string"


def rows_of(texts):
    return [(i, t, random.Random(i).choice(["en", "de", None, "xx"]), random.Random(i).choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]


def with_extra(spark, texts):
    return spark.createDataFrame([(i if i else None, t, None, "s", 1, 2, 3, True, 4, 5, "r") for i, t in enumerate(texts)], EXTRA)


# --- 1 fertility ---


def brute_counts(text):
    text = text or ""
    words, word = [], ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#<é\u00a0\u2003"), max_size=120))
def test_fertility_counts(text):
    assert fert.measure(text, fert.shared_pieces())[:5] == brute_counts(text)


def test_fertility_table(spark):
    docs = spark.createDataFrame(rows_of(EDGE), DOCS)
    found = {r["doc_id"]: r for r in fert.fertility(docs).collect()}
    assert len(found) == len(EDGE)
    for i, t in enumerate(EDGE):
        r = found[i]
        n = brute_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert fert.fertility(with_extra(spark, EDGE)).count() == len(EDGE)
    assert fert.fertility(docs.limit(0)).count() == 0


def test_fertility_bands():
    prose = "The committee met on Tuesday and agreed that further work would be needed before the report is sent to members. " * 1
    noise = "Ⱦ꙰ӾꙖ ҉҈ ᚠᛇᚻ ⰀⰁ ꔀꔁꔂ " * 8
    m = fert.measure(prose, fert.shared_pieces())
    assert fert.in_bands(m, fert.BANDS["en"]) and m[8] == 0
    assert not fert.in_bands(fert.measure(noise, fert.shared_pieces()), fert.BANDS["en"])
    assert fert.script("Привет мир") == "Cyrillic" and fert.script("漢字") == "CJK" and fert.script("!?") == "Latin" and fert.script("٣") == "Other"


def test_fertility_bands_of_the_corpus(spark, monkeypatch):
    """Medians and scatter are those of all texts; a text far off for its length is rejected, a short one is not."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 9)))
    texts = [" ".join(word() for _ in range(rnd.randint(30, 300))) for _ in range(250)]
    texts += [" ".join(word().upper() + "#" for _ in range(300)), " ".join(word() for _ in range(40_000))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    found = {r["doc_id"]: r for r in fert.fertility(docs).collect()}
    assert [i for i, r in found.items() if not r["kept"]] == [250]
    known = fert.usual(fert.fertility(docs)).first()
    for name in ("chars_per_token", "chars_per_piece"):
        values = [(r[name], r["n_tokens"]) for r in found.values()]
        middle = sorted(v for v, _ in values)[(len(values) - 1) // 2]
        assert abs(known[f"{name}_m"] - middle) <= fert.BIN
        off = sorted(abs(v - known[f"{name}_m"]) * min(n, fert.SPREAD_TOKENS) ** 0.5 for v, n in values)[(len(values) - 1) // 2]
        assert abs(known[f"{name}_s"] - 1.4826 * off) <= 2 * fert.SCATTER_BIN


# --- 2 quality ---


def corpus(spark, n=300):
    rnd, rows = random.Random(7), []
    for i in range(n):
        good = rnd.random() < 0.7
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(60)]
        text = " ".join(w if good else w + rnd.choice(["***", "$$$", "%%%"]) for w in words)
        rows.append((i, text, "en", "good.org" if good and rnd.random() < 0.9 else "mixed.org", int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int")


def test_quality_held_out_accuracy(spark):
    docs = corpus(spark)
    labels = docs.select("doc_id", "quality")
    weights = quality_bayes.train(docs, labels.where("doc_id % 2 = 0"))
    judged = quality_bayes.classify(docs.drop("quality"), weights).join(labels, "doc_id").where("doc_id % 2 = 1").collect()
    assert sum(r["__kept"] == bool(r["quality"]) for r in judged) / len(judged) > 0.97


def test_quality_shrinks_sparse_sites(spark):
    docs = spark.createDataFrame([(i, "plain words here and there " * 5, None, "big") for i in range(200)] + [(900, "plain words here and there " * 5, None, "tiny")], "doc_id long, text string, lang string, source string")
    weights = np.zeros(quality_bayes.SIZE + 1)
    weights[-1] = 2.0
    got = {r["source"]: r for r in quality_bayes.classify(docs, weights).collect()}
    mean = 1 / (1 + math.exp(-2.0))
    assert abs(got["tiny"]["__path"] - mean) < 0.01 and abs(got["big"]["__path"] - mean) < 0.01


def test_quality_brute_force_posterior(spark):
    docs = corpus(spark, 80).drop("quality")
    weights = quality_bayes.train(docs, corpus(spark, 80).select("doc_id", "quality"))
    rows = quality_bayes.classify(docs, weights).collect()
    p = {r["doc_id"]: 1 / (1 + math.exp(-float(np.clip(quality_bayes.features(r["text"]) @ weights[:-1] + weights[-1], -30, 30)))) for r in rows}
    mean = sum(p.values()) / len(p)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(p[r["doc_id"]])

    def strength(groups, prior):  # groups: (n, s); prior of each
        n = sum(g[0] for g in groups)
        spread = sum(g[0] * (g[1] / g[0] - q) ** 2 for g, q in zip(groups, prior)) / n
        chance = sum(q * (1 - q) for q in prior) / n
        return min(max(sum(q * (1 - q) for q in prior) / len(prior) / max(spread - chance, 1e-9) - 1, 1), 10_000)

    hosts = {h: (len(v), sum(v)) for h, v in by.items()}
    k = strength(list(hosts.values()), [mean] * len(hosts))
    prior = [(s + k * mean) / (n + k) for n, s in hosts.values()]
    k2 = strength(list(hosts.values()), prior)  # one path a host here
    clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
    for r in rows:
        n, s = hosts[r["source"]]
        host = (s - p[r["doc_id"]] + k * mean) / (n - 1 + k)
        path = clip((s - p[r["doc_id"]] + k2 * host) / (n - 1 + k2))
        odds = r["__evidence"] + math.log(path / (1 - path)) - math.log(mean / (1 - mean))
        assert abs(r["__posterior"] - 1 / (1 + math.exp(-odds))) < 1e-6


def test_quality_edges(spark):
    weights = quality_bayes.train(with_extra(spark, EDGE), spark.createDataFrame([(1, None), (None, 1), (3, 1)], "doc_id long, quality int"))
    docs = with_extra(spark, EDGE)
    judged = quality_bayes.classify(docs, weights)
    assert judged.count() == len(EDGE) and judged.select(*docs.columns).schema == docs.schema
    assert quality_bayes.classify(docs.limit(0), weights).count() == 0
    assert quality_bayes.keep_good(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).columns == docs.columns
    assert quality_bayes.train(docs, spark.createDataFrame([], "doc_id long, quality int")).shape == (quality_bayes.SIZE + 1,)


# --- 3 chat format ---

TRICKY = ["", "### Assistant:", "\\### User:", "\\\\</turn>", "</turn>", "<|endoftext|>", "a\\", "### [x]:\n", "]:\n", "é\n</turn>\n", "\\" * 5 + "<|", "plain"]


@settings(max_examples=100, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool", "", "critic", "### [", "</turn>"]), st.one_of(st.sampled_from(TRICKY), st.text(st.sampled_from("\\#<|/turn> Asitan:[]é\n"), max_size=40)))
def test_chat_turn_round_trip(role, text):
    ids, mask = chat.encode_turn(role, text)
    assert chat.read_turn(ids) == (role, text)
    assert chat.unescape(byte_bpe().decode_bytes(ids[mask > 0].tolist()).decode()) == (text if role == "assistant" else "")
    body = chat.escape(text)
    assert chat._CONTROL and not __import__("re").search(r"(?<!\\)" + chat._CONTROL, body)
    assert chat.show(ids).endswith(body + "\n</turn>\n")


def test_chat_digest(spark):
    rows = [(1, 1, "assistant", "b </turn>"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, None, "x" * 30_000), (None, 5, "user", "n"), (None, None, "system", "s"), (3, 0, "user", "r"), (3, 0, "user", "r")]
    rows += [(4, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, mask string, start long")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or "", r is not None))
    for c, turns in by.items():
        turns = sorted(turns, key=lambda t: (t[0], t[1], t[4], t[2], t[3]))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    starts = chat.format_turns(df).where("conv_id = 4").orderBy("turn").collect()
    assert [r["start"] for r in starts] == np.cumsum([0, *[len(r["ids"]) for r in starts]]).tolist()[:-1]
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# --- 5 packing ---


def test_packing_tokens_match_the_tokenizer():
    for t in [x or "" for x in EDGE] + ["a <|endoftext|> b", "don't 12 345 \r\n\t x  y"]:
        ids = byte_bpe_json().encode(t, add_special_tokens=False).ids
        assert np.frombuffer(packing.token_bytes(t), "<u4").tolist() == [*ids, 0]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
def test_packing_plan(counts):
    runs = packing.plan(counts, 60)
    used, rows = Counter(), defaultdict(list)
    ranks = defaultdict(list)
    for n, rank, first, count, at in runs:
        used[n] += count
        ranks[n].append((rank, count))
        for s in range(first, first + count):
            rows[s].append((at, n))
    assert used == Counter(counts)
    for spans in ranks.values():
        at = 0
        for rank, count in sorted(spans):
            assert rank == at
            at += count
    for items in rows.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 60
        assert sum(3 * n > 60 for _, n in items) <= 2
    # no worse than first-fit decreasing
    bins = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        k = next((k for k, b in enumerate(bins) if b + n <= 60), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    assert len(rows) <= len(bins)


@pytest.mark.parametrize("bucket_rows", [packing.BUCKET_ROWS, 3])
def test_packing_table(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(packing, "BUCKET_ROWS", bucket_rows)
    texts = EDGE + ["word " * 5000, "<|endoftext|>"] + [f"t{i} " * (i * 7) for i in range(60)] + ["dup"] * 9
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows_of(texts)], DOCS + ", rank int, sequence_id int")
    out = packing.pack(docs, capacity=512, with_ids=True).collect()
    pieces, rows = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, t in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert b"".join(bytes(r["ids"]) for r in own) == packing.token_bytes(t or "")
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]]).tolist()[:-1]
        assert all(r["length"] == 512 for r in own[1:])
    for items in rows.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 512
    assert packing.pack(docs.limit(0)).count() == 0


# --- 7 mixing ---


def fill(sizes, weights, share, cap):
    """Water-filling, source after source, until nobody is above the cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        for s in free:
            target[s] = left * w[s] / sum(w[x] for x in free)
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            break
        full |= over
    return target | {s: float(cap * sizes[s]) for s in full}


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rnd = random.Random(seed)
    sources = ["b", "a", None, "ä", "Z", "z"]
    rows = [(i, "w " * int(rnd.expovariate(1 / 30)) if rnd.random() > 0.05 else None, rnd.choices(sources, [10, 3, 1, 1, 1, 1])[0], 1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, hash long, rest int")
    out = mixing.mix(df).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, t, s, *_ in rows:
        n = len((t or "").split())
        sizes[s] += n
        largest[s] = max(largest[s], n)
    want = fill(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.CAP)
    assert len(out) == len(rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_mixing_edges(spark):
    df = spark.createDataFrame([(None, "a b", "s"), (None, "c", "s"), (1, "d e", "s"), (1, "d e", "s"), (2, None, None), (3, " ", None)], "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == 6 and all(r["taken"] == 0 for r in out if r["source"] is None)
    assert mixing.mix(df.limit(0)).count() == 0
