"""Tokeniser fertility: what public vocabularies make of a text, against bands for its language or script.

Measures: characters per token of a byte-level and of a piece vocabulary, share of byte-fallback tokens of the
latter, entropy of the former's tokens: of all (against the most that so many tokens can have, up to ENTROPY_FULL),
and the mean over windows of WINDOW tokens, which does not depend on a text's length. A text outside a band of its
language, or of its script where the language is unknown, is rejected. There are fixed bands, and bands that the
corpus itself gives: characters per token and the windows' entropy scatter about the language's median by
1 / sqrt(tokens), and what lies SPREADS times the usual scatter away is rejected. Medians come from grouped histograms
over all documents. They are shrunk by empirical Bayes, a language's median towards that of all by what sampling
explains of their difference, its scatter towards a wide prior; so few documents reject little, at any size by the
same rule. Beside the measures stand plain counts of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colferry.llm.common import SPACES, Scratch, byte_bpe, piece_bpe, slices, small_batches

#: Least and most characters a token; most share of byte fallback; least entropy (0 to 1).
BANDS: dict[str, dict[str, float]] = {
    "en": {"low": 1.6, "high": 7.0, "fallback": 0.02, "entropy": 0.45},
    "de": {"low": 1.4, "high": 7.0, "fallback": 0.02, "entropy": 0.45},
    "fr": {"low": 1.4, "high": 7.0, "fallback": 0.02, "entropy": 0.45},
    "es": {"low": 1.4, "high": 7.0, "fallback": 0.02, "entropy": 0.45},
    "Latin": {"low": 1.3, "high": 8.0, "fallback": 0.05, "entropy": 0.4},
    "Greek": {"low": 0.5, "high": 6.0, "fallback": 0.5, "entropy": 0.4},
    "Cyrillic": {"low": 0.5, "high": 6.0, "fallback": 0.3, "entropy": 0.4},
    "CJK": {"low": 0.25, "high": 4.0, "fallback": 0.9, "entropy": 0.4},
    "Other": {"low": 0.2, "high": 8.0, "fallback": 1.0, "entropy": 0.3},
}
#: Entropy says nothing about fewer tokens than these.
ENTROPY_TOKENS = 32
ENTROPY_FULL = 1024
#: Tokens to a window of the windows' entropy.
WINDOW = 32
#: Scatter that a text may have, and tokens beyond which it narrows no further.
SPREADS, SPREAD_TOKENS = 6.0, 2048
#: Prior scatter by measure, the documents that it counts as, and its share that the scatter never falls below.
PRIORS, PRIOR_DOCS, LEAST_SCATTER = {"chars_per_token": 2.0, "chars_per_piece": 2.0, "window_entropy": 0.4}, 8, 0.25
#: Widths of the histograms' bins: of characters a token, and of scatter.
BIN, SCATTER_BIN = 0.001, 0.01
#: Words whose pieces a worker remembers (about 200 bytes each).
CACHE_WORDS = 400_000
#: The piece vocabulary is smaller, so its lower bound is this share of the band's.
PIECE_LOW = 0.75
SYMBOLS = "#*$%&|<>"
_SCRIPTS = (("Latin", "[A-Za-zÀ-ɏ]"), ("Greek", "[Ͱ-Ͽ]"), ("Cyrillic", "[Ѐ-ԯ]"), ("CJK", "[぀-ヿ㐀-鿿가-힯]"))
_SCRIPT = [(name, re.compile(pattern)) for name, pattern in _SCRIPTS]


def script(text: str) -> str:
    if text.isascii():
        return "Latin"
    counts = [(sum(1 for _ in p.finditer(text)), name) for name, p in _SCRIPT]
    most = max(counts)
    return most[1] if most[0] else "Other"


class Pieces(dict):
    """Piece and byte-fallback counts by word, as n + fallback x 2^32; emptied when it grows past CACHE_WORDS."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        sp = piece_bpe()
        ids = sp.encode(word.decode())
        value = self[word] = len(ids) + (sum(map(sp.is_byte, ids)) << 32)
        return value


@cache
def shared_pieces() -> Pieces:
    """Kept by a worker from task to task."""
    return Pieces()


def repeat_words(words: list[bytes]) -> int:
    """Words in 5-word windows found twice or more, the first included."""
    n = len(words) - 4
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        w = h[:n].copy()
        for k in range(1, 5):
            w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice))
    seen: dict[tuple, list[int]] = {}
    for i in at.tolist():  # the words themselves decide, not their hashes
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    mark = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            p = np.asarray(places)
            np.add.at(mark, p, 1)
            np.add.at(mark, p + 5, -1)
    return int((np.cumsum(mark) > 0).sum())


def word_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words in repeated windows."""
    spaces = sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def counts_fail(counts: tuple) -> bool:
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def measure(text: str, pieces: Pieces) -> tuple:
    """Word counts, then tokens, characters a token (both vocabularies), fallback share, both entropies; None without words."""
    words = text.encode().split()
    counts = word_counts(text, words)
    if not words:
        return *counts, 0, None, None, None, None, None
    ids = byte_bpe().encode_to_numpy(text, disallowed_special=())
    total = sum(map(pieces.__getitem__, words))
    n_pieces, fallback = total & 0xFFFFFFFF, total >> 32
    _, each = np.unique(ids, return_counts=True)
    share = each / len(ids)
    entropy = float(-(share * np.log(share)).sum() / np.log(min(len(ids), ENTROPY_FULL))) if len(ids) > 1 else 0.0
    return *counts, len(ids), len(text) / len(ids), counts[1] / max(1, n_pieces), fallback / max(1, n_pieces), entropy, window_entropy(ids)


def window_entropy(ids: np.ndarray) -> float | None:
    """Mean entropy of the windows of WINDOW ids, against the most there is; None if there is no whole one."""
    n = len(ids) // WINDOW * WINDOW
    if not n:
        return None
    rows = np.sort(ids[:n].reshape(-1, WINDOW), axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    each = np.diff(np.append(np.flatnonzero(new), n))
    return float(1 - (each * np.log(each)).sum() / n / np.log(WINDOW))


def in_bands(m: tuple, band: Mapping[str, float]) -> bool:
    _, by_byte, by_piece, fallback, entropy = m[5:10]
    if by_byte is None:
        return False
    return band["low"] <= by_byte <= band["high"] and PIECE_LOW * band["low"] <= by_piece <= band["high"] and fallback <= band["fallback"] and (m[5] < ENTROPY_TOKENS or entropy >= band["entropy"])


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, chars_per_piece double, fallback_share double, entropy double, band string, window_entropy double"


COUNTS = ", ".join(SCHEMA.split(", ")[:7])


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The plain counts of fertility and base_failed alone, without vocabularies: one pass, nothing written between."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for text in batch.column(1).to_pylist():
                    counts = word_counts(text or "", (text or "").encode().split())
                    rows.append((*counts, counts_fail(counts)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 5 + [pa.bool_()]))], names=[c.split()[0] for c in COUNTS.split(", ")])

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(judge, COUNTS)


def _medians(rows: DataFrame, value: str, width: float) -> DataFrame:
    """band, docs and the median of a column to the width of a bin; one row a bin and band is ranked."""
    bins = rows.groupBy("band", F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("band").orderBy("bin"))
    docs = F.sum("n").over(Window.partitionBy("band"))
    ranked = bins.select("band", "bin", upto.alias("upto"), docs.alias("docs")).where(2 * F.col("upto") >= F.col("docs"))
    return ranked.groupBy("band").agg((F.min("bin") * width + width / 2).alias(value), F.first("docs").alias("docs"))


def usual(measured: DataFrame) -> DataFrame:
    """band, docs, and for both vocabularies the median and the usual scatter (1.48 x median absolute deviation)."""
    out = None
    for name in PRIORS:
        rows = measured.where(F.col(name).isNotNull() & ~F.col("base_failed"))
        middle = _medians(rows, name, BIN).withColumnRenamed(name, "m")
        near = rows.join(F.broadcast(middle), "band").select("band", (F.abs(F.col(name) - F.col("m")) * F.sqrt(F.least("n_tokens", F.lit(SPREAD_TOKENS)))).alias("off"))
        both = middle.join(_medians(near, "off", SCATTER_BIN * PRIORS[name] / 2).drop("docs"), "band").join(rows.groupBy("band").agg(F.avg(1 / F.least("n_tokens", F.lit(SPREAD_TOKENS))).alias(f"{name}_t")), "band")
        both = both.select("band", "docs", F.col("m").alias(f"{name}_m"), (1.4826 * F.col("off")).alias(f"{name}_s"), f"{name}_t", F.col("docs").alias(f"{name}_n"))
        out = both if out is None else out.join(both.drop("docs"), "band", "left")
    return out


def limits(known: list) -> list[tuple]:
    """(band, and for each measure centre, variance of one token's worth, variance of the centre), from usual's rows.

    With n texts of a language the centre's variance is n-fold less than one text's; what of the medians' differences
    that leaves is between languages. So a median is worth n / (n + ratio of the two), the median of all the rest.
    """
    out = {r["band"]: [r["band"]] for r in known}
    for name, prior in PRIORS.items():
        rows = [r for r in known if r[f"{name}_m"] is not None]
        total = sum(r[f"{name}_n"] for r in rows)
        middle = sum(r[f"{name}_n"] * r[f"{name}_m"] for r in rows) / max(1, total)
        between = sum(r[f"{name}_n"] * (r[f"{name}_m"] - middle) ** 2 for r in rows) / max(1, total)
        for r in known:
            if r not in rows:
                out[r["band"]] += [None, None, None]
                continue
            n = r[f"{name}_n"]
            spread = max((n * r[f"{name}_s"] ** 2 + PRIOR_DOCS * prior**2) / (n + PRIOR_DOCS), (LEAST_SCATTER * prior) ** 2)
            one = spread * r[f"{name}_t"]
            trust = n * between / (n * between + one)
            out[r["band"]] += [middle + trust * (r[f"{name}_m"] - middle), spread, trust * one / n + (1 - trust) * between]
    return [tuple(x) for x in out.values()]


def fertility(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: Mapping[str, Mapping[str, float]] = BANDS) -> DataFrame:
    """Counts, measures and verdict of every document: one pass over the texts, then grouped sums over the measures.

    Null or wordless text: no words, base_failed, not kept, measures null. A null or unknown language: the band of the
    text's script. Null ids stay; repeated rows are judged each; an empty table gives none; other columns aren't read.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces()
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    m = measure(text or "", pieces)
                    failed = counts_fail(m)
                    name = lang if lang in bands else script(text or "")
                    rows.append((*m[:5], failed, not failed and in_bands(m, bands[name]), *m[5:10], name, m[10]))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 4 + [pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    src = small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), (docs[lang_col] if lang_col else F.lit(None).cast("string")).alias("lang"))
    measured = Scratch(docs.sparkSession).write(src.mapInArrow(judge, SCHEMA), "measured")
    known = limits(usual(measured).collect())  # one row a band: at most as many as bands has
    fields = [f"{name}_{x}" for name in PRIORS for x in ("m", "v", "c")]
    table = docs.sparkSession.createDataFrame(known, ", ".join(["band string", *[f"{f} double" for f in fields]]))
    joined = measured.join(F.broadcast(table), "band", "left")
    tokens = F.least("n_tokens", F.lit(SPREAD_TOKENS))
    far = lambda n: F.coalesce(F.pow(F.col(n) - F.col(f"{n}_m"), 2) > SPREADS**2 * (F.col(f"{n}_v") / tokens + F.col(f"{n}_c")), F.lit(False))
    odd = reduce(or_, map(far, PRIORS))
    return joined.withColumn("kept", F.col("kept") & ~odd).select(*[c.split()[0] for c in SCHEMA.split(", ")])
