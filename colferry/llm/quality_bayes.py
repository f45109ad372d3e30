"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model, fitted here on a bounded sample of labelled documents, gives each document's evidence from counts of
its bytes. Grouped sums of that evidence give each host a posterior share of good documents, shrunk to the global
share, and each path one that is shrunk to its host's. How strongly, follows from how much hosts (paths) differ
beyond what their sizes explain. A document's odds are its evidence times its path's odds over the global odds, with
the document itself left out of the sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colferry.llm.common import Scratch, free_name, slices, small_batches

#: Labelled documents that the model is fitted on at most (those with the least hash of their id).
SAMPLE_ROWS = 4000
BIGRAMS = 1024
SIZE = BIGRAMS + 10
STRENGTH = (1.0, 10_000.0)
THRESHOLD = 0.5
#: Paths up to which their posteriors (some 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_PATHS = 50_000
#: Tasks that a path's rows are spread over in that shuffle.
SALTS = 16
_CLASS = np.zeros((5, 256))
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>{}[]\\/=+~^_@", "!?.,;:", " \n\t")):
    _CLASS[_k, list(_chars.encode())] = 1


def features(text: str) -> np.ndarray:
    """Shares of hashed byte pairs (square roots), of classes of bytes, logarithms of length, shares of distinct and doubled words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(SIZE, np.float32)
    if not len(raw):
        return out
    pairs = np.zeros(BIGRAMS, np.int64)
    for at in range(0, len(raw), 1 << 20):
        part = raw[at : at + (1 << 20) + 1].astype(np.uint32)
        pairs += np.bincount((part[:-1] * 257 + part[1:] * 31) * 0x9E3779B1 >> np.uint32(22) & (BIGRAMS - 1), minlength=BIGRAMS)
    out[:BIGRAMS] = np.sqrt(pairs / len(raw))
    counts = np.bincount(raw, minlength=256)
    out[BIGRAMS : BIGRAMS + 5] = _CLASS @ counts / len(raw)
    out[BIGRAMS + 5] = np.log1p(len(raw)) / 10
    out[BIGRAMS + 6] = np.log1p(counts[32] + counts[10] + counts[9]) / 10
    out[BIGRAMS + 7] = len(raw) < 40
    words = text.split()
    if words:
        out[BIGRAMS + 8] = len(set(words)) / len(words)
        out[BIGRAMS + 9] = sum(map(eq, words, words[1:])) / len(words)
    return out


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-5, steps: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model; accelerated gradient descent from zero, so reruns agree."""
    if not len(y) or y.min() == y.max():  # nothing to tell apart
        bias = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        return np.append(np.zeros(SIZE), bias)
    a = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    rate = 4.0 / (np.square(a).sum(1).mean() + 1e-9)
    w = np.zeros(a.shape[1])
    last = w
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -30, 30)))
        gradient = a.T @ (p - y) / len(y) + l2 * np.append(ahead[:-1], 0)
        last, w = w, ahead - rate * gradient
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights from at most sample_rows labelled documents; null labels and documents that aren't there are passed over; rows of one id and text count once."""
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("__id")).agg(F.min(label_col).alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([features(t or "").tobytes() for t in batch.column(3).to_pylist()], pa.binary())], names=["__id", "nth", "y", "x"])

    joined = small_batches(docs).select(docs[id_col].cast("long").alias("__id"), docs[text_col].alias("t")).join(F.broadcast(known), "__id").select("__id", F.col("__y").cast("int").alias("y"), "t")
    texts = joined.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64("t"), "t")))
    seen = texts.select("__id", "nth", "y", "t").mapInArrow(vectors, "__id long, nth int, y int, x binary")
    rows = sorted(seen.orderBy("nth", F.xxhash64("__id"), "__id").limit(sample_rows).select("y", "x").collect())  # each id once before any twice
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, SIZE)
    return fit(x, np.array([r["y"] > 0 for r in rows], np.float64))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, share: str, prior: Column) -> Column:
    """Pseudo-documents of the prior: from the spread of the groups' shares beyond that of sampling."""
    spread = F.sum(F.col("n") * F.pow(F.col(share) / F.col("n") - prior, 2)) / F.sum("n")
    chance = F.sum(prior * (1 - prior)) / F.sum("n")
    between = F.greatest(spread - chance, F.lit(1e-9))
    return F.least(F.greatest(F.avg(prior * (1 - prior)) / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def classify(docs: DataFrame, weights: np.ndarray, text_col: str = "text", host_col: str | None = "source", path_col: str | None = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """docs with __evidence (logit), __host, __path (posterior shares), __posterior and __kept.

    Two passes over the texts: sums by host and path, then verdicts; the texts themselves are never shuffled while the
    paths are few. Null or empty text: evidence of an empty text. A null host or path is a group of its own. Repeated
    rows are judged each; an empty table gives none. Other columns pass through, whatever their names: where docs has
    a column of a verdict's name, the verdict's gets one more underscore, until it is free.
    """
    judged = verdicts(docs, weights, text_col, host_col, path_col, threshold)
    return judged.select("row.*", *[F.col(f"verdict.{c}").alias(free_name(docs, f"__{c}")) for c in ("evidence", "host", "path", "posterior", "kept")])


def verdicts(docs: DataFrame, weights: np.ndarray, text_col: str = "text", host_col: str | None = "source", path_col: str | None = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """row (the columns of docs) and verdict (evidence, host, path, posterior, kept), as two structs."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(weights)  # a thousand numbers
    group = lambda c: F.coalesce(docs[c].cast("string"), F.lit("\0null")) if c else F.lit("")
    names, text_at = docs.columns, [c.lower() for c in docs.columns].index(text_col.lower())
    src = small_batches(docs).select(F.struct(*[docs[c] for c in names]).alias("__row"), group(host_col).alias("__h"), group(path_col).alias("__p"))

    def evidence(texts: pa.Array) -> pa.Array:
        w = model.value
        x = np.stack([features(t or "") for t in texts.to_pylist()]) if len(texts) else np.zeros((0, SIZE))
        return pa.array(np.clip(x @ w[:-1] + w[-1], -30, 30))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), evidence(batch.column(2))], names=["__h", "__p", "__evidence"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4 << 20):
                yield pa.RecordBatch.from_arrays([*batch.columns, evidence(batch.column(0).field(text_at))], names=["__row", "__h", "__p", "__evidence"])

    share = 1 / (1 + F.exp(-F.col("__evidence")))
    paths = src.select("__h", "__p", F.col("__row")[text_col].alias("__t")).mapInArrow(score, "__h string, __p string, __evidence double").groupBy("__h", "__p").agg(F.count("*").alias("n"), F.sum(share).alias("s"))
    paths = Scratch(spark).write(paths, "paths")
    hosts = paths.groupBy("__h").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max((total["s"] or 0) / max(1, total["n"] or 0), 1e-4), 1 - 1e-4)
    of_host = hosts.agg(_strength(hosts, "s", F.lit(mean)).alias("k")).first()["k"] or STRENGTH[0]
    hosts = hosts.select("__h", F.col("n").alias("hn"), F.col("s").alias("hs"))
    both = paths.join(hosts, "__h")
    prior = (F.col("hs") + of_host * mean) / (F.col("hn") + of_host)
    of_path = both.agg(_strength(both, "s", prior).alias("k")).first()["k"] or STRENGTH[0]
    few = paths.count() <= BROADCAST_PATHS
    kinds = T.StructType([src.schema["__row"], *(T.StructField(c, T.StringType()) for c in ("__h", "__p")), T.StructField("__evidence", T.DoubleType())])
    judged = src.mapInArrow(judge, kinds)
    p = 1 / (1 + F.exp(-F.col("__evidence")))
    host = (F.col("hs") - p + of_host * mean) / (F.col("hn") - 1 + of_host)
    path = (F.col("s") - p + of_path * host) / (F.col("n") - 1 + of_path)
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.col("__evidence") + _logit(clip(path)) - _logit(F.lit(mean))
    if few:
        joined = judged.join(F.broadcast(both), ["__h", "__p"])
    else:  # a hot path's rows go to SALTS tasks
        salts = both.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = judged.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int")).join(salts, ["__h", "__p", "__salt"])
    posterior = 1 / (1 + F.exp(-odds))
    fields = (F.col("__evidence").alias("evidence"), clip(host).alias("host"), clip(path).alias("path"), posterior.alias("posterior"), (posterior >= threshold).alias("kept"))
    return joined.select(F.col("__row").alias("row"), F.struct(*fields).alias("verdict"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """docs that the classifier keeps."""
    judged = verdicts(docs, train(docs, labels, id_col, text_col), text_col, host_col, path_col, threshold)
    return judged.where("verdict.kept").select("row.*")
