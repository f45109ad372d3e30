"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Lengths are at most the capacity, so a plan needs no more than their counts: items above one third of the capacity
meet at most twice in a sequence and are matched greedily, the longest with the longest that fits; smaller ones go,
longest first, where they fit best. A plan is some thousand runs "so many sequences with these lengths", whatever the
number of documents; each piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colferry.llm.common import SPECIAL, Scratch, byte_bpe, byte_bpe_json, slices, small_batches

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked in one window.
BUCKET_ROWS = 1 << 18
#: The same where the ids go along.
BUCKET_ROWS_IDS = 1 << 14
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, rank, first sequence, sequences, offset) of each run: pieces of this length from this rank on fill
    the sequences one after another, at this offset in each."""
    left = {n: c for n, c in counts.items() if c}
    groups: dict[int, list[list]] = {}  # gap -> [count, ((length, times), ...)]
    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect.bisect_right(large, min(n, capacity - n))
            while k and not left[large[k - 1]]:
                k -= 1
            if k and large[k - 1] == n and left[n] == 1:
                k -= 1
                while k and not left[large[k - 1]]:
                    k -= 1
            if not k:
                groups.setdefault(capacity - n, []).append([left[n], ((n, 1),)])
                left[n] = 0
                break
            m = large[k - 1]
            pairs = left[n] // 2 if m == n else min(left[n], left[m])
            groups.setdefault(capacity - n - m, []).append([pairs, ((n, 1), (m, 1))])
            left[n] -= pairs
            left[m] -= pairs
    gaps = sorted(groups)

    def put(gap: int, group: list) -> None:
        if gap not in groups:
            groups[gap] = []
            bisect.insort(gaps, gap)
        groups[gap].append(group)

    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            k = bisect.bisect_left(gaps, n)
            if k < len(gaps):
                gap = gaps[k]
                count, items = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap]
                    gaps.pop(k)
            else:
                gap, items, count = capacity, (), left[n]
            each = gap // n
            full = min(count, left[n] // each)
            if full:
                put(gap - each * n, [full, (*items, (n, each))])
                left[n] -= full * each
                count -= full
            if count and left[n]:
                some = left[n]  # fewer than fill one more sequence
                put(gap - some * n, [1, (*items, (n, some))])
                left[n] = 0
                count -= 1
            if count and items:
                put(gap, [count, items])
    runs, first, rank = [], 0, dict.fromkeys(counts, 0)
    for gap in sorted(groups):
        for count, items in groups[gap]:
            at = 0
            for n, times in items:
                for _ in range(times):
                    runs.append((n, rank[n], first, count, at))
                    rank[n] += count
                    at += n
            first += count
    return runs


def token_bytes(text: str) -> bytes:
    """Ids of byte_bpe_50k.json and the end id, as little-endian unsigned 32-bit numbers."""
    if SPECIAL in text:  # the end mark written out in a text is one id there
        ids = np.asarray(byte_bpe_json().encode(text, add_special_tokens=False).ids, "<u4")
    else:
        ids = byte_bpe().encode_to_numpy(text, disallowed_special=()).astype("<u4")
    return ids.tobytes() + END_ID.to_bytes(4, "little")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece, with its ids as bytes if asked for."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
        for whole in batches:
            for batch in slices(whole, 1 << 20):
                cols: list[list] = [[] for _ in range(5)]
                ids: list[bytes] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    data = token_bytes(text or "")
                    for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        own = data[4 * start : 4 * (start + length)]
                        for c, x in zip(cols, (doc, k, start, length, zlib.crc32(own))):
                            c.append(x)
                        if with_ids:
                            ids.append(own)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.array(ids, pa.binary())] * with_ids, names=names)

    src = small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return src.mapInArrow(tokenize, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, with_copies: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset, gapless from 0 (and its ids, if asked for; and copy, an int from 0
    that tells equal pieces of rows with one id apart, if asked for).

    Null or empty text: one piece, the end id alone. Null ids and repeated rows are documents each; texts of any
    length are cut; an empty table gives none; other columns are not read. The driver holds one count a length (at
    most capacity of them) and the plan. Pieces of one length are ranked in buckets of some BUCKET_ROWS rows, so that
    no length, however frequent, meets in one task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.write(pieces_of(docs, id_col, text_col, capacity, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, capacity)
    buckets = max(1, -(-max(counts.values(), default=1) // (BUCKET_ROWS_IDS if with_ids else BUCKET_ROWS)))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    if buckets > 1:  # ranks begin where the smaller buckets of the length end
        begins = salted.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("begin", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
        salted = salted.join(begins, ["length", "bucket"])
    else:
        salted = salted.withColumn("begin", F.lit(0).cast("long"))
    rank = F.col("begin") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    copy = F.row_number().over(Window.partitionBy("length", "bucket", "doc_id", "piece", "ids_crc32").orderBy("start")) - 1  # same shuffle and order
    own = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    cols = own + ["copy"] * with_copies
    ranked = salted.select(*own, rank.cast("long").alias("rank"), *[copy.cast("int").alias("copy")] * with_copies)
    table = np.asarray(sorted(runs), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)  # a few thousand rows, as the plan has

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            own = runs[np.searchsorted(keys, (length << 48) + rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            sequence = own[:, 2] + rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(sequence), pa.array(own[:, 4])], names=[*cols, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", ids binary" * with_ids + ", copy int" * with_copies + ", sequence_id long, offset long")
