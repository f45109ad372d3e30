"""SimHash near-duplicates: fingerprints, pigeonhole blocks, a join on blocks, and a check of the Hamming distance.

64 bits are cut in four blocks; of two fingerprints that differ in at most two bits, two blocks are equal, so each
fingerprint enters six tables, keyed by two blocks. A key that many distinct fingerprints share is cut again over its
free bits, by the same rule, and once more: then 8 bits are free, and no key has above 256 fingerprints. So no hot key
is ever joined in full, and no pair is missed. Equal fingerprints are one row from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colferry.llm.common import Scratch, slices, small_batches
from colferry.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Distinct fingerprints to a key up to which its pairs are compared.
KEY_ROWS = 64
CHUNK = 1 << 16
BLOCKS = 4
#: Rows of ids up to which a join by document id broadcasts them (8 bytes each).
BROADCAST_IDS = 1 << 21


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits that over half of the shingles' hashes have; 0 without words."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(shingle)))), repeat(SEED))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.fromiter(hashes, np.uint64, min(CHUNK, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                fps = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(hash_rows, "doc_id long, fp long")


def _submasks(mask: int) -> list[int]:
    """Masks with DISTANCE of BLOCKS equal parts of the free bits fixed besides."""
    free = [b for b in range(64) if not mask >> b & 1]
    size = len(free) // BLOCKS
    parts = [sum(1 << b for b in free[k * size : (k + 1) * size]) for k in range(BLOCKS)]
    return [mask | sum(keep) for keep in combinations(parts, BLOCKS - DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, scratch: Scratch, key_rows: int = KEY_ROWS) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints within DISTANCE bits; a pair may come more than once."""
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in _submasks(0)])).alias("mask"))
    masks, out = _submasks(0), None
    for level in range(3):
        keyed = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        keyed = scratch.write(keyed.join(sizes, ["mask", "key"]), f"keys{level}")
        few = keyed.where(F.col("n") <= key_rows) if level < 2 else keyed
        a, b = few.select("mask", "key", F.col("fp").alias("a")), few.select("mask", "key", F.col("fp").alias("b"))
        pairs = a.join(b, ["mask", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
        out = pairs if out is None else out.union(pairs)
        hot = keyed.where(F.col("n") > key_rows)
        if level == 2 or not hot.head(1):
            break
        finer = F.lit(None)
        for m in masks:
            finer = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(s)) for s in _submasks(m)])).otherwise(finer)
        masks = [s for m in masks for s in _submasks(m)]
        rows = hot.select("fp", F.explode(finer).alias("mask")).distinct()
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links lead to, the document itself included.

    Null, empty or wordless text: fingerprint zero, linked like any other. A null id stays (and is no component's
    id, unless no other is there); repeated rows fall together. Texts of any length are hashed whole. Empty table:
    empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    hashed = scratch.write(fingerprints(docs, id_col, text_col, shingle), "hashed")
    fps = scratch.write(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = scratch.write(components(links(fps.select("fp"), scratch), scratch), "roots")
    by_fp = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = scratch.write(by_fp.join(least, "root").select("fp", "component_id"), "of_fp")
    scratch.keep("hashed", "of_fp")
    return hashed.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't among dropped.id. Few ids are broadcast; more are joined by shuffle."""
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    dropped = dropped.select(F.col("id").alias("__dropped")).distinct()
    return docs.join(F.broadcast(dropped) if few else dropped, docs[id_col] == dropped["__dropped"], "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose component has a smaller id. Rows with one id stay together; null ids stay."""
    found = near_duplicates(docs, id_col, text_col)
    dropped = Scratch(docs.sparkSession).write(found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")), "dropped")
    return without_ids(docs, dropped, id_col)
