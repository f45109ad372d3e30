"""Helpers shared by the operators: tables, slices of batches, public tokenizers."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from colferry.scratch import Scratch  # noqa: F401

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
SPECIAL = "<|endoftext|>"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's Arrow batches to BATCH_BYTES: at the default, a few of them fill a small executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(df.sparkSession.conf.get(key)).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """The name, with more underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch, max_bytes: int = 8 << 20) -> Iterator:
    """Row ranges of an Arrow batch of about max_bytes each, so that long texts don't meet in memory."""
    rows = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    give_back()


@cache
def _trim():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Freed memory goes back to the system: workers stay, idle, while others of the executor work."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


@cache
def byte_bpe(path: str | None = None):
    """The byte-level vocabulary, as tiktoken runs it; its ids are those of byte_bpe_50k.json."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def byte_bpe_json(path: str | None = None):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))


@cache
def piece_bpe(path: str | None = None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
