"""Documents to packed training sequences: quality, near duplicates, repeated passages, source weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colferry.llm.common import Scratch, table
from colferry.llm.mixing import mix
from colferry.llm.near_copies import keep_one
from colferry.llm.packing import pack
from colferry.llm.quality_bayes import keep_good
from colferry.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles alike to 0.8 or more, the one with the smallest id stays."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that start earlier in the corpus are cut from the texts; a document without text left goes."""
    Scratch(spark).settle()
    cut = remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.where(F.length(F.trim("text")) > 0).select(*docs.columns)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it: not at all, once or twice. Rows without words come once.

    The mix takes rows of one id and source alike, null ids and sources among them, so these two say how often.
    """
    Scratch(spark).settle()
    times = (F.col("taken") / F.col("size")).cast("int")
    taken = mix(docs).where("size > 0").select(F.struct("doc_id", "source", times.alias("times")).alias("mixed")).distinct().where("mixed.times <> 1")
    taken = Scratch(spark).write(taken, "taken")
    row = docs.select(F.struct(*docs.columns).alias("row"))  # whatever names the columns have
    same = (F.col("row.doc_id").cast("long").eqNullSafe(F.col("mixed.doc_id"))) & (F.col("row.source").eqNullSafe(F.col("mixed.source")))
    kept = row.join(F.broadcast(taken) if taken.count() <= BROADCAST_IDS else taken, same, "left")
    return kept.select("row", F.explode(F.array_repeat(F.lit(0), F.coalesce("mixed.times", F.lit(1))))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, their sequences, and which copy of the document they are of."""
    Scratch(spark).settle()
    return pack(docs, with_ids=True, with_copies=True)


#: Ids up to which what the mix takes of them is broadcast (some 50 bytes each).
BROADCAST_IDS = 1 << 20
STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_weights", source_weights),
    ("packed", packed),
]
#: The classifier, the links and the repeated strings cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
