"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; prefix sums over the buckets find the bucket in which a source's budget
ends; only that bucket's documents are summed again, by the next bits of the hash, until it holds one hash value.
The documents are then filtered by their source's threshold. Nothing is sorted by hash and no document is moved;
budgets nest: a larger budget's threshold takes all that a smaller one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colferry.llm.common import Scratch

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: Bits of the hash resolved by each level; 60 in all.
LEVEL_BITS, HASH_BITS = 12, 60
#: Sources up to which the thresholds (some tens of bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5; a null id counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def sums_before(rows: DataFrame, order: list[Column], sums: dict[str, str], scratch: Scratch | None) -> DataFrame:
    """rows and, by name, sums of a column over the rows before each in that order. Without scratch in one window, of
    few rows; else in ranges of the order, whose own sums (one row a range) are added up first."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if scratch is None:
        return rows.select("*", *[F.coalesce(F.sum(c).over(before(Window.orderBy(*order))), F.lit(0)).alias(name) for name, c in sums.items()])
    ranges = scratch.write(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), f"by-{'-'.join(sums)}")
    ends = sorted(ranges.groupBy("range").agg(*[F.sum(c).alias(name) for name, c in sums.items()]).collect())
    kinds = [ranges.groupBy().agg(F.sum(c).alias("s")).schema["s"].dataType.simpleString() for c in sums.values()]
    begins, so_far = [], [0.0 if x == "double" else 0 for x in kinds]
    for end in ends:
        begins.append((end["range"], *so_far))
        so_far = [x + y for x, y in zip(so_far, list(end)[1:])]
    begin = rows.sparkSession.createDataFrame(begins, ", ".join(["range int", *[f"begin{k} {t}" for k, t in enumerate(kinds)]]))
    own = before(Window.partitionBy("range").orderBy(*order))
    both = ranges.join(F.broadcast(begin), "range")
    return both.select(*rows.columns, *[(F.col(f"begin{k}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(name) for k, (name, c) in enumerate(sums.items())])


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, scratch: Scratch | None = None) -> DataFrame:
    """(source, source_size) with target: weighted shares of share x all sizes, filled up to cap x source_size.

    Sources stand in order of code points, null last; weights repeat. The level at which the uncapped sources share
    the rest comes from prefix sums over the sources by size for weight, in one pass. One small row per source; where
    they are many, scratch says where their ranges may be written.
    """
    name = F.col("source").cast("binary").asc_nulls_last()
    placed = sums_before(sizes.select("source", "source_size", F.lit(1).alias("one")), [name], {"place": "one"}, scratch)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = placed.select("source", "source_size", weight.alias("w"))
    rows = scratch.write(rows, "weights") if scratch else rows
    every = rows.agg(F.sum("source_size").alias("sizes"), F.sum("w").alias("all_w")).first()
    sizes_of_all, all_w = every["sizes"] or 0, every["all_w"] or 0.0
    levels = sums_before(rows, [F.col("source_size") / F.col("w"), name], {"size_before": "source_size", "w_before": "w"}, scratch)
    level = (F.lit(sizes_of_all * share) - F.col("size_before") * cap) / (F.lit(all_w) - F.col("w_before"))
    # the level rises while sources fall short of it and sinks from the first that doesn't: its peak is the right one
    peak = levels.agg(F.max(level)).first()[0] or 0.0
    return rows.select("source", "source_size", F.least(F.lit(peak) * F.col("w"), (F.col("source_size") * cap).cast("double")).cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes.

    taken is a multiple of size: whole rounds of the source, and one more for the documents whose hash lies below the
    source's threshold. The document at the threshold is in if that brings the source nearer to its target.
    Null text or no word: size 0, taken 0. A null source is a source of its own. Rows with one id share a hash and go
    together, so repeated rows and null ids are taken or left as one. Empty table: empty result. Other columns are not
    read. Reruns agree, as the hash depends on the id alone.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = scratch.write(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), id_hash(docs[id_col]).alias("hash")), "sized")
    sizes = scratch.write(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    few = sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    targets = source_targets(sizes, weights, share, cap, None if few else scratch)
    per_source = scratch.write(targets.coalesce(1) if few else targets, "sources")
    hint = F.broadcast if few else lambda df: df

    # rounds: whole copies of the source; rest: words still to be taken below the threshold
    state = per_source.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("rounds"),
    ).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")).withColumn("low", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    # low: the boundary bucket begins here; before: words below it
    for level in range(HASH_BITS // LEVEL_BITS):
        width = 1 << (HASH_BITS - LEVEL_BITS * (level + 1))
        inside = sized.alias("d").join(hint(state.select(F.col("source").alias("s"), "low")), F.col("source").eqNullSafe(F.col("s")))
        if level:
            inside = inside.where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + (width << LEVEL_BITS)))
        bucket = F.col("low") + F.expr(f"(hash - low) div {width}L") * F.lit(width).cast("long")
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("most"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2^12 rows a source
        sums = sums.withColumn("upto", running).join(hint(state.select(F.col("source").alias("s"), "rest", F.col("before").alias("b"))), F.col("source").eqNullSafe(F.col("s")))
        # the first bucket that passes the budget; if none does, all are taken
        past = sums.where(F.col("b") + F.col("upto") > F.col("rest"))
        edge = past.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("b") + F.col("upto") - F.col("words")).alias("before"), "words", "least", "most"), "bucket").alias("e"))
        edge = edge.select(F.col("source").alias("s"), "e.*")
        state = state.select("source", "source_size", "target", "rounds", "rest", F.col("low").alias("low0"), F.col("before").alias("before0")).join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        state = state.select(
            "source", "source_size", "target", "rounds", "rest",
            F.coalesce("bucket", "low0").alias("low"), F.coalesce("before", "before0").alias("before"),
            F.col("bucket").isNull().alias("whole"), F.coalesce("words", F.lit(0).cast("long")).alias("words"), F.coalesce(F.col("most") > F.col("least"), F.lit(False)).alias("open"), "most",
        )
        state = scratch.write(state.coalesce(1) if few else state, f"level{level}")
        if not state.where("open").head(1):
            break
        state = state.drop("whole", "words", "open", "most")
    scratch.keep("sized", f"level{level}")
    # the boundary bucket holds one hash now, and is taken if that brings the sum nearer to the rest
    nearer = F.abs(F.col("before") + F.col("words") - F.col("rest")) < F.abs(F.col("before") - F.col("rest"))
    limit = F.when(F.col("whole"), F.lit((1 << HASH_BITS) - 1).cast("long")).when(nearer & (F.col("rounds") < cap), F.col("most")).otherwise(F.col("low") - 1)
    final = state.select(F.col("source").alias("s"), "source_size", "target", "rounds", F.when(F.col("rest") > 0, limit).otherwise(F.lit(-1).cast("long")).alias("limit"))
    out = sized.join(hint(final), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("rounds") + (F.col("hash") <= F.col("limit")).cast("long"))).alias("taken"))
