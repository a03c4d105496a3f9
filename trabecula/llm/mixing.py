"""Mixing sources to target weights by a low-discrepancy source schedule, in DataFrame operations only.

Every source is a circular stream of its documents in hashed order, cut into blocks of equally many words. The points of
the van der Corput sequence are mapped through the cumulative targets, counted in blocks, to sources; the r-th slot of a
source takes the r-th block of its stream. A prefix of 2**m points visits each of the 2**m cells once, so that a source gets
exactly the blocks its target needs and any run of slots holds nearly the target shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, staged

#: Weights by the rank of a source, repeating, and how often a source may be taken at most; words of a block, and what orders the streams.
WEIGHTS, MOST = (5, 2, 1), 3
BLOCK_WORDS, SEED = 2048, 20
#: A source's stream is ordered in so many hashed ranges, each summed alone, so that no task orders a whole source.
RANGES = 4096
#: Slots ranked in one task, and cells by which points meet the sources' intervals.
CHUNK_BITS, CELL_BITS = 12, 10


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, size) -> source, source_id, source_size, target. Sources by code point, null last, have the weights in turn.

    The targets fill up to a common level, target = least(most * source_size, weight * level); the level is the largest of the
    levels found by closing the sources in the order of their bounds. Rows: one per source, so one task may hold them.
    """
    by_name, by_bound = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("bound", "source_id")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_id") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    src = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_id", F.row_number().over(by_name).cast("long"))
        .withColumn("weight", w).withColumn("bound", most * F.col("source_size") / F.col("weight"))
    )
    every = Window.partitionBy()
    closed = F.coalesce(F.sum(most * F.col("source_size")).over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    still_open = F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing))
    return (
        src.withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", F.max((F.col("total") - closed) / still_open).over(every))
        .select("source", "source_id", "source_size", F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.col("level")).alias("target"))
    )


def radical_inverse(n: Column, bits: int) -> Column:
    """The van der Corput point of n in base 2, times 2**bits."""
    return F.conv(F.reverse(F.lpad(F.bin(n), bits, "0")), 2, 10).cast("long")


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """Slots in order: slot, source_id, block (0, 1, ... within the source's stream)."""
    spark = targets.sparkSession
    needed = targets.select("source_id", F.ceil(F.round("target") / block_words).cast("long").alias("blocks")).filter("blocks > 0")
    total = needed.agg(F.sum("blocks")).first()[0] or 0
    bits = max(1, (max(total, 1) - 1).bit_length())
    shift = max(0, bits - CELL_BITS)
    w = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        needed.withColumn("hi", F.sum("blocks").over(w)).withColumn("lo", F.col("hi") - F.col("blocks"))
        .withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
        .select("source_id", "lo", "hi", "cell")
    )
    points = spark.range(0, (1 << bits) if total else 0).select(F.col("id").alias("slot"), radical_inverse(F.col("id"), bits).alias("point"))
    placed = (
        points.withColumn("cell", F.shiftright("point", shift)).join(spans, "cell")
        .filter("point >= lo and point < hi").select("slot", "source_id", F.shiftright("slot", CHUNK_BITS).alias("chunk"))
    )
    before = Window.partitionBy("source_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("source_id", "chunk").agg(F.count("*").alias("n")).withColumn("prior", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("source_id", "chunk").orderBy("slot")
    return (
        placed.withColumn("rank", F.row_number().over(within)).join(counts, ["source_id", "chunk"])
        .select("slot", "source_id", (F.col("prior") + F.col("rank") - 1).alias("block"))
    )


def shuffled(seed: int) -> Column:
    """60 bits of the digest of the seed and the doc_id, null as empty text: the order of a source's stream."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, source, ...) -> one row for each row of docs: doc_id, size, source_size, target, taken, mix_order.

    size counts the words of the text (null: 0). taken is the number of the row's words that the scheduled blocks hold, repeats
    counted, at most `most` times size; over a source it adds up to the rounded target. mix_order is the first slot that takes
    the row (null if none). Null sources are one source of their own, last by name. Repeated rows and ids are rows of their own.
    Empty tables give empty results. Other columns aren't read. The same input gives the same mix.
    """
    sized = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = staged(source_targets(sized, weights, most), "mix-targets")
    keyed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select("doc_id", "size", "source_id", "source_size", "target", shuffled(seed).alias("shuffled"))
    keyed = keyed.withColumn("range", F.pmod(F.shiftright("shuffled", 40), F.lit(RANGES)))
    before = Window.partitionBy("source_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("source_id", "range").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("source_id", "range").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    streamed = staged(
        keyed.withColumn("upto", F.sum("size").over(own)).join(offsets, ["source_id", "range"])
        .select("doc_id", "size", "source_id", "source_size", "target", (F.col("offset") + F.col("upto") - F.col("size")).alias("start")),
        "mix-streams",
    )
    limit = F.round("target").cast("long")
    turns = streamed.filter("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    pieces = (
        turns.withColumn("lo", F.col("start") + F.col("turn") * F.col("source_size"))
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), limit)).filter("lo < hi")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words))))
        .select("source_id", "start", "block", (F.least("hi", (F.col("block") + 1) * block_words) - F.greatest("lo", F.col("block") * block_words)).alias("piece"))
    )
    taken = pieces.join(schedule(targets, block_words), ["source_id", "block"]).groupBy("source_id", "start").agg(F.sum("piece").alias("taken"), F.min("slot").alias("mix_order"))
    key = F.when(F.col("size") > 0, F.col("start"))
    return (
        streamed.withColumn("start", key).join(taken, ["source_id", "start"], "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "mix_order")
    )
