"""A corpus pipeline of five stages: quality filter, exact and near deduplication, mixing, tokenising.

All stages but the last return the columns of their input, whatever these are; names of their own columns give way to those.
Null texts count as empty. Rows of null ids are judged for quality and taken by the mix like others, and never removed as
copies. Rows of one id are told apart by their texts. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trabecula.llm.common import A_Z, LOWER_A_Z, bucket_of, discard, staged, table
from trabecula.llm.exact_dedup import exact_dedup
from trabecula.llm.mixing import mix
from trabecula.llm.near_dups import near_duplicates, with_nodes
from trabecula.llm.pieces import encode
from trabecula.llm.quality import fit, scored


def unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs, which have the column key, but for the rows whose id and key are in gone, merged at every size. Rows of null ids stay."""
    return docs.join(gone.filter("doc_id is not null").select("doc_id", key).distinct().hint("merge"), ["doc_id", key], "left_anti").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier scores 0.5 or more. It learns from the same fold of the labels as op9."""
    labels = table(spark, sf_dir, "labels")
    name = unused(docs, "quality_score")
    return scored(docs, fit(docs, labels.filter(bucket_of("doc_id", 3) != 1)), name).filter(F.col(name) >= 0.5).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, the one with the largest doc_id."""
    key = unused(docs, "exact_key")
    own = docs.withColumn(key, F.sha2(F.translate(F.coalesce("text", F.lit("")), A_Z, LOWER_A_Z).cast("binary"), 256))
    return without(own, exact_dedup(docs).filter("not kept").withColumnRenamed("text_sha256", key), key).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, the one with the smallest doc_id."""
    key = unused(docs, "near_key")
    return without(with_nodes(docs, key), near_duplicates(docs, with_node=True).filter("doc_id <> class_id").withColumnRenamed("node", key), key).select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes its words, to the nearest whole number; what it doesn't take goes.

    A source's stream is cut at one place, so that at most one document of a source is taken in part. Rows of one id are repeated
    alike, by what the mix takes of all of them; texts without words have no words to take and go.
    """
    own, n, turn = (unused(docs, x) for x in ("mix_id", "mix_times", "mix_turn"))
    taken = mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).filter("size > 0")
    times = taken.select(F.col("doc_id").alias(own), F.round(F.col("taken") / F.col("size")).cast("int").alias(n)).filter(F.col(n) > 0)
    met = docs.join(times.hint("merge"), docs["doc_id"].eqNullSafe(times[own]))
    return met.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(docs[c] for c in docs.columns))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and decodes it again: doc_id, n_pieces, ids, decoded_sha256."""
    return encode(docs).select("doc_id", "n_pieces", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mix_stage),
    ("SentencePiece", pieces_stage),
]
#: The stages' scores, hashes and token ids have no SQL; tests hold the exact stage, the ids and the decoded texts against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{n}")
            discard(before)
    return docs
