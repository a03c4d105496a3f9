"""N-gram Jaccard join by MinHash banding.

Texts with equal n-gram sets are one node. A node's MinHash signature is cut into bands; nodes that share a band's hash are
candidates. The chosen numbers of bands and rows find a pair at the threshold with the wanted recall. Candidates aren't
expanded to pairs: each band value links its nodes to the smallest of them, the links' connected components are dealt to tasks
in blocks of bounded size, and all pairs of a component are verified on their full n-gram sets by products of blocks. A task
returns each node's number of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, thrifty
from .graph import components
from .shingles import flat, mixed, runs, word_hashes

N, THRESHOLD, RECALL, MOST_HASHES, SEED = 5, 0.8, 0.999, 256, 11
#: Nodes and words that a block holds; columns multiplied at once.
BLOCK_NODES, BLOCK_WORDS, COLUMNS = 1024, 1_000_000, 4096


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """The most rows to a band, and the fewest such bands, that find a pair at the threshold with at least that probability."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            return bands, rows
    return most_hashes, 1


def sets_of(hashes: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of each text; a text of fewer words than n has the run of all its words, an empty one has none."""
    grams = runs(hashes, n)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if hi - lo >= n:
            yield np.unique(grams[lo : hi - n + 1])
        else:
            yield runs(hashes[lo:hi], hi - lo, seed=hi - lo) if hi > lo else np.zeros(0, np.uint64)


def node_of(grams: np.ndarray) -> int:
    """A set's number: eight bytes of the digest of its sorted hashes."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "big", signed=True)


def _signatures(n: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        for batch in batches:
            hashes, offsets = flat(batch.column("hashes"))
            nodes, counts, keys = [], [], []
            for grams in sets_of(hashes, offsets, n):
                nodes.append(node_of(grams))
                counts.append(len(grams))
                if not len(grams):
                    keys.append([])
                    continue
                low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(grams), 2048):
                    np.minimum(low, (grams[i : i + 2048, None] * a + b).min(0), out=low)
                acc = np.arange(bands, dtype=np.uint64)
                for column in mixed(low).reshape(bands, rows).T:
                    acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + column)
                keys.append(acc.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(counts, pa.int32()), pa.array(np.diff(offsets), pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "n_grams", "n_words", "keys"])

    return run


def with_nodes(docs: DataFrame, name: str, n: int = N) -> DataFrame:
    """docs with the hash of each text's set of n-word runs as a column of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = flat(batch.column(batch.num_columns - 1))
            nodes = pa.array([node_of(grams) for grams in sets_of(hashes, offsets, n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], nodes], [*batch.schema.names[:-1], name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.select("*", word_hashes(F.col("text")).alias(name)).mapInArrow(thrifty(run), schema)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], by products of 0/1 columns; n-grams of one set only have none."""
    sizes = np.array([len(s) for s in sets])
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = df[inverse] > 1
    column = (np.cumsum(df > 1) - 1)[inverse[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(sets), int(column[j - 1]) - c + 1), np.float32)
        m[owner[i:j], column[i:j] - c] = 1.0
        out += m[left] @ m[right].T
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links a - b between 0 .. n - 1."""
    root, out = list(range(n)), []
    for x, y in zip(a.tolist(), b.tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((x, y))
    return out


def _verify(n: int, threshold: float):
    def run(key, table):
        hashes, offsets = flat(table.column("hashes"))
        wanted, part = table.column("node").to_pylist(), table.column("own").to_pylist()
        kept: dict[int, tuple[np.ndarray, int]] = {}
        for grams, node, own in zip(sets_of(hashes, offsets, n), wanted, part):
            if node not in kept and node_of(grams) == node:  # an id may stand for several texts
                kept[node] = (grams, own)
        nodes = sorted(kept)
        sets = [kept[x][0] for x in nodes]
        i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
        own = np.array([kept[x][1] for x in nodes])
        left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            both = overlaps(sets, left, right)
            size = np.array([len(s) for s in sets], np.float64)
            # |A & B| / |A | B| >= t, without a division; the tolerance covers the rounding of t
            linked = both * (1 + threshold) >= threshold * (size[left][:, None] + size[right][None, :]) - 1e-6
            if i == j:
                np.fill_diagonal(linked, False)
            counts = np.zeros(len(nodes), np.int64)
            counts[left] += linked.sum(1)
            if i != j:
                counts[right] += linked.sum(0)
            at = np.nonzero(linked)
            out = [(nodes[x], int(counts[x]), 0) for x in np.nonzero(counts)[0].tolist()]
            out += [(nodes[x], 0, nodes[y]) for x, y in forest(len(nodes), left[at[0]], right[at[1]])]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([y if not c else None for c, y in zip(cols[1], cols[2])], pa.int64())], names=["node", "links", "other"])

    return run


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES, with_node: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each row: doc_id, class_id, set_id, n_copies, n_links; with_node adds node, the set's hash.

    set_id is the smallest doc_id of the rows with the same set of n-word runs, n_copies their number. n_links counts the other
    sets whose Jaccard similarity with it is at least the threshold; class_id is the smallest doc_id that such links and equal
    sets reach. Texts of fewer than n words have one run, all their words; empty and null texts have none, are copies of each
    other and link to nothing. Null ids have null ids of sets and classes unless an equal set has an id. Repeated rows count as
    copies. An empty table gives an empty result. Other columns aren't read.
    """
    bands, rows = bands_for(threshold, recall, most_hashes)
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("hashes"))
    signed = staged(hashed.mapInArrow(thrifty(_signatures(n, bands, rows, SEED)), "doc_id long, node long, n_grams int, n_words long, keys array<long>"), "near-signatures")
    nodes = staged(signed.groupBy("node").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("n_copies"), F.max("n_words").alias("n_words"), F.first("keys").alias("keys")), "near-nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    met = components(keyed.join(shared.hint("merge"), "key").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    met = staged(met.join(nodes.select(F.col("node").alias("id"), "set_id", "n_words"), "id"), "near-components")
    size = met.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n_words") / BLOCK_WORDS)).cast("int").alias("blocks"), F.count("*").alias("members"))
    dealt = met.join(size.filter("members > 1"), "root").select("root", "blocks", F.col("id").alias("node"), "set_id", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("own"))
    # merged at every size: a broadcast of what happens to be small would only make small runs unlike large ones
    texts = docs.select("doc_id", "text").join(dealt.hint("merge"), F.col("doc_id") == F.col("set_id"))
    # sets of null ids only are fetched by their hash
    nameless = with_nodes(docs.filter("doc_id is null").select("doc_id", "text"), "set").groupBy("set").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
    texts = texts.unionByName(nameless.join(dealt.filter("set_id is null").hint("merge"), F.col("set") == F.col("node")).select(texts.columns))
    paired = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = paired.repartition(parts, "root", "i", "j").select("root", "i", "j", "own", "node", word_hashes(F.col("text")).alias("hashes"))
    verified = staged(grouped.groupBy("root", "i", "j").applyInArrow(_verify(n, threshold), "node long, links long, other long"), "near-links")
    links = verified.filter("other is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    joined = components(verified.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.select("node", "set_id", "n_copies").join(joined.withColumnRenamed("id", "node"), "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = staged(named, "near-nodes")
    first = named.groupBy("root").agg(F.min("set_id").alias("class_id"))
    out = signed.select("doc_id", "node").join(named.join(first, "root").select("node", "class_id", "set_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "node")
    return out.select("doc_id", "class_id", "set_id", "n_copies", "n_links", *(["node"] if with_node else []))
