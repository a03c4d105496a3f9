"""Approximate nearest neighbours by shifted Hilbert orderings.

Each of ORDERINGS orderings projects the unit vectors on DIMS random orthogonal axes, shifts the projections, and sorts all
rows by their place on the Hilbert curve through the cells. Spark range-partitions the places; sorted partitions are cut into
blocks. A query searches its own block and `reach` blocks to either side in every ordering, by one matrix product for a block;
the best of each block merge to the result. `reach` is measured: for CALIBRATE queries the exact neighbours are found against
all rows, in blocks, and the smallest reach that finds the wanted share of them is taken. Equal vectors are one entry of the
index, with as many of their smallest ids as a result can need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

ORDERINGS, DIMS, BITS, BLOCK, CALIBRATE = 16, 6, 8, 1024, 128


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """cells (rows x dims, each below 2**bits) -> place on the Hilbert curve, by Skilling's transposition (2004), for all rows at once."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for d in range(len(x)):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where(x[-1] & (1 << level), flip ^ ((1 << level) - 1), flip)
    key = np.zeros_like(x[0])
    x = [v ^ flip for v in x]
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> level) & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def ordering(number: int, width: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((seed, number))
    return np.linalg.qr(rng.normal(size=(width, dims)))[0], rng.random(dims)


def place(unit: np.ndarray, number: int, dims: int = DIMS, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """Projections have about the spread 1/sqrt(width); a logistic curve evens them out, the shift moves the cells' borders."""
    axes, shift = ordering(number, unit.shape[1], min(dims, unit.shape[1]), seed)
    u = (1 / (1 + np.exp(-1.702 * np.sqrt(unit.shape[1]) * (unit @ axes))) + shift) / 2
    return hilbert_keys(np.minimum((u * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def _keyed(orderings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            unit = _unit(_matrix(b.column("vec")))
            for o in range(orderings):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), o, np.int32)), pa.array(place(unit, o)), *b.columns], ["ordering", "key", *b.schema.names])

    return run


def _blocks(size: int):
    """Sorted rows -> a row for each block: ordering, partition, its number there, ids, asked (one byte a row), vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, held = TaskContext.get().partitionId(), 0, None, []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number
            if held:
                ids, asked = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.uint8)
                vectors = np.array([h[2] for h in held], np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([asked.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], ["ordering", "part", "number", "ids", "asked", "vectors"])
                number += 1
                held.clear()

        for b in batches:
            for o, rep, ask, vec in zip(*(b.column(c).to_pylist() for c in ("ordering", "rep", "asked", "vec"))):
                if o != now or len(held) == size:
                    yield from out()
                    now = o
                held.append((rep, ask, vec))
        yield from out()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for o, no, last, ids, asked, vectors in zip(*(b.column(c).to_pylist() for c in ("ordering", "no", "last", "ids", "asked", "vectors"))):
            at = np.nonzero(np.frombuffer(asked, np.uint8))[0]
            if len(at):
                x = np.frombuffer(vectors, np.float64).reshape(len(ids), -1)[at]
                yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), pa.array([no], pa.int64()), pa.array([last], pa.int64()), pa.array([[ids[i] for i in at]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], ["ordering", "no", "last", "query_ids", "query_vectors"])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k nearest rows with another id, ties to the smaller id: query ids, ids, cosines."""
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    s = cosines(q, x)
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    at = np.argsort(-s, axis=1, kind="stable")[:, :k]
    score = np.take_along_axis(s, at, 1)
    ok = np.isfinite(score)
    return np.repeat(q_ids, at.shape[1]).reshape(at.shape)[ok], ids[at][ok], score[ok]


def _search(k: int):
    def run(key, queries, block):
        out = [[], [], []]
        for ids, vectors in zip(block.column("ids").to_pylist(), block.column("vectors").to_pylist()):
            x = np.frombuffer(vectors, np.float64).reshape(len(ids), -1)
            q_ids = np.concatenate([np.array(i, np.int64) for i in queries.column("query_ids").to_pylist()] or [np.zeros(0, np.int64)])
            if len(q_ids):
                q = np.concatenate([np.frombuffer(v, np.float64) for v in queries.column("query_vectors").to_pylist()]).reshape(len(q_ids), -1)
                for o, v in zip(out, best(q_ids, q, np.array(ids, np.int64), x, k)):
                    o.append(v)
        cat = lambda v, t: pa.array(np.concatenate(v) if v else np.zeros(0), t)
        return pa.table([cat(out[0], pa.int64()), cat(out[1], pa.int64()), cat(out[2], pa.float64())], names=["query", "rep", "score"])

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vec of the rows that take part: no null or non-finite component, not zero, as wide as most vectors are."""
    x = vectors.select("vec_id", F.col("embedding").alias("vec")).filter("vec_id is not null and vec is not null and size(vec) > 0")
    x = x.filter(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vec", lambda v: v != 0))
    widths = x.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return x.filter(F.size("vec") == (widths[0][0] if widths else 0))


def _exact(queries: list, k: int):
    q_ids, q = np.array([r[0] for r in queries], np.int64), np.array([r[1] for r in queries], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                out = best(q_ids, q, np.array(b.column("rep").to_pylist(), np.int64), _matrix(b.column("vec")), k)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], ["query", "rep", "score"])

    return run


FOUND = "query long, rep long, score double"


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best different entries of each query; a pair found in several orderings counts once."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def nearest(vectors: DataFrame, k: int = 5, modulus: int = 50, orderings: int = ORDERINGS, block: int = BLOCK, recall: float = 0.95, calibrate: int = CALIBRATE) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> query_id, rank, vec_id, score: the k nearest that each row with vec_id divisible by
    `modulus` finds among all other rows, by cosine in double precision, ties to the smaller vec_id.

    Rows whose vector is null, empty, zero, of another width than most or holds null or non-finite components take no part, nor
    do null ids. Of several rows of one id the least vector counts. With fewer than k candidates all are returned; an empty table gives an
    empty result. Other columns aren't read. `recall` is the share of true neighbours that the calibrated reach must find on at
    most `calibrate` queries (the bound of what the driver gathers).
    """
    spark = vectors.sparkSession
    rows = staged(valid_vectors(vectors).groupBy("vec_id").agg(F.min("vec").alias("vec")), "ann-rows")
    ask = F.pmod(F.col("vec_id"), F.lit(modulus)) == 0
    few = Window.partitionBy("vec").orderBy("vec_id")
    classes = rows.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.max(ask).cast("int").alias("asked"))
    index = staged(classes, "ann-classes")
    sample = index.filter("asked = 1").orderBy(F.xxhash64("rep"), "rep").limit(calibrate).select("rep", "vec").collect()
    keyed = index.mapInArrow(_keyed(orderings), "ordering int, key long, vec array<double>, rep long, asked int" if dict(index.dtypes)["vec"] == "array<double>" else "ordering int, key long, vec array<float>, rep long, asked int")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = keyed.repartitionByRange(parts, "ordering", "key", "rep").sortWithinPartitions("ordering", "key", "rep")
    cut = staged(sorted_rows.mapInArrow(_blocks(block), "ordering int, part int, number int, ids array<long>, asked binary, vectors binary"), "ann-blocks")
    numbers = cut.select("ordering", "part", "number").withColumn("no", F.row_number().over(Window.partitionBy("ordering").orderBy("part", "number")).cast("long"))
    numbers = numbers.withColumn("last", F.count("*").over(Window.partitionBy("ordering")))
    blocks = cut.join(numbers, ["ordering", "part", "number"]).select("ordering", "no", "last", "ids", "asked", "vectors")
    reach = 0
    if sample:
        truth = merged(index.select("rep", "vec").mapInArrow(_exact(sample, k), FOUND), k).select("query", "rep").collect()
        wanted = {r[0] for r in truth} | {r[1] for r in truth}
        ids = spark.createDataFrame([(x,) for x in sorted(wanted)], "id long")
        at: dict[int, dict[int, int]] = {}
        for o, no, i in blocks.select("ordering", "no", F.explode("ids").alias("id")).join(F.broadcast(ids), "id").select("ordering", "no", "id").collect():
            at.setdefault(i, {})[o] = no
        gaps = sorted(min(abs(no - at[r][o]) for o, no in at[q].items()) for q, r in truth)
        reach = gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))))] if gaps else 0
    queries = blocks.mapInArrow(_asked, "ordering int, no long, last long, query_ids array<long>, query_vectors binary")
    spread = queries.withColumn("no", F.explode(F.sequence(F.greatest(F.lit(1), F.col("no") - reach), F.least(F.col("last"), F.col("no") + reach))))
    found = spread.select("ordering", "no", "query_ids", "query_vectors").groupBy("ordering", "no").cogroup(blocks.select("ordering", "no", "ids", "vectors").groupBy("ordering", "no")).applyInArrow(_search(k), FOUND)
    near = merged(found, k)
    # the entries' own ids: an entry can give k + 1 of them at most
    own = rows.withColumn("nth", F.row_number().over(few)).filter(F.col("nth") <= k + 1)
    members = own.join(index.select(F.col("vec").alias("class"), "rep"), F.col("vec") == F.col("class")).select("rep", "vec_id")
    norm = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    self_found = index.filter("asked = 1").select(F.col("rep").alias("query"), "rep", (norm(F.col("vec")) / F.sqrt(norm(F.col("vec"))) / F.sqrt(norm(F.col("vec")))).alias("score"))
    candidates = near.select("query", "rep", "score").unionByName(self_found).join(members, "rep").select("query", "vec_id", "score")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    short = candidates.withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= k + 1)
    asked = rows.filter(ask).join(index.select(F.col("vec").alias("class"), "rep"), F.col("vec") == F.col("class")).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    lists = short.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.join(lists, "query").select("query_id", F.posexplode(others).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
    )
