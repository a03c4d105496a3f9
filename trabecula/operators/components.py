"""Connected components of voxels: 26 neighbours for objects, 6 for the background."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.grid import BITS, OFFSETS13, dealt, delta, key_of, unkeyed
from .stencil import voxel_edges


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialised(df: DataFrame) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir and read again, to cut its plan.

    The table goes with the session's JVM, or with discard(). Only a local session may do without the setting.
    """
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = f"{tempfile.gettempdir()}/trabecula-{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/voxels-{uuid.uuid4().hex}"
    df.write.parquet(path)
    store, at = _place(spark, path)
    store.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialised() that nothing reads any more."""
    for t in tables:
        store, at = _place(t.sparkSession, t.written_at)
        store.delete(at, True)


def fixpoint_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(volume_id, a, b) -> volume_id, key, root: the smallest key that each key reaches. For volumes too large for a task.

    Large-star and small-star steps in turn; keys without an edge have no row. An error if most_rounds don't suffice.
    """
    now = materialised(edges.filter("a <> b").select("volume_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("volume_id", "a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
        both = now.unionByName(now.select("volume_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("volume_id", "a").agg(F.min("b").alias("m")).select("volume_id", "a", F.least("a", "m").alias("m"))
        large, old = materialised(both.join(low, ["volume_id", "a"]).filter("b > a").select("volume_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()), now
        low = large.groupBy("volume_id", "a").agg(F.min("b").alias("m"))
        small = large.join(low, ["volume_id", "a"]).filter("b <> m").select("volume_id", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("volume_id", "a", F.col("m").alias("b")))
        now = materialised(small.distinct())
        discard(large, old)
    else:
        raise RuntimeError(f"components are still changing after {most_rounds} rounds")
    stars = now.select("volume_id", F.col("a").alias("key"), F.col("b").alias("root"))
    return stars.unionByName(stars.select("volume_id", F.col("root").alias("key"), "root").distinct())


def key_components(keys: np.ndarray) -> np.ndarray:
    """For sorted keys of one volume the smallest key that each reaches by 26 neighbours."""
    a, b = [], []
    for o in OFFSETS13:
        at = np.searchsorted(keys, keys + delta(o))
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == (keys + delta(o))[hit]
        a.append(np.nonzero(hit)[0])
        b.append(at[hit])
    return keys[arrays.linked(len(keys), np.concatenate(a), np.concatenate(b))]


def _volume_roots(key, table):
    """Rows with their roots, labels by the roots' order, and sizes in different voxels; without other columns each voxel once."""
    keys, inverse = np.unique(table.column("key").to_numpy(), return_inverse=True)
    roots, label, sizes = np.unique(key_components(keys), return_inverse=True, return_counts=True)
    extra = [c for c in table.column_names if c not in ("volume_id", "key")]
    at = inverse if extra else np.arange(len(keys))
    label = label[at]
    found = [pa.array(keys[at]), pa.array(roots[label]), pa.array((label + 1).astype(np.int32)), pa.array(sizes[label])]
    return pa.table([table.column("volume_id").slice(0, 1).take(np.zeros(len(at), int)), *found, *(table.column(c) for c in extra)], names=["volume_id", "key", "root", "label", "n_voxels", *extra])


def _in_volumes(voxels: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """-> volume_id, key, root, label, n_voxels and the extra columns, a volume to a task."""
    kinds = dict(voxels.dtypes)
    schema = f"volume_id {kinds['volume_id']}, key long, root long, label int, n_voxels long" + "".join(f", {c} {kinds[c]}" for c in extra)
    return voxels.select("volume_id", key_of().alias("key"), *extra).groupBy("volume_id").applyInArrow(_volume_roots, schema)


def components(voxels: DataFrame, method: str = "kernel") -> DataFrame:
    """voxels(volume_id, i, j, k) -> volume_id, key, root. method "kernel" takes a volume to a task, "fixpoint" spreads it."""
    if method == "kernel":
        return _in_volumes(voxels).select("volume_id", "key", "root")
    if method != "fixpoint":
        raise ValueError(f"unknown method {method!r}: kernel or fixpoint")
    found = fixpoint_components(voxel_edges(voxels))
    return voxels.select("volume_id", key_of().alias("key")).distinct().join(found, ["volume_id", "key"], "left").select("volume_id", "key", F.coalesce("root", "key").alias("root"))


def object_counts(voxels: DataFrame, method: str = "kernel") -> DataFrame:
    """volume_id, objects: how many 26-connected objects."""
    return components(voxels, method).filter("key = root").groupBy("volume_id").agg(F.count("*").alias("objects"))


def decompose(voxels: DataFrame, min_size: int = 1, method: str = "kernel", extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """-> voxels with label, objects(volume_id, label, n_voxels, i0, i1, j0, j1, k0, k1).

    Labels follow the raster order of the objects' first voxels, before small objects go; boxes are half open. With extra columns
    every row of the input comes back with its label, else every voxel once.
    """
    if method == "kernel":
        labelled = _in_volumes(voxels, extra).filter(F.col("n_voxels") >= min_size).select("volume_id", "label", "key", *unkeyed(), *extra)
    else:
        parts = components(voxels, method)
        labels = parts.filter("key = root").select("volume_id", "root", F.row_number().over(Window.partitionBy("volume_id").orderBy("root")).alias("label"))
        labels = labels.join(parts.groupBy("volume_id", "root").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size), ["volume_id", "root"])
        labelled = parts.join(labels, ["volume_id", "root"]).select("volume_id", "label", "key", *unkeyed())
        if extra:
            labelled = labelled.join(voxels.select("volume_id", key_of().alias("key"), *extra), ["volume_id", "key"])
    objects = labelled.groupBy("volume_id", "label").agg(
        (F.count_distinct("key") if extra else F.count("*")).alias("n_voxels"), *(f(c).alias(f"{c}{n}") for c in "ijk" for n, f in ((0, F.min), (1, lambda x: F.max(x) + 1)))
    )
    return labelled.select("volume_id", "label", "i", "j", "k", *extra), objects


def background_runs(keys: np.ndarray, shape: tuple[int, int, int]) -> int:
    """6-connected components of what isn't a voxel in the array. Each line along the last axis is cut into runs between its
    voxels; runs of neighbouring lines that overlap are linked. The array is dense in lines only, never in voxels."""
    ni, nj, nk = shape
    i, j, k = (((keys >> (BITS * n)) & ((1 << BITS) - 1)) - 1 for n in (2, 1, 0))
    own = (i < ni) & (j < nj) & (k < nk)
    wide = nk + 2
    lines = np.arange(ni * nj, dtype=np.int64) * wide
    # places in all lines one after another; each line has a stop before its first place and one after its last
    stops = np.unique(np.concatenate([lines, lines + nk + 1, ((i * nj + j) * wide + k + 1)[own]]))
    gap = np.flatnonzero(np.diff(stops) > 1)
    lo, hi = stops[gap] + 1, stops[gap + 1] - 1
    last = lo // wide % nj == nj - 1
    a, b = [], []
    for run, step in ((np.arange(len(lo)), nj * wide), (np.flatnonzero(~last), wide)):
        first = np.searchsorted(hi, lo[run] + step)
        n = np.searchsorted(lo, hi[run] + step, "right") - first
        a.append(np.repeat(run, n))
        b.append(np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()))
    return len(np.unique(arrays.linked(len(lo), np.concatenate(a), np.concatenate(b))))


def background_counts(voxels: DataFrame, shape: tuple[int, int, int] | None = None, volumes: DataFrame | None = None) -> DataFrame:
    """volume_id, background: 6-connected components of what isn't a voxel in the array, a volume to a task.

    shape, or volumes(volume_id, ni, nj, nk), gives its size.
    """
    keyed, schema = dealt(voxels), f"volume_id {dict(voxels.dtypes)['volume_id']}, background long"

    def row(ids, keys, size):
        return pa.table([ids.slice(0, 1), pa.array([background_runs(keys.to_numpy(), size)], pa.int64())], names=["volume_id", "background"])

    if volumes is None:
        return keyed.groupBy("volume_id").applyInArrow(lambda key, t: row(t.column("volume_id"), t.column("key"), shape), schema)

    def sized(key, sizes, t):
        if not len(sizes):
            return pa.table({"volume_id": t.column("volume_id").slice(0, 0), "background": pa.array([], pa.int64())})
        return row(sizes.column("volume_id"), t.column("key"), tuple(sizes.column(c)[0].as_py() for c in ("ni", "nj", "nk")))

    return volumes.select("volume_id", "ni", "nj", "nk").groupBy("volume_id").cogroup(keyed.groupBy("volume_id")).applyInArrow(sized, schema)
