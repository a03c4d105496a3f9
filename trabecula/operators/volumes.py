"""What holds for whole volumes: ranges, binariness, normalisation, spacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_ranges(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """voxels(volume_id, ..., value) without zeros, volumes(volume_id, ni, nj, nk) -> volume_id, vmin, vmax, is_binary.

    Zeros aren't stored: a volume has one if its voxels are fewer than its places. Binary is zeros, or zeros and ones; ones
    alone are not.
    """
    v = voxels.groupBy("volume_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"), F.bool_and(F.col("value") == 1).alias("ones"))
    x = volumes.join(v, "volume_id", "left").withColumn("zero", F.coalesce("n", F.lit(0)) < F.col("ni").cast("long") * F.col("nj") * F.col("nk"))
    low = F.when(F.col("zero"), F.least(F.lit(0.0), F.col("lo"))).otherwise(F.col("lo"))
    high = F.when(F.col("zero"), F.greatest(F.lit(0.0), F.col("hi"))).otherwise(F.col("hi"))
    return x.select("volume_id", F.coalesce(low, F.lit(0.0)).cast("float").alias("vmin"), F.coalesce(high, F.lit(0.0)).cast("float").alias("vmax"), (F.col("zero") & F.coalesce("ones", F.lit(True))).alias("is_binary"))


def normalised(voxels: DataFrame, ranges: DataFrame) -> DataFrame:
    """Memberships in 0..1: binary volumes as they are, those within 0..1 clipped, others stretched from least to most; constant
    ones become 0. Zero memberships have no rows; what the background becomes when the least is negative is ranges' business:
    -vmin / (vmax - vmin) everywhere that no voxel is stored."""
    x = voxels.join(ranges, "volume_id")
    wide = (F.col("vmin") < 0) | (F.col("vmax") > 1)
    span = F.col("vmax") - F.col("vmin")
    value = F.when(F.col("is_binary") | ~wide, F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(1.0))).when(span > 0, (F.col("value") - F.col("vmin")) / span).otherwise(0.0)
    return x.withColumn("value", value.cast("float")).filter("value > 0").select(voxels.columns)


def middle_slice_is_binary(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """volume_id, binary: whether the slice in the middle of axis i has fewer than three different values, zero among them."""
    mid = voxels.join(volumes.select("volume_id", "ni", "nj", "nk"), "volume_id").filter(F.col("i") == F.expr("ni div 2"))
    seen = mid.groupBy("volume_id").agg(F.count_distinct("value").alias("values"), F.count("*").alias("n"))
    full = F.coalesce("n", F.lit(0)) == F.col("nj").cast("long") * F.col("nk")
    return volumes.join(seen, "volume_id", "left").select("volume_id", ((F.coalesce("values", F.lit(0)) + F.when(full, 0).otherwise(1)) < 3).alias("binary"))


def bounding_boxes(voxels: DataFrame) -> DataFrame:
    """volume_id, i0, i1, j0, j1, k0, k1 of the non-zero voxels, half open, with their number."""
    sides = [f(c).alias(f"{c}{n}") for c in "ijk" for n, f in ((0, F.min), (1, lambda x: F.max(x) + 1))]
    return voxels.groupBy("volume_id").agg(F.count("*").alias("n_voxels"), *sides)


def polyline_lengths(points: DataFrame, order: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """points(path_id, i, j, k and the order column) -> path_id, length: the sum of the steps between points in order."""
    w = Window.partitionBy("path_id").orderBy(order)
    square = sum((F.pow((F.col(c) - F.lag(c).over(w)) * s, F.lit(2.0)) for c, s in zip("ijk", spacing)), F.lit(0.0))
    return points.withColumn("step", F.sqrt(square)).groupBy("path_id").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))
