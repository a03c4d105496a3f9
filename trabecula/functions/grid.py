"""Voxel coordinates as keys, and the neighbourhoods as constants.

A voxel's key packs its three coordinates, each plus one, into 21 bits; a neighbour's key is the key plus a constant, and a
neighbour outside the array has a key that no voxel has. Keys are in raster order.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 21
OFFSETS26 = tuple(o for o in product((-1, 0, 1), repeat=3) if o != (0, 0, 0))
OFFSETS13 = tuple(o for o in OFFSETS26 if o > (0, 0, 0))
OFFSETS6 = tuple(o for o in OFFSETS26 if sum(map(abs, o)) == 1)


def delta(o: tuple[int, int, int]) -> int:
    return (o[0] << 2 * BITS) + (o[1] << BITS) + o[2]


def length(o: tuple[int, int, int]) -> float:
    return math.sqrt(sum(x * x for x in o))


def key_of(i: str = "i", j: str = "j", k: str = "k") -> Column:
    return F.expr(f"(({i} + 1L) << {2 * BITS}) + (({j} + 1L) << {BITS}) + ({k} + 1L)")


def unkeyed(key: str = "key") -> list[Column]:
    mask = (1 << BITS) - 1
    return [F.expr(f"cast(({key} >> {2 * BITS}) - 1 as int)").alias("i"), F.expr(f"cast((({key} >> {BITS}) & {mask}L) - 1 as int)").alias("j"), F.expr(f"cast(({key} & {mask}L) - 1 as int)").alias("k")]


def dealt(voxels: DataFrame, *extra: str) -> DataFrame:
    """volume_id, key and the extra columns, one exchange by volume: every stencil on it joins within partitions.

    Spark must be let to join on more columns than it is dealt by; where it isn't, the joins still hold, with exchanges.
    """
    spark = voxels.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return voxels.select("volume_id", key_of().alias("key"), *extra).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "volume_id")


def pairs(left: DataFrame, right: DataFrame, offsets=OFFSETS26, how: str = "inner") -> DataFrame:
    """left(volume_id, key, ...) with each of its offsets o, dist (float) and the voxel at that offset: right's columns as q_*."""
    steps = F.array(*(F.struct(F.lit(n).alias("o"), F.lit(delta(o)).cast("long").alias("delta"), F.lit(length(o)).cast("float").alias("dist")) for n, o in enumerate(offsets)))
    near = left.select("*", F.explode(steps).alias("step")).select(*left.columns, F.col("step.o").alias("o"), F.col("step.dist").alias("dist"), (F.col("key") + F.col("step.delta")).alias("q_key"))
    q = right.select(*(F.col(c).alias(c if c == "volume_id" else f"q_{c}") for c in right.columns)).withColumn("q_in", F.lit(True))
    return near.join(q.hint("shuffle_hash"), ["volume_id", "q_key"], how)


def voxel_ball(radius: float) -> list[tuple[int, int, int]]:
    """Offsets within the radius, in voxels; compared in 32-bit floats with a tolerance."""
    return physical_ball(radius, (1.0, 1.0, 1.0))


def physical_ball(radius: float, spacing: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    import numpy as np

    reach = [math.ceil(radius / s) for s in spacing]
    limit = np.float32(radius * radius + 1e-8)
    return [o for o in product(*(range(-r, r + 1) for r in reach)) if np.float32(sum(np.float32(x * s) ** 2 for x, s in zip(o, spacing))) <= limit]
