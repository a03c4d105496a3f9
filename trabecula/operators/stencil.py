"""Stencils over sparse voxels: classes, endpoints, maximal balls, local significance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import OFFSETS13, OFFSETS26, dealt, pairs, unkeyed

END, REGULAR, BRANCH = 1, 2, 3
HALF = "CAST(0.5 AS FLOAT)"


def degrees(voxels: DataFrame) -> DataFrame:
    """voxels(volume_id, i, j, k) -> volume_id, key, n: how many of the 26 neighbours are voxels."""
    v = dealt(voxels).distinct()
    return pairs(v, v, how="left").groupBy("volume_id", "key").agg(F.count("q_in").alias("n"))


def classify(voxels: DataFrame) -> DataFrame:
    """-> volume_id, i, j, k, n, cls: 1 end (or alone), 2 regular, 3 branch."""
    return degrees(voxels).select("volume_id", *unkeyed(), "n", F.least(F.greatest("n", F.lit(1)), F.lit(3)).cast("int").alias("cls"))


def endpoints(voxels: DataFrame) -> DataFrame:
    """Voxels with exactly one of 26 neighbours."""
    return degrees(voxels).filter("n = 1").select("volume_id", *unkeyed())


def voxel_edges(voxels: DataFrame) -> DataFrame:
    """volume_id, a, b: keys of neighbouring voxels, each pair once."""
    v = dealt(voxels).distinct()
    return pairs(v, v, OFFSETS13).select("volume_id", F.col("key").alias("a"), F.col("q_key").alias("b"))


def significance_fields(fields: DataFrame) -> DataFrame:
    """fields(volume_id, i, j, k, mu, fdt) -> with fcmb and lsf; what lies outside has mu and fdt 0. All in 32-bit floats.

    A voxel is the centre of a maximal ball if for all 26 neighbours q, fdt(q) - fdt(p) < (mu(p) + mu(q)) / 2 * |p - q|; there
    lsf is 1 less the largest ratio of the two sides, if that is positive, and elsewhere 0.
    """
    v = dealt(fields, "mu", "fdt")
    near = pairs(v, v.select("volume_id", "key", "mu", "fdt"), OFFSETS26, "left")
    zero = "CAST(0 AS FLOAT)"
    rise = F.expr(f"CAST(coalesce(q_fdt, {zero}) - fdt AS FLOAT)")
    room = F.expr(f"CAST({HALF} * CAST(mu + coalesce(q_mu, {zero}) AS FLOAT) * dist AS FLOAT)")
    rated = near.withColumn("rise", rise).withColumn("room", room)
    out = rated.groupBy("volume_id", "key", "mu", "fdt").agg(F.bool_and(F.col("rise") < F.col("room")).alias("fcmb"), F.max(F.expr("CAST(rise / room AS FLOAT)")).alias("top"))
    lsf = F.expr(f"CASE WHEN fcmb THEN CAST(greatest({zero}, least(CAST(1 AS FLOAT), CAST(1 AS FLOAT) - greatest({zero}, top))) AS FLOAT) ELSE {zero} END")
    return out.select("volume_id", *unkeyed(), "mu", "fdt", "fcmb", lsf.alias("lsf"))
