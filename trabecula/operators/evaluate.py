"""Skeleton evaluation: prediction against reference, many pairs in one job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import dealt, delta, physical_ball, voxel_ball
from .components import background_counts, object_counts
from .stencil import degrees

#: Micrometres to a unit of spacing; fixed values.
MICROMETRES = {"meter": 1_000_000.0, "mm": 1000.0, "micron": 1.0, "um": 1.0}
UNITS, CLIP, CLOSE = ("voxels", "um"), 5.0, 1e-6


def check_radius(radius: float, unit: str) -> float:
    if unit not in UNITS:
        raise ValueError(f"buffer radius unit must be one of {UNITS}, got {unit!r}")
    if not math.isfinite(radius) or radius < 0:
        raise ValueError("buffer radius must be finite and not negative")
    return float(radius)


def spacing_in_um(spacing: tuple[float, float, float], unit: str) -> tuple[float, float, float]:
    if unit not in MICROMETRES:
        raise ValueError(f"a radius in um needs a spacing unit of {sorted(MICROMETRES)}, got {unit!r}")
    return tuple(s * MICROMETRES[unit] for s in spacing)


def check_spacing(spacing) -> tuple[float, float, float]:
    out = tuple(float(s) for s in spacing)
    if len(out) != 3 or not all(math.isfinite(s) and s > 0 for s in out):
        raise ValueError("spacing must be three positive finite numbers")
    return out


def anisotropy_warning(spacing, unit: str) -> str | None:
    if max(spacing) - min(spacing) <= CLOSE:
        return None
    what = "distances in voxels weigh the axes alike" if unit == "voxels" else "the buffer is an ellipsoid in voxels"
    return f"spacing {tuple(spacing)} differs between axes: {what}"


def unmatched(pred: DataFrame, ref: DataFrame, unit: str) -> DataFrame:
    """volumes tables of both sides -> volume_id, problem for pairs that can't be compared; no rows if all can."""
    p = pred.select("volume_id", *(F.col(c).alias(f"p_{c}") for c in ("ni", "nj", "nk", "si", "sj", "sk", "spatial_unit")))
    shape = F.expr("p_ni <> ni or p_nj <> nj or p_nk <> nk")
    step = F.expr(" or ".join(f"abs(p_{c} - {c}) > {CLOSE}" for c in ("si", "sj", "sk")))
    units = F.lit(unit == "um") & (F.col("p_spatial_unit") != F.col("spatial_unit"))
    problem = F.when(shape, "shapes differ").when(step, "spacings differ").when(units, "spatial units differ")
    return p.join(ref, "volume_id").select("volume_id", problem.alias("problem")).filter("problem is not null")


def _met(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Joined by volume where both are dealt already. Never by a broadcast: Spark takes tables of voxels for as small as the
    files that they are made from."""
    return left.join(right.hint("shuffle_hash"), "volume_id", how)


def buffer_counts(pred: DataFrame, ref: DataFrame, ball: list[tuple[int, int, int]]) -> DataFrame:
    """-> volume_id, tp, fp, fn: voxels of the prediction within the reference's buffer and not, and of the reference outside
    the prediction's. The buffer is never built: a voxel's ball of keys meets the other side in a semi-join."""
    p, r = dealt(pred).distinct(), dealt(ref).distinct()
    reach = F.array(*(F.lit(delta(o)).cast("long") for o in ball))

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        spread = left.select("volume_id", "key", F.explode(reach).alias("d")).select("volume_id", F.col("key").alias("own"), (F.col("key") + F.col("d")).alias("key"))
        return spread.join(right.hint("shuffle_hash"), ["volume_id", "key"], "left_semi").groupBy("volume_id").agg(F.count_distinct("own").alias("near"))

    tp = near(p, r).withColumnRenamed("near", "tp")
    hit = near(r, p).withColumnRenamed("near", "hit")
    n_p, n_r = p.groupBy("volume_id").agg(F.count("*").alias("n_pred")), r.groupBy("volume_id").agg(F.count("*").alias("n_ref"))
    x = _met(_met(_met(n_p, n_r, "full"), tp), hit).na.fill(0)
    return x.select("volume_id", "n_pred", "n_ref", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_ref") - F.col("hit")).alias("fn"))


def _ratio(tp: str, other: str) -> Column:
    """tp / (tp + other); with nothing to divide by 1 if both sides are empty, else 0."""
    total = F.col(tp) + F.col(other)
    return F.when(total > 0, F.col(tp) / total).otherwise(F.when(F.expr("n_pred = 0 and n_ref = 0"), 1.0).otherwise(0.0))


def _relative(pred: str, ref: str) -> Column:
    """(pred - ref) / ref; with no reference 0 if there is no prediction either, else the difference."""
    p, r = F.col(pred).cast("double"), F.col(ref).cast("double")
    return F.when(r != 0, (p - r) / r).when(p == 0, 0.0).otherwise(p - r)


def evaluate(pred: DataFrame, ref: DataFrame, shape: tuple[int, int, int] | None = None, radius: float = 1.0, unit: str = "voxels", spacing=(1.0, 1.0, 1.0), spatial_unit: str = "um", volumes: DataFrame | None = None, background: bool = True) -> DataFrame:
    """One row for each volume: counts, Cp, Cr, OCC, BCC and E with their clipped and normalised forms, P and warnings."""
    check_radius(radius, unit)
    spacing = check_spacing(spacing)
    ball = voxel_ball(radius) if unit == "voxels" else physical_ball(radius, spacing_in_um(spacing, spatial_unit))
    out = buffer_counts(pred, ref, ball).withColumn("cp", _ratio("tp", "fn")).withColumn("cr", _ratio("tp", "fp"))
    for side, x in (("pred", pred), ("ref", ref)):
        ends = degrees(x).groupBy("volume_id").agg(F.count_if(F.expr("n = 1")).alias(f"e_{side}"))
        out = _met(_met(out, object_counts(x).withColumnRenamed("objects", f"occ_{side}")), ends)
        if background:
            out = _met(out, background_counts(x, shape, volumes).withColumnRenamed("background", f"bcc_{side}"))
        else:
            out = out.withColumn(f"bcc_{side}", F.lit(1).cast("long"))
    out = out.na.fill(0, ["occ_pred", "occ_ref", "e_pred", "e_ref"]).na.fill(1, ["bcc_pred", "bcc_ref"])
    for m in ("occ", "bcc", "e"):
        clipped = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col(m)))
        out = out.withColumn(m, _relative(f"{m}_pred", f"{m}_ref")).withColumn(f"{m}_n", 1 - F.abs(clipped) / CLIP)
    warning = anisotropy_warning(spacing, unit)
    notes = [F.when(F.col(f"{m}_ref") == 0, F.lit(f"no reference for {m}: the difference stands for the ratio")) for m in ("occ", "bcc", "e")]
    notes += [F.when(F.expr("tp + fn = 0"), F.lit("cp has nothing to divide by")), F.when(F.expr("tp + fp = 0"), F.lit("cr has nothing to divide by")), F.lit(warning)]
    return out.withColumn("p", (F.col("cp") + F.col("cr") + F.col("occ_n") + F.col("bcc_n") + F.col("e_n")) / 5).withColumn("warnings", F.array_compact(F.array(*notes)))


def json_report(radius: float, unit: str) -> Column:
    """The report of an evaluation's row in five sections."""
    cols = lambda *names: F.struct(*(F.col(c) for c in names))
    return F.to_json(F.struct(
        F.struct(F.col("volume_id").cast("string").alias("volume_id"), F.col("n_pred").alias("prediction_voxels"), F.col("n_ref").alias("reference_voxels")).alias("metadata"),
        F.struct(F.lit(radius).alias("buffer_radius"), F.lit(unit).alias("buffer_radius_unit")).alias("config"),
        cols("tp", "fp", "fn", "cp", "cr", "occ_pred", "occ_ref", "bcc_pred", "bcc_ref", "e_pred", "e_ref", "occ", "bcc", "e").alias("raw_metrics"),
        cols("cp", "cr", "occ_n", "bcc_n", "e_n", "p").alias("normalized_metrics"), F.col("warnings"),
    )).alias("json")


def text_report(verbose: bool = False) -> Column:
    """The lines of the report of an evaluation's row, numbers to four places."""
    number = lambda c: F.coalesce(F.format_string("%.4f", F.col(c).cast("double")), F.lit("N/A"))
    shown = ("cp", "cr", "occ_n", "bcc_n", "e_n", "p") + (("occ", "bcc", "e") if verbose else ())
    lines = [F.concat(F.lit(f"{c}: "), number(c)) for c in shown]
    if verbose:
        lines += [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("tp", "fp", "fn", "n_pred", "n_ref")]
    lines.append(F.when(F.size("warnings") > 0, F.concat(F.lit("warnings: "), F.concat_ws("; ", "warnings"))))
    return F.concat_ws("\n", *lines).alias("text")


def report_json(result: DataFrame, radius: float, unit: str) -> DataFrame:
    return result.select("volume_id", json_report(radius, unit))


def report_text(result: DataFrame, verbose: bool = False) -> DataFrame:
    return result.select("volume_id", text_report(verbose))
