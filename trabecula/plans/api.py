"""Files in, files out: skeletons, scores and graphs of whole folders in one job each."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators.matching import match_references
from ..operators.protograph import located, protograph
from ..operators.voxelgraph import voxel_graphs
from ..sources import graphml, nifti, sinks
from .registry import get_backend


def relative(spark: SparkSession, path: Column, source: str) -> Column:
    """The path of a file under source, or its name alone if source is the file or a pattern."""
    root = nifti.qualified(spark, source).rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))


def bare(path: Column) -> Column:
    """The path without the extension of a volume."""
    return F.regexp_replace(path, r"\.nii(\.gz)?$", "")


def is_file(source: str) -> bool:
    return source.endswith((".nii", ".nii.gz"))


def skeletonise(spark: SparkSession, source: str, target: str, algorithm: str = "mcp", **options: Any) -> list[str]:
    """Skeletons of all volumes under source, written to the same folders under target as <name>_centreline.nii.gz; that of a single
    file is written as target.
    """
    backend = get_backend(algorithm)
    volumes = nifti.read_volumes(spark, source)
    skeleton, _ = backend.run(nifti.read_voxels(spark, source), backend.build_config(options))
    out = volumes.withColumn("path", F.lit(sinks.nifti_name(target)) if is_file(source) else F.concat(F.lit(target.rstrip("/") + "/"), bare(relative(spark, F.col("path"), source)), F.lit("_centreline.nii.gz")))
    return sinks.store(sinks.nifti_files(skeleton, out, "label" if options.get("label_objects") else None, "i4" if options.get("label_objects") else "u1"))


def score(spark: SparkSession, predictions: str, references: str, radius: float = 1.0, unit: str = "voxels") -> DataFrame:
    """A row for each prediction that has one reference by its name: the report's columns. Others are an error."""
    pv, rv = nifti.read_volumes(spark, predictions), nifti.read_volumes(spark, references)
    pairs = match_references(pv.select("path"), rv.select("path"))
    bad = pairs.filter("problem is not null").limit(10).collect()
    if bad:
        raise ValueError("; ".join(f"{r.pred_path}: {r.problem}" for r in bad))
    own = pairs.select(F.col("ref_path").alias("r"), F.col("pred_path").alias("pair"))
    named = lambda x: x.join(own, x["volume_id"] == own["r"]).withColumn("volume_id", F.col("pair")).drop("r", "pair")
    problems = ev.unmatched(pv, named(rv), unit).limit(10).collect()
    if problems:
        raise ValueError("; ".join(f"{r.volume_id}: {r.problem}" for r in problems))
    p, r = nifti.read_voxels(spark, predictions, normalize=False), named(nifti.read_voxels(spark, references, normalize=False))
    for side in (p, r):
        odd = side.filter("value <> 1").select("value").distinct().orderBy("value").limit(10).collect()
        if odd:
            raise ValueError(f"expected voxels of 0 and 1, found {[x.value for x in odd]}")
    spacing = pv.select("si", "sj", "sk", "spatial_unit").distinct().limit(2).collect()
    if len(spacing) != 1:
        raise ValueError("the volumes have different spacings; score them apart")
    s = spacing[0]
    return ev.evaluate(p, r, radius=radius, unit=unit, spacing=(s.si, s.sj, s.sk), spatial_unit=s.spatial_unit, volumes=pv.select("volume_id", "ni", "nj", "nk"))


def write_scores(result: DataFrame, radius: float, unit: str, folder: str) -> None:
    """One JSON line for each volume."""
    ev.report_json(result, radius, unit).select("json").write.mode("overwrite").text(folder)


def graphs(spark: SparkSession, source: str, target: str) -> list[str]:
    """Proto-graphs of all skeletons under source, written to the same folders under target as <name>.graphml, all in one job; that of a single file
    is written as target.
    """
    named = lambda x: x.withColumn("volume_id", bare(relative(spark, F.col("volume_id"), source)))
    volumes = named(nifti.read_volumes(spark, source)).select("volume_id", "ni", "nj", "nk", "affine")
    nodes, edges = protograph(named(nifti.read_voxels(spark, source)), (1, 1, 1))
    # positions and borders by each volume's own affine and shape
    placed = located(nodes.join(volumes, "volume_id"), tuple(F.col(c) for c in ("ni", "nj", "nk")), tuple(F.get("affine", F.lit(n)) for n in range(16)))
    files = sinks.graphml_files(placed, edges, volumes, target)
    return sinks.store(files.withColumn("path", F.lit(target)) if is_file(source) else files)


def simplified_graphs(spark: SparkSession, source: str, prune_length: float = 0.0, filter_length: float = 0.0) -> tuple[DataFrame, DataFrame]:
    return voxel_graphs(nifti.read_voxels(spark, source, normalize=False), prune_length, filter_length)


def view(spark: SparkSession, source: str, edge_thickness: float = 1.0, node_size: float = 1.0) -> DataFrame:
    """What a viewer needs to draw the graphs under source."""
    return graphml.meshes(*graphml.read_graphs(spark, source), edge_thickness, node_size)
