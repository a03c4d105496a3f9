"""Writers: NIfTI files from voxels, GraphML files from nodes and edges, JSON and text reports.

A file is made whole where its volume's rows are and goes out as one row, path and content; Hadoop's file system writes it, so
that any store Spark writes to will do.
"""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nifti import encode


def nifti_name(path):
    """The path with .nii.gz, unless it ends so or with .nii already. Takes a column or a string."""
    if isinstance(path, str):
        return path if path.endswith((".nii", ".nii.gz")) else path + ".nii.gz"
    return F.when(path.endswith(".nii") | path.endswith(".nii.gz"), path).otherwise(F.concat(path, F.lit(".nii.gz")))


def store(files: DataFrame) -> list[str]:
    """files(path, content) written, folders made; -> the paths. Contents pass the driver one at a time, a partition's in turn."""
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = []
    for row in files.toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(row.path)
        fs = path.getFileSystem(conf)
        fs.mkdirs(path.getParent())
        out = fs.create(path, True)
        out.write(bytearray(row.content))
        out.close()
        done.append(row.path)
    return done


def nifti_files(voxels: DataFrame, volumes: DataFrame, value: str | None = None, datatype: str = "u1") -> DataFrame:
    """voxels(volume_id, i, j, k[, value]), volumes(volume_id, path, ni, nj, nk, si, sj, sk, spatial_unit, affine) -> path, content.
    path is where to write to."""
    v = voxels.select(F.col("volume_id").alias("v"), "i", "j", "k", (F.col(value) if value else F.lit(1)).cast("float").alias("value"))
    kinds = volumes.select("volume_id", nifti_name(F.col("path")).alias("path"), "ni", "nj", "nk", "si", "sj", "sk", "spatial_unit", "affine")

    def run(key, meta, rows):
        m = meta.slice(0, 1).to_pylist()[0]
        data = np.zeros((m["ni"], m["nj"], m["nk"]), datatype)
        data[tuple(rows.column(c).to_numpy() for c in "ijk")] = rows.column("value").to_numpy().astype(datatype)
        raw = encode(data, np.array(m["affine"] or np.eye(4).ravel()), (m["si"], m["sj"], m["sk"]), m["spatial_unit"], m["path"].endswith(".gz"))
        return pa.table({"path": [m["path"]], "content": pa.array([raw], pa.binary())})

    return kinds.groupBy("volume_id").cogroup(v.groupBy("v")).applyInArrow(run, "path string, content binary")


def graphml_files(nodes: DataFrame, edges: DataFrame, volumes: DataFrame, folder: str) -> DataFrame:
    """nodes and edges of operators.protograph.protograph, volumes(volume_id, affine) -> path, content, a file for each volume, whose
    id is its path under the folder; a graph without edges fails."""
    from ..operators.protograph import json_points, world

    affine = tuple(F.get("affine", F.lit(n)) for n in range(16))
    points = F.to_json(F.transform("voxels", lambda v: F.array(*world((v["i"], v["j"], v["k"]), affine).values())))
    edges = edges.join(volumes.select("volume_id", "affine"), "volume_id").withColumn("points", points)

    n = nodes.select("volume_id", F.struct("node_id", F.to_json(F.array("ci", "cj", "ck")).alias("voxel_pos"), json_points(F.col("voxels")).alias("voxels"), "kind", "x", "y", "z", "at_sample_border").alias("n"))
    e = edges.select("volume_id", F.struct("edge_id", "node1", "node2", json_points(F.col("voxels")).alias("voxels"), "n", "points").alias("e"))
    both = n.groupBy("volume_id").agg(F.array_sort(F.collect_list("n")).alias("nodes")).join(e.groupBy("volume_id").agg(F.array_sort(F.collect_list("e")).alias("edges")), "volume_id", "left")

    def run(batches):
        for b in batches:
            rows = [{"path": f"{folder.rstrip('/')}/{r['volume_id']}.graphml", "content": graphml(r["nodes"], r["edges"] or [])} for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return both.mapInArrow(run, "path string, content binary")


#: Attributes of the files, with their types; fixed names of the format's readers.
NODE = (("proto_id", "int"), ("name", "string"), ("X", "double"), ("Y", "double"), ("Z", "double"), ("voxel_pos", "string"), ("voxels", "string"), ("kind", "string"), ("at_sample_border", "boolean"))
EDGE = (("proto_edge_id", "int"), ("centerline_voxels", "string"), ("centerline_points", "string"), ("num_centerline_voxels", "int"))


def graphml(nodes: list[dict], edges: list[dict]) -> bytes:
    if not edges:
        raise ValueError("a graph without edges can't be written")
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for kind, names in (("node", NODE), ("edge", EDGE)):
        out += [f'  <key id="{kind[0]}_{c}" for="{kind}" attr.name="{c}" attr.type="{t}"/>' for c, t in names]
    out.append('  <graph id="G" edgedefault="undirected">')
    cell = lambda k, c, v: f"      <data key={quoteattr(f'{k}_{c}')}>{escape(str(v).lower() if isinstance(v, bool) else str(v))}</data>"
    for n in nodes:
        values = (n["node_id"], n["node_id"], n["x"], n["y"], n["z"], n["voxel_pos"], n["voxels"], n["kind"], n["at_sample_border"])
        out += [f'    <node id="n{n["node_id"]}">', *(cell("n", c, v) for (c, _), v in zip(NODE, values)), "    </node>"]
    for e in edges:
        values = (e["edge_id"], e["voxels"], e["points"], e["n"])
        out += [f'    <edge source="n{e["node1"]}" target="n{e["node2"]}">', *(cell("e", c, v) for (c, _), v in zip(EDGE, values)), "    </edge>"]
    return "\n".join([*out, "  </graph>", "</graphml>", ""]).encode()
