"""GraphML files as tables of nodes and edges."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = "{http://graphml.graphdrawing.org/xmlns}"


def parse(text: bytes) -> tuple[list[tuple[str, float, float, float]], list[tuple[int, int]]]:
    """Nodes with positions by X, Y, Z or else x, y, z, and edges as pairs of node numbers; errors name what is missing."""
    root = ET.fromstring(text)
    tag = lambda e: e.tag.rpartition("}")[2]
    keys = {k.get("id"): k.get("attr.name") for k in root.iter() if tag(k) == "key"}
    nodes = [e for e in root.iter() if tag(e) == "node"]
    if not nodes:
        raise ValueError("the graph does not contain any nodes")
    values = [{keys.get(d.get("key"), d.get("key")): d.text for d in n if tag(d) == "data"} for n in nodes]
    axes = next((a for a in (("X", "Y", "Z"), ("x", "y", "z")) if all(all(c in v for c in a) for v in values)), None)
    if axes is None:
        raise ValueError("Expected node attributes 'X', 'Y', 'Z' or 'x', 'y', 'z'")
    try:
        places = [tuple(float(v[c]) for c in axes) for v in values]
    except (TypeError, ValueError):
        raise ValueError("node coordinates must be numeric") from None
    if not np.isfinite(places).all():
        raise ValueError("node coordinates must be finite")
    at = {n.get("id"): x for x, n in enumerate(nodes)}
    try:
        edges = [(at[e.get("source")], at[e.get("target")]) for e in root.iter() if tag(e) == "edge"]
    except KeyError as missing:
        raise ValueError(f"an edge refers to the missing node {missing}") from None
    return [(n.get("id"), *p) for n, p in zip(nodes, places)], edges


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """-> nodes(path, node, id, x, y, z), edges(path, source, target) of all .graphml files under the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.graphml").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                nodes, edges = parse(raw)
                rows = [{"path": p, "a": n, "id": x[0], "x": x[1], "y": x[2], "z": x[3]} for n, x in enumerate(nodes)] + [{"path": p, "a": a, "b": c} for a, c in edges]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("id", pa.string()), *((c, pa.float64()) for c in "xyz")]))

    out = files.mapInArrow(run, "path string, a int, b int, id string, x double, y double, z double")
    return out.filter("b is null").select("path", F.col("a").alias("node"), "id", "x", "y", "z"), out.filter("b is not null").select("path", F.col("a").alias("source"), F.col("b").alias("target"))


def meshes(nodes: DataFrame, edges: DataFrame, edge_thickness: float = 1.0, node_size: float = 1.0) -> DataFrame:
    """path, points [[x, y, z], ...], lines [2, a, b, ...], edge_thickness, node_size: what a viewer draws as tubes and balls."""
    if edge_thickness <= 0 or node_size <= 0:
        raise ValueError("edge_thickness and node_size must be positive")
    p = nodes.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", F.array("x", "y", "z").alias("p")))), lambda v: v["p"]).alias("points"))
    e = edges.groupBy("path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source", "target"))), lambda v: F.array(F.lit(2), v["source"], v["target"]))).alias("lines"))
    return p.join(e, "path", "left").select("path", "points", F.coalesce("lines", F.array().cast("array<int>")).alias("lines"), F.lit(float(edge_thickness)).alias("edge_thickness"), F.lit(float(node_size)).alias("node_size"))
