"""Skeletons to graphs: end and branch nodes, edges along regular voxels, all as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import OFFSETS13, OFFSETS26, dealt, key_of, pairs, unkeyed
from .components import components
from .stencil import BRANCH, END, REGULAR, classify, degrees

IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def _voxel(key: Column | str) -> Column:
    i, j, k = unkeyed(key if isinstance(key, str) else "key")
    return F.struct(i, j, k)


def class_components(voxels: DataFrame) -> DataFrame:
    """volume_id, key, cls, root: voxels of one class that touch are together, under their first voxel in raster order."""
    classed = classify(voxels)
    out = None
    for c in (END, REGULAR, BRANCH):
        part = classed.filter(F.col("cls") == c)
        found = components(part).withColumn("cls", F.lit(c))
        out = found if out is None else out.unionByName(found)
    return out


def ordered_path(rows: DataFrame) -> DataFrame:
    """regular voxels(volume_id, key, root) -> volume_id, root, path: keys from the smaller end, or from the smallest voxel of a
    cycle by its smaller neighbour. A component is a path or a cycle; a grouped walk of it is linear in its size."""
    import pyarrow as pa

    from ..functions.grid import delta

    kind = dict(rows.dtypes)["volume_id"]
    steps = [delta(o) for o in OFFSETS26]

    def walk(key, table):
        by_root: dict[int, set[int]] = {}
        for k, r in zip(table.column("key").to_pylist(), table.column("root").to_pylist()):
            by_root.setdefault(r, set()).add(k)
        roots, paths, cycles = [], [], []
        for r, keys in sorted(by_root.items()):
            near = {k: sorted(k + d for d in steps if k + d in keys) for k in keys}
            ends = [k for k in keys if len(near[k]) < 2]
            path, at, left = [], min(ends or keys), set(keys)
            while at is not None:
                path.append(at)
                left.discard(at)
                at = next((q for q in near[at] if q in left), None)
            roots.append(r)
            paths.append(path)
            cycles.append(not ends and len(keys) > 2)
        return pa.table([table.column("volume_id").slice(0, 1).take(pa.array([0] * len(roots))), pa.array(roots, pa.int64()), pa.array(paths, pa.list_(pa.int64())), pa.array(cycles)], names=["volume_id", "root", "path", "cycle"])

    return rows.select("volume_id", "key", "root").groupBy("volume_id").applyInArrow(walk, f"volume_id {kind}, root long, path array<long>, cycle boolean")


def protograph(voxels: DataFrame, shape: tuple[int, int, int], affine: tuple[float, ...] = IDENTITY) -> tuple[DataFrame, DataFrame]:
    """-> nodes(volume_id, node_id, kind, voxels, ci, cj, ck, x, y, z, at_sample_border),
    edges(volume_id, edge_id, node1, node2, voxels, n). Ids count from 0 within a volume.

    A regular voxel has two neighbours, so that a regular component is a path or a cycle. A path of two voxels or more is an
    edge between the nodes at its ends; a single voxel is one if its two nodes differ; a cycle gets a node of its own and a loop.
    An end voxel whose only neighbour is a branch is an edge without voxels.
    """
    parts = class_components(voxels)
    grouped = parts.groupBy("volume_id", "cls", "root").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    firsts = grouped.filter(F.col("cls") != REGULAR).select("volume_id", "cls", "root", F.when(F.col("cls") == END, F.slice("keys", 1, 1)).otherwise(F.col("keys")).alias("keys"))
    paths = ordered_path(parts.filter(F.col("cls") == REGULAR))
    loops = paths.filter("cycle").select("volume_id", F.lit(4).alias("cls"), "root", F.array_sort(F.array(F.element_at("path", 1), F.element_at("path", -1))).alias("keys"))
    number = Window.partitionBy("volume_id").orderBy("cls", "root")
    nodes = firsts.unionByName(loops).withColumn("node_id", (F.row_number().over(number) - 1).cast("int"))
    member = nodes.filter("cls < 4").select("volume_id", "node_id", "cls", F.explode("keys").alias("key"))
    at = dealt(member.select("volume_id", *unkeyed(), "node_id", "cls"), "node_id", "cls")
    ends = paths.filter("not cycle").select("volume_id", "root", F.size("path").alias("n"), "path", F.posexplode(F.array(F.element_at("path", 1), F.element_at("path", -1))).alias("side", "key"))
    touch = pairs(dealt(ends.select("volume_id", *unkeyed(), "root", "n", "path", "side"), "root", "n", "path", "side"), at)
    met = touch.groupBy("volume_id", "root", "n", "path").agg(F.array_sort(F.collect_set("q_node_id")).alias("ids"), F.min(F.when(F.col("side") == 0, F.col("q_node_id"))).alias("n1"), F.min(F.when(F.col("side") == 1, F.col("q_node_id"))).alias("n2"))
    one = F.col("n") == 1
    along = met.filter(~one | (F.size("ids") >= 2)).select("volume_id", F.lit(0).alias("kind"), "root", F.when(one, F.get("ids", F.lit(0))).otherwise(F.col("n1")).alias("node1"), F.when(one, F.get("ids", F.lit(1))).otherwise(F.col("n2")).alias("node2"), "path").filter("node1 is not null and node2 is not null")
    round_ = nodes.filter("cls = 4").join(paths.filter("cycle"), ["volume_id", "root"]).select("volume_id", F.lit(0).alias("kind"), "root", F.col("node_id").alias("node1"), F.col("node_id").alias("node2"), "path")
    single = dealt(member.filter(F.col("cls") == END).select("volume_id", *unkeyed(), "node_id"), "node_id")
    beside = pairs(single, at.filter(F.col("cls") == BRANCH)).groupBy("volume_id", "node_id").agg(F.min("q_node_id").alias("other"))
    direct = beside.select("volume_id", F.lit(1).alias("kind"), F.col("node_id").cast("long").alias("root"), F.col("other").alias("node1"), F.col("node_id").alias("node2"), F.array().cast("array<bigint>").alias("path"))
    order = Window.partitionBy("volume_id").orderBy("kind", "root")
    as_voxels = lambda c: F.transform(c, lambda x: F.struct(*(_of(x, n).alias("ijk"[n]) for n in range(3))))
    edges = along.unionByName(round_).unionByName(direct).withColumn("edge_id", (F.row_number().over(order) - 1).cast("int")).select("volume_id", "edge_id", "node1", "node2", as_voxels(F.col("path")).alias("voxels"), F.size("path").alias("n"))
    placed = nodes.select("volume_id", "node_id", F.element_at(F.array(F.lit("endpoint"), F.lit("regular"), F.lit("branch"), F.lit("synthetic_loop")), F.col("cls")).alias("kind"), as_voxels(F.col("keys")).alias("voxels"))
    mean = lambda c: F.aggregate(F.transform("voxels", lambda v: v[c].cast("double")), F.lit(0.0), lambda a, x: a + x) / F.size("voxels")
    placed = placed.withColumns({f"c{c}": mean(c) for c in "ijk"})
    return located(placed, tuple(map(F.lit, shape)), tuple(map(F.lit, affine))), edges


def world(at: tuple[Column, ...], affine: tuple[Column, ...]) -> dict[str, Column]:
    """x, y, z of a voxel position by an affine of 16 numbers, row by row."""
    return {n: sum((at[q] * affine[4 * r + q] for q in range(3)), affine[4 * r + 3]) for r, n in enumerate("xyz")}


def located(nodes: DataFrame, shape: tuple[Column, ...], affine: tuple[Column, ...]) -> DataFrame:
    """nodes with x, y, z and at_sample_border by the shape and affine of their volumes."""
    at_edge = lambda v: (v["i"] <= 0) | (v["j"] <= 0) | (v["k"] <= 0) | (v["i"] >= shape[0] - 1) | (v["j"] >= shape[1] - 1) | (v["k"] >= shape[2] - 1)
    return nodes.withColumns(world((F.col("ci"), F.col("cj"), F.col("ck")), affine) | {"at_sample_border": F.exists("voxels", at_edge)})


def branch_counts(voxels: DataFrame) -> DataFrame:
    """volume_id, branches of a raw skeleton: its chains between ends and junctions, a ring without either counting one."""
    regular = ordered_path(class_components(voxels).filter(F.col("cls") == REGULAR)).groupBy("volume_id").agg(F.count("*").alias("chains"))
    near = degrees(voxels).withColumn("node", F.col("n") != 2)
    v = dealt(near.filter("node").select("volume_id", *unkeyed(), "n"), "n")
    touching = pairs(v, v, OFFSETS13).filter("n < 2 or q_n < 2").groupBy("volume_id").agg(F.count("*").alias("direct"))
    volumes = voxels.select("volume_id").distinct()
    return volumes.join(regular, "volume_id", "left").join(touching, "volume_id", "left").select("volume_id", (F.coalesce("chains", F.lit(0)) + F.coalesce("direct", F.lit(0))).alias("branches"))


def _of(key: Column, axis: int) -> Column:
    mask = (1 << 21) - 1
    return (F.shiftright(key, 21 * (2 - axis)).bitwiseAND(F.lit(mask).cast("long")) - 1).cast("int")


def require_graph(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises if a skeleton has no nodes, or no edges, as a graph file needs."""
    if nodes.isEmpty():
        raise ValueError("the skeleton has no nodes")
    if edges.isEmpty():
        raise ValueError("the skeleton has no edges")


def json_points(voxels: Column) -> Column:
    """[[i,j,k],...] as compact JSON."""
    return F.to_json(F.transform(voxels, lambda v: F.array(v["i"], v["j"], v["k"])))
