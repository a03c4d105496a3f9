"""Voxel graphs: every skeleton voxel a vertex, cliques and clusters simplified, short spurs and pieces removed.

Vertices, edges, degrees and cliques are joins over the whole table; simplification is sequential within a volume and runs in
one group for each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stencil import voxel_edges

#: Clusters of branch voxels up to this size become their centre; larger ones at most SLICES centres along the longest axis.
CLUSTER, SLICES = 50, 5


def degree_table(voxels: DataFrame) -> DataFrame:
    """volume_id, degree, vertices."""
    e = voxel_edges(voxels)
    ends = e.select("volume_id", F.col("a").alias("key")).unionByName(e.select("volume_id", F.col("b").alias("key")))
    return ends.groupBy("volume_id", "key").agg(F.count("*").alias("degree")).groupBy("volume_id", "degree").agg(F.count("*").alias("vertices"))


def cliques(edges: DataFrame) -> DataFrame:
    """edges(volume_id, a < b) -> volume_id, members: the cliques of four, and of three that no clique of four has."""
    e = edges.select("volume_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x, y: e.select("volume_id", F.col("a").alias(x), F.col("b").alias(y))
    three = e.join(side("b", "c"), ["volume_id", "b"]).join(side("a", "c"), ["volume_id", "a", "c"], "left_semi").select("volume_id", "a", "b", "c")
    four = three.join(side("c", "d"), ["volume_id", "c"]).join(side("a", "d"), ["volume_id", "a", "d"], "left_semi").join(side("b", "d"), ["volume_id", "b", "d"], "left_semi").select("volume_id", F.array("a", "b", "c", "d").alias("members"))
    faces = four.select("volume_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda x: F.array_sort(F.array_remove("members", F.element_at("members", x.cast("int")))))).alias("members")).distinct()
    alone = three.select("volume_id", F.array("a", "b", "c").alias("members")).join(faces, ["volume_id", "members"], "left_anti")
    return four.unionByName(alone)


class Graph:
    """Undirected, with a place and a radius for each vertex."""

    def __init__(self, places: np.ndarray, edges: list[tuple[int, int]]) -> None:
        self.place = {n: p for n, p in enumerate(places.astype(float))}
        self.near: dict[int, set[int]] = {n: set() for n in self.place}
        for a, b in edges:
            self.link(a, b)

    def link(self, a: int, b: int) -> None:
        if a != b:
            self.near[a].add(b)
            self.near[b].add(a)

    def drop(self, n: int) -> None:
        for q in self.near.pop(n):
            self.near[q].discard(n)
        del self.place[n]

    def add(self, place: np.ndarray) -> int:
        n = max(self.place, default=-1) + 1
        self.place[n], self.near[n] = place, set()
        return n

    def parts(self, members: set[int]) -> list[list[int]]:
        left, out = set(members), []
        for s in sorted(members):
            if s in left:
                left.discard(s)
                part, todo = [s], [s]
                while todo:
                    for q in sorted(self.near[todo.pop()]):
                        if q in left:
                            left.discard(q)
                            part.append(q)
                            todo.append(q)
                out.append(sorted(part))
        return out

    def branch(self) -> set[int]:
        return {n for n, q in self.near.items() if len(q) > 2}

    def small_cliques(self, members: set[int]) -> list[tuple[int, ...]]:
        """Maximal cliques of three and four among the members."""
        out = []
        for a in sorted(members):
            for b in sorted(x for x in self.near[a] & members if x > a):
                both = self.near[a] & self.near[b] & members
                for c in sorted(x for x in both if x > b):
                    more = both & self.near[c]
                    fours = sorted(x for x in more if x > c)
                    out += [(a, b, c, d) for d in fours]
                    if not more:
                        out.append((a, b, c))
        return out


def cut_cliques(g: Graph) -> None:
    """In cliques whose vertices all have degrees below five the edge between the two lightest goes: least degree, then number."""
    core = {n for n in g.branch()}
    while thin := {n for n in core if len(g.near[n] & core) < 2}:
        core -= thin
    degree = {n: len(q) for n, q in g.near.items()}
    for clique in g.small_cliques(core):
        if all(degree[n] < 5 for n in clique):
            a, b = sorted(clique, key=lambda n: (degree[n], n))[:2]
            g.near[a].discard(b)
            g.near[b].discard(a)


def merge_clusters(g: Graph, chain: bool = True) -> None:
    """Clusters of four and more branch vertices become their mean place, large ones slices of it that follow each other."""
    for part in [p for p in g.parts(g.branch()) if len(p) > 3]:
        outer = {q: [n for n in part if q in g.near[n]] for n in part for q in g.near[n] if q not in part}
        places = np.array([g.place[n] for n in part])
        if len(part) <= CLUSTER:
            slices = [list(range(len(part)))]
        else:
            axis = int(np.argmax(places.max(0) - places.min(0)))
            order = np.argsort(places[:, axis], kind="stable")
            count = min(SLICES, len(part))
            cuts = np.linspace(0, len(part), count + 1).astype(int)
            slices = [order[a:b].tolist() for a, b in zip(cuts, cuts[1:]) if b > a]
        new = [g.add(places[s].mean(0)) for s in slices]
        of = {part[x]: new[y] for y, s in enumerate(slices) for x in s}
        for q, inner in outer.items():
            for n in inner:
                g.link(of[n], q)
        if chain:
            for a, b in zip(new, new[1:]):
                g.link(a, b)
        for n in part:
            g.drop(n)


def samples(n: int, radius: float = 1.0) -> int:
    """How many points stand for a path of n: more for longer ones, half as many for very long or thick ones."""
    if n < 2:
        return n
    step = max(3, math.ceil(n / math.log2(n)))
    return max(3, step // 2) if n > 100 or radius > 3 and n > 20 else step


def smooth(points: np.ndarray, radius: float = 1.0) -> np.ndarray:
    """Points on the clamped B-spline of degree 3 (n - 1 for fewer than five) with the path as its control polygon, by de Boor."""
    n = len(points)
    if n < 3:
        return points
    degree = 3 if n > 4 else n - 1
    knots = np.concatenate([np.zeros(degree), np.linspace(0, 1, n - degree + 1), np.ones(degree)])
    out = []
    for u in np.linspace(0, 1, samples(n, radius)):
        k = min(max(int(np.searchsorted(knots, u, "right")) - 1, degree), n - 1)
        d = [points[k - degree + r].astype(float) for r in range(degree + 1)]
        for r in range(1, degree + 1):
            for j in range(degree, r - 1, -1):
                low, high = knots[k - degree + j], knots[j + 1 + k - r]
                w = (u - low) / (high - low) if high > low else 0.0
                d[j] = (1 - w) * d[j - 1] + w * d[j]
        out.append(d[degree])
    return np.array(out)


def path_length(points: np.ndarray, spacing=(1.0, 1.0, 1.0), smoothed: bool = True) -> float:
    x = smooth(points) if smoothed and len(points) > 2 else points
    return float(np.sqrt(((np.diff(x, axis=0) * np.array(spacing)) ** 2).sum(1)).sum())


def walk(g: Graph, part: list[int]) -> list[int]:
    """The chain's vertices in order, from its smaller end or round a ring; with the vertex that each end hangs on."""
    own = set(part)
    ends = [n for n in part if len(g.near[n] & own) < 2]
    path, left = [min(ends or part)], set(part)
    left.discard(path[0])
    while (nxt := min((q for q in g.near[path[-1]] if q in left), default=None)) is not None:
        path.append(nxt)
        left.discard(nxt)
    if not ends:
        return path + path[:1]
    before = sorted(g.near[path[0]] - own)
    after = sorted(g.near[path[-1]] - own - (set(before[:1]) if len(path) == 1 else set()))
    return before[:1] + path + after[:1]


def prune(g: Graph, limit: float, spacing=(1.0, 1.0, 1.0)) -> None:
    """Drops chains that end freely at one side and are shorter than the limit; then once more those shorter than 1.01."""
    for most in (limit, 1.01):
        if most <= 0:
            continue
        for part in g.parts({n for n, q in g.near.items() if len(q) < 3}):
            if sum(len(g.near[n]) == 1 for n in part) == 1 and path_length(np.array([g.place[n] for n in walk(g, part)]), spacing) < most:
                for n in part:
                    g.drop(n)


def filtered(g: Graph, limit: float, spacing=(1.0, 1.0, 1.0)) -> None:
    """Drops lone vertices and, with a limit, short pieces with exactly two free ends."""
    for n in [n for n, q in g.near.items() if not q]:
        g.drop(n)
    if limit > 0:
        for part in g.parts(set(g.near)):
            if sum(len(g.near[n]) == 1 for n in part) == 2 and len(part) <= max(2, limit) and path_length(np.array([g.place[n] for n in walk(g, part)]), spacing) < limit:
                for n in part:
                    g.drop(n)


def voxel_graphs(voxels: DataFrame, prune_length: float = 0.0, filter_length: float = 0.0, simplify: bool = True, chain: bool = True, spacing=(1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """-> vertices(volume_id, vertex_id, x, y, z), edges(volume_id, source, target). x, y, z are k, j, i in the file's axes."""
    from ..functions.grid import OFFSETS13, delta, key_of

    kind = dict(voxels.dtypes)["volume_id"]
    keyed = voxels.select("volume_id", key_of().alias("key"), "i", "j", "k").distinct()

    def run(key, table):
        order = np.argsort(table.column("key").to_numpy())
        keys = table.column("key").to_numpy()[order]
        places = np.stack([table.column(c).to_numpy()[order] for c in "ijk"], 1)
        edges = []
        for o in OFFSETS13:
            at = np.searchsorted(keys, keys + delta(o))
            for n in np.nonzero(at < len(keys))[0].tolist():
                if keys[at[n]] == keys[n] + delta(o):
                    edges.append((n, int(at[n])))
        g = Graph(places, edges)
        if simplify:
            cut_cliques(g)
            merge_clusters(g, chain)
        prune(g, prune_length, spacing)
        filtered(g, filter_length, spacing)
        number = {n: x for x, n in enumerate(sorted(g.place))}
        rows = [(number[n], None, *g.place[n][::-1].tolist()) for n in sorted(g.place)]
        rows += [(number[a], number[b], None, None, None) for a in sorted(g.near) for b in sorted(g.near[a]) if a < b]
        cols = list(zip(*rows)) or [()] * 5
        v = table.column("volume_id").slice(0, 1).take(pa.array([0] * len(rows), pa.int64()))
        return pa.table([v, *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), *[pa.float64()] * 3)))], names=["volume_id", "source", "target", "x", "y", "z"])

    out = keyed.groupBy("volume_id").applyInArrow(run, f"volume_id {kind}, source int, target int, x double, y double, z double")
    return out.filter("target is null").select("volume_id", F.col("source").alias("vertex_id"), "x", "y", "z"), out.filter("target is not null").select("volume_id", "source", "target")
