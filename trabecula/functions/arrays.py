"""Kernels on the voxels of one object, dense in its bounding box, and on small graphs."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable
from functools import cached_property

import numpy as np

from .grid import OFFSETS13, OFFSETS26

ROOTS = tuple(np.float32(math.sqrt(x)) for x in (1, 2, 3))
#: The 26 offsets by length: 6 of length 1, 12 of the root of 2, 8 of the root of 3.
STEPS = tuple(sorted(OFFSETS26, key=lambda o: sum(x * x for x in o)))
CUTS = ((0, 6), (6, 18), (18, 26))
LENGTHS = np.array([math.sqrt(sum(x * x for x in o)) for o in STEPS])


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Connected components of 0 .. n - 1 under the links a - b: for each the smallest member."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def shifted(x: np.ndarray, o: tuple[int, int, int], fill=0) -> np.ndarray:
    """The value at each place plus o; fill outside."""
    out = np.full_like(x, fill)
    to = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, x.shape))
    at = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, x.shape))
    out[to] = x[at]
    return out


def components(mask: np.ndarray, offsets=OFFSETS13) -> np.ndarray:
    """Labels 1, 2, ... in raster order of each component's first voxel, 0 outside the mask."""
    at = np.full(mask.shape, -1, np.int64)
    n = int(mask.sum())
    at[mask] = np.arange(n)
    a, b = [], []
    for o in offsets:
        if o < (0, 0, 0):
            continue
        q = shifted(at, o, -1)
        both = mask & (q >= 0)
        a.append(at[both])
        b.append(q[both])
    root = linked(n, np.concatenate(a) if a else np.zeros(0, int), np.concatenate(b) if b else np.zeros(0, int))
    out = np.zeros(mask.shape, np.int64)
    _, label = np.unique(root, return_inverse=True)
    out[mask] = label + 1
    return out


def squared_edt(mask: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance to the nearest place outside the mask but within the array; a large number without any."""
    far = 1 << 40
    kind = np.int32 if sum(n * n for n in mask.shape) < 1 << 28 else np.int64
    much = kind(1 << 29 if kind is np.int32 else far)
    d = np.where(mask, much, 0).astype(kind)
    for axis in range(3):
        d = np.ascontiguousarray(np.moveaxis(d, axis, 0))
        n = d.shape[0]
        step = ((np.arange(n)[:, None] - np.arange(n)[None, :]) ** 2).astype(kind)
        out = np.empty_like(d)
        for x in range(n):
            (d + step[x][:, None, None]).min(0, out=out[x])
        d = np.moveaxis(np.minimum(out, much), 0, axis)
    return np.where(d >= much, far, d).astype(np.int64)


class Graph:
    """An object's voxels, numbered in raster order, and their neighbours: waves run over lists of numbers.

    near: a column for each of STEPS, -1 where there is no voxel. Values come and go as arrays over the voxels.
    """

    def __init__(self, inside: np.ndarray) -> None:
        self.inside = inside
        padded = np.pad(inside, 1)
        at = np.flatnonzero(padded)
        number = np.full(padded.size, -1, np.int64)
        number[at] = np.arange(len(at))
        _, b, c = padded.shape
        self.near = number[at[:, None] + np.array([(x * b + y) * c + z for x, y, z in STEPS])]
        self.n = len(at)

    @cached_property
    def places(self) -> list[tuple[int, int, int]]:
        return list(map(tuple, np.argwhere(self.inside).tolist()))

    def dense(self, values: np.ndarray, fill=0) -> np.ndarray:
        out = np.full(self.inside.shape, fill, values.dtype)
        out[self.inside] = values
        return out

    def _lists(self, values: np.ndarray, lo: int = 0, hi: int = 26) -> list[list]:
        """For each voxel the values of its neighbours by the steps lo .. hi."""
        there = self.near[:, lo:hi] >= 0
        flat = values[:, lo:hi][there].tolist()
        ends = [0, *np.cumsum(there.sum(1)).tolist()]
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    @cached_property
    def every(self) -> list[list[int]]:
        return self._lists(self.near)

    @cached_property
    def by_length(self) -> list[tuple[list[int], list[int], list[int]]]:
        return list(zip(*(self._lists(self.near, *c) for c in CUTS)))

    def _of(self, values: np.ndarray) -> np.ndarray:
        """Neighbours' values, 0 where there is none."""
        return np.append(values, values.dtype.type(0))[self.near]

    def components(self, mask: np.ndarray) -> np.ndarray:
        """Labels 1, 2, ... in raster order of each component's first voxel, 0 outside the mask."""
        label, n = [-1 if x else 0 for x in mask.tolist()], 0
        for first, x in enumerate(label):
            if label[first] >= 0:
                continue
            n += 1
            label[first], todo = n, [first]
            while todo:
                for q in self.every[todo.pop()]:
                    if label[q] < 0:
                        label[q] = n
                        todo.append(q)
        return np.array(label, np.int64)

    def cheapest(self, seeds: dict[int, float], costs: list[list[float]], until: Iterable[int] = ()) -> tuple[list[float], list[int]]:
        """Least values that spread from the seeds by the costs of the steps, and predecessors (-1: none). Those of `until`, if
        any, are final, and so is the way to them; others may not be."""
        value, before, open_ = [math.inf] * self.n, [-1] * self.n, set(until)
        for p, v in seeds.items():
            value[p] = v
        heap = [(v, p) for p, v in seeds.items()]
        heapq.heapify(heap)
        pop, push, every = heapq.heappop, heapq.heappush, self.every
        while heap:
            v, p = pop(heap)
            if v != value[p]:
                continue
            if p in open_:
                open_.remove(p)
                if not open_:
                    break
            for q, cost in zip(every[p], costs[p]):
                new = v + cost
                if new < value[q] - 1e-12:
                    value[q], before[q] = new, p
                    push(heap, (new, q))
        return value, before

    def fuzzy_distance(self, mu: np.ndarray) -> np.ndarray:
        m = mu.astype(np.float64)
        out = self.near < 0
        first = out.argmax(1)
        edge = np.flatnonzero(out.any(1))
        seeds = dict(zip(edge.tolist(), (0.5 * m[edge] * LENGTHS[first[edge]]).tolist()))
        value, _ = self.cheapest(seeds, self._lists(0.5 * (m[:, None] + self._of(m)) * LENGTHS))
        value = np.array(value)
        return np.where(np.isfinite(value), value, 0).astype(np.float32)

    def significance(self, mu: np.ndarray, fdt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = LENGTHS.astype(np.float32)
        rise = self._of(fdt) - fdt[:, None]
        room = np.float32(0.5) * (mu[:, None] + self._of(mu)) * length
        fcmb = (rise < room).all(1)
        top = np.maximum((rise / room).max(1), np.float32(0))
        return fcmb, np.where(fcmb, np.clip(np.float32(1) - top, 0, 1), 0).astype(np.float32)

    def geodesic(self, sources: np.ndarray) -> np.ndarray:
        value, after = np.where(sources, 0.0, math.inf).tolist(), {}
        rim = sources & np.append(~sources, False)[self.near].any(1)  # the others have sources around them only
        heap = [(0.0, p) for p in np.flatnonzero(rim).tolist()]
        pop, push, by_length = heapq.heappop, heapq.heappush, self.by_length
        while heap:
            v, p = pop(heap)
            if v != value[p]:
                continue
            steps = after.get(v)
            if steps is None:
                steps = after[v] = [float(np.float32(v) + r) for r in ROOTS]
            for new, near in zip(steps, by_length[p]):
                for q in near:
                    if new < value[q]:
                        value[q] = new
                        push(heap, (new, q))
        return np.array(value, np.float32)

    def path_costs(self, lsf: np.ndarray, epsilon: float = 0.01) -> list[list[float]]:
        """Length / (epsilon + mean lsf)**2 for every step."""
        w = lsf.astype(np.float64)
        length = np.concatenate([np.full(b - a, float(r)) for r, (a, b) in zip(ROOTS, CUTS)])
        return self._lists(length / (epsilon + 0.5 * (w[:, None] + self._of(w))) ** 2)

    def cheapest_paths(self, costs: list[list[float]], sources: np.ndarray, targets: list[int]) -> list[list[int]]:
        """From each target to the first source, in one wave for all of them; [] if there is no way."""
        value, before = self.cheapest(dict.fromkeys(np.flatnonzero(sources).tolist(), 0.0), costs, targets)
        paths = [[t] if value[t] < math.inf else [] for t in targets]
        for path in paths:
            while path and before[path[-1]] >= 0:
                path.append(before[path[-1]])
        return paths

    def cheapest_path(self, costs: list[list[float]], sources: np.ndarray, target: int) -> list[int]:
        return self.cheapest_paths(costs, sources, [target])[0]

    def dilate(self, branch: list[int], fdt: np.ndarray, factor: float = 2.0) -> np.ndarray:
        value = [-math.inf] * self.n
        heap = []
        for p in dict.fromkeys(branch):
            value[p] = factor * float(fdt[p])
            heap.append((-value[p], p))
        heapq.heapify(heap)
        pop, push, by_length, lengths = heapq.heappop, heapq.heappush, self.by_length, tuple(map(float, ROOTS))
        while heap:
            v, p = pop(heap)
            v = -v
            if v != value[p]:
                continue
            for length, near in zip(lengths, by_length[p]):
                new = v - length
                if new < -1e-6:
                    break
                for q in near:
                    if -new < -value[q] - 1e-6:
                        value[q] = new
                        push(heap, (-new, q))
        return np.array(value) > -math.inf


def _neighbours(p: tuple[int, int, int], shape: tuple[int, ...]):
    for o in OFFSETS26:
        q = (p[0] + o[0], p[1] + o[1], p[2] + o[2])
        if 0 <= q[0] < shape[0] and 0 <= q[1] < shape[1] and 0 <= q[2] < shape[2]:
            yield q, math.sqrt(o[0] * o[0] + o[1] * o[1] + o[2] * o[2])


def wavefront(seeds: dict[tuple[int, int, int], float], shape, step, better=lambda new, old: new < old - 1e-12, sign: float = 1.0, until=None):
    """Best values that spread from the seeds: step(p, value, q, length) gives q's value or None. -> values, predecessors."""
    value, before = dict(seeds), {}
    heap = [(sign * v, p) for p, v in seeds.items()]
    heapq.heapify(heap)
    while heap:
        v, p = heapq.heappop(heap)
        v *= sign
        if v != value[p]:
            continue
        if p == until:
            break
        for q, dist in _neighbours(p, shape):
            new = step(p, v, q, dist)
            if new is not None and (q not in value or better(sign * new, sign * value[q])):
                value[q], before[q] = new, p
                heapq.heappush(heap, (sign * new, q))
    return value, before


def is_binary_crop(mu: np.ndarray) -> bool:
    """Only zeros, or zeros and ones; a crop of ones alone takes the fuzzy way."""
    zero = mu == 0
    return bool(zero.any() and (zero | (mu == 1)).all())


def fuzzy_distance(mu: np.ndarray, graph: Graph | None = None) -> np.ndarray:
    """Least sum of half the memberships times the step length, from the outside; beyond the array is outside."""
    g = graph or Graph(mu > 0)
    return g.dense(g.fuzzy_distance(mu[g.inside]))


def distance_transform(mu: np.ndarray, graph: Graph | None = None) -> np.ndarray:
    return np.sqrt(squared_edt(mu > 0).astype(np.float64)).astype(np.float32) if is_binary_crop(mu) else fuzzy_distance(mu, graph)


def significance(mu: np.ndarray, fdt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fcmb and lsf, as operators.stencil.significance_fields has them."""
    g = Graph(mu > 0)
    fcmb, lsf = g.significance(mu[g.inside], fdt[g.inside])
    return g.dense(fcmb), g.dense(lsf)


def geodesic(sources: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Least sum of steps 1, sqrt 2, sqrt 3 within the object, each sum rounded to 32 bits; infinite elsewhere."""
    g = Graph(inside)
    return g.dense(g.geodesic(sources[inside]), np.inf)


def cheapest_path(lsf: np.ndarray, inside: np.ndarray, sources: np.ndarray, target: tuple[int, int, int], epsilon: float = 0.01) -> list[tuple[int, int, int]]:
    """From the target to the first source, by steps of length / (epsilon + mean lsf)**2; [] if there is no way."""
    if not inside[target]:
        return []
    g = Graph(inside)
    goal = int(np.count_nonzero(inside.ravel()[: np.ravel_multi_index(target, inside.shape)]))
    return [g.places[p] for p in g.cheapest_path(g.path_costs(lsf[inside], epsilon), sources[inside], goal)]


def dilate(branch: list[tuple[int, int, int]], fdt: np.ndarray, inside: np.ndarray, factor: float = 2.0) -> np.ndarray:
    """Places of the object that balls of factor times the fdt about the branch's voxels reach, by steps within the object."""
    g = Graph(inside)
    marks = np.zeros(inside.shape, bool)
    for p in branch:
        marks[p] = inside[p]
    return g.dense(g.dilate(np.flatnonzero(marks[inside]).tolist(), fdt[inside], factor))
