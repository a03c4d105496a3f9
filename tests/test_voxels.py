import math
import random
import shutil

import numpy as np
import pytest

from trabecula.functions import arrays
from trabecula.functions.grid import OFFSETS6, OFFSETS13, OFFSETS26, physical_ball, voxel_ball
from trabecula.operators import components, evaluate, mcp, protograph, stencil, thinning, voxelgraph, wavefront

CHAIN = [(2, 2, k) for k in range(1, 6)]
TEE = [(2, 2, k) for k in range(7)] + [(i, 2, 3) for i in (3, 4, 5)]
DIAMOND = [(1, 0, 1), (1, 1, 0), (1, 1, 2), (1, 2, 1)]
SHELL = [(i + 1, j + 1, k + 1) for i in range(3) for j in range(3) for k in range(3) if (i, j, k) != (1, 1, 1)]
PLANE = [(1, j, k) for j in range(3) for k in range(3)]
CASES = [(CHAIN, (5, 5, 7)), (TEE, (6, 5, 7)), (DIAMOND, (3, 3, 3)), (SHELL, (5, 5, 5)), (PLANE, (3, 3, 3)), ([(1, 1, 1)], (3, 3, 3)), ([(1, 1, 0), (1, 1, 1)], (3, 3, 3))]


def table(spark, *cases):
    return spark.createDataFrame([(v, *p) for v, c in enumerate(cases) for p in c], "volume_id long, i int, j int, k int")


@pytest.fixture(scope="module")
def cases(spark):
    return table(spark, *(c for c, _ in CASES)).cache()


def test_tubes_cover_every_part(spark, tmp_path):
    from trabecula.plans.fixtures import fixture

    spark.range(100).selectExpr("id AS p_partkey", "cast(id % 50 + 1 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("skel", "tube", "fuzzy"):
        assert {r.volume_id for r in fixture(spark, str(tmp_path), name).select("volume_id").distinct().collect()} == set(range(13)), name


def test_offsets_and_balls():
    assert (len(OFFSETS26), len(OFFSETS13), len(OFFSETS6)) == (26, 13, 6)
    assert len(voxel_ball(0)) == 1 and len(voxel_ball(1)) == 7 and len(voxel_ball(1.5)) == 19
    assert len(physical_ball(1.0, (0.5, 1.0, 2.0))) == len([(i, j) for i in range(-2, 3) for j in range(-1, 2) if i * i / 4 + j * j <= 1])


def test_classes(cases):
    got = {}
    for r in stencil.classify(cases).collect():
        got.setdefault(r.volume_id, []).append(r.cls)
    count = lambda v: tuple(got[v].count(c) for c in (1, 2, 3))
    assert [count(v) for v in range(7)] == [(2, 3, 0), (3, 3, 4), (0, 4, 0), (0, 0, 26), (0, 0, 9), (1, 0, 0), (2, 0, 0)]
    ends = stencil.endpoints(cases).groupBy("volume_id").count().collect()
    assert {r.volume_id: r["count"] for r in ends} == {0: 2, 1: 3, 6: 2}


def test_components_agree(spark, cases):
    two = table(spark, [(1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 1, 5), (1, 1, 6), (1, 1, 7)])
    assert components.object_counts(two).first().objects == 2
    for x in (two, cases):
        a = {tuple(r) for r in components.components(x).collect()}
        assert a == {tuple(r) for r in components.components(x, "fixpoint").collect()}


def test_background(spark):
    got = [components.background_counts(table(spark, c), shape).first().background for c, shape in (CASES[0], CASES[3], CASES[4])]
    assert got == [1, 2, 2]


def test_protograph(spark, cases):
    nodes, edges = protograph.protograph(cases, (6, 6, 7))
    n = {}
    for r in nodes.collect():
        n.setdefault(r.volume_id, []).append(r.kind)
    e = {}
    for r in edges.orderBy("edge_id").collect():
        e.setdefault(r.volume_id, []).append((r.node1, r.node2, r.n))
    assert n[0] == ["endpoint"] * 2 and e[0] == [(0, 1, 3)]
    assert sorted(n[1]) == ["branch"] + ["endpoint"] * 3 and sorted(x[2] for x in e[1]) == [1, 1, 1]
    assert n[2] == ["synthetic_loop"] and e[2] == [(0, 0, 4)]
    assert n[3] == ["branch"] and 3 not in e
    assert n[6] == ["endpoint"] and 6 not in e
    with pytest.raises(ValueError, match="no edges"):
        protograph.require_graph(*protograph.protograph(table(spark, [(1, 1, 1)]), (3, 3, 3)))


def test_registered_nodes_hold_those_of_rings(cases, monkeypatch):
    from trabecula.plans import queries

    monkeypatch.setattr(queries, "fixture", lambda *_: cases)
    assert [r.kind for r in queries.QUERIES["vox_graph_nodes"](None, "").filter("volume_id = 2").collect()] == ["synthetic_loop"]


def test_protograph_holds_to_the_sequential_rules(spark):
    rng = random.Random(5)
    sets = [sorted({tuple(rng.randrange(4) for _ in range(3)) for _ in range(rng.randrange(3, 22))}) for _ in range(40)]
    _, edges = protograph.protograph(table(spark, *sets), (4, 4, 4))
    got = {}
    for r in edges.collect():
        got.setdefault(r.volume_id, []).append((min(r.node1, r.node2), max(r.node1, r.node2), r.n))
    near = lambda p, q: p != q and max(abs(a - b) for a, b in zip(p, q)) <= 1
    for v, s in enumerate(sets):
        cls = {p: min(3, max(1, sum(near(p, q) for q in s))) for p in s}

        def parts(c):
            left, out = [p for p in s if cls[p] == c], []
            while left:
                part, todo = [], [left.pop(0)]
                while todo:
                    part.append(todo.pop())
                    for q in [q for q in left if near(q, part[-1])]:
                        left.remove(q)
                        todo.append(q)
                out.append(sorted(part))
            return sorted(out)

        nodes = [[p[0]] for p in parts(1)] + parts(3)
        touch = lambda p: {n for n, m in enumerate(nodes) if any(near(p, q) for q in m)}  # noqa: B023, E731
        want, used = [], set()
        for part in parts(2):
            ends = [p for p in part if sum(near(p, q) for q in part) < 2]
            if not ends:
                nodes_of = None
            elif len(part) == 1:
                t = sorted(touch(part[0]))
                nodes_of = t[:2] if len(t) > 1 else None
            else:
                nodes_of = [min(touch(p)) for p in ends]
            if not ends:
                want.append(("loop", len(part)))
            elif nodes_of:
                want.append((min(nodes_of), max(nodes_of), len(part)))
                used |= set(nodes_of)
        for n, m in enumerate(nodes):
            if n not in used and (others := touch(m[0]) - {n}) and len(m) == 1 and cls[m[0]] == 1:
                want.append((min(min(others), n), max(min(others), n), 0))
        have = [("loop", x[2]) if x[0] == x[1] and x[0] >= len(nodes) else x for x in got.get(v, [])]
        assert sorted(map(str, have)) == sorted(map(str, want)), (v, s)


def test_scores(spark):
    p, r = table(spark, CHAIN), table(spark, [(2, 3, k) for k in range(1, 8)])
    x = evaluate.evaluate(p, r, (5, 5, 9), 1.0).first()
    assert (x.tp, x.fp, x.fn, x.cr, x.occ_n, x.e_n) == (5, 0, 2, 1.0, 1.0, 1.0) and x.cp == 5 / 7
    assert evaluate.buffer_counts(p, r, voxel_ball(0)).first().tp == 0
    text = evaluate.report_text(evaluate.evaluate(p, r, (5, 5, 9), 1.0), True).first().text
    assert "cp: 0.7143" in text and "tp: 5" in text
    for radius, unit in ((-1, "voxels"), (math.inf, "um"), (1, "feet")):
        with pytest.raises(ValueError):
            evaluate.check_radius(radius, unit)
    assert evaluate.spacing_in_um((1, 2, 3), "mm") == (1000, 2000, 3000) and evaluate.anisotropy_warning((1, 1, 1), "um") is None


def test_distance_transforms_against_brute_force():
    rng = np.random.default_rng(1)
    mask = rng.random((6, 7, 5)) < 0.8
    zeros = np.argwhere(~mask)
    want = [min(((z - p) ** 2).sum() for z in zeros) for p in np.argwhere(mask)]
    assert arrays.squared_edt(mask)[mask].tolist() == want
    solid = arrays.distance_transform(np.ones((3, 3, 3), np.float32))
    assert solid[0, 0, 0] == 0.5 and solid[1, 1, 1] == 1.5
    g = arrays.geodesic(np.array([[[True, False, False, False]]]), np.array([[[True, True, False, True]]]))
    assert g[0, 0].tolist() == [0.0, 1.0, math.inf, math.inf]


def test_spread_is_the_kernel(spark):
    rows = spark.createDataFrame([(0, i, j, 0, 1.0 + (i * j) % 3) for i in range(4) for j in range(4)], "volume_id long, i int, j int, k int, w double")
    seed = spark.createDataFrame([(0, 0, 0, 0, 0.0)], "volume_id long, i int, j int, k int, value double")
    from pyspark.sql import functions as F

    got = {(r.i, r.j): r.value for r in wavefront.spread(rows, seed, F.expr("(w + q_w) / 2 * dist")).collect()}
    w = {(i, j): 1.0 + (i * j) % 3 for i in range(4) for j in range(4)}
    value, _ = arrays.wavefront({(0, 0, 0): 0.0}, (4, 4, 1), lambda p, v, q, d: v + (w[p[:2]] + w[q[:2]]) / 2 * d)
    assert {p[:2]: pytest.approx(v, abs=1e-5) for p, v in value.items()} == got


def tube():
    out = set()
    for i, j, k in [(0, 0, t) for t in range(24)] + [(0, t, 12) for t in range(14)]:
        out |= {(i + 2 + a, j + 2 + b, k + 2 + c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)}
    return sorted(out)


def test_growth_and_thinning(spark):
    x = table(spark, tube())
    skeleton, runs = mcp.mcp_skeletons(x, mcp.MCPConfig(min_object_size=1))
    got = {(r.i, r.j, r.k) for r in skeleton.collect()}
    r = runs.first()
    assert got < set(tube()) and (r.ri, r.rj, r.rk) in got and r.paths >= 1 and not r.capped
    assert components.object_counts(skeleton).first().objects == 1
    thin = thinning.thinned(x)
    mine = np.zeros((8, 20, 30), bool)
    mine[tuple(np.array([tuple(v)[1:] for v in thin.collect()]).T)] = True
    assert components.object_counts(thin).first().objects == 1 and (thinning.thin(mine) == mine).all()
    assert components.background_counts(thin, (8, 20, 30)).first().background == 1
    assert mcp.run_summary(runs).first().objects == 1
    with pytest.raises(ValueError):
        mcp.MCPConfig(root_method="centre").validate()


def ladder(rungs, gap=6, width=6):
    """Two rails and rungs between them, a voxel thick: each round of growth takes one more piece of the far rail."""
    n = rungs * gap + 1
    return [(i, j, 0) for j in range(n) for i in range(width + 1) if i in (0, width) or j % gap == 0]


def test_growth_has_no_cap(spark, monkeypatch):
    from trabecula.plans import queries

    monkeypatch.setattr(queries, "fixture", lambda *_: table(spark, ladder(420)))
    got = {r.j for r in queries.vox_mcp(spark, "").filter("i = 6").collect()}
    bare = [j for j in range(420 * 6 - 12) if not got & set(range(j, j + 13))]
    assert not bare, (len(bare), bare[:3])


def test_summary_has_whole_growth(spark, monkeypatch):
    from trabecula.plans import queries

    monkeypatch.setattr(queries, "fixture", lambda *_: table(spark, ladder(420), ladder(10)))
    long, short = queries.vox_mcp_summary(spark, "").orderBy("volume_id").collect()
    assert (long.objects, long.cap_hits, long.fuse_hits, short.objects, short.cap_hits) == (1, 0, 0, 1, 0)
    assert long.mean_iterations > 200 and long.branch_count > 200


def test_growth_has_no_clock(monkeypatch):
    import itertools
    import time

    mu = np.zeros((7, 61, 1), np.float32)
    mu[tuple(np.array(ladder(10)).T)] = 1
    whole, _ = mcp.skeletonise(mu, mcp.MCPConfig())
    ticks = itertools.count(0, 100)
    monkeypatch.setattr(time, "monotonic", lambda: float(next(ticks)))
    slow, _ = mcp.skeletonise(mu, mcp.MCPConfig())
    monkeypatch.undo()
    assert whole.sum() > 1 and (slow == whole).all()


def test_voxel_graph(spark):
    v, e = voxelgraph.voxel_graphs(table(spark, TEE))
    assert e.count() == v.count() - 1
    cut, _ = voxelgraph.voxel_graphs(table(spark, TEE + [(0, 0, 6)]), 2.5, 0.0)
    assert cut.count() < v.count() + 1
    line = np.array([(0.0, 0.0, float(n)) for n in range(12)])
    assert voxelgraph.path_length(line) == pytest.approx(11) and voxelgraph.path_length(line, (1, 1, 2), False) == 22


def test_files(spark, tmp_path):
    from trabecula.plans import api, cli
    from trabecula.sources import nifti

    x = np.zeros((8, 20, 30), np.uint8)
    x[tuple(np.array(tube()).T)] = 1
    aff = np.diag([2.0, 2.0, 2.0, 1.0])
    aff[2, 3] = -5.0
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("Lnet_i1_a.nii.gz", "Lnet_i1_b.nii"):
        (tmp_path / "in" / name).write_bytes(nifti.encode(x, aff, (2.0, 2.0, 2.0), "mm", name.endswith("gz")))
    (tmp_path / "in" / "sub" / "Lnet_i1_b.nii").write_bytes(nifti.encode(x[:, ::-1], aff, (2.0, 2.0, 2.0), "mm", False))
    n = nifti.decode((tmp_path / "in" / "Lnet_i1_b.nii").read_bytes())
    assert (n.data == x).all() and n.unit == "mm" and n.spacing == (2.0, 2.0, 2.0) and (n.affine == aff).all()
    made = api.skeletonise(spark, str(tmp_path / "in"), str(tmp_path / "out"), min_object_size=1)
    # equal names in two folders stay apart
    assert sorted(p.removeprefix(str(tmp_path)) for p in made) == [f"/out/{p}_centreline.nii.gz" for p in ("Lnet_i1_a", "Lnet_i1_b", "sub/Lnet_i1_b")]
    files = api.graphs(spark, str(tmp_path / "out"), str(tmp_path / "graphs"))
    assert sorted(p.removeprefix(str(tmp_path)) for p in files) == [f"/graphs/{p}_centreline.graphml" for p in ("Lnet_i1_a", "Lnet_i1_b", "sub/Lnet_i1_b")]
    import json
    import xml.etree.ElementTree as et

    ns = "{http://graphml.graphdrawing.org/xmlns}"
    for f in files:
        root = et.parse(f).getroot()
        cells = lambda e: {d.get("key")[2:]: d.text for d in e.findall(f"{ns}data")}
        for e in map(cells, root.iter(f"{ns}edge")):
            assert json.loads(e["centerline_points"]) == [[2.0 * i, 2.0 * j, 2.0 * k - 5.0] for i, j, k in json.loads(e["centerline_voxels"])]
        for e in map(cells, root.iter(f"{ns}node")):
            i, j, k = json.loads(e["voxel_pos"])
            assert e["name"] == e["proto_id"] and [float(e[c]) for c in "XYZ"] == [2 * i, 2 * j, 2 * k - 5]
            assert (e["at_sample_border"] == "true") == any(p in (0, n - 1) for v in json.loads(e["voxels"]) for p, n in zip(v, x.shape))
    assert api.view(spark, str(tmp_path / "graphs")).count() == 3
    for name in ("in", "out"):
        shutil.rmtree(tmp_path / name / "sub")
    out = api.score(spark, str(tmp_path / "out"), str(tmp_path / "out"))
    assert [r.p for r in out.collect()] == [1.0, 1.0]
    one = str(tmp_path / "in" / "Lnet_i1_b.nii")
    assert cli.main(["run", "--algorithm", "mcp", "-i", one, "-o", str(tmp_path / "one"), "--min-object-size", "1"]) == 0
    assert cli.main(["graphgen", "-i", str(tmp_path / "one.nii.gz"), "-o", str(tmp_path / "one.graphml")]) == 0
    assert (tmp_path / "one.graphml").read_bytes().count(b"<edge ") > 0
    with pytest.raises(SystemExit):
        cli.build_parser().parse_args(["run"])
    with pytest.raises(SystemExit):
        cli.build_parser().parse_args(["evaluate", "--pred", "a", "--ref", "b"])


@pytest.mark.parametrize(("body", "says"), [
    ('<key id="x" for="node" attr.name="X"/><graph/>', "any nodes"),
    ('<graph><node id="n0"/></graph>', "Expected node attributes"),
    ("".join(f'<key id="{c}" for="node" attr.name="{c}"/>' for c in "xyz") + '<graph><node id="n0"><data key="x">a</data><data key="y">1</data><data key="z">1</data></node></graph>', "numeric"),
])
def test_graph_files_that_fail(body, says):
    from trabecula.sources.graphml import parse

    with pytest.raises(ValueError, match=says):
        parse(f"<graphml>{body}</graphml>".encode())


def test_matching(spark):
    from trabecula.operators.matching import match_references

    p = spark.createDataFrame([("a/x1.nii",), ("a/Lnet_i4_c.seg.nii.gz",), ("a/zz.nii",), ("a/dup.nii",)], "path string")
    r = spark.createDataFrame([("b/x1.nii.gz",), ("b/x1_more.nii",), ("b/Lnet_i4_c_ref.nii",), ("b/dup_1.nii",), ("b/dup_2.nii",)], "path string")
    got = {x.pred_path[2:]: (x.ref_path, x.problem) for x in match_references(p, r).collect()}
    assert got == {"x1.nii": ("b/x1.nii.gz", None), "Lnet_i4_c.seg.nii.gz": ("b/Lnet_i4_c_ref.nii", None), "zz.nii": (None, "no reference"), "dup.nii": (None, "several references")}


def test_matching_of_names_that_begin_alike(spark):
    """Many names with one beginning meet by what they share, never pair by pair; the rules are those of plain loops."""
    import re

    from trabecula.operators.matching import match_references

    rng = random.Random(3)
    name = lambda: "Lnet_i"[: rng.choice((1, 6, 6))] + "".join(rng.choice("12.") for _ in range(rng.randrange(5)))
    ps, rs = ([f"{d}/{s}.nii" for s in sorted({name() for _ in range(80)})] for d in "ab")
    stem = lambda x: x[2:-4]
    want = {}
    for p in ps:
        f = re.match(r"Lnet_i[^.]+", stem(p))
        fits = [r for r in rs if stem(r).startswith(stem(p)) or stem(p).startswith(stem(r)) or f and stem(r).startswith(f[0])]
        equal = [r for r in fits if stem(r) == stem(p)]
        one = equal[0] if len(equal) == 1 else fits[0] if not equal and len(fits) == 1 else None
        want[p] = (one, None if one else "several references" if fits else "no reference")
    frames = [spark.createDataFrame([(x,) for x in xs], "path string") for xs in (ps, rs)]
    assert {x.pred_path: (x.ref_path, x.problem) for x in match_references(*frames).collect()} == want
    # 20,000 names: pairs of names would be 400 million
    same = spark.range(20000).selectExpr("concat('a/Lnet_i', id, '_x.nii') AS path")
    plan = match_references(same, same)._jdf.queryExecution().executedPlan().toString()
    assert "startswith" not in plan.lower()
    assert match_references(same, same).filter("pred_path = ref_path").count() == 20000
    twice = spark.createDataFrame([("a/x.nii",)] * 2, "path string")
    assert [tuple(x) for x in match_references(twice, frames[1].limit(0).union(twice.limit(1))).collect()] == [("a/x.nii", None, "several references")]


def test_waves_over_neighbour_lists_are_the_plain_ones(spark):
    """The kernels of growth, paths and fields give what the plain wave over places gives, on odd shapes."""
    rng = np.random.default_rng(8)
    for shape in ((1, 1, 1), (4, 1, 6), (5, 6, 4)):
        mu = np.where(rng.random(shape) < 0.7, rng.integers(1, 9, shape) / 8, 0).astype(np.float32)
        mu.flat[0] = 1
        inside, m = mu > 0, mu.astype(float)
        g = arrays.Graph(inside)
        fdt = arrays.distance_transform(mu, g)
        padded = np.pad(inside, 1)
        out = {p: [math.dist(o, (0, 0, 0)) for o in OFFSETS26 if not padded[tuple(np.add(p, o) + 1)]] for p in g.places}
        want, _ = arrays.wavefront({p: 0.5 * m[p] * min(x) for p, x in out.items() if x}, shape, lambda p, v, q, d: v + 0.5 * (m[p] + m[q]) * d if inside[q] else None)
        assert [np.float32(want.get(p, 0)) for p in g.places] == fdt[inside].tolist()
        fcmb, lsf = arrays.significance(mu, fdt)
        start = (0, 0, 0)
        w = lsf.astype(float)
        cost = lambda p, v, q, d: v + float(arrays.ROOTS[round(d * d) - 1]) / (0.01 + 0.5 * (w[p] + w[q])) ** 2 if inside[q] else None  # noqa: B023, E731
        value, before = arrays.wavefront({start: 0.0}, shape, cost)
        for goal in g.places:
            path = [goal]
            while path[-1] in before:
                path.append(before[path[-1]])
            assert arrays.cheapest_path(lsf, inside, np.arange(inside.size).reshape(shape) == 0, goal) == (path if goal in value else [])
        reach, _ = arrays.wavefront({start: 3.0}, shape, lambda p, v, q, d: v - d if inside[q] and v - d >= -1e-6 else None, lambda new, old: new < old - 1e-6, sign=-1.0)
        assert set(map(tuple, np.argwhere(arrays.dilate([start], np.full(shape, 1.5, np.float32), inside)).tolist())) == set(reach)
        left = inside & (rng.random(shape) < 0.5)
        assert (g.dense(g.components(left[inside])) == arrays.components(left)).all()


def test_fields_in_one_pass_are_the_stencil(spark):
    lab, _ = components.decompose(table(spark, tube(), SHELL + [(8, 8, 8)]))
    got = {tuple(r) for r in wavefront.significance_fields(lab).collect()}
    apart = wavefront.distance_fields(lab).selectExpr("volume_id * 10 + label AS volume_id", "i", "j", "k", "mu", "fdt")
    assert got == {(r.volume_id // 10, r.volume_id % 10, *r[1:]) for r in stencil.significance_fields(apart).collect()}


def test_labels_carry_columns(spark):
    rows = spark.createDataFrame([(0, 1, 1, 1, 0.5), (0, 1, 1, 1, 0.25), (0, 1, 1, 2, 1.0), (0, 5, 5, 5, 0.75)], "volume_id long, i int, j int, k int, value double")
    for method in ("kernel", "fixpoint"):
        kept, objects = components.decompose(rows, 2, method, ("value",))
        assert sorted(r.value for r in kept.collect()) == [0.25, 0.5, 1.0] and [(r.label, r.n_voxels) for r in objects.collect()] == [(1, 2)]
        assert components.decompose(rows, 1, method)[0].count() == 3


def test_background_against_brute_force(spark):
    rng = np.random.default_rng(4)
    shapes = [(1, 1, 1), (1, 5, 4), (5, 1, 4), (4, 5, 6), (6, 5, 4)]
    filled = [np.argwhere(rng.random(s) < 0.6) for s in shapes]
    want = []
    for s, at in zip(shapes, filled):
        left = {p for p in np.ndindex(s)} - set(map(tuple, at.tolist()))
        n = 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                p = todo.pop()
                for q in [tuple(int(x) for x in np.add(p, o)) for o in OFFSETS6]:
                    if q in left:
                        left.remove(q)
                        todo.append(q)
        want.append(n)
    volumes = spark.createDataFrame([(v, *s) for v, s in enumerate(shapes)] + [(9, 2, 2, 2)], "volume_id long, ni int, nj int, nk int")
    got = dict(map(tuple, components.background_counts(table(spark, *(x.tolist() for x in filled)), volumes=volumes).collect()))
    assert [got[v] for v in range(len(shapes))] == want and got[9] == 1


def test_evaluation_broadcasts_no_voxels(spark, tmp_path):
    """Spark takes voxels for as small as the parts that they are made from, and would send them to the driver."""
    from trabecula.plans import queries

    spark.range(100).selectExpr("id AS p_partkey", "cast(id % 50 + 1 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("vox_evaluate", "vox_report"):
        x = queries.QUERIES[name](spark, str(tmp_path))
        assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString(), name
    assert x.count() == 13 and '"bcc_pred":' in x.first().json and "cp: " in x.first().text


def test_root_paths_are_the_cheapest_paths(spark):
    from pyspark.sql import functions as F

    lab, _ = components.decompose(table(spark, tube(), SHELL + [(8, 8, 8)], PLANE))
    f = wavefront.significance_fields(lab)
    last = f.groupBy("volume_id", "label").agg(F.max(F.struct("i", "j", "k")).alias("v")).select("volume_id", "label", "v.*")
    want = wavefront.cheapest_paths(f, wavefront.root_voxels(f), last).collect()
    got = wavefront.root_paths(lab).collect()
    assert len(got) == 4 and sorted(got) == sorted(want) and max(len(r.path) for r in got) > 5
