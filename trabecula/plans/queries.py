"""The registered queries of the voxel engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, evaluate, matching, mcp, protograph, stencil, thinning, volumes, voxelgraph, wavefront
from .fixtures import SHAPE, SQL, fixture

BOX = (SHAPE, SHAPE, SHAPE)


def vox_curves(spark, d):
    return fixture(spark, d, "skel")


def vox_classify(spark, d):
    return stencil.classify(fixture(spark, d, "skel")).groupBy("volume_id", "cls").agg(F.count("*").alias("voxels"))


def vox_endpoints(spark, d):
    return stencil.endpoints(fixture(spark, d, "skel"))


def vox_objects(spark, d):
    return components.object_counts(fixture(spark, d, "skel"))


def vox_objects_fixpoint(spark, d):
    return components.object_counts(fixture(spark, d, "skel"), "fixpoint")


def vox_decompose(spark, d):
    return components.decompose(fixture(spark, d, "skel"), 10)[1]


def vox_buffer_counts(spark, d):
    return evaluate.buffer_counts(fixture(spark, d, "pred"), fixture(spark, d, "skel"), evaluate.voxel_ball(1.0))


def vox_scores(spark, d):
    out = evaluate.evaluate(fixture(spark, d, "pred"), fixture(spark, d, "skel"), BOX, 1.5, background=False)
    return out.select("volume_id", "tp", "fp", "fn", "occ_pred", "occ_ref", "e_pred", "e_ref", *(F.round(c, 6).alias(c) for c in ("cp", "cr", "occ", "e", "occ_n", "e_n", "p")))


def vox_evaluate(spark, d):
    return evaluate.evaluate(fixture(spark, d, "pred"), fixture(spark, d, "skel"), BOX, 1.0)


def vox_report(spark, d):
    return vox_evaluate(spark, d).select("volume_id", evaluate.json_report(1.0, "voxels"), evaluate.text_report(True))


def vox_degrees(spark, d):
    return voxelgraph.degree_table(fixture(spark, d, "skel"))


def vox_cliques(spark, d):
    return voxelgraph.cliques(stencil.voxel_edges(fixture(spark, d, "skel"))).groupBy("volume_id", F.size("members").cast("long").alias("size")).agg(F.count("*").alias("cliques"))


def vox_nodes(spark, d):
    n, _ = protograph.protograph(fixture(spark, d, "skel"), BOX, (2.0, 0.0, 0.0, 1.0, 0.0, 3.0, 0.0, -1.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 1.0))
    return n.filter("kind <> 'synthetic_loop'").select("volume_id", "node_id", "kind", F.size("voxels").cast("long").alias("voxels"), *(F.round(c, 6).alias(c) for c in "xyz"), "at_sample_border")


def vox_graph_nodes(spark, d):
    """All nodes, those of closed rings too, which vox_nodes and its SQL leave out."""
    n, _ = protograph.protograph(fixture(spark, d, "skel"), BOX)
    return n.select("volume_id", "node_id", "kind", F.size("voxels").cast("long").alias("voxels"), *(F.round(c, 6).alias(c) for c in "xyz"), "at_sample_border")


def vox_graph_edges(spark, d):
    _, e = protograph.protograph(fixture(spark, d, "skel"), BOX)
    return e.select("volume_id", "edge_id", "node1", "node2", "n", protograph.json_points(F.col("voxels")).alias("path"))


def vox_edge_lengths(spark, d):
    _, e = protograph.protograph(fixture(spark, d, "skel"), BOX)
    return e.groupBy("volume_id", "n").agg(F.count("*").alias("edges"))


def vox_squared_edt(spark, d):
    return wavefront.squared_distances(components.decompose(fixture(spark, d, "tube"))[0])


def _fields(spark, d):
    """mu, fdt, fcmb and lsf of the tubes."""
    return wavefront.significance_fields(components.decompose(fixture(spark, d, "tube"))[0])


def vox_significance(spark, d):
    return _fields(spark, d).select("volume_id", "label", "i", "j", "k", F.round(F.col("fdt").cast("double"), 5).alias("fdt"), "fcmb", F.round(F.col("lsf").cast("double"), 5).alias("lsf"))


def vox_roots(spark, d):
    return wavefront.root_voxels(_fields(spark, d)).select("volume_id", "label", "i", "j", "k")


def vox_roots_topmost(spark, d):
    return wavefront.root_voxels(_fields(spark, d), "topmost").select("volume_id", "label", "i", "j", "k")


def vox_geodesic(spark, d):
    lab, _ = components.decompose(fixture(spark, d, "tube"))
    first = lab.groupBy("volume_id").agg(F.min(F.struct("i", "j", "k")).alias("v")).select("volume_id", "v.*")
    out = wavefront.geodesic_distance(lab, first).filter("geodesic is not null")
    return out.groupBy("volume_id").agg(F.count("*").alias("reached"), F.round(F.max("geodesic").cast("double"), 3).alias("farthest"))


def vox_fuzzy_distance(spark, d):
    lab, _ = components.decompose(fixture(spark, d, "fuzzy"), extra=("value",))
    return wavefront.distance_fields(lab, "value")


def vox_dilation(spark, d):
    f = _fields(spark, d)
    return wavefront.dilated(f, wavefront.root_voxels(f))


def vox_cheapest_path(spark, d):
    return wavefront.root_paths(components.decompose(fixture(spark, d, "tube"))[0])


#: Small objects count too, and each is grown to its end, whatever the defaults.
EVERY = mcp.MCPConfig(min_object_size=1, max_iterations=None)


def vox_mcp(spark, d):
    return mcp.mcp_skeletons(fixture(spark, d, "tube"), EVERY)[0]


def vox_mcp_fuzzy(spark, d):
    return mcp.mcp_skeletons(fixture(spark, d, "fuzzy"), EVERY)[1]


def vox_mcp_summary(spark, d):
    return mcp.run_summary(mcp.mcp_skeletons(fixture(spark, d, "tube"), EVERY)[1])


def vox_thinning(spark, d):
    return thinning.thinned(fixture(spark, d, "tube"))


def vox_graph_vertices(spark, d):
    return voxelgraph.voxel_graphs(fixture(spark, d, "skel"), 3.0, 3.0)[0]


def vox_summary_arithmetic(spark, d):
    runs = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey div 8 AS volume_id", "cast(p_size % 7 as bigint) AS branches", "cast(p_size as bigint) AS iterations", "cast(p_size % 5 = 0 as bigint) AS capped", "0L AS fused")
    return mcp.run_summary(runs).select("volume_id", "objects", "branch_count", F.round("mean_iterations", 6).alias("mean_iterations"), "cap_hits", F.round("log2_branches", 6).alias("log2_branches"), F.round("sqrt_branches", 6).alias("sqrt_branches"))


def vox_normalise(spark, d):
    rows = fixture(spark, d, "fuzzy").withColumn("value", (F.col("value") * 4 - 1).cast("float"))
    vols = rows.select("volume_id").distinct().select("volume_id", *(F.lit(SHAPE).alias(c) for c in ("ni", "nj", "nk")))
    out = volumes.normalised(rows, volumes.value_ranges(rows, vols))
    return out.select("volume_id", "i", "j", "k", F.round(F.col("value").cast("double"), 5).alias("value"))


def vox_boxes(spark, d):
    return volumes.bounding_boxes(fixture(spark, d, "skel"))


def vox_middle_slice(spark, d):
    rows = fixture(spark, d, "fuzzy")
    vols = rows.select("volume_id").distinct().select("volume_id", *(F.lit(SHAPE).alias(c) for c in ("ni", "nj", "nk")))
    return volumes.middle_slice_is_binary(rows, vols)


def vox_branches(spark, d):
    return protograph.branch_counts(fixture(spark, d, "skel"))


def vox_lengths(spark, d):
    """Lengths of the order's line items as points in a grid."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey AS path_id", "struct(l_linenumber, l_partkey, l_suppkey, l_quantity) AS nth", "l_partkey % 10 AS i", "l_suppkey % 7 AS j", "cast(l_quantity as int) AS k")
    return volumes.polyline_lengths(items, "nth", (1.0, 2.0, 0.5)).select("path_id", F.round("length", 6).alias("length"))


def vox_match_files(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    name = "concat('out/Lnet_i', cast(p_partkey div 3 as string), '_', cast(p_partkey % 3 as string), '{}.nii.gz')"
    pred = parts.selectExpr(name.format("") + " AS path")
    ref = parts.filter("p_partkey % 4 <> 0").selectExpr(name.format("") + " AS path").unionByName(parts.filter("p_partkey % 4 = 0 and p_size > 10").selectExpr(name.format("_ref") + " AS path"))
    return matching.match_references(pred, ref)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    vox_curves, vox_classify, vox_endpoints, vox_objects, vox_objects_fixpoint, vox_decompose, vox_buffer_counts, vox_scores, vox_evaluate, vox_report, vox_degrees, vox_cliques,
    vox_nodes, vox_graph_nodes, vox_graph_edges, vox_edge_lengths, vox_squared_edt, vox_significance, vox_roots, vox_roots_topmost, vox_geodesic, vox_fuzzy_distance, vox_dilation, vox_cheapest_path,
    vox_mcp, vox_mcp_fuzzy, vox_mcp_summary, vox_thinning, vox_graph_vertices, vox_summary_arithmetic, vox_normalise, vox_match_files, vox_boxes, vox_middle_slice, vox_branches, vox_lengths,
)}

# SQL ------------------------------------------------------------------------------------------------------------------

_NEAR = "abs(a.i-b.i)<=1 AND abs(a.j-b.j)<=1 AND abs(a.k-b.k)<=1 AND (a.i<>b.i OR a.j<>b.j OR a.k<>b.k)"


def _with(*names: str) -> str:
    return ", ".join(f"{n} AS ({SQL[n]('duckdb')})" for n in names)


def _steps() -> str:
    return "o AS (SELECT x.v AS di, y.v AS dj, z.v AS dk FROM (VALUES (-1),(0),(1)) x(v), (VALUES (-1),(0),(1)) y(v), (VALUES (-1),(0),(1)) z(v) WHERE x.v<>0 OR y.v<>0 OR z.v<>0)"


def _edges(of: str, to: str) -> str:
    return f"{to} AS (SELECT a.volume_id, a.i*10000+a.j*100+a.k AS a, b.i*10000+b.j*100+b.k AS b FROM {of} a, o JOIN {of} b ON a.volume_id=b.volume_id AND b.i=a.i+o.di AND b.j=a.j+o.dj AND b.k=a.k+o.dk)"


def _counts(of: str, to: str) -> str:
    return f"{to} AS (SELECT v.volume_id, v.i, v.j, v.k, count(b.volume_id) AS n FROM {of} v CROSS JOIN o LEFT JOIN {of} b ON v.volume_id=b.volume_id AND b.i=v.i+o.di AND b.j=v.j+o.dj AND b.k=v.k+o.dk GROUP BY ALL)"


def _reach(of: str, edges: str, to: str) -> str:
    """Roots by plain recursion: every voxel is told of each smaller one that it is linked to."""
    return f"""{to}_r AS (SELECT volume_id, i*10000+j*100+k AS x, i*10000+j*100+k AS root FROM {of}
      UNION SELECT r.volume_id, e.b, r.root FROM {to}_r r JOIN {edges} e ON e.volume_id=r.volume_id AND e.a=r.x WHERE r.root < e.b),
    {to} AS (SELECT volume_id, x, min(root) AS root FROM {to}_r GROUP BY ALL)"""


_CLASSES = f"WITH {_with('skel')}, {_steps()}, {_counts('skel', 'n')}"
_OBJECTS = f"WITH RECURSIVE {_with('skel')}, {_steps()}, {_edges('skel', 'e')}, {_reach('skel', 'e', 'c')}"
_TUBES = f"""WITH RECURSIVE {_with('tube')}, {_steps()}, {_edges('tube', 'e')}, {_reach('tube', 'e', 'c')},
  lab AS (SELECT t.*, c.root, dense_rank() OVER (PARTITION BY t.volume_id ORDER BY c.root) AS label FROM tube t JOIN c ON t.volume_id=c.volume_id AND c.x=t.i*10000+t.j*100+t.k),
  box AS (SELECT volume_id, label, min(i) i0, max(i) i1, min(j) j0, max(j) j1, min(k) k0, max(k) k1 FROM lab GROUP BY ALL),
  cells AS (SELECT volume_id, label, unnest(generate_series(i0,i1)) AS i, j0, j1, k0, k1 FROM box),
  cells2 AS (SELECT volume_id, label, i, unnest(generate_series(j0,j1)) AS j, k0, k1 FROM cells),
  cells3 AS (SELECT volume_id, label, i, j, unnest(generate_series(k0,k1)) AS k FROM cells2),
  zero AS (SELECT z.* FROM cells3 z ANTI JOIN lab l ON l.volume_id=z.volume_id AND l.label=z.label AND l.i=z.i AND l.j=z.j AND l.k=z.k),
  edt AS (SELECT l.volume_id, CAST(l.label AS INT) AS label, l.i, l.j, l.k, min((l.i-z.i)*(l.i-z.i)+(l.j-z.j)*(l.j-z.j)+(l.k-z.k)*(l.k-z.k)) AS d2
          FROM lab l JOIN zero z ON l.volume_id=z.volume_id AND l.label=z.label GROUP BY ALL)"""
_SIGNIFICANCE = _TUBES + """,
  f AS (SELECT *, CAST(sqrt(CAST(d2 AS DOUBLE)) AS FLOAT) AS fdt FROM edt),
  near AS (SELECT a.volume_id, a.label, a.i, a.j, a.k, a.fdt, CAST(coalesce(b.fdt, CAST(0 AS FLOAT)) - a.fdt AS FLOAT) AS rise,
      CAST(CAST(0.5 AS FLOAT) * CAST(1 + CASE WHEN b.fdt IS NULL THEN 0 ELSE 1 END AS FLOAT) * CAST(sqrt(CAST(abs(o.di)+abs(o.dj)+abs(o.dk) AS DOUBLE)) AS FLOAT) AS FLOAT) AS room
    FROM f a CROSS JOIN o LEFT JOIN f b ON a.volume_id=b.volume_id AND a.label=b.label AND b.i=a.i+o.di AND b.j=a.j+o.dj AND b.k=a.k+o.dk),
  sig AS (SELECT volume_id, label, i, j, k, fdt, bool_and(rise < room) AS fcmb, max(CAST(CAST(rise AS DOUBLE)/CAST(room AS DOUBLE) AS FLOAT)) AS top FROM near GROUP BY ALL),
  fields AS (SELECT volume_id, label, i, j, k, fdt, fcmb, CASE WHEN fcmb THEN CAST(1 AS FLOAT) - greatest(CAST(0 AS FLOAT), top) ELSE CAST(0 AS FLOAT) END AS lsf FROM sig)"""


def _buffer(limit: float) -> str:
    return f"""WITH RECURSIVE {_with('skel', 'pred')}, {_steps()},
  ball AS (SELECT x.v AS di, y.v AS dj, z.v AS dk FROM (VALUES (-2),(-1),(0),(1),(2)) x(v), (VALUES (-2),(-1),(0),(1),(2)) y(v), (VALUES (-2),(-1),(0),(1),(2)) z(v) WHERE x.v*x.v+y.v*y.v+z.v*z.v <= {limit}),
  hit AS (SELECT DISTINCT p.* FROM pred p CROSS JOIN ball o JOIN skel r ON r.volume_id=p.volume_id AND r.i=p.i+o.di AND r.j=p.j+o.dj AND r.k=p.k+o.dk),
  got AS (SELECT DISTINCT p.* FROM skel p CROSS JOIN ball o JOIN pred r ON r.volume_id=p.volume_id AND r.i=p.i+o.di AND r.j=p.j+o.dj AND r.k=p.k+o.dk),
  vols AS (SELECT volume_id FROM skel UNION SELECT volume_id FROM pred),
  per AS (SELECT v.volume_id, (SELECT count(*) FROM pred x WHERE x.volume_id=v.volume_id) AS n_pred, (SELECT count(*) FROM skel x WHERE x.volume_id=v.volume_id) AS n_ref,
    (SELECT count(*) FROM hit x WHERE x.volume_id=v.volume_id) AS tp, (SELECT count(*) FROM got x WHERE x.volume_id=v.volume_id) AS got FROM vols v),
  c AS (SELECT volume_id, n_pred, n_ref, tp, n_pred-tp AS fp, n_ref-got AS fn FROM per)"""


_SCORES = _buffer(2.25) + f""",
  {_edges('skel', 'es')}, {_edges('pred', 'ep')}, {_reach('skel', 'es', 'cs')}, {_reach('pred', 'ep', 'cp')}, {_counts('skel', 'ns')}, {_counts('pred', 'np')},
  m AS (SELECT c.*, coalesce((SELECT count(*) FROM cp x WHERE x.volume_id=c.volume_id AND x.x=x.root),0) AS occ_pred, coalesce((SELECT count(*) FROM cs x WHERE x.volume_id=c.volume_id AND x.x=x.root),0) AS occ_ref,
    (SELECT count(*) FROM np x WHERE x.volume_id=c.volume_id AND x.n=1) AS e_pred, (SELECT count(*) FROM ns x WHERE x.volume_id=c.volume_id AND x.n=1) AS e_ref FROM c),
  s AS (SELECT *, CASE WHEN tp+fn>0 THEN tp/(tp+fn) WHEN n_pred=0 AND n_ref=0 THEN 1.0 ELSE 0.0 END AS cpx, CASE WHEN tp+fp>0 THEN tp/(tp+fp) WHEN n_pred=0 AND n_ref=0 THEN 1.0 ELSE 0.0 END AS crx,
    CASE WHEN occ_ref<>0 THEN (occ_pred-occ_ref)/occ_ref WHEN occ_pred=0 THEN 0.0 ELSE occ_pred-occ_ref END AS occx, CASE WHEN e_ref<>0 THEN (e_pred-e_ref)/e_ref WHEN e_pred=0 THEN 0.0 ELSE e_pred-e_ref END AS ex FROM m),
  t AS (SELECT *, 1-abs(greatest(-5.0,least(5.0,occx)))/5.0 AS on_, 1-abs(greatest(-5.0,least(5.0,ex)))/5.0 AS en_ FROM s)
  SELECT volume_id, tp, fp, fn, occ_pred, occ_ref, e_pred, e_ref, round(CAST(cpx AS DOUBLE),6) AS cp, round(CAST(crx AS DOUBLE),6) AS cr, round(CAST(occx AS DOUBLE),6) AS occ, round(CAST(ex AS DOUBLE),6) AS e,
    round(CAST(on_ AS DOUBLE),6) AS occ_n, round(CAST(en_ AS DOUBLE),6) AS e_n, round(CAST((cpx+crx+on_+1+en_)/5 AS DOUBLE),6) AS p FROM t"""
_NAME = "concat('out/Lnet_i', p_partkey // 3, '_', p_partkey % 3, '{}.nii.gz')"

ORACLE_SQL: dict[str, str] = {
    "vox_curves": SQL["skel"]("duckdb"),
    "vox_classify": f"{_CLASSES} SELECT volume_id, CAST(least(greatest(n,1),3) AS INT) AS cls, count(*) AS voxels FROM n GROUP BY ALL",
    "vox_endpoints": f"{_CLASSES} SELECT volume_id, i, j, k FROM n WHERE n.n = 1",
    "vox_objects": f"{_OBJECTS} SELECT volume_id, count(*) AS objects FROM c WHERE x=root GROUP BY ALL",
    "vox_objects_fixpoint": f"{_OBJECTS} SELECT volume_id, count(*) AS objects FROM c WHERE x=root GROUP BY ALL",
    "vox_decompose": f"""{_OBJECTS} SELECT volume_id, CAST(label AS INT) AS label, n_voxels, i0, i1, j0, j1, k0, k1 FROM (
        SELECT volume_id, dense_rank() OVER (PARTITION BY volume_id ORDER BY root) AS label, count(*) AS n_voxels,
          CAST(min(x//10000) AS INT) AS i0, CAST(max(x//10000)+1 AS INT) AS i1, CAST(min(x//100%100) AS INT) AS j0, CAST(max(x//100%100)+1 AS INT) AS j1, CAST(min(x%100) AS INT) AS k0, CAST(max(x%100)+1 AS INT) AS k1
        FROM c GROUP BY volume_id, root) q WHERE n_voxels >= 10""",
    "vox_buffer_counts": f"{_buffer(1.0)} SELECT * FROM c",
    "vox_scores": _SCORES,
    "vox_degrees": f"{_CLASSES} SELECT volume_id, n AS degree, count(*) AS vertices FROM n WHERE n > 0 GROUP BY ALL",
    "vox_cliques": f"""WITH {_with('skel')}, {_steps()}, {_edges('skel', 'e')},
        t3 AS (SELECT x.volume_id, x.a, x.b, y.b AS c FROM e x JOIN e y ON x.volume_id=y.volume_id AND x.b=y.a JOIN e z ON z.volume_id=x.volume_id AND z.a=x.a AND z.b=y.b WHERE x.a<x.b AND x.b<y.b),
        t4 AS (SELECT t.volume_id, t.a, t.b, t.c, w.b AS d FROM t3 t JOIN e w ON w.volume_id=t.volume_id AND w.a=t.c AND w.b>t.c JOIN e u ON u.volume_id=t.volume_id AND u.a=t.a AND u.b=w.b JOIN e v ON v.volume_id=t.volume_id AND v.a=t.b AND v.b=w.b),
        f AS (SELECT volume_id,a,b,c FROM t4 UNION SELECT volume_id,a,b,d FROM t4 UNION SELECT volume_id,a,c,d FROM t4 UNION SELECT volume_id,b,c,d FROM t4)
        SELECT volume_id, CAST(4 AS BIGINT) AS size, count(*) AS cliques FROM t4 GROUP BY ALL
        UNION ALL SELECT volume_id, CAST(3 AS BIGINT), count(*) FROM (SELECT volume_id,a,b,c FROM t3 EXCEPT SELECT * FROM f) q GROUP BY ALL""",
    "vox_nodes": f"""WITH RECURSIVE {_with('skel')}, {_steps()}, {_counts('skel', 'n')},
        cl AS (SELECT volume_id, i, j, k, least(greatest(n,1),3) AS cls FROM n WHERE n <> 2),
        e AS (SELECT a.volume_id, a.i*10000+a.j*100+a.k AS a, b.i*10000+b.j*100+b.k AS b FROM cl a, o JOIN cl b ON a.volume_id=b.volume_id AND a.cls=b.cls AND b.i=a.i+o.di AND b.j=a.j+o.dj AND b.k=a.k+o.dk),
        {_reach('cl', 'e', 'c')},
        v AS (SELECT cl.*, c.root FROM cl JOIN c ON c.volume_id=cl.volume_id AND c.x=cl.i*10000+cl.j*100+cl.k WHERE cls=3 OR c.x=c.root)
        SELECT volume_id, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY cls, root)-1 AS INT) AS node_id, CASE cls WHEN 1 THEN 'endpoint' ELSE 'branch' END AS kind, count(*) AS voxels,
          round(2*avg(i)+1, 6) AS x, round(3*avg(j)-1, 6) AS y, round(0.5*avg(k), 6) AS z, bool_or(i=0 OR j=0 OR k=0 OR i>={SHAPE - 1} OR j>={SHAPE - 1} OR k>={SHAPE - 1}) AS at_sample_border
        FROM v GROUP BY volume_id, cls, root""",
    "vox_squared_edt": f"{_TUBES} SELECT volume_id, label, i, j, k, d2 FROM edt",
    "vox_significance": f"{_SIGNIFICANCE} SELECT volume_id, label, i, j, k, round(CAST(fdt AS DOUBLE), 5) AS fdt, fcmb, round(CAST(lsf AS DOUBLE), 5) AS lsf FROM fields",
    "vox_roots": f"{_TUBES} SELECT volume_id, label, i, j, k FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, label ORDER BY d2 DESC, i, j, k) AS nth FROM edt) q WHERE nth=1",
    "vox_roots_topmost": f"{_SIGNIFICANCE} SELECT volume_id, label, i, j, k FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, label ORDER BY fcmb DESC, CASE WHEN fcmb THEN i END, fdt DESC, i, j, k) AS nth FROM fields) q WHERE nth=1",
    "vox_summary_arithmetic": """SELECT p_partkey // 8 AS volume_id, count(*) AS objects, CAST(sum(p_size % 7) AS BIGINT) AS branch_count, round(avg(p_size), 6) AS mean_iterations, CAST(sum(CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cap_hits,
        round(CASE WHEN sum(p_size % 7) > 0 THEN log2(sum(p_size % 7)) ELSE 0 END, 6) AS log2_branches, round(sqrt(sum(p_size % 7)), 6) AS sqrt_branches FROM part GROUP BY ALL""",
    "vox_normalise": f"""WITH {_with('fuzzy')}, r AS (SELECT volume_id, i, j, k, CAST(value*4-1 AS FLOAT) AS value FROM fuzzy),
        m AS (SELECT volume_id, least(0, min(value)) AS lo, greatest(0, max(value)) AS hi FROM r GROUP BY ALL)
        SELECT volume_id, i, j, k, round(CAST(CAST((value-lo)/(hi-lo) AS FLOAT) AS DOUBLE), 5) AS value FROM r JOIN m USING (volume_id) WHERE value > lo""",
    "vox_boxes": f"""WITH {_with('skel')} SELECT volume_id, count(*) AS n_voxels, CAST(min(i) AS INT) AS i0, CAST(max(i)+1 AS INT) AS i1, CAST(min(j) AS INT) AS j0, CAST(max(j)+1 AS INT) AS j1,
        CAST(min(k) AS INT) AS k0, CAST(max(k)+1 AS INT) AS k1 FROM skel GROUP BY volume_id""",
    "vox_middle_slice": f"""WITH {_with('fuzzy')} SELECT volume_id, count(DISTINCT CASE WHEN i = {SHAPE // 2} THEN value END) + 1 < 3 AS binary FROM fuzzy GROUP BY volume_id""",
    "vox_lengths": """SELECT path_id, round(coalesce(sum(step), 0), 6) AS length FROM (SELECT l_orderkey AS path_id, sqrt(power(l_partkey % 10 - lag(l_partkey % 10) OVER w, 2)
        + power(2 * (l_suppkey % 7 - lag(l_suppkey % 7) OVER w), 2) + power(0.5 * (CAST(l_quantity AS INT) - lag(CAST(l_quantity AS INT)) OVER w), 2)) AS step
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) q GROUP BY path_id""",
    "vox_match_files": f"""WITH p AS (SELECT {_NAME.format('')} AS path FROM part), r AS (SELECT {_NAME.format('')} AS path FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT {_NAME.format('_ref')} FROM part WHERE p_partkey % 4 = 0 AND p_size > 10),
        ps AS (SELECT path, regexp_extract(path, 'out/(.*)\\.nii\\.gz', 1) AS s FROM p), rs AS (SELECT path, regexp_extract(path, 'out/(.*)\\.nii\\.gz', 1) AS s FROM r),
        m AS (SELECT ps.path AS pred_path, count(*) FILTER (ps.s=rs.s) AS equal, min(CASE WHEN ps.s=rs.s THEN rs.path END) AS own, count(rs.path) AS n, min(rs.path) AS any_ FROM ps LEFT JOIN rs ON starts_with(rs.s, ps.s) OR starts_with(ps.s, rs.s) GROUP BY ALL)
        SELECT pred_path, CASE WHEN equal=1 THEN own WHEN equal=0 AND n=1 THEN any_ END AS ref_path,
          CASE WHEN equal=1 OR (equal=0 AND n=1) THEN NULL WHEN n=0 THEN 'no reference' ELSE 'several references' END AS problem FROM m""",
}
