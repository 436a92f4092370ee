"""More queries of the catalog: surfaces, neighbourhoods and numberings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meshlake.operators import mesh, spatial, surfaces, voxels
from meshlake.plans import catalog as c
from meshlake.plans.catalog import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

_TRI = c.CLOUD + """,
tri AS MATERIALIZED (SELECT a.pid AS fid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, d.x AS cx, d.y AS cy, d.z AS cz
        FROM cloud a JOIN cloud b ON b.pid = a.pid + 2 JOIN cloud d ON d.pid = a.pid + 51)"""


def _triangles(spark, sf_dir):
    p = c.cloud(spark, sf_dir).select("pid", "x", "y", "z")
    at = lambda n, k: p.select((F.col("pid") - k).alias("fid"), *[F.col(a).alias(f"{n}{a}") for a in "xyz"])
    return at("a", 0).join(at("b", 2), "fid").join(at("c", 51), "fid")


def _o(a: str, b: str, d: str, p: str) -> str:
    q = lambda x: [f"{x}{k}" for k in ("x", "y", "z")]
    u, v, w = ([f"({e} - {f})" for e, f in zip(q(x), q(a), strict=True)] for x in (b, d, p))
    return c._dot(u, c._cross(v, w))


def _pierce(p: str, q: str, t: str) -> str:
    x, y, z = f"{t}.a", f"{t}.b", f"{t}.c"
    turn = [_o(p, q, *e) for e in ((x, y), (y, z), (z, x))]
    return f"({_o(x, y, z, p)} * {_o(x, y, z, q)} < 0 AND (({' AND '.join(s + ' > 0' for s in turn)}) OR ({' AND '.join(s + ' < 0' for s in turn)})))"


_CROSS = " OR ".join(_pierce(f"{s}.{a}", f"{s}.{b}", o) for s, o in (("l", "r"), ("r", "l")) for a, b in ("ab", "bc", "ca"))


@query(f"WITH {_TRI} SELECT l.fid AS i, r.fid AS j FROM tri l JOIN tri r ON l.fid < r.fid AND least(l.ax, l.bx, l.cx) <= greatest(r.ax, r.bx, r.cx) AND least(r.ax, r.bx, r.cx) <= greatest(l.ax, l.bx, l.cx) WHERE {_CROSS}")
def triangle_crossings(spark, sf_dir):
    return surfaces.triangle_crossings(_triangles(spark, sf_dir), 1.5)


_EDGE = f"edge AS (SELECT DISTINCT a, b FROM ({c._edges('1 AS one')})), nb AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge)"
_HC = ", ".join(f"avg(q.{a}) AS m{a}" for a in "xyz")


@query(f"WITH {c.SIDES}{c.NODES}, {_EDGE}, m AS (SELECT nb.a AS nid, {_HC} FROM nb JOIN node q ON q.nid = nb.b GROUP BY nb.a), b AS (SELECT n.nid, " + ", ".join(f"coalesce(m{a}, {a}) AS p{a}, coalesce(m{a}, {a}) - (0.5 * {a} + 0.5 * {a}) AS w{a}" for a in "xyz") + " FROM node n LEFT JOIN m USING (nid)), k AS (SELECT nb.a AS nid, " + ", ".join(f"avg(b.w{a}) AS k{a}" for a in "xyz") + " FROM nb JOIN b ON b.nid = nb.b GROUP BY nb.a) SELECT b.nid, " + ", ".join(f"round(p{a} - (0.5 * w{a} + 0.5 * coalesce(k{a}, w{a})) + 1e-9, 6) AS {a}" for a in "xyz") + " FROM b LEFT JOIN k USING (nid)")
def surface_smoothing(spark, sf_dir):
    """One laplacianhc pass over the edges of the region surfaces."""
    edges = mesh.face_edges(c.face_extraction(spark, sf_dir)).distinct()
    out = surfaces.smooth(c.nodes(spark, sf_dir), edges)
    return out.select("nid", *[F.round(F.col(a) + 1e-9, 6).alias(a) for a in "xyz"])


_CUT = " UNION ALL ".join(f"SELECT tid, label, p{i}x + (2.3 - p{i}z) / (p{j}z - p{i}z) * (p{j}x - p{i}x) AS u, p{i}y + (2.3 - p{i}z) / (p{j}z - p{i}z) * (p{j}y - p{i}y) AS v FROM pts WHERE least(p{i}z, p{j}z) < 2.3 AND greatest(p{i}z, p{j}z) >= 2.3" for i in range(4) for j in range(i + 1, 4))


@query(f"WITH {c.POINTS} SELECT tid, label, round(u, 6) AS u, round(v, 6) AS v FROM ({_CUT})")
def mesh_slice(spark, sf_dir):
    """Points of the tetrahedra's edges on the plane z = 2.3."""
    s = surfaces.slice_points(mesh.tet_points(c.tet_mesh(spark, sf_dir), c.nodes(spark, sf_dir)), "z", 2.3)
    return s.select("tid", "label", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query(f"WITH {c.PROB}, q AS (SELECT x, y, z, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3 FROM prob), s AS (SELECT x, y, z, list_sort([{{'v': -p1, 'l': 1}}, {{'v': -p2, 'l': 2}}, {{'v': -p3, 'l': 3}}]) AS s FROM q) SELECT x, y, z, s[1].l AS best, s[2].l AS second, round(s[2].v - s[1].v, 9) AS margin FROM s")
def top_two_labels(spark, sf_dir):
    """The best label of a voxel, the runner-up and how far it is behind."""
    ranked = F.array_sort(F.array(*[F.struct((-F.round(F.col("p")[k], 9)).alias("v"), F.lit(k + 1).alias("l")) for k in range(3)]))
    s = c.probability_volume(spark, sf_dir).select("x", "y", "z", ranked.alias("s"))
    return s.select("x", "y", "z", F.col("s")[0]["l"].alias("best"), F.col("s")[1]["l"].alias("second"), F.round(F.col("s")[1]["v"] - F.col("s")[0]["v"], 9).alias("margin"))


@query(f"WITH {c._BARS}, h AS (SELECT CAST(floor(log2(dist)) AS INT) AS bin, count(*) AS n FROM bars WHERE dist > 0 GROUP BY 1), s AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h) SELECT min(pow(2.0, bin + 1)) AS p99 FROM s WHERE upto >= 0.99 * total")
def histogram_p99(spark, sf_dir):
    """The upper edge of the power-of-two bin that holds the 99th percentile of bar lengths."""
    bars = spatial.truss(c.cloud(spark, sf_dir), 1.3).where("dist > 0")
    h = bars.groupBy(F.floor(F.log2("dist")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # as many rows as a logarithm has whole values
    s = h.select("bin", F.sum("n").over(Window.orderBy("bin")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return s.where(F.col("upto") >= 0.99 * F.col("total")).agg(F.min(F.pow(F.lit(2.0), F.col("bin") + 1)).alias("p99"))


@query(f"WITH {c.GRAY}, st AS (SELECT abs(a.intensity - b.intensity) AS step FROM gray a JOIN gray b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z WHERE (a.intensity >= 50) <> (b.intensity >= 50)), r AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS rn, count(*) OVER () AS n FROM st) SELECT min(step) AS median_step, 4 * min(step) AS width FROM r WHERE rn = n // 2")
def median_step(spark, sf_dir):
    """Element n/2 of the intensity steps along x that cross level 50, and the width that follows from it."""
    g = c.gray_volume(spark, sf_dir)
    after = F.lead("intensity").over(Window.partitionBy("y", "z").orderBy("x"))
    steps = g.withColumn("b", after).where("b is not null and (intensity >= 50) <> (b >= 50)").select(F.abs(F.col("intensity") - F.col("b")).alias("step"))
    m = mesh.positional(steps, "step", {"median_step": 2})
    return m.withColumn("width", 4 * F.col("median_step"))


@query(f"WITH {c.GRAY} SELECT a.x, a.y, a.z, min(b.intensity) AS least FROM gray a JOIN gray b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.z BETWEEN a.z - 2 AND a.z + 2 GROUP BY a.x, a.y, a.z")
def minimum_filter(spark, sf_dir):
    """The least intensity of the 5 x 5 x 5 voxels around each: a window along each axis."""
    g = c.gray_volume(spark, sf_dir).withColumnRenamed("intensity", "least")
    for axis in "xyz":
        line = Window.partitionBy(*[a for a in "xyz" if a != axis]).orderBy(axis).rowsBetween(-2, 2)
        g = g.withColumn("least", F.min("least").over(line))
    return g.select("x", "y", "z", "least")


@query(f"WITH {c.PROB}, q AS (SELECT p.*, v.label FROM prob p JOIN voxel v USING (x, y, z)) SELECT x, y, z, label, round(CASE label WHEN 1 THEN greatest(p1, greatest(p2, p3) + 0.01) WHEN 2 THEN greatest(p2, greatest(p1, p3) + 0.01) ELSE greatest(p3, greatest(p1, p2) + 0.01) END, 9) AS own FROM q")
def label_preserving_field(spark, sf_dir):
    """A voxel's own field raised to 0.01 above every other."""
    p = c.probability_volume(spark, sf_dir).join(c.voxel_volume(spark, sf_dir), ["x", "y", "z"])
    others = F.array_max(F.filter("p", lambda v, i: i + 1 != F.col("label")))
    return p.select("x", "y", "z", "label", F.round(F.greatest(F.col("p")[F.col("label") - 1], others + 0.01), 9).alias("own"))


@query(f"WITH {c.VOXEL}, s AS (SELECT x, y, z, label, unnest(range(label)) AS i FROM voxel), t AS (SELECT *, unnest(range(label)) AS j FROM s) SELECT x, y, z, round(x + (i + 0.5) / label, 9) AS px, round(y + (j + 0.5) / label, 9) AS py, label FROM t")
def lattice_seeds(spark, sf_dir):
    """label x label seeds in the plane of each voxel."""
    v = c.voxel_volume(spark, sf_dir)
    s = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("label") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("label") - 1)))
    return s.select("x", "y", "z", F.round(F.col("x") + (F.col("i") + 0.5) / F.col("label"), 9).alias("px"), F.round(F.col("y") + (F.col("j") + 0.5) / F.col("label"), 9).alias("py"), "label")


@query(f"WITH {c.DENSE}, k AS (SELECT a.x, a.y, a.z, b.label FROM dense a JOIN dense b ON b.x - a.x IN (0, 1) AND b.y - a.y IN (0, 1) AND b.z - a.z IN (0, 1)), j AS (SELECT x, y, z, list_sort(list(DISTINCT label)) AS labels FROM k GROUP BY x, y, z HAVING count(DISTINCT label) >= 3 AND count(*) = 8), r AS (SELECT *, row_number() OVER (PARTITION BY x // 4, y // 4, z // 4, labels ORDER BY z, y, x) AS rn FROM j) SELECT x, y, z, labels FROM r WHERE rn = 1")
def junction_candidates(spark, sf_dir):
    """One junction vertex for each cell of four voxels and label set, the first in the grid's order."""
    cell = [F.floor(F.col(a) / 4) for a in "xyz"]
    order = F.row_number().over(Window.partitionBy(*cell, "labels").orderBy("z", "y", "x"))
    return c.junction_vertices(spark, sf_dir).withColumn("rn", order).where("rn = 1").select("x", "y", "z", "labels")


@query(f"WITH {c.CLOUD} SELECT pid, round(0.9 * x - 0.1 * y + 12.5, 9) AS wx, round(1.1 * y + 0.2 * z - 3.0, 9) AS wy, round(1.5 * z + 0.25 * x, 9) AS wz FROM cloud")
def world_points(spark, sf_dir):
    """Grid points by an affine."""
    m = [[0.9, -0.1, 0.0, 12.5], [0.0, 1.1, 0.2, -3.0], [0.25, 0.0, 1.5, 0.0]]
    row = lambda r: r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + r[3]
    return c.cloud(spark, sf_dir).select("pid", *[F.round(row(r), 9).alias(n) for r, n in zip(m, ("wx", "wy", "wz"), strict=True)])


@query()
def region_of_points(spark, sf_dir):
    """Winding numbers of points in the surface of label 1."""
    faces = c.face_extraction(spark, sf_dir).where("inner = 1 or outer = 1")
    n = mesh.vertex_nodes(c.tet_mesh(spark, sf_dir), c.NX, c.NY)
    turned = faces.select(*[F.when(F.col("inner") == 1, F.col(v)).otherwise(F.col(w)).alias(v) for v, w in (("v0", "v0"), ("v1", "v2"), ("v2", "v1"))])
    t = turned.withColumn("fid", F.xxhash64("v0", "v1", "v2"))
    for k, name in enumerate("abc"):
        t = t.join(n.select(F.col("nid").alias(f"v{k}"), *[F.col(a).alias(f"{name}{a}") for a in "xyz"]), f"v{k}")
    p = c.cloud(spark, sf_dir).select("pid", *[F.col(a) for a in "xyz"])
    return spatial.winding(p, t.drop("v0", "v1", "v2"), 1.0)


@query(f"WITH RECURSIVE {c.VOXEL}, e AS (SELECT a.x + 100 * a.y + 10000 * a.z AS i, b.x + 100 * b.y + 10000 * b.z AS j FROM voxel a JOIN voxel b ON a.label = b.label AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1), r(i, root) AS (SELECT i, i FROM e UNION SELECT e.j, r.root FROM r JOIN e USING (i)), comp AS (SELECT i, min(root) AS c FROM r GROUP BY i), size AS (SELECT c AS component, count(*) AS n FROM comp GROUP BY c) SELECT component, n, row_number() OVER (ORDER BY n DESC, component) - 1 AS rn FROM size")
def numbered_regions(spark, sf_dir):
    """Regions numbered largest first, then by their least voxel."""
    from meshlake.operators.ordering import global_row_number

    sizes = c.region_components(spark, sf_dir).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return global_row_number(sizes, [F.col("n").desc(), F.col("component").asc()]).select("component", "n", "rn")


_QT = c._AREA.replace("q0.", "q.a").replace("q1.", "q.b").replace("q2.", "q.c")


@query(f"WITH {_TRI} SELECT fid, round({_QT}, 6) AS area, round({4 * 3**0.5!r}::DOUBLE * {_QT} / (" + " + ".join(c._dot(c._v(f"q.{a}", f"q.{b}"), c._v(f"q.{a}", f"q.{b}")) for a, b in ("ab", "ac", "bc")) + "), 6) AS quality FROM tri q")
def triangle_quality(spark, sf_dir):
    from meshlake.functions import geometry as geo

    p = surfaces.corners()
    return _triangles(spark, sf_dir).select("fid", F.round(geo.triangle_area(p), 6).alias("area"), F.round(geo.triangle_quality(p), 6).alias("quality"))


@query(f"WITH {c.VOXEL} SELECT x, y, z FROM voxel WHERE label = 1 AND NOT EXISTS (SELECT 1 FROM voxel b WHERE b.label = 3 AND abs(b.x - voxel.x) <= 1 AND abs(b.y - voxel.y) <= 1 AND abs(b.z - voxel.z) <= 1)")
def clear_of_label(spark, sf_dir):
    """Voxels of label 1 with no label 3 among their 26 neighbours: an anti-join on a dilation."""
    v = c.voxel_volume(spark, sf_dir)
    near = voxels.dilate(v.where("label = 3"), voxels.BALL).select("x", "y", "z").distinct()
    return v.where("label = 1").join(near, ["x", "y", "z"], "left_anti").select("x", "y", "z")
