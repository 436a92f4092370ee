"""More queries of the catalog: sizes, seeds, labels of tetrahedra and cells, conformity."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meshlake.functions import geometry as geo
from meshlake.functions import sdf
from meshlake.operators import cells, conformity, mesh, sizing, spatial, surfaces, voxels
from meshlake.plans import catalog as c
from meshlake.plans import surfaces as s
from meshlake.plans.catalog import ORACLES, QUERIES, query
from meshlake.sources.phantoms import phantom

__all__ = ["ORACLES", "QUERIES"]

_GRADE = f"CAST(least(greatest(floor(ln((0.5 + intensity / 10.0) / 0.5) / {math.log(40) / 255!r}::DOUBLE + 0.5), 0), 255) AS INT)"


@query(f"WITH {c.GRAY}, g AS (SELECT x, y, z, {_GRADE} AS grade FROM gray), l AS (SELECT *, CAST(floor(grade * (7.0::DOUBLE / 255.0::DOUBLE) + 0.5) AS INT) AS level FROM g) SELECT x, y, z, grade, level, round(0.5 * pow(40.0::DOUBLE, level / 7.0::DOUBLE), 9) AS spacing FROM l")
def seed_levels(spark, sf_dir):
    """Grade of each voxel's size, the coarse level of eight, and its lattice spacing."""
    g = c.gray_volume(spark, sf_dir).select("x", "y", "z", geo.grade(0.5 + F.col("intensity") / 10.0, 0.5, 20.0).alias("grade"))
    leveled = g.withColumn("level", geo.seed_level(F.col("grade"), 8))
    return leveled.withColumn("spacing", F.round(geo.seed_spacing(F.col("level"), 8, 0.5, 20.0), 9))


_FIELD = "f AS (SELECT x, y, z, intensity / 10.0 AS v FROM gray)"
_NEAR = ", ".join(f"max(b.v) FILTER (b.x - a.x = {i} AND b.y - a.y = {j} AND b.z - a.z = {k}) AS f{i + 1}{j + 1}{k + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))
_GN = "sqrt(g0 * g0 + g1 * g1 + g2 * g2)"


@query(
    f"WITH {c.GRAY}, {_FIELD}, n AS (SELECT a.x, a.y, a.z, count(*) AS m, {_NEAR} FROM f a JOIN f b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 GROUP BY a.x, a.y, a.z HAVING count(*) = 27), "
    "d AS MATERIALIZED (SELECT x, y, z, (f211 - f011) / 2.0 AS g0, (f121 - f101) / 2.0 AS g1, (f112 - f110) / 2.0 AS g2, f211 - 2.0 * f111 + f011 AS h00, f121 - 2.0 * f111 + f101 AS h11, f112 - 2.0 * f111 + f110 AS h22, (f221 - f201 - f021 + f001) / 4.0 AS h01, (f212 - f210 - f012 + f010) / 4.0 AS h02, (f122 - f120 - f102 + f100) / 4.0 AS h12 FROM n), "
    f"u AS MATERIALIZED (SELECT *, {_GN} AS gn, g0 / {_GN} AS a, g1 / {_GN} AS b, g2 / {_GN} AS c FROM d WHERE {_GN} >= 1e-6), "
    # the Hessian between two unit vectors of the tangent plane, built from the axis that is least along the normal
    "p AS MATERIALIZED (SELECT *, CASE WHEN abs(a) <= abs(b) AND abs(a) <= abs(c) THEN 0.0 WHEN abs(b) <= abs(c) THEN c ELSE -b END AS e0, CASE WHEN abs(a) <= abs(b) AND abs(a) <= abs(c) THEN -c WHEN abs(b) <= abs(c) THEN 0.0 ELSE a END AS e1, CASE WHEN abs(a) <= abs(b) AND abs(a) <= abs(c) THEN b WHEN abs(b) <= abs(c) THEN -a ELSE 0.0 END AS e2 FROM u), "
    "t AS MATERIALIZED (SELECT *, e0 / sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS p0, e1 / sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS p1, e2 / sqrt(e0 * e0 + e1 * e1 + e2 * e2) AS p2 FROM p), "
    "w AS MATERIALIZED (SELECT *, b * p2 - c * p1 AS q0, c * p0 - a * p2 AS q1, a * p1 - b * p0 AS q2 FROM t), "
    "k AS MATERIALIZED (SELECT x, y, z, (h00 * p0 * p0 + h11 * p1 * p1 + h22 * p2 * p2 + 2 * (h01 * p0 * p1 + h02 * p0 * p2 + h12 * p1 * p2)) / gn AS k11, (h00 * q0 * q0 + h11 * q1 * q1 + h22 * q2 * q2 + 2 * (h01 * q0 * q1 + h02 * q0 * q2 + h12 * q1 * q2)) / gn AS k22, (h00 * p0 * q0 + h11 * p1 * q1 + h22 * p2 * q2 + h01 * (p0 * q1 + p1 * q0) + h02 * (p0 * q2 + p2 * q0) + h12 * (p1 * q2 + p2 * q1)) / gn AS k12 FROM w) "
    "SELECT x, y, z, round(abs(k11 + k22) / 2.0 + sqrt((k11 - k22) * (k11 - k22) / 4.0 + k12 * k12), 5) AS curvature FROM k "
    f"UNION ALL SELECT x, y, z, 0.0 FROM d WHERE {_GN} < 1e-6"
)
def max_curvature(spark, sf_dir):
    """The greater principal curvature of the intensity's level sets; the SQL takes the eigenvalues in the tangent plane."""
    field = c.gray_volume(spark, sf_dir).withColumn("v", F.col("intensity") / 10.0)
    near = sizing.neighbourhood(field, "v").where(" and ".join(f"f_{i}{j}{k} is not null" for i in range(3) for j in range(3) for k in range(3)))
    return near.select("x", "y", "z", F.round(sizing.max_curvature(), 5).alias("curvature"))


_TOP = "q AS (SELECT p.x, p.y, p.z, v.label, p1, p2, p3 FROM prob p JOIN voxel v USING (x, y, z)), r AS (SELECT *, CASE label WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS own, CASE label WHEN 1 THEN greatest(p2, p3) WHEN 2 THEN greatest(p1, p3) ELSE greatest(p1, p2) END AS best, CASE label WHEN 1 THEN CASE WHEN p2 >= p3 THEN 2 ELSE 3 END WHEN 2 THEN CASE WHEN p1 >= p3 THEN 1 ELSE 3 END ELSE CASE WHEN p1 >= p2 THEN 1 ELSE 2 END END AS rival FROM q)"


@query(f"WITH {c.PROB}, {_TOP}, n AS (SELECT *, own - best < 0.45 AS near, CASE rival WHEN 1 THEN 2.5 WHEN 2 THEN 4.0 END AS his FROM r) SELECT x, y, z, label, round(least(greatest(least(CASE label WHEN 1 THEN 2.5 WHEN 2 THEN 4.0 ELSE 6.0 END, coalesce(CASE WHEN near THEN his END, 1e9), coalesce(CASE WHEN near AND label + rival = 5 THEN 1.75 END, 1e9), coalesce(CASE WHEN near AND p1 > 0 THEN greatest(1.0 / (3.0 * p1), 0.9) END, 1e9)), 1.0), 5.0), 9) AS h FROM n")
def voxel_sizes(spark, sf_dir):
    """Size of each voxel from label sizes, its rival's, the size of interface 2:3, and a curvature of p1."""
    p = c.probability_volume(spark, sf_dir).join(c.voxel_volume(spark, sf_dir), ["x", "y", "z"])
    own = F.col("p")[F.col("label") - 1]
    others = F.filter(F.transform("p", lambda v, i: F.struct(v.alias("v"), (-i - 1).alias("l"))), lambda e: -e["l"] != F.col("label"))
    rival = F.array_max(others)
    at = p.select("x", "y", "z", "label", own.alias("own"), rival["v"].alias("best"), (-rival["l"]).alias("rival"), F.col("p")[0].alias("p1"))
    pair = F.when(F.col("label") + F.col("rival") == 5, F.lit(1.75))
    h = sizing.voxel_size(F.col("label"), F.col("own"), F.col("best"), F.col("rival"), {1: 2.5, 2: 4.0}, pair, F.col("p1"), 6.0, 1.0, 5.0, curved_least=0.9)
    return at.select("x", "y", "z", "label", F.round(h, 9).alias("h"))


@query(f"WITH {c.VOXEL} SELECT x, y, z, label, CASE label WHEN 1 THEN 2.0 WHEN 2 THEN 0.5 ELSE 3.0 END::DOUBLE AS h FROM voxel")
def user_sizes(spark, sf_dir):
    """The user's sizes of five channels, of which labels 1 and 2 have two each and take the lesser."""
    sizes = sizing.user_sizes([9.0, 2.0, 4.0, 0.5, 3.0, 1.0], [0, 1, 1, 2, 3, 2])
    h = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("label")]
    return c.voxel_volume(spark, sf_dir).select("x", "y", "z", "label", h.alias("h"))


@query(f"WITH {c.DENSE} SELECT max(x) - min(x) >= 1 AND max(y) - min(y) >= 1 AND max(z) - min(z) >= 1 AS dims_ok, bool_or(label <> 0) AS has_label, FALSE AS thresholds_ok FROM dense")
def validation_flags(spark, sf_dir):
    """What a plan checks before it starts; thresholds are asked for without a gray volume here."""
    return conformity.validation(c.dense_volume(spark, sf_dir), [20.0], gray=False)


@query(f"WITH {c.CLOUD} SELECT p.pid, v.label FROM cloud p LEFT JOIN voxel v ON v.x = CAST(floor(p.x / 1.5 + 0.5) AS INT) AND v.y = CAST(floor(p.y / 1.5 + 0.5) AS INT) AND v.z = CAST(floor(p.z / 1.5 + 0.5) AS INT)")
def voxel_of_points(spark, sf_dir):
    """The label of the voxel whose centre is nearest to each point, voxels being 1.5 wide."""
    p = c.cloud(spark, sf_dir).select("pid", *[F.col(a).alias(f"p{a}") for a in "xyz"])
    return voxels.voxel_of(p, c.voxel_volume(spark, sf_dir), "label", (1.5, 1.5, 1.5)).select("pid", "label")


_P = f"pe AS (SELECT x, y, z, {c._P0} AS p0, greatest(0, p1) AS p1, greatest(0, p2) AS p2, greatest(0, p3) AS p3 FROM prob)"


@query(f"WITH {c.PROB}, {c.GRID}, dense AS (SELECT g.x, g.y, g.z, coalesce(v.label, 0) AS label FROM grid g LEFT JOIN voxel v USING (x, y, z)), {_P}, zero AS (SELECT * FROM dense WHERE label = 0), near AS (SELECT DISTINCT p.x, p.y, p.z FROM pe p JOIN zero e ON e.x BETWEEN p.x - 2 AND p.x + 2 AND abs(p.x - e.x) + abs(p.y - e.y) + abs(p.z - e.z) <= 2) SELECT p.x, p.y, p.z, round(CASE WHEN n.x IS NULL THEN 0.0 ELSE p0 END, 9) AS p0, " + ", ".join(f"round(CASE WHEN n.x IS NULL AND p0 > 0 AND p1 + p2 + p3 > 0 THEN p{k} / (p1 + p2 + p3) ELSE p{k} END, 9) AS p{k}" for k in (1, 2, 3)) + " FROM pe p LEFT JOIN near n ON n.x = p.x AND n.y = p.y AND n.z = p.z")
def without_deep_exterior(spark, sf_dir):
    """Probabilities with no exterior more than two steps inside, the tissues rescaled there."""
    out = voxels.without_deep_exterior(c._with_exterior(spark, sf_dir), c.dense_volume(spark, sf_dir), 4)
    return out.select("x", "y", "z", *[F.round(F.col("p")[k], 9).alias(f"p{k}") for k in range(4)])


@query(f"WITH {c.PROB}, {_P}, q AS (SELECT p.*, v.label FROM pe p JOIN voxel v USING (x, y, z)), hit AS (SELECT DISTINCT a.x, a.y, a.z FROM q a JOIN q b ON a.label = 1 AND b.label = 3 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 < 2.25) SELECT q.x, q.y, q.z, CAST(CASE WHEN h.x IS NULL THEN label ELSE 2 END AS INT) AS label, round(CASE WHEN h.x IS NULL THEN p1 ELSE 0 END, 9) AS p1, round(CASE WHEN h.x IS NULL THEN p2 ELSE p2 + p1 END, 9) AS p2 FROM q LEFT JOIN hit h ON h.x = q.x AND h.y = q.y AND h.z = q.z")
def gap_probabilities(spark, sf_dir):
    """The minimum gap of label 2 between 1 and 3, with the probability that moves along."""
    d = c._with_exterior(spark, sf_dir).join(c.voxel_volume(spark, sf_dir), ["x", "y", "z"])
    out = voxels.minimum_gap(d, 1, 2, 3, 0.5, "p")
    return out.select("x", "y", "z", "label", F.round(F.col("p")[1], 9).alias("p1"), F.round(F.col("p")[2], 9).alias("p2"))


@query(f"WITH {c.PROB}, {_P} SELECT x, y, z, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2 + 0.05, 9) AS p2, round(p3 + 0.1, 9) AS p3 FROM pe")
def shifted_fields(spark, sf_dir):
    """Fields moved by the thresholds' biases."""
    p = voxels.shift_fields(F.col("p"), 4, {2: 0.05, 3: 0.1})
    return c._with_exterior(spark, sf_dir).select("x", "y", "z", *[F.round(p[k], 9).alias(f"p{k}") for k in range(4)])


_EIGHTEEN = [f"CAST((x * {k + 3} + y * {2 * k + 1} + z * {k * k + 1}) % 11 AS DOUBLE)" for k in range(18)]


@query(f"WITH {c.VOXEL}, m AS (SELECT x, y, z, " + ", ".join(f"({' + '.join(e for e, b in zip(_EIGHTEEN, voxels.SIX_OF_EIGHTEEN, strict=True) if b == six)}) / 100.0 AS p{0 if six == 5 else six + 1}" for six in range(6)) + " FROM voxel) SELECT x, y, z, " + ", ".join(f"round(p{k}, 9) AS p{k}" for k in range(6)) + " FROM m")
def six_class_merge(spark, sf_dir):
    """Eighteen channels merged into six classes, air as the exterior."""
    made = [F.pmod(F.col("x") * (k + 3) + F.col("y") * (2 * k + 1) + F.col("z") * (k * k + 1), F.lit(11)).cast("double") for k in range(18)]
    p = c.voxel_volume(spark, sf_dir).select("x", "y", "z", F.array(*made).alias("p"))
    out = voxels.merge_channels(p, voxels.six_class_labels(18), scale=100.0)
    return out.select("x", "y", "z", *[F.round(F.col("p")[k], 9).alias(f"p{k}") for k in range(6)])


@query(f"WITH {c._SETS} SELECT nid, label, typ FROM sets WHERE typ <> 0")
def surface_nodes(spark, sf_dir):
    return conformity.surface_nodes(c.node_label_sets(spark, sf_dir)).select("nid", "label", "typ")


@query(f"WITH {c.SIDES} SELECT n AS uses, count(*) AS n FROM met GROUP BY met.n")
def side_uses(spark, sf_dir):
    """How many sides lie on one tetrahedron, and on two."""
    return conformity.side_uses(c.tet_mesh(spark, sf_dir))


@query(f"WITH {c.TETS} SELECT tid, row_number() OVER (ORDER BY least(v0, v1, v2, v3), tid) - 1 AS rn FROM tet")
def tets_by_least_node(spark, sf_dir):
    return conformity.ordered_by_least_node(c.tet_mesh(spark, sf_dir)).select("tid", "rn")


_MAJOR = c._SETS + ", votes AS (SELECT t.tid, s.label, count(*) AS n FROM (SELECT tid, unnest([v0, v1, v2, v3]) AS nid FROM tet) t JOIN sets s USING (nid) GROUP BY t.tid, s.label), maj AS MATERIALIZED (SELECT tid, arg_max(label, n * 10 - label) AS label FROM votes GROUP BY tid)"
_AGAIN = (
    ", side2 AS (SELECT maj.label, tid, f0, f1, f2, key FROM side JOIN maj USING (tid)), met2 AS MATERIALIZED (SELECT key, count(*) AS n, arg_max(f0, label * 100000000 + tid) AS f0, arg_max(f1, label * 100000000 + tid) AS f1, arg_max(f2, label * 100000000 + tid) AS f2, max(label) AS hi, min(label) AS lo FROM side2 GROUP BY key), "
    'face2 AS MATERIALIZED (SELECT f0 AS v0, f1 AS v1, f2 AS v2, hi AS "inner", CASE WHEN n = 1 THEN 0 ELSE lo END AS "outer" FROM met2 WHERE n = 1 OR hi <> lo), '
    'corner AS (SELECT v0, v1, v2, "inner", "outer", unnest([v0, v1, v2]) AS nid FROM face2)'
)


@query(f'WITH {_MAJOR}{_AGAIN} SELECT v0, v1, v2, "inner", "outer", count(*) FILTER (NOT (list_contains(labels, "inner") AND list_contains(labels, "outer"))) AS n_off FROM corner JOIN sets USING (nid) GROUP BY v0, v1, v2, "inner", "outer" HAVING n_off > 0')
def bad_faces(spark, sf_dir):
    """Faces of the mesh relabelled by its corners' majority that leave the interface their nodes are on."""
    major = c.majority_label(spark, sf_dir)
    tets = c.tet_mesh(spark, sf_dir).drop("label").join(major, "tid")
    return conformity.bad_faces(mesh.extract_faces(tets), c.node_label_sets(spark, sf_dir))


_COMMON = c.ORACLES["tet_labelling"]


@query(f"{_COMMON.split(' SELECT t.tid, coalesce', 1)[0]}, common AS (SELECT t.tid, coalesce(g.common, []) AS common FROM tet t LEFT JOIN (SELECT tid, list_sort(list(l)) AS common FROM c GROUP BY tid) g USING (tid)), here AS (SELECT tid, CAST(tid * 7 % 4 AS INT) AS lab, [CAST(tid % 5 AS DOUBLE), CAST(tid % 7 AS DOUBLE), CAST(tid % 3 AS DOUBLE)] AS f FROM tet) SELECT tid, CAST(CASE len(common) WHEN 1 THEN common[1] WHEN 0 THEN lab ELSE CASE WHEN list_contains(common, lab) THEN lab ELSE (SELECT arg_max(l, f[l] * 100 - l) FROM (SELECT unnest(common) AS l)) END END AS INT) AS label, len(common) = 0 AS conflict FROM common JOIN here USING (tid)")
def centroid_labels(spark, sf_dir):
    """Labels of tetrahedra from their corners' common labels, then the centroid's label and fields."""
    tets = c.tet_mesh(spark, sf_dir)
    mod = lambda k: F.pmod(F.col("tid"), F.lit(k)).cast("double")
    at = tets.select("tid", F.pmod(F.col("tid") * 7, F.lit(4)).cast("int").alias("at"), F.array(mod(5), mod(7), mod(3)).alias("fields"))
    return conformity.label_by_centroid(tets, c.tet_labelling(spark, sf_dir).select("tid", "common"), at)


@query(f"WITH {s._TRI}, x AS (SELECT l.fid AS i, r.fid AS j FROM tri l JOIN tri r ON l.fid < r.fid AND least(l.ax, l.bx, l.cx) <= greatest(r.ax, r.bx, r.cx) AND least(r.ax, r.bx, r.cx) <= greatest(l.ax, l.bx, l.cx) WHERE {s._CROSS}) SELECT i, j FROM x ORDER BY i, j LIMIT 20")
def first_crossings(spark, sf_dir):
    """The first twenty crossings, which a report names."""
    return s.triangle_crossings(spark, sf_dir).orderBy("i", "j").limit(20)


def _seg(a: str, b: str) -> str:
    ab, ap = c._v(f"q.{a}", f"q.{b}"), [f"({v} - q.{a}{k})" for v, k in zip(("5.0", "4.0", "3.0"), "xyz", strict=True)]
    t = f"least(greatest({c._dot(ap, ab)} / greatest({c._dot(ab, ab)}, 1e-300), 0.0), 1.0)"
    off = [f"({p} - {t} * {d})" for p, d in zip(ap, ab, strict=True)]
    return f"sqrt({c._dot(off, off)})"


_TN = c._cross(c._v("q.a", "q.b"), c._v("q.a", "q.c"))
_IN = " AND ".join(f"{c._dot(c._cross(c._v(f'q.{a}', f'q.{b}'), [f'({v} - q.{a}{k})' for v, k in zip(('5.0', '4.0', '3.0'), 'xyz', strict=True)]), _TN)} >= 0" for a, b in ("ab", "bc", "ca"))
_PLANE = f"abs({c._dot([f'({v} - q.a{k})' for v, k in zip(('5.0', '4.0', '3.0'), 'xyz', strict=True)], _TN)}) / sqrt({c._dot(_TN, _TN)})"


@query(f"WITH {s._TRI} SELECT fid, round(CASE WHEN {c._dot(_TN, _TN)} > 0 AND {_IN} THEN {_PLANE} ELSE least({_seg('a', 'b')}, {_seg('b', 'c')}, {_seg('c', 'a')}) END, 6) AS dist FROM tri q")
def point_distances(spark, sf_dir):
    """The distance of each triangle from the point (5, 4, 3)."""
    at = (F.lit(5.0), F.lit(4.0), F.lit(3.0))
    return s._triangles(spark, sf_dir).select("fid", F.round(geo.point_triangle_distance(at, surfaces.corners()), 6).alias("dist"))


_REGIONS = f"""{c.VOXEL}, num AS MATERIALIZED (SELECT x + 100 * y + 10000 * z AS i, x, y, z, label FROM voxel),
e AS MATERIALIZED (SELECT a.i, b.i AS j FROM num a JOIN num b ON a.label = b.label AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
r(i, root) AS (SELECT i, i FROM num UNION SELECT e.j, r.root FROM r JOIN e USING (i)),
comp AS MATERIALIZED (SELECT i, min(root) + 1 AS cell FROM r GROUP BY i),
vox AS MATERIALIZED (SELECT x, y, z, cell FROM num JOIN comp USING (i)),
step(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)),
nb AS MATERIALIZED (SELECT DISTINCT v.cell AS a, coalesce(w.cell, 0) AS b FROM vox v CROSS JOIN step LEFT JOIN vox w ON w.x = v.x + dx AND w.y = v.y + dy AND w.z = v.z + dz WHERE v.cell <> coalesce(w.cell, 0)),
both_ways AS MATERIALIZED (SELECT a, b FROM nb UNION SELECT b, a FROM nb),
d(cell, depth) AS (SELECT 0, 0 UNION SELECT t.b, d.depth + 1 FROM d JOIN both_ways t ON t.a = d.cell WHERE d.depth < 40),
found AS (SELECT cell, min(depth) AS depth FROM d GROUP BY cell),
vol AS (SELECT cell, count(*) AS n FROM vox GROUP BY cell)"""


@query(f"WITH RECURSIVE {_REGIONS} SELECT cell, depth, CASE WHEN depth > 0 THEN row_number() OVER (PARTITION BY depth > 0 ORDER BY depth, n DESC, cell) ELSE 0 END AS label FROM (SELECT f.cell, f.depth, coalesce(v.n, 0) AS n FROM found f LEFT JOIN vol v USING (cell))")
def cell_labels(spark, sf_dir):
    """Cells of one label's voxels, numbered by how many cells lie between them and the outside, then by size."""
    v = c.voxel_volume(spark, sf_dir)
    number = (F.col("x") + 100 * F.col("y") + 10000 * F.col("z")).cast("long")
    own = v.withColumn("node", number).join(c.region_components(spark, sf_dir), "node", "left")
    own = own.select("x", "y", "z", (F.coalesce("component", "node") + 1).cast("long").alias("cell"))
    sides = voxels.dilate(own, voxels.SIX, ("cell",)).withColumnRenamed("cell", "a")
    met = sides.join(own, ["x", "y", "z"], "left").select("a", F.coalesce("cell", F.lit(0)).cast("long").alias("b")).where("a <> b").distinct()
    sizes = own.groupBy("cell").agg(F.count(F.lit(1)).alias("volume")).unionByName(spark.sql("select 0L as cell, 0L as volume"))
    return cells.cell_labels(sizes, met).select("cell", "depth", F.col("label").cast("long").alias("label"))


@query(f"WITH {c._BARS}, r AS (SELECT dist, row_number() OVER (ORDER BY dist) - 1 AS rn, count(*) OVER () AS n FROM (SELECT round(dist, 6) AS dist FROM bars)) SELECT min(dist) FILTER (rn = n // 2) AS p50, min(dist) FILTER (rn = n * 95 // 100) AS p95, min(dist) FILTER (rn = n * 99 // 100) AS p99, max(dist) AS top FROM r")
def deviation_percentiles(spark, sf_dir):
    """Positional percentiles of bar lengths, and the greatest."""
    from meshlake.operators import spatial

    bars = spatial.truss(c.cloud(spark, sf_dir), 1.3).select(F.round("dist", 6).alias("dist"))
    return mesh.positional(bars, "dist", {"p50": (1, 2), "p95": (95, 100), "p99": (99, 100), "top": (1, 1)})


@query(f"WITH {s._TRI}, a AS (SELECT fid % 3 + 1 AS label, {s._QT} AS area FROM tri q) SELECT label, count(*) AS n, round(sum(area), 5) AS area FROM a GROUP BY label")
def label_areas(spark, sf_dir):
    """Areas of triangles by label."""
    t = s._triangles(spark, sf_dir).select((F.pmod("fid", F.lit(3)) + 1).alias("label"), geo.triangle_area(surfaces.corners()).alias("a"))
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a"), 5).alias("area"))


_HOLLOW = "g AS (SELECT x, y, z, 2.0 * (x + 0.5) / 24 - 1.0 AS u, 2.0 * (y + 0.5) / 24 - 1.0 AS v, 2.0 * (z + 0.5) / 24 - 1.0 AS w FROM range(24) a(x), range(24) b(y), range(24) c(z)), h AS (SELECT x, y, z, sqrt(u * u + v * v + w * w) AS r FROM g)"


@query(f"WITH {_HOLLOW} SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, CASE WHEN r < 0.7 THEN 1 ELSE 0 END AS label FROM h")
def filled_holes(spark, sf_dir):
    """A hollow ball, its hole filled with the shell's label."""
    d = phantom(spark, "hollow", 24).select("x", "y", "z", "label")
    return voxels.fill_holes(d, (24, 24, 24))


@query(f"WITH {_HOLLOW} SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM h WHERE r < 0.4")
def hollow_voxels(spark, sf_dir):
    """The voxels of a hollow ball's hole: of label 0, but reached by no border voxel."""
    zero = phantom(spark, "hollow", 24).where("label = 0").select("x", "y", "z")
    border = " or ".join(f"{a} = {n}" for a in "xyz" for n in (0, 23))
    return zero.join(voxels.flood(zero, zero.where(border)), ["x", "y", "z"], "left_anti")


_ORDERED = "m AS (SELECT *, CAST(s1 > 0 AS INT) + 2 * CAST(s2 > 0 AS INT) + 4 * CAST(s3 > 0 AS INT) AS mask FROM s)"


@query(f"{c._SDF}, {_ORDERED}, ranked AS (SELECT mask, row_number() OVER (ORDER BY mask) + 3 AS k FROM (SELECT DISTINCT mask FROM m WHERE mask NOT IN (0, 1, 2, 4))) SELECT m.x, m.y, m.z, CAST(CASE mask WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE r.k END AS INT) AS cell FROM m LEFT JOIN ranked r USING (mask)")
def overlap_cells(spark, sf_dir):
    """Each combination of solids that occurs as a region: alone a solid keeps its label, the rest follow in order."""
    f = c._fields(spark)
    return sdf.overlap_cells(f, [(k, F.col(f"s{k}")) for k in (1, 2, 3)]).select("x", "y", "z", F.col("tag").alias("cell"))


@query(f"{c._SDF}, n AS (SELECT count(*) FILTER (s1 > 0) AS n1, count(*) FILTER (s2 > 0) AS n2, count(*) FILTER (s3 > 0) AS n3 FROM s), o AS (SELECT s.*, list_sort([{{'n': CASE WHEN s1 > 0 THEN n1 ELSE 1000000000 END, 'l': 1}}, {{'n': CASE WHEN s2 > 0 THEN n2 ELSE 1000000000 END, 'l': 2}}, {{'n': CASE WHEN s3 > 0 THEN n3 ELSE 1000000000 END, 'l': 3}}])[1] AS w FROM s, n) SELECT x, y, z, CAST(CASE WHEN w.n < 1000000000 THEN w.l ELSE 0 END AS INT) AS tag FROM o")
def overlap_nest(spark, sf_dir):
    """The smaller solid wins where solids overlap, of equal ones the lower label."""
    f = c._fields(spark)
    return sdf.overlap_nest(f, [(k, F.col(f"s{k}")) for k in (1, 2, 3)]).select("x", "y", "z", "tag")


_BOXES = " AND ".join(f"least(l.a{k}, l.b{k}, l.c{k}) <= greatest(r.a{k}, r.b{k}, r.c{k}) AND least(r.a{k}, r.b{k}, r.c{k}) <= greatest(l.a{k}, l.b{k}, l.c{k})" for k in "xyz")


@query(
    f"""WITH {c.SIDES}{c.NODES}{c.POINTS.removeprefix(c.TETS + c.NODES)}, reg AS (SELECT *, unnest(list_filter([-1, "inner", "outer"], lambda r: r <> 0)) AS region FROM face), e AS ({c._edges("region", "reg")}),
u AS (SELECT region, a, b, count(*) AS n FROM e GROUP BY region, a, b),
tri AS MATERIALIZED (SELECT row_number() OVER () AS fid, """
    + ", ".join(f'q{k}.{a} AS "{n}{a}"' for k, n in enumerate("abc") for a in "xyz")
    + f""" FROM face f JOIN node q0 ON q0.nid = f.v0 JOIN node q1 ON q1.nid = f.v1 JOIN node q2 ON q2.nid = f.v2),
near AS MATERIALIZED (SELECT l.fid AS i, r.fid AS j FROM tri l JOIN tri r ON l.fid < r.fid AND floor(least(l.ax, l.bx, l.cx)) BETWEEN floor(least(r.ax, r.bx, r.cx)) - 2 AND floor(least(r.ax, r.bx, r.cx)) + 2 WHERE {_BOXES}),
crossing AS (SELECT count(*) AS n_crossings FROM near JOIN tri l ON l.fid = i JOIN tri r ON r.fid = j WHERE {s._CROSS}),
edges AS (SELECT count(*) FILTER (region = -1 AND n = 1) AS n_open, count(*) FILTER (region <> -1 AND n % 2 = 1) AS n_region_open FROM u),
quality AS (SELECT count(*) AS n_tets, least(count(*) FILTER ({c._V6} > 0), count(*) FILTER ({c._V6} < 0)) AS n_inverted, count(*) FILTER ({c._V6} = 0) AS n_flat, count(*) FILTER (round({c._DIHEDRAL}, 6) < 10) AS n_slivers FROM pts)
SELECT *, n_inverted = 0 AND n_open = 0 AND n_region_open = 0 AND n_crossings = 0 AS ok FROM quality, edges, crossing"""
)
def check_report(spark, sf_dir):
    """The report on the whole mesh: its quality, the edges of its surfaces and their crossings."""
    return mesh.check_report(c.tet_mesh(spark, sf_dir), c.nodes(spark, sf_dir))


_AT = ", ".join(f"CAST(floor(u{k} + CAST(s AS DOUBLE) / parts * (w{k} - u{k}) + 0.5) AS INT) AS {k}" for k in "xyz")


@query(
    f"""WITH {c.TETS}{c.NODES}, edge AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM (SELECT unnest([v0, v0, v0, v1, v1, v2]) AS p, unnest([v1, v2, v3, v2, v3, v3]) AS q FROM tet)),
ends AS (SELECT a, b, m.x - 0.5 AS ux, m.y - 0.5 AS uy, m.z - 0.5 AS uz, n.x - 0.5 AS wx, n.y - 0.5 AS wy, n.z - 0.5 AS wz FROM edge JOIN node m ON m.nid = a JOIN node n ON n.nid = b),
cut AS (SELECT *, greatest(2, CAST(ceil(sqrt((wx - ux) * (wx - ux) + (wy - uy) * (wy - uy) + (wz - uz) * (wz - uz)) / 0.25) AS INT)) AS parts FROM ends),
place AS (SELECT a, b, {_AT} FROM (SELECT *, unnest(range(1, parts)) AS s FROM cut))
SELECT DISTINCT a, b FROM place ANTI JOIN (SELECT x, y, z FROM voxel WHERE label <> 0) USING (x, y, z)"""
)
def exterior_edges(spark, sf_dir):
    """Edges of the mesh that leave the labelled voxels between their ends; a voxel's centre is half a side from its corners."""
    centred = c.nodes(spark, sf_dir).select("nid", *[(F.col(a) - 0.5).alias(a) for a in "xyz"])
    return conformity.exterior_edges(mesh.unique_edges(c.tet_mesh(spark, sf_dir)), centred, c.voxel_volume(spark, sf_dir))


@query(
    f"""WITH {c.CLOUD}, pin AS (SELECT pid // {c.NX} AS curve, pid, x, y, z, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM cloud WHERE typ = 2 WINDOW w AS (PARTITION BY pid // {c.NX} ORDER BY pid)),
ball AS MATERIALIZED (SELECT 0.5 * (x + nx) AS x, 0.5 * (y + ny) AS y, 0.5 * (z + nz) AS z, 0.25 * ((x - nx) * (x - nx) + (y - ny) * (y - ny) + (z - nz) * (z - nz)) AS r2 FROM pin WHERE nx IS NOT NULL)
SELECT pid, typ FROM cloud p WHERE typ = 2 OR NOT EXISTS (SELECT 1 FROM ball b WHERE r2 > 0 AND r2 <= 0.64 * (1.8 + 0.01 * b.x) * (1.8 + 0.01 * b.x) AND (p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y) + (p.z - b.z) * (p.z - b.z) < r2)"""
)
def protected_features(spark, sf_dir):
    """Points outside the balls between pins that follow along x in a row of voxels; points of type 2 are the pins."""
    p = c.cloud(spark, sf_dir)
    pins = p.where("typ = 2").select("pid", F.floor(F.col("pid") / c.NX).alias("curve"), F.col("pid").alias("t"), "x", "y", "z")
    balls = spatial.feature_balls(pins).withColumn("h", 1.8 + 0.01 * F.col("x"))
    return spatial.protect(p, balls, F.col("typ") == 2).select("pid", "typ")
