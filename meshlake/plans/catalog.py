"""Queries over the driver's tables, each with the SQL that gives the same rows.

lineitem stands for a segmented image: quantity, discount and tax are the coordinates of a
voxel, and the return flags that meet there decide its label. The other volumes, meshes
and points are made from the same columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.functions import geometry as geo
from meshlake.functions import sdf
from meshlake.operators import mesh, ordering, spatial, voxels
from meshlake.operators.graph import connected_components
from meshlake.sources.phantoms import grid, phantom

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The size of the volume.
NX, NY, NZ = 51, 11, 9


def query(sql: str | None = None):
    """Register a query under the function's name, with its SQL."""

    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return li.select(F.col("l_quantity").cast("int").alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y"), F.round(F.col("l_tax") * 100).cast("int").alias("z"), flag.alias("l"), "l_orderkey")


def voxel_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, label): the majority flag of each cell, of equals the lowest. Missing cells are 0."""
    counts = lineitem(spark, sf_dir).groupBy("x", "y", "z", "l").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("x", "y", "z").agg(F.max_by("l", F.struct("c", -F.col("l"))).cast("int").alias("label"))


def dense_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, NX, NY, NZ).join(voxel_volume(spark, sf_dir), ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("label", F.lit(0)).alias("label"))


def gray_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense (x, y, z, intensity), in tenths from 0 to 99.9."""
    g = lineitem(spark, sf_dir).groupBy("x", "y", "z").agg((F.sum("l_orderkey") % 1000 / 10.0).alias("intensity"))
    return grid(spark, NX, NY, NZ).join(g, ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("intensity", F.lit(0.0)).alias("intensity"))


def probability_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, p): the share of each flag among ten and the cell's rows, as three channels."""
    c = lineitem(spark, sf_dir).groupBy("x", "y", "z").agg(*[F.count(F.when(F.col("l") == k, 1)).alias(f"c{k}") for k in (1, 2, 3)], F.count(F.lit(1)).alias("n"))
    return c.select("x", "y", "z", F.array(*[F.col(f"c{k}") / (F.col("n") + 10).cast("double") for k in (1, 2, 3)]).alias("p"))


def tet_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tetrahedra for each voxel of the whole volume."""
    return mesh.voxel_tets(voxel_volume(spark, sf_dir), NX, NY)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid vertices moved by a fixed small amount that depends on their number."""
    n = mesh.vertex_nodes(tet_mesh(spark, sf_dir), NX, NY)
    shift = lambda k: (F.pmod(F.col("nid") * k, F.lit(17)) - 8) / F.lit(100.0)
    return n.select("nid", (F.col("x") + shift(7)).alias("x"), (F.col("y") + shift(11)).alias("y"), (F.col("z") + shift(13)).alias("z"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from lineitem's distinct cells with a size, label and type."""
    v = voxel_volume(spark, sf_dir)
    pid = (F.col("x") + NX * (F.col("y") + NY * F.col("z"))).cast("long")
    jitter = lambda k: F.pmod(pid * k, F.lit(19)) / F.lit(40.0)
    return v.select(pid.alias("pid"), *[(F.col(a).cast("double") + jitter(k)).alias(a) for a, k in (("x", 5), ("y", 7), ("z", 11))], "label", F.pmod(pid, F.lit(3)).cast("int").alias("typ"), (0.8 + F.pmod(pid, F.lit(5)) / 10.0).alias("h"))


VOXEL = """
li AS (SELECT CAST(l_quantity AS INT) AS x, CAST(round(l_discount * 100) AS INT) AS y, CAST(round(l_tax * 100) AS INT) AS z,
              CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS l, l_orderkey FROM lineitem),
cells AS (SELECT x, y, z, l, count(*) AS c FROM li GROUP BY x, y, z, l),
voxel AS MATERIALIZED (SELECT x, y, z, CAST(arg_max(l, c * 10 - l) AS INT) AS label FROM cells GROUP BY x, y, z)"""
GRID = f"""
grid AS (SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, CAST(k AS INT) AS z FROM range({NX}) a(i), range({NY}) b(j), range({NZ}) c(k))"""
DENSE = f"{VOXEL},{GRID},\ndense AS (SELECT g.x, g.y, g.z, coalesce(v.label, 0) AS label FROM grid g LEFT JOIN voxel v USING (x, y, z))"
GRAY = f"{VOXEL},{GRID},\ngray AS (SELECT g.x, g.y, g.z, coalesce(v.i, 0.0::DOUBLE) AS intensity FROM grid g LEFT JOIN (SELECT x, y, z, CAST(sum(l_orderkey) % 1000 AS DOUBLE) / 10.0 AS i FROM li GROUP BY x, y, z) v USING (x, y, z))"
PROB = VOXEL + ",\nprob AS (SELECT x, y, z, " + ", ".join(f"CAST(count(*) FILTER (l = {k}) AS DOUBLE) / CAST(count(*) + 10 AS DOUBLE) AS p{k}" for k in (1, 2, 3)) + " FROM li GROUP BY x, y, z)"
_VERTEX = f"CAST(x + (c & 1) + {NX + 1} * (y + (c >> 1 & 1) + {NY + 1} * (z + (c >> 2 & 1))) AS BIGINT)"
TETS = (
    VOXEL
    + ",\nkuhn(k, a, b, c, d) AS (VALUES "
    + ", ".join(f"({k}, {', '.join(map(str, t))})" for k, t in enumerate(mesh.KUHN))
    + "),\ntet AS MATERIALIZED (SELECT CAST(x + %d * (y + %d * z) AS BIGINT) * 6 + k AS tid, " % (NX, NY)
    + ", ".join(f"CAST(x + ({c} & 1) + {NX + 1} * (y + ({c} >> 1 & 1) + {NY + 1} * (z + ({c} >> 2 & 1))) AS BIGINT) AS v{n}" for n, c in enumerate("abcd"))
    + ", label FROM voxel, kuhn WHERE label <> 0)"
)
SIDES = (
    TETS
    + ",\nside AS ("
    + " UNION ALL ".join(f"SELECT tid, label, v{f[0]} AS f0, v{f[1]} AS f1, v{f[2]} AS f2, list_sort([v{f[0]}, v{f[1]}, v{f[2]}]) AS key FROM tet" for f in mesh.FACES)
    + """),
met AS MATERIALIZED (SELECT key, count(*) AS n, arg_max(f0, label * 100000000 + tid) AS f0, arg_max(f1, label * 100000000 + tid) AS f1, arg_max(f2, label * 100000000 + tid) AS f2, max(label) AS hi, min(label) AS lo FROM side GROUP BY key),
face AS (SELECT f0 AS v0, f1 AS v1, f2 AS v2, hi AS "inner", CASE WHEN n = 1 THEN 0 ELSE lo END AS "outer" FROM met WHERE n = 1 OR hi <> lo)"""
)
_SHIFT = lambda k: f"(nid * {k} % 17 - 8) / 100.0::DOUBLE"
NODES = f""",
node AS MATERIALIZED (SELECT nid, CAST(nid % {NX + 1} AS DOUBLE) + {_SHIFT(7)} AS x, CAST(nid // {NX + 1} % {NY + 1} AS DOUBLE) + {_SHIFT(11)} AS y, CAST(nid // {(NX + 1) * (NY + 1)} AS DOUBLE) + {_SHIFT(13)} AS z
         FROM (SELECT DISTINCT unnest([v0, v1, v2, v3]) AS nid FROM tet))"""
POINTS = TETS + NODES + ",\npts AS MATERIALIZED (SELECT t.tid, t.label, " + ", ".join(f"n{k}.{a} AS p{k}{a}" for k in range(4) for a in "xyz") + " FROM tet t " + " ".join(f"JOIN node n{k} ON n{k}.nid = t.v{k}" for k in range(4)) + ")"
_CLOUD_ID = f"CAST(x + {NX} * (y + {NY} * z) AS BIGINT)"
CLOUD = VOXEL + ",\ncloud AS MATERIALIZED (SELECT pid, " + ", ".join(f"CAST({a} AS DOUBLE) + (pid * {k} % 19) / 40.0::DOUBLE AS {a}" for a, k in (("x", 5), ("y", 7), ("z", 11))) + f", label, CAST(pid % 3 AS INT) AS typ, 0.8::DOUBLE + (pid % 5) / 10.0::DOUBLE AS h FROM (SELECT *, {_CLOUD_ID} AS pid FROM voxel))"


def _v(a: str, b: str) -> list[str]:
    return [f"({b}{c} - {a}{c})" for c in "xyz"]


def _cross(u: list[str], v: list[str]) -> list[str]:
    return [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]


def _dot(u: list[str], v: list[str]) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v, strict=True)) + ")"


_V6 = _dot(_v("p0", "p1"), _cross(_v("p0", "p2"), _v("p0", "p3")))
_L2 = " + ".join(_dot(_v(f"p{i}", f"p{j}"), _v(f"p{i}", f"p{j}")) for i in range(4) for j in range(i + 1, 4))
_QUALITY = f"12.0::DOUBLE * pow(3.0::DOUBLE * abs({_V6}) / 6.0::DOUBLE, {2 / 3!r}::DOUBLE) / ({_L2})"


def _dihedral(i: int, j: int) -> str:
    k, m = (n for n in range(4) if n not in (i, j))
    e = _v(f"p{i}", f"p{j}")
    n1, n2 = _cross(e, _v(f"p{i}", f"p{k}")), _cross(e, _v(f"p{i}", f"p{m}"))
    return f"degrees(acos(least(greatest({_dot(n1, n2)} / (sqrt({_dot(n1, n1)}) * sqrt({_dot(n2, n2)})), -1.0), 1.0)))"


_DIHEDRAL = "least(" + ", ".join(_dihedral(i, j) for i in range(4) for j in range(i + 1, 4)) + ")"


# scans, projections and voxel labelling


@query(f"WITH {VOXEL} SELECT * FROM voxel")
def voxel_labels(spark, sf_dir):
    """Majority label of each cell, ties to the lowest."""
    return voxel_volume(spark, sf_dir)


@query(f"WITH {GRAY} SELECT x, y, z, CAST(intensity >= 20 AS INT) + CAST(intensity >= 50 AS INT) + CAST(intensity >= 80 AS INT) AS label FROM gray")
def gray_thresholds(spark, sf_dir):
    return gray_volume(spark, sf_dir).select("x", "y", "z", voxels.threshold_label(F.col("intensity"), [80, 20, 50]).alias("label"))


def _smooth_sql(sigma: float) -> str:
    w = voxels.gaussian_weights(sigma)
    r = len(w) // 2
    parts, source = [], "gray"
    for n, axis in enumerate("xyz"):
        rest = ", ".join(a for a in "xyz" if a != axis)
        terms = []
        for k, weight in enumerate(w):
            off = k - r
            at = "intensity" if off == 0 else f"coalesce(lag(intensity, {-off}) OVER l, first_value(intensity) OVER f)" if off < 0 else f"coalesce(lead(intensity, {off}) OVER l, last_value(intensity) OVER f)"
            terms.append(f"{at} * {weight!r}::DOUBLE")
        parts.append(f"s{n} AS (SELECT x, y, z, {' + '.join(terms)} AS intensity FROM {source} WINDOW l AS (PARTITION BY {rest} ORDER BY {axis}), f AS (PARTITION BY {rest} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")
        source = f"s{n}"
    return f"WITH {GRAY},\n" + ",\n".join(parts) + " SELECT x, y, z, round(intensity, 6) AS intensity FROM s2"


@query(_smooth_sql(0.7))
def gaussian_smooth(spark, sf_dir):
    return voxels.gaussian_smooth(gray_volume(spark, sf_dir), 0.7).select("x", "y", "z", F.round("intensity", 6).alias("intensity"))


@query(f"WITH {PROB} SELECT x, y, z, greatest(0, p1) + greatest(0, p3) AS p1, greatest(0, p2) AS p2 FROM prob")
def merge_channels(spark, sf_dir):
    """Channels 1 and 3 to label 1, channel 2 to label 2."""
    p = voxels.merge_channels(probability_volume(spark, sf_dir), [1, 2, 1])
    return p.select("x", "y", "z", F.col("p")[1].alias("p1"), F.col("p")[2].alias("p2"))


_P0 = "least(greatest(1.0 - (p1 + p2 + p3), 0.0), 1.0)"


def _with_exterior(spark, sf_dir):
    p = voxels.merge_channels(probability_volume(spark, sf_dir), [1, 2, 3])
    return p.withColumn("p", voxels.missing_exterior(F.col("p"), 4))


@query(f"WITH {PROB} SELECT x, y, z, round({_P0}, 12) AS p0 FROM prob")
def missing_exterior(spark, sf_dir):
    return _with_exterior(spark, sf_dir).select("x", "y", "z", F.round(F.col("p")[0], 12).alias("p0"))


_Q = f"round({_P0}, 9) AS q0, round(p1, 9) AS q1, round(p2 + 0.05, 9) AS q2, round(p3 + 0.1, 9) AS q3"


@query(f"WITH {PROB}, q AS (SELECT x, y, z, {_Q} FROM prob) SELECT x, y, z, CASE WHEN q0 >= q1 AND q0 >= q2 AND q0 >= q3 THEN 0 WHEN q1 >= q2 AND q1 >= q3 THEN 1 WHEN q2 >= q3 THEN 2 ELSE 3 END AS label FROM q")
def argmax_label(spark, sf_dir):
    """Thresholds 0.45 and 0.4 for labels 2 and 3, then the greatest, ties to the lowest label."""
    p = voxels.threshold_bias(F.col("p"), 4, {2: 0.45, 3: 0.4})
    biased = _with_exterior(spark, sf_dir).withColumn("p", F.transform(p, lambda v: F.round(v, 9)))
    return biased.select("x", "y", "z", voxels.argmax_label(F.col("p")).alias("label"))


@query(f"WITH {PROB} SELECT x, y, z, round(p1 + CASE WHEN {_P0} + p2 + p3 > 1e-6 THEN 0.2 * p2 / ({_P0} + p2 + p3) ELSE 0 END, 9) AS p1 FROM prob")
def pair_threshold(spark, sf_dir):
    p = voxels.pair_bias(F.col("p"), 4, 1, 2, 0.3)
    return _with_exterior(spark, sf_dir).select("x", "y", "z", F.round(p[1], 9).alias("p1"))


@query(f"WITH {PROB} SELECT * FROM (SELECT unnest([0, 1, 2, 3]) AS label, round(unnest([sum({_P0}), sum(p1), sum(p2), sum(p3)]) * 0.125, 6) AS volume FROM prob)")
def soft_volumes(spark, sf_dir):
    return voxels.soft_volumes(_with_exterior(spark, sf_dir), 4, 0.125).select("label", F.round("volume", 6).alias("volume"))


@query(f"WITH {DENSE}, near AS (SELECT d.x, d.y, d.z, min(abs(d.x - e.x) + abs(d.y - e.y) + abs(d.z - e.z)) AS depth FROM dense d JOIN dense e ON e.label = 0 AND abs(d.x - e.x) + abs(d.y - e.y) + abs(d.z - e.z) <= 3 AND e.x BETWEEN d.x - 3 AND d.x + 3 GROUP BY d.x, d.y, d.z) SELECT d.x, d.y, d.z, d.label, n.depth FROM dense d LEFT JOIN near n USING (x, y, z)")
def deep_exterior(spark, sf_dir):
    """6-connected steps to the nearest voxel of label 0, up to 3."""
    return voxels.exterior_depth(dense_volume(spark, sf_dir), 3)


@query(f"WITH RECURSIVE {DENSE}, zero AS (SELECT * FROM dense WHERE label = 0), r(x, y, z) AS (SELECT x, y, z FROM zero WHERE x IN (0, {NX - 1}) OR y IN (0, {NY - 1}) OR z IN (0, {NZ - 1}) UNION SELECT n.x, n.y, n.z FROM r JOIN zero n ON abs(n.x - r.x) + abs(n.y - r.y) + abs(n.z - r.z) = 1) SELECT z.x, z.y, z.z FROM zero z ANTI JOIN r USING (x, y, z)")
def enclosed_voxels(spark, sf_dir):
    """Voxels of label 0 that no border voxel reaches."""
    d = dense_volume(spark, sf_dir)
    zero = d.where("label = 0")
    border = zero.where((F.col("x").isin(0, NX - 1)) | (F.col("y").isin(0, NY - 1)) | (F.col("z").isin(0, NZ - 1)))
    return zero.join(voxels.flood(zero, border), ["x", "y", "z"], "left_anti").select("x", "y", "z")


@query(f"WITH {DENSE} SELECT d.x, d.y, d.z, CASE WHEN d.label = 1 AND EXISTS (SELECT 1 FROM dense e WHERE e.label = 3 AND (d.x - e.x) * (d.x - e.x) + (d.y - e.y) * (d.y - e.y) + (d.z - e.z) * (d.z - e.z) < 2.25) THEN 2 ELSE d.label END AS label FROM dense d")
def minimum_gap(spark, sf_dir):
    """Voxels of label 1 nearer than 1.5 voxels to label 3 become 2."""
    return voxels.minimum_gap(dense_volume(spark, sf_dir), 1, 2, 3, 0.5).select("x", "y", "z", "label")


def _bricks(axis: str) -> str:
    return f"unnest(range(CAST(floor(({axis} - 1) / 8.0) AS INT), CAST(floor(({axis} + 1) / 8.0) AS INT) + 1))"


@query(f'WITH {VOXEL}, a AS (SELECT label, y, z, CAST({_bricks("x")} AS INT) AS bx FROM voxel), b AS (SELECT label, z, bx, CAST({_bricks("y")} AS INT) AS "by" FROM a), c AS (SELECT label, bx, "by", CAST({_bricks("z")} AS INT) AS bz FROM b) SELECT bx, "by", bz, list_sort(list(DISTINCT label)) AS labels FROM c GROUP BY bx, "by", bz')
def brick_labels(spark, sf_dir):
    """Labels met in each brick of 8 voxels an edge, dilated by one."""
    return voxels.brick_labels(voxel_volume(spark, sf_dir), 1).select("bx", "by", "bz", "labels")


@query(f"WITH {VOXEL}, s AS (SELECT x, y, z, label, CASE label WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 END AS own FROM voxel) SELECT a.x, a.y, a.z, a.label AS la, b.label AS lb, CAST(coalesce(CASE WHEN a.label + b.label = 4 AND a.label <> b.label THEN 0.75 END, least(a.own, b.own), 3.0) AS DOUBLE) AS h FROM s a JOIN s b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z WHERE a.label <> b.label")
def interface_sizes(spark, sf_dir):
    """Size at each label change along x: pair 1:3 has its own, label 3 none."""
    own = F.when(F.col("label") == 1, 2.0).when(F.col("label") == 2, 1.5)
    v = voxel_volume(spark, sf_dir).withColumn("own", own)
    a = v.select("x", "y", "z", F.col("label").alias("la"), F.col("own").alias("oa"))
    b = v.select((F.col("x") - 1).alias("x"), "y", "z", F.col("label").alias("lb"), F.col("own").alias("ob"))
    pair = F.when((F.col("la") + F.col("lb") == 4), F.lit(0.75))
    h = voxels.interface_size(F.col("la"), F.col("lb"), pair, F.col("oa"), F.col("ob"), 3.0)
    return a.join(b, ["x", "y", "z"]).where("la <> lb").select("x", "y", "z", "la", "lb", h.alias("h"))


@query(
    f"""WITH {DENSE}, s AS MATERIALIZED (SELECT x, y, z, CAST(CASE label WHEN 0 THEN 9 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 6 END AS DOUBLE) AS h FROM dense),
far AS (SELECT a.x, a.y, a.z, b.h, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy, abs(a.z - b.z) AS dz FROM s a JOIN s b ON b.h < a.h WHERE abs(a.x - b.x) * 0.3 < a.h - b.h),
sorted AS (SELECT x, y, z, h, greatest(dx, dy, dz) AS q3, least(dx, dy, dz) AS q1, dx + dy + dz - greatest(dx, dy, dz) - least(dx, dy, dz) AS q2 FROM far),
low AS (SELECT x, y, z, min(h + CAST(0.3 AS DOUBLE) * ((q3 - q2) * 1.0 + (q2 - q1) * sqrt(2.0) + q1 * sqrt(3.0))) AS m FROM sorted GROUP BY x, y, z)
SELECT s.x, s.y, s.z, round(least(s.h, coalesce(low.m, s.h)), 6) AS h FROM s LEFT JOIN low USING (x, y, z)"""
)
def gradient_limit(spark, sf_dir):
    """Sizes by label, limited to grow by 0.3 a voxel; the SQL takes the closed form of the fixpoint on a full grid."""
    h = F.when(F.col("label") == 0, 9.0).when(F.col("label") == 1, 1.0).when(F.col("label") == 2, 4.0).otherwise(6.0)
    s = dense_volume(spark, sf_dir).withColumn("h", h)
    return voxels.gradient_limit(s, 0.3).select("x", "y", "z", F.round("h", 6).alias("h"))


@query(f"WITH {GRAY}, h AS (SELECT CAST(floor(intensity) AS INT) AS bin, count(*) AS n FROM gray GROUP BY 1), w AS (SELECT bin, sum(n) OVER o AS w0, sum(n * bin) OVER o AS s0, sum(n) OVER () AS n, sum(n * bin) OVER () AS s FROM h WINDOW o AS (ORDER BY bin)) SELECT arg_max(bin, CAST((s0 * n - s * w0) AS DOUBLE) ** 2 / CAST(w0 * (n - w0) AS DOUBLE)) AS threshold FROM w WHERE w0 < n")
def otsu_threshold(spark, sf_dir):
    return voxels.otsu(gray_volume(spark, sf_dir).groupBy(F.floor("intensity").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {CLOUD}, {GRID.strip()}, g AS (SELECT g.x, g.y, g.z, coalesce(v.i, 0.0::DOUBLE) AS intensity FROM grid g LEFT JOIN (SELECT x, y, z, CAST(sum(l_orderkey) % 1000 AS DOUBLE) / 10.0 AS i FROM li GROUP BY x, y, z) v USING (x, y, z)), c AS (SELECT pid, CAST(floor(x) AS INT) + i AS x, CAST(floor(y) AS INT) + j AS y, CAST(floor(z) AS INT) + k AS z, (CASE i WHEN 1 THEN x - floor(x) ELSE 1.0 - (x - floor(x)) END) * (CASE j WHEN 1 THEN y - floor(y) ELSE 1.0 - (y - floor(y)) END) * (CASE k WHEN 1 THEN z - floor(z) ELSE 1.0 - (z - floor(z)) END) AS w FROM cloud, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j), (VALUES (0), (1)) d(k)) SELECT pid, round(sum(intensity * w) + 1e-9, 6) AS intensity FROM c JOIN g USING (x, y, z) GROUP BY pid")
def trilinear_samples(spark, sf_dir):
    p = cloud(spark, sf_dir).select("pid", *[F.col(a).alias(f"p{a}") for a in "xyz"])
    return voxels.sample_trilinear(p, gray_volume(spark, sf_dir), "intensity").select("pid", F.round(F.col("intensity") + 1e-9, 6).alias("intensity"))


# faces, checks and quality


@query(f"WITH {SIDES} SELECT * FROM face")
def face_extraction(spark, sf_dir):
    return mesh.extract_faces(tet_mesh(spark, sf_dir))


_STEPS = (("x", 1, 0, 0), ("y", 0, 1, 0), ("z", 0, 0, 1))


@query(f"WITH {VOXEL}, pair AS (" + " UNION ALL ".join(f"SELECT coalesce(a.label, 0) AS la, coalesce(b.label, 0) AS lb FROM voxel a FULL JOIN voxel b ON b.x = a.x + {i} AND b.y = a.y + {j} AND b.z = a.z + {k}" for _, i, j, k in _STEPS) + ') SELECT greatest(la, lb) AS "inner", least(la, lb) AS "outer", count(*) AS n FROM pair WHERE la <> lb GROUP BY 1, 2')
def interface_faces(spark, sf_dir):
    return mesh.voxel_faces(voxel_volume(spark, sf_dir))


@query(f"WITH {POINTS} SELECT label, count(*) AS n_tets, round(sum(abs({_V6}) / 6.0), 6) AS volume, round(max(abs({_V6}) / 6.0), 9) AS largest FROM pts GROUP BY label")
def label_volumes(spark, sf_dir):
    v = mesh.label_volumes(tet_mesh(spark, sf_dir), nodes(spark, sf_dir))
    return v.select("label", "n_tets", F.round("volume", 6).alias("volume"), F.round("largest", 9).alias("largest"))


@query(f"WITH {POINTS} SELECT tid, label, round({_QUALITY}, 6) AS quality, round({_DIHEDRAL}, 6) AS dihedral FROM pts")
def tet_quality(spark, sf_dir):
    q = mesh.quality_rows(tet_mesh(spark, sf_dir), nodes(spark, sf_dir))
    return q.select("tid", "label", F.round("quality", 6).alias("quality"), F.round("dihedral", 6).alias("dihedral"))


@query(f"WITH {POINTS}, q AS (SELECT round({_QUALITY}, 6) AS q FROM pts), s AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS rn, count(*) OVER () AS n FROM q) SELECT min(q) FILTER (rn = 0) AS least, min(q) FILTER (rn = n // 20) AS p5, min(q) FILTER (rn = n // 2) AS median FROM s")
def quality_percentiles(spark, sf_dir):
    """Elements 0, n/20 and n/2 of the sorted qualities, without interpolation."""
    return mesh.positional(tet_quality(spark, sf_dir), "quality", {"least": 0, "p5": 20, "median": 2})


@query(f"WITH {POINTS} SELECT label, count(*) FILTER (round({_DIHEDRAL}, 6) < 30) AS n_below_30, count(*) FILTER (round({_DIHEDRAL}, 6) < 10) AS n_below_10 FROM pts GROUP BY label")
def slivers(spark, sf_dir):
    q = tet_quality(spark, sf_dir)
    return q.groupBy("label").agg(F.count(F.when(F.col("dihedral") < 30, 1)).alias("n_below_30"), F.count(F.when(F.col("dihedral") < 10, 1)).alias("n_below_10"))


@query(f"WITH {POINTS} SELECT least(count(*) FILTER ({_V6} > 0), count(*) FILTER ({_V6} < 0)) AS n_inverted, count(*) FILTER (abs({_V6}) <= 0.0) AS n_flat FROM pts")
def orientation_counts(spark, sf_dir):
    return mesh.orientation_counts(mesh.quality_rows(tet_mesh(spark, sf_dir), nodes(spark, sf_dir)))


_TET_EDGES = " UNION ".join(f"SELECT least(v{i}, v{j}) AS a, greatest(v{i}, v{j}) AS b FROM tet" for i in range(4) for j in range(i + 1, 4))


@query(f"WITH {TETS} {_TET_EDGES}")
def unique_edges(spark, sf_dir):
    return mesh.unique_edges(tet_mesh(spark, sf_dir))


def _edges(columns: str, source: str = "face") -> str:
    return " UNION ALL ".join(f"SELECT {columns}, least(v{i}, v{j}) AS a, greatest(v{i}, v{j}) AS b FROM {source}" for i, j in ((0, 1), (1, 2), (2, 0)))


_IO = '"inner", "outer"'


@query(f"""WITH {SIDES}, reg AS (SELECT *, unnest(list_filter([-1, "inner", "outer"], lambda r: r <> 0)) AS region FROM face), e AS ({_edges("region", "reg")}), u AS (SELECT region, a, b, count(*) AS n FROM e GROUP BY region, a, b) SELECT region, count(*) AS n_edges, count(*) FILTER (CASE WHEN region = -1 THEN n = 1 ELSE n % 2 = 1 END) AS n_open, count(*) FILTER (n > 2) AS n_junction FROM u GROUP BY region""")
def edge_incidence(spark, sf_dir):
    return mesh.edge_incidence(face_extraction(spark, sf_dir))


@query(f"WITH {SIDES}, e AS ({_edges(_IO)}) SELECT a, b, {_IO}, count(*) AS n FROM e GROUP BY a, b, {_IO} HAVING count(*) > 2")
def pinched_edges(spark, sf_dir):
    return mesh.pinched_edges(face_extraction(spark, sf_dir))


_SETS = SIDES + """,
member AS (SELECT unnest([v0, v1, v2, v3]) AS nid, label FROM tet UNION ALL SELECT unnest([v0, v1, v2]) AS nid, 0 FROM face WHERE "outer" = 0),
sets AS (SELECT nid, list_sort(list(DISTINCT label)) AS labels, min(label) FILTER (label <> 0) AS label, least(count(DISTINCT label) - 1, 3) AS typ FROM member GROUP BY nid)"""


@query(f"WITH {_SETS} SELECT * FROM sets")
def node_label_sets(spark, sf_dir):
    return mesh.node_label_sets(tet_mesh(spark, sf_dir), face_extraction(spark, sf_dir))


@query(f"WITH {_SETS}, votes AS (SELECT t.tid, s.label, count(*) AS n FROM (SELECT tid, unnest([v0, v1, v2, v3]) AS nid FROM tet) t JOIN sets s USING (nid) GROUP BY t.tid, s.label) SELECT tid, arg_max(label, n * 10 - label) AS label FROM votes GROUP BY tid")
def majority_label(spark, sf_dir):
    return mesh.majority_label(tet_mesh(spark, sf_dir), node_label_sets(spark, sf_dir))


@query(f"WITH {_SETS}, c AS (SELECT t.tid, l, count(*) AS n FROM (SELECT tid, unnest([v0, v1, v2, v3]) AS nid FROM tet) t JOIN (SELECT nid, unnest(labels) AS l FROM sets) s USING (nid) WHERE l <> 0 GROUP BY t.tid, l HAVING count(*) = 4) SELECT t.tid, coalesce(g.common, []) AS common, len(coalesce(g.common, [])) AS n_common FROM tet t LEFT JOIN (SELECT tid, list_sort(list(l)) AS common FROM c GROUP BY tid) g USING (tid)")
def tet_labelling(spark, sf_dir):
    """Labels that all four corners of a tetrahedron share."""
    return mesh.tet_label_conflicts(tet_mesh(spark, sf_dir), node_label_sets(spark, sf_dir))


_F3 = [f"q{k}." for k in range(3)]
_AREA = f"0.5 * sqrt({_dot(_cross(_v('q0.', 'q1.'), _v('q0.', 'q2.')), _cross(_v('q0.', 'q1.'), _v('q0.', 'q2.')))})"
_ENC = f"{_dot(['q0.x', 'q0.y', 'q0.z'], _cross(['q1.x', 'q1.y', 'q1.z'], ['q2.x', 'q2.y', 'q2.z']))} / 6.0"


@query(f"WITH {SIDES}{NODES} SELECT {_IO}, count(*) AS n, round(sum({_AREA}), 5) AS area, round(sum({_ENC}), 4) AS enclosed FROM face f JOIN node q0 ON q0.nid = f.v0 JOIN node q1 ON q1.nid = f.v1 JOIN node q2 ON q2.nid = f.v2 GROUP BY {_IO}")
def interface_areas(spark, sf_dir):
    a = mesh.interface_areas(face_extraction(spark, sf_dir), nodes(spark, sf_dir))
    return a.select("inner", "outer", "n", F.round("area", 5).alias("area"), F.round("enclosed", 4).alias("enclosed"))


@query()
def same_label_components(spark, sf_dir):
    return mesh.same_label_components(tet_mesh(spark, sf_dir))


@query(f"WITH {TETS}{NODES}, r AS (SELECT nid AS old, row_number() OVER (ORDER BY nid) - 1 AS nid FROM node) SELECT t.tid, t.label, " + ", ".join(f"r{k}.nid AS v{k}" for k in range(4)) + " FROM tet t " + " ".join(f"JOIN r r{k} ON r{k}.old = t.v{k}" for k in range(4)))
def compact_nodes(spark, sf_dir):
    return mesh.compact_nodes(nodes(spark, sf_dir), tet_mesh(spark, sf_dir))[1].select("tid", "label", *mesh.CORNERS)


@query(f"WITH {TETS}, s AS (SELECT tid, label, list_sort([v0, v1, v2, v3]) AS s, (" + " + ".join(f"CAST(v{i} > v{j} AS INT)" for i in range(4) for j in range(i + 1, 4)) + ") % 2 AS odd FROM tet) SELECT tid, s[1] AS v0, s[2] AS v1, CASE odd WHEN 1 THEN s[4] ELSE s[3] END AS v2, CASE odd WHEN 1 THEN s[3] ELSE s[4] END AS v3, label FROM s")
def canonical_tets(spark, sf_dir):
    return mesh.canonical_tets(tet_mesh(spark, sf_dir))


@query(f"WITH {VOXEL} SELECT x, y, z, CAST(" + " + ".join(f"(((CAST({a} AS BIGINT) >> {k}) & 1) << {3 * k + n})" for k in range(6) for n, a in enumerate("xyz")) + " AS BIGINT) AS code FROM voxel")
def morton_codes(spark, sf_dir):
    return voxel_volume(spark, sf_dir).select("x", "y", "z", geo.morton(F.col("x"), F.col("y"), F.col("z"), 6).alias("code"))


@query(f"WITH {VOXEL} SELECT x, y, z, row_number() OVER (ORDER BY label, z, y, x) - 1 AS rn FROM voxel")
def renumbering(spark, sf_dir):
    v = ordering.global_row_number(voxel_volume(spark, sf_dir), [F.col(c) for c in ("label", "z", "y", "x")])
    return v.select("x", "y", "z", "rn")


# neighbours, points and fields

_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_BARS = CLOUD + f""",
near AS (SELECT a.pid AS i, b.pid AS j, {_DIST} AS dist, a.h AS ha, b.h AS hb FROM cloud a JOIN cloud b ON a.pid <> b.pid AND b.x BETWEEN a.x - 2 AND a.x + 2
         WHERE {_DIST} < 1.3 * (a.h + b.h) / 2 AND NOT (a.typ = 0 AND b.typ = 0 AND a.label <> b.label)),
bars AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(dist, 9), j) AS rn FROM near) WHERE rn <= 24)"""


@query(f"WITH {_BARS} SELECT i, j, round(dist, 9) AS dist, rn FROM bars WHERE rn <= 8")
def nearest_truss(spark, sf_dir):
    """Up to 8 nearest neighbours within the reach of both sizes."""
    ranked = spatial.truss(cloud(spark, sf_dir), 1.3, 8).withColumn("dist", F.round("dist", 9))
    return ranked.select("i", "j", "dist", "rn")


@query(f"WITH {_BARS} SELECT i, " + ", ".join(f"round(sum(greatest(1.2 * (ha + hb) / 2 - dist, 0.0) * (a.{c} - b.{c}) / dist), 6) AS f{c}" for c in "xyz") + " FROM bars JOIN cloud a ON a.pid = i JOIN cloud b ON b.pid = j WHERE dist > 0 GROUP BY i")
def spring_forces(spark, sf_dir):
    p = cloud(spark, sf_dir)
    f = spatial.spring_forces(spatial.truss(p, 1.3), p)
    return f.select("i", *[F.round(f"f{c}", 6).alias(f"f{c}") for c in "xyz"])


@query(f"WITH RECURSIVE {CLOUD}, e AS (SELECT a.pid AS i, b.pid AS j FROM cloud a JOIN cloud b ON b.x BETWEEN a.x - 1 AND a.x + 1 WHERE {_DIST} < 0.6), r(pid, root) AS (SELECT i, i FROM e UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.pid) SELECT pid, min(root) AS kept FROM r GROUP BY pid")
def weld_points(spark, sf_dir):
    return spatial.weld(cloud(spark, sf_dir), 0.6)


@query()
def thin_seeds(spark, sf_dir):
    """Greedy thinning: interface points first, then the finest."""
    return spatial.thin(cloud(spark, sf_dir).withColumn("first", -F.col("typ")), 1.1, ["first", "h"]).select("pid", "typ", "h")


@query(f"WITH RECURSIVE {VOXEL}, e AS (SELECT a.x + 100 * a.y + 10000 * a.z AS i, b.x + 100 * b.y + 10000 * b.z AS j FROM voxel a JOIN voxel b ON a.label = b.label AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1), r(i, root) AS (SELECT i, i FROM e UNION SELECT e.j, r.root FROM r JOIN e USING (i)) SELECT i AS node, min(root) AS component FROM r GROUP BY i")
def region_components(spark, sf_dir):
    """Voxels of one label joined over 6 neighbours."""
    v = voxel_volume(spark, sf_dir)
    num = (F.col("x") + 100 * F.col("y") + 10000 * F.col("z")).alias("i")
    near = voxels.dilate(v, voxels.SIX[::2], ("label",)).select(F.col("x"), F.col("y"), F.col("z"), "label")
    own = v.select("x", "y", "z", "label", num)
    moved = voxels.dilate(own, voxels.SIX[::2], ("label", "i")).withColumnRenamed("i", "j").drop("d2")
    edges = own.join(moved, ["x", "y", "z", "label"]).select("i", "j")
    return connected_components(edges, "i", "j")


def _scene(p):
    return [(1, sdf.sphere(p, (10, 5, 4), 5.5)), (2, sdf.box(p, (14, 5, 4), (5, 3, 2))), (3, sdf.subtract(sdf.torus(p, (20, 5, 4), 4, 2), sdf.half_space(p, (0, 0, 1), 3)))]


_S1 = "(5.5 - sqrt(((x - 10) * (x - 10) + (y - 5) * (y - 5)) + (z - 4) * (z - 4)))"
_QX, _QY, _QZ = "(abs(x - 14) - 5)", "(abs(y - 5) - 3)", "(abs(z - 4) - 2)"
_S2 = f"(0.0 - (sqrt(greatest({_QX}, 0.0) ** 2 + greatest({_QY}, 0.0) ** 2 + greatest({_QZ}, 0.0) ** 2) + least(greatest({_QX}, {_QY}, {_QZ}), 0.0)))"
_S3 = "least(2.0 - sqrt((sqrt((x - 20) ** 2 + (y - 5) ** 2) - 4) ** 2 + (z - 4) ** 2), -(3.0 - z))"
_SDF = f"WITH {GRID}, s AS (SELECT x, y, z, round({_S1}, 6) AS s1, round({_S2}, 6) AS s2, round({_S3}, 6) AS s3 FROM grid)"


def _fields(spark):
    p = tuple(F.col(a).cast("double") for a in "xyz")
    return grid(spark, NX, NY, NZ).select("x", "y", "z", *[F.round(s, 6).alias(f"s{t}") for t, s in _scene(p)])


@query(f"{_SDF} SELECT x, y, z, s1, s2, s3 FROM s")
def signed_distances(spark, sf_dir):
    """Sphere, box and a torus less a half-space at every voxel centre."""
    return _fields(spark)


_IN = "CASE WHEN s{0} > 0 THEN {0} END"
_RULES = {
    "overwrite": "coalesce(" + ", ".join(_IN.format(k) for k in (3, 2, 1)) + ", 0)",
    "max": "coalesce(" + ", ".join(_IN.format(k) for k in (3, 2, 1)) + ", 0)",
    "min": "coalesce(" + ", ".join(_IN.format(k) for k in (1, 2, 3)) + ", 0)",
    "order": "coalesce(" + ", ".join(_IN.format(k) for k in (2, 1, 3)) + ", 0)",
    "union": "CASE WHEN s1 > 0 OR s2 > 0 OR s3 > 0 THEN 1 ELSE 0 END",
    "split": "CASE WHEN greatest(s1, s2, s3) <= 0 THEN 0 WHEN s1 >= s2 AND s1 >= s3 THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END",
    "cells": "CAST(s1 > 0 AS INT) + 2 * CAST(s2 > 0 AS INT) + 4 * CAST(s3 > 0 AS INT)",
}


@query(_SDF + " SELECT x, y, z, " + ", ".join(f"{sql} AS r_{rule}" for rule, sql in _RULES.items()) + " FROM s")
def overlap_rules(spark, sf_dir):
    f = _fields(spark)
    fields = [(k, F.col(f"s{k}")) for k in (1, 2, 3)]
    return f.select("x", "y", "z", *[sdf.overlap_tag(fields, rule, [2] if rule == "order" else None).alias(f"r_{rule}") for rule in _RULES])


@query(_SDF + " SELECT x, y, z, round(least(greatest(0.5 + s1 / 1.5, 0.0), 1.0), 9) AS f1, round(greatest(0.5 + greatest(-s1, -s2) * -1 / 1.5, 0.0), 9) AS f2 FROM s")
def soft_fields(spark, sf_dir):
    soft = lambda s: sdf.soft_field(s, 1.5)
    both = sdf.intersection(F.col("s1"), F.col("s2"))
    return _fields(spark).select("x", "y", "z", F.round(soft(F.col("s1")), 9).alias("f1"), F.round(F.greatest(F.lit(0.5) + both / 1.5, F.lit(0.0)), 9).alias("f2"))


@query(f"WITH {GRAY} SELECT x, y, z, round(least(greatest(0.5 + least((intensity - 20.0) / 8.0, (50.0 - intensity) / 8.0), 0.0), 1.0), 9) AS m FROM gray")
def gray_membership(spark, sf_dir):
    m = sdf.gray_membership(F.col("intensity"), 20, 50, 8)
    return gray_volume(spark, sf_dir).select("x", "y", "z", F.round(m, 9).alias("m"))


_W = f"ln(1.0 - t * t)"
_T = f"({2 / (math.pi * 0.147)!r}::DOUBLE + {_W} / 2.0)"


_ERF = f"(2.0 / sqrt(pi()) * e * list_reduce({[c for c in reversed(geo.ERF_SERIES)]!r}::DOUBLE[], lambda acc, c: acc * e * e + c))"
_NEWTON = ", ".join(f"n{k} AS (SELECT * EXCLUDE (e), e - ({_ERF} - t) * sqrt(pi()) / 2.0 * exp(e * e) AS e FROM n{k - 1})" for k in range(1, 4))


@query(f"WITH {GRAY}, n0 AS (SELECT x, y, z, intensity / 100.0 AS t, 0.5 + intensity / 10.0 AS h, sqrt(sqrt({_T} * {_T} - {_W} / 0.147) - {_T}) AS e FROM (SELECT *, intensity / 100.0 AS t FROM gray)), {_NEWTON} SELECT x, y, z, round(CASE WHEN t < 0.9999 THEN {2 * math.sqrt(2) * 0.35!r}::DOUBLE * e END, 6) AS thickness, CAST(least(greatest(floor(ln(h / 0.5) / {math.log(40) / 255!r}::DOUBLE + 0.5), 0), 255) AS INT) AS grade FROM n3")
def thickness_and_grades(spark, sf_dir):
    g = gray_volume(spark, sf_dir)
    return g.select("x", "y", "z", F.round(geo.layer_thickness(F.col("intensity") / 100.0, 0.35), 6).alias("thickness"), geo.grade(0.5 + F.col("intensity") / 10.0, 0.5, 20.0).alias("grade"))


@query(f"WITH {VOXEL} SELECT x, y, z, round(0.5::DOUBLE * (x + 0.5 * (y % 2) + 0.5 * (z % 2)), 9) AS px, round({0.5 * math.sqrt(3) / 2!r}::DOUBLE * (y + {1 / 3!r}::DOUBLE * (z % 2)), 9) AS py, round({0.5 * math.sqrt(6) / 3!r}::DOUBLE * z, 9) AS pz FROM voxel")
def hcp_lattice(spark, sf_dir):
    p = geo.hcp_point(F.col("x"), F.col("y"), F.col("z"), 0.5)
    return voxel_volume(spark, sf_dir).select("x", "y", "z", *[F.round(c, 9).alias(n) for c, n in zip(p, ("px", "py", "pz"), strict=True)])


@query(f"WITH {DENSE}, c AS (SELECT a.x, a.y, a.z, b.label FROM dense a JOIN dense b ON b.x - a.x IN (0, 1) AND b.y - a.y IN (0, 1) AND b.z - a.z IN (0, 1)) SELECT x, y, z, list_sort(list(DISTINCT label)) AS labels FROM c GROUP BY x, y, z HAVING count(DISTINCT label) >= 3 AND count(*) = 8")
def junction_vertices(spark, sf_dir):
    """Grid vertices between eight voxels with three labels or more."""
    corners = [(-i, -j, -k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    at = voxels.dilate(dense_volume(spark, sf_dir), corners, ("label",)).groupBy("x", "y", "z").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.count(F.lit(1)).alias("n"))
    return at.where((F.size("labels") >= 3) & (F.col("n") == 8)).select("x", "y", "z", "labels")


@query("SELECT i AS vid, CAST(i % 16 AS INT) AS x, CAST(i // 16 % 16 AS INT) AS y, CAST(i // 256 AS INT) AS z, CASE WHEN (2.0 * (i % 16 + 0.5) / 16 - 1) ** 2 + (2.0 * (i // 16 % 16 + 0.5) / 16 - 1) ** 2 + (2.0 * (i // 256 + 0.5) / 16 - 1) ** 2 >= 0.49 THEN 0 WHEN i // 256 < 8 THEN 1 WHEN i % 16 < 8 THEN 2 ELSE 3 END AS label FROM range(4096) t(i)")
def phantom_tjunction(spark, sf_dir):
    return phantom(spark, "tjunction", 16)
