"""Neighbour and containment joins over points, by cells and equality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.operators.graph import connected_components
from meshlake.operators.ordering import global_row_number

AXES = ("x", "y", "z")


def near_pairs(points: DataFrame, radius: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, dist, keep columns of i and j with suffixes _i and _j), i < j, dist < radius; points are pid, x, y, z.

    Points are dealt into cells of edge radius. A point offers itself in its own cell and
    looks into the 27 around it, so each pair meets in exactly one.
    """
    cell = [F.floor(F.col(a) / F.lit(radius)).cast("long") for a in AXES]
    own = points.select("pid", *AXES, *keep, *[c.alias(f"c{a}") for c, a in zip(cell, AXES, strict=True)])
    at = own.select(*[f"c{a}" for a in AXES], F.col("pid").alias("j"), *[F.col(a).alias(f"{a}_j") for a in AXES], *[F.col(c).alias(f"{c}_j") for c in keep])
    look = own
    for a in AXES:
        look = look.withColumn(f"c{a}", F.explode(F.array(*[F.col(f"c{a}") + d for d in (-1, 0, 1)])))
    look = look.select(*[f"c{a}" for a in AXES], F.col("pid").alias("i"), *[F.col(a).alias(f"{a}_i") for a in AXES], *[F.col(c).alias(f"{c}_i") for c in keep])
    d = [F.col(f"{a}_i") - F.col(f"{a}_j") for a in AXES]
    dist = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    pairs = look.join(at, [f"c{a}" for a in AXES]).where(F.col("i") < F.col("j")).withColumn("dist", dist).where(F.col("dist") < radius)
    return pairs.select("i", "j", "dist", *[f"{c}_{s}" for c in keep for s in "ij"])


def truss(points: DataFrame, reach: float, most: int = 24) -> DataFrame:
    """(i, j, dist, rn): up to most nearest neighbours of each point, by distance in billionths and then number.

    points are pid, x, y, z, label, typ, h. A pair counts if its distance is below
    reach * (h_i + h_j) / 2; interior points (typ 0) of different labels are not joined.
    """
    top = points.agg(F.max("h")).first()[0]
    if top is None:
        return points.sparkSession.createDataFrame([], "i long, j long, dist double, rn int")
    pairs = near_pairs(points, reach * float(top), ("label", "typ", "h"))
    pairs = pairs.where((F.col("dist") < F.lit(reach) * (F.col("h_i") + F.col("h_j")) / 2) & ~((F.col("typ_i") == 0) & (F.col("typ_j") == 0) & (F.col("label_i") != F.col("label_j"))))
    both = pairs.select("i", "j", "dist").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("i").orderBy(F.round("dist", 9), "j"))).where(F.col("rn") <= most)


def spring_forces(bars: DataFrame, points: DataFrame, scale: float = 1.2) -> DataFrame:
    """(i, fx, fy, fz): sums of (l0 - l)+ along the bars of a point, l0 = scale * (h_i + h_j) / 2."""
    p = points.select("pid", *AXES, "h")
    a = p.select(F.col("pid").alias("i"), *[F.col(c).alias(f"{c}_i") for c in (*AXES, "h")])
    b = p.select(F.col("pid").alias("j"), *[F.col(c).alias(f"{c}_j") for c in (*AXES, "h")])
    push = F.greatest(F.lit(scale) * (F.col("h_i") + F.col("h_j")) / 2 - F.col("dist"), F.lit(0.0))
    joined = bars.where("dist > 0").join(a, "i").join(b, "j")
    return joined.groupBy("i").agg(*[F.sum(push * (F.col(f"{c}_i") - F.col(f"{c}_j")) / F.col("dist")).alias(f"f{c}") for c in AXES])


def weld(points: DataFrame, tolerance: float) -> DataFrame:
    """(pid, kept): points within tolerance of each other, chains included, become the one with the least pid."""
    pairs = near_pairs(points, tolerance)
    groups = connected_components(pairs, "i", "j").withColumnsRenamed({"node": "pid", "component": "to"})
    return points.select("pid").join(groups, "pid", "left").select("pid", F.coalesce("to", "pid").alias("kept"))


def thin(points: DataFrame, distance: float, order: list[str]) -> DataFrame:
    """Greedy thinning in the given order: a point stays unless one that stays is nearer than distance.

    Rounds in which every undecided point that comes before all its undecided
    neighbours stays, and drops those; this gives what the sequential pass gives.
    """
    from meshlake.runtime import materialize

    rank = F.struct(*[F.col(c) for c in order], F.col("pid"))
    pairs = near_pairs(points.withColumn("__rank", rank), distance, ("__rank",))
    both = pairs.select("i", "j", F.col("__rank_i").alias("ri"), F.col("__rank_j").alias("rj")).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("__rank_j").alias("ri"), F.col("__rank_i").alias("rj")))
    # only a point's earlier neighbours can drop it
    waits = materialize(both.where("rj < ri").select("i", "j"), "thin")
    dropped = waits.select("i").limit(0)
    while waits.limit(1).count():
        stay = waits.select(F.col("j").alias("pid")).distinct().join(waits.select(F.col("i").alias("pid")), "pid", "left_anti")
        gone = materialize(waits.join(stay.withColumnRenamed("pid", "j"), "j", "left_semi").select("i").distinct(), "thin")
        dropped = dropped.unionByName(gone)
        waits = materialize(waits.join(gone, "i", "left_anti").join(gone.withColumnRenamed("i", "j"), "j", "left_anti"), "thin")
    return points.join(dropped.withColumnRenamed("i", "pid"), "pid", "left_anti")


def winding(points: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """(pid, w): signed crossings of the ray in +x from each point with closed surfaces.

    triangles are fid, a/b/c with suffixes x, y, z. Triangles are dealt over the (y, z)
    cells that their bounds cover. Edges count by the half-open rule, so a ray through
    an edge or corner crosses once.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / F.lit(cell)).cast("long"), F.floor(hi / F.lit(cell)).cast("long")))
    t = triangles
    for a in ("y", "z"):
        own = [F.col(f"{c}{a}") for c in "abc"]
        t = t.withColumn(f"k{a}", cells(F.least(*own), F.greatest(*own)))
    p = points.withColumns({f"k{a}": F.floor(F.col(a) / F.lit(cell)).cast("long") for a in ("y", "z")})
    j = p.join(t, ["ky", "kz"])

    def side(u: str, v: str):
        """Twice the signed area of (u, v, point) in the y-z plane."""
        return (F.col(f"{v}y") - F.col(f"{u}y")) * (F.col("z") - F.col(f"{u}z")) - (F.col(f"{v}z") - F.col(f"{u}z")) * (F.col("y") - F.col(f"{u}y"))

    crosses = F.lit(0)
    for u, v in (("a", "b"), ("b", "c"), ("c", "a")):
        up = (F.col(f"{u}y") <= F.col("y")) & (F.col(f"{v}y") > F.col("y")) & (side(u, v) > 0)
        down = (F.col(f"{v}y") <= F.col("y")) & (F.col(f"{u}y") > F.col("y")) & (side(u, v) < 0)
        crosses = crosses + F.when(up, 1).when(down, -1).otherwise(0)
    e1 = [F.col(f"b{a}") - F.col(f"a{a}") for a in AXES]
    e2 = [F.col(f"c{a}") - F.col(f"a{a}") for a in AXES]
    nx, ny, nz = e1[1] * e2[2] - e1[2] * e2[1], e1[2] * e2[0] - e1[0] * e2[2], e1[0] * e2[1] - e1[1] * e2[0]
    plane = nx * (F.col("x") - F.col("ax")) + ny * (F.col("y") - F.col("ay")) + nz * (F.col("z") - F.col("az"))
    ahead = F.when(nx > 0, plane < 0).when(nx < 0, plane > 0).otherwise(F.lit(False))
    hits = j.where(ahead & (crosses != 0)).groupBy("pid").agg(F.sum(crosses).cast("int").alias("w"))
    return points.select("pid").join(hits, "pid", "left").select("pid", F.coalesce("w", F.lit(0)).alias("w"))


def feature_balls(pins: DataFrame) -> DataFrame:
    """(curve, i, j, x, y, z, r2): centre and squared radius of the diametral ball of each two pins that follow on a curve.

    pins are pid, curve, t, x, y, z; t is the place along the curve, of equal places the least
    pid goes first. Pins are numbered over all curves, so no curve is one task's work.
    """
    own = global_row_number(pins.select("curve", "t", "pid", *AXES), [F.col("curve"), F.col("t"), F.col("pid")])
    after = own.select((F.col("rn") - 1).alias("rn"), F.col("curve").alias("on"), F.col("pid").alias("j"), *[F.col(a).alias(f"{a}_j") for a in AXES])
    met = own.join(after, "rn").where(F.col("curve") == F.col("on"))
    d = [F.col(a) - F.col(f"{a}_j") for a in AXES]
    centre = [(0.5 * (F.col(a) + F.col(f"{a}_j"))).alias(a) for a in AXES]
    return met.select("curve", F.col("pid").alias("i"), "j", *centre, (0.25 * (d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).alias("r2")).where("r2 > 0")


def protect(points: DataFrame, balls: DataFrame, pinned: Column, most: float = 1.6) -> DataFrame:
    """points without those inside a ball (x, y, z, r2, h), pinned ones apart.

    A ball wider than most times the size h at its centre is no crease and removes nothing.
    Balls are dealt by size: one of a level lies in at most eight cells, whose edge is the
    power of two above its diameter, and a point is looked up once for each level in use.
    """
    wide = F.col("r2") <= F.lit(most * most / 4) * F.col("h") * F.col("h")
    sized = balls.where(wide).withColumn("level", F.ceil(F.log2(2.0 * F.sqrt("r2")) + 1e-9).cast("int"))
    # one for each power of two among the diameters
    levels = [r.level for r in sized.select("level").distinct().collect()]
    if not levels:
        return points
    edge = F.pow(F.lit(2.0), F.col("level"))
    dealt = sized.select("level", "r2", *[F.col(a).alias(f"b{a}") for a in AXES])
    for a in AXES:
        low, high = [F.floor((F.col(f"b{a}") + s * F.sqrt("r2")) / edge) for s in (-1, 1)]
        dealt = dealt.withColumn(f"c{a}", F.explode(F.sequence(low, high)))
    free = points.where(~pinned).select("pid", *AXES, F.explode(F.array(*[F.lit(v) for v in levels])).alias("level"))
    free = free.select("pid", *AXES, "level", *[F.floor(F.col(a) / edge).alias(f"c{a}") for a in AXES])
    d = [F.col(a) - F.col(f"b{a}") for a in AXES]
    inside = free.join(dealt, ["level", "cx", "cy", "cz"]).where(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < F.col("r2"))
    return points.join(inside.select("pid").distinct(), "pid", "left_anti")
