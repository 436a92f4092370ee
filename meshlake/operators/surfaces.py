"""Operators over surfaces: crossings, smoothing, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions.geometry import Point, det3, sub

AXES = ("x", "y", "z")


def corners(prefix: str = "") -> list[Point]:
    return [tuple(F.col(f"{prefix}{c}{a}") for a in AXES) for c in "abc"]  # type: ignore[misc]


def orientation(a: Point, b: Point, c: Point, d: Point) -> Column:
    return det3(sub(b, a), sub(c, a), sub(d, a))


def _pierces(p: Point, q: Point, t: list[Point]) -> Column:
    """Whether the open segment p-q crosses the inside of the triangle."""
    sides = orientation(*t, p) * orientation(*t, q) < 0
    turn = [orientation(p, q, t[i], t[(i + 1) % 3]) for i in range(3)]
    return sides & (((turn[0] > 0) & (turn[1] > 0) & (turn[2] > 0)) | ((turn[0] < 0) & (turn[1] < 0) & (turn[2] < 0)))


def triangle_crossings(triangles: DataFrame, cell: float) -> DataFrame:
    """(i, j), i < j: triangles of which an edge of one crosses the inside of the other.

    triangles are fid and ax .. cz. They are dealt over the cells that their bounds cover
    and meet by equality of cells; a pair is kept in the least cell that both cover, so it
    is tested once. Touching at corners or edges is no crossing.
    """
    t = triangles
    low = {a: F.least(*[F.col(f"{c}{a}") for c in "abc"]) for a in AXES}
    high = {a: F.greatest(*[F.col(f"{c}{a}") for c in "abc"]) for a in AXES}
    number = lambda x: F.floor(x / F.lit(float(cell))).cast("long")
    t = t.select("fid", *[f"{c}{a}" for c in "abc" for a in AXES], *[low[a].alias(f"lo{a}") for a in AXES], *[high[a].alias(f"hi{a}") for a in AXES])
    for a in AXES:
        t = t.withColumn(f"k{a}", F.explode(F.sequence(number(F.col(f"lo{a}")), number(F.col(f"hi{a}")))))
    keys = [f"k{a}" for a in AXES]
    left = t.select(*keys, *[F.col(c).alias(f"l_{c}") for c in t.columns if c not in keys])
    right = t.select(*keys, *[F.col(c).alias(f"r_{c}") for c in t.columns if c not in keys])
    pairs = left.join(right, keys).where("l_fid < r_fid")
    for a in AXES:
        overlap = (F.col(f"l_lo{a}") <= F.col(f"r_hi{a}")) & (F.col(f"r_lo{a}") <= F.col(f"l_hi{a}"))
        pairs = pairs.where(overlap & (F.col(f"k{a}") == number(F.greatest(f"l_lo{a}", f"r_lo{a}"))))
    p, q = corners("l_"), corners("r_")
    crosses = F.lit(False)
    for i in range(3):
        crosses = crosses | _pierces(p[i], p[(i + 1) % 3], q) | _pierces(q[i], q[(i + 1) % 3], p)
    return pairs.where(crosses).select(F.col("l_fid").alias("i"), F.col("r_fid").alias("j"))


def _mean_of_neighbours(values: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(values.withColumnRenamed("nid", "b"), "b")
    return near.groupBy("a").agg(*[F.avg(c).alias(f"m_{c}") for c in columns]).withColumnRenamed("a", "nid")


def smooth(nodes: DataFrame, edges: DataFrame, kind: str = "laplacianhc", passes: int = 1, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """nodes (nid, x, y, z) after Jacobi passes over edges (a, b); nodes without edges stay.

    laplacian moves a share alpha towards the neighbours' mean, lowpass does so with alpha
    and then -1.02 alpha, laplacianhc pushes back what the neighbours lost on average.
    """
    if kind not in ("laplacian", "lowpass", "laplacianhc"):
        raise ValueError(f"unknown smoothing {kind}")
    state = nodes.select("nid", *AXES)
    start = nodes.select("nid", *[F.col(a).alias(f"o_{a}") for a in AXES])
    for _ in range(passes):
        if kind != "laplacianhc":
            for share in (alpha,) if kind == "laplacian" else (alpha, -1.02 * alpha):
                near = _mean_of_neighbours(state, edges, list(AXES))
                state = state.join(near, "nid", "left").select("nid", *[(F.col(a) * F.lit(1.0 - share) + F.coalesce(f"m_{a}", a) * F.lit(share)).alias(a) for a in AXES])
            continue
        near = _mean_of_neighbours(state, edges, list(AXES))
        moved = state.join(near, "nid", "left").join(start, "nid")
        lost = {a: F.coalesce(F.col(f"m_{a}"), F.col(a)) - (F.lit(alpha) * F.col(f"o_{a}") + F.lit(1.0 - alpha) * F.col(a)) for a in AXES}
        moved = moved.select("nid", *[F.coalesce(f"m_{a}", a).alias(a) for a in AXES], *[lost[a].alias(f"b_{a}") for a in AXES])
        back = _mean_of_neighbours(moved.select("nid", *[f"b_{a}" for a in AXES]), edges, [f"b_{a}" for a in AXES])
        state = moved.join(back, "nid", "left").select("nid", *[(F.col(a) - (F.lit(beta) * F.col(f"b_{a}") + F.lit(1.0 - beta) * F.coalesce(f"m_b_{a}", f"b_{a}"))).alias(a) for a in AXES])
    return state


def slice_points(tet_points: DataFrame, axis: str, at: float) -> DataFrame:
    """(tid, label, u, v): where the edges of tetrahedra (p0x .. p3z) cross the plane axis = at, u and v the other axes."""
    others = [a for a in AXES if a != axis]
    cuts = []
    for i in range(4):
        for j in range(i + 1, 4):
            zi, zj = F.col(f"p{i}{axis}"), F.col(f"p{j}{axis}")
            t = (F.lit(float(at)) - zi) / (zj - zi)
            inside = (F.least(zi, zj) < at) & (F.greatest(zi, zj) >= at)
            point = F.struct(*[(F.col(f"p{i}{a}") + t * (F.col(f"p{j}{a}") - F.col(f"p{i}{a}"))).alias(n) for n, a in zip("uv", others, strict=True)])
            cuts.append(F.when(inside, point))
    return tet_points.select("tid", "label", F.explode(F.filter(F.array(*cuts), lambda x: x.isNotNull())).alias("p")).select("tid", "label", "p.u", "p.v")
