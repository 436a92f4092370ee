"""Scalar geometry as column expressions; points are structs or triples of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def point(prefix: str) -> Point:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def sub(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def det3(a: Point, b: Point, c: Point) -> Column:
    return dot(a, cross(b, c))


def tet_volume6(p: list[Point]) -> Column:
    """Six times the signed volume."""
    return det3(sub(p[1], p[0]), sub(p[2], p[0]), sub(p[3], p[0]))


def tet_volume(p: list[Point]) -> Column:
    return F.abs(tet_volume6(p)) / 6.0


def squared_edges(p: list[Point]) -> Column:
    total = None
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            d = sub(p[j], p[i])
            total = dot(d, d) if total is None else total + dot(d, d)
    return total


def joe_liu(p: list[Point]) -> Column:
    """12 (3V)^(2/3) / sum of squared edges: 1 for the regular tetrahedron."""
    return 12.0 * F.pow(3.0 * tet_volume(p), F.lit(2.0 / 3.0)) / squared_edges(p)


def min_dihedral(p: list[Point]) -> Column:
    """The least dihedral angle in degrees."""
    angles = []
    for i in range(4):
        for j in range(i + 1, 4):
            k, m = (n for n in range(4) if n not in (i, j))
            e = sub(p[j], p[i])
            n1, n2 = cross(e, sub(p[k], p[i])), cross(e, sub(p[m], p[i]))
            c = dot(n1, n2) / (norm(n1) * norm(n2))
            angles.append(F.degrees(F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))))
    return F.least(*angles)


def circumradius(p: list[Point]) -> Column:
    """Of a tetrahedron, from the offset of its circumcentre."""
    a, b, c = (sub(x, p[0]) for x in p[1:])
    n = [tuple(s * x for x in v) for s, v in ((dot(a, a), cross(b, c)), (dot(b, b), cross(c, a)), (dot(c, c), cross(a, b)))]
    offset = tuple(n[0][k] + n[1][k] + n[2][k] for k in range(3))
    return norm(offset) / (2.0 * F.abs(det3(a, b, c)))


def shortest_edge(p: list[Point]) -> Column:
    return F.sqrt(F.least(*[dot(sub(p[j], p[i]), sub(p[j], p[i])) for i in range(4) for j in range(i + 1, 4)]))


def radius_edge(p: list[Point]) -> Column:
    return circumradius(p) / shortest_edge(p)


def triangle_area(p: list[Point]) -> Column:
    return 0.5 * norm(cross(sub(p[1], p[0]), sub(p[2], p[0])))


def triangle_quality(p: list[Point]) -> Column:
    """4 sqrt(3) A / sum of squared edges: 1 for the equilateral triangle."""
    return F.lit(4.0 * math.sqrt(3.0)) * triangle_area(p) / squared_edges(p)


def morton(x: Column, y: Column, z: Column, bits: int = 10) -> Column:
    """Interleaved bits of three non-negative integers."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for shift, c in enumerate((x, y, z)):
            bit = F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, 3 * k + shift))
    return out


#: Coefficients of erf(x) sqrt(pi) / (2 x) in powers of x squared: enough for x up to 3.
ERF_SERIES = [(-1) ** n / (math.factorial(n) * (2 * n + 1)) for n in range(48)]


def erf(x: Column) -> Column:
    """The error function by its Maclaurin series, for x from 0 to 3."""
    series = F.aggregate(F.array(*[F.lit(float(c)) for c in reversed(ERF_SERIES)]), F.lit(0.0), lambda acc, c: acc * x * x + c)
    return F.lit(2.0 / math.sqrt(math.pi)) * x * series


def erfinv(y: Column) -> Column:
    """Inverse error function for 0 <= y <= 0.9999: a closed approximation and three Newton steps on the series."""
    a = 0.147
    w = F.log(F.lit(1.0) - y * y)
    t = F.lit(2.0 / (math.pi * a)) + w / 2.0
    start = F.sqrt(F.sqrt(t * t - w / F.lit(a)) - t)
    step = lambda x: x - (erf(x) - y) * F.lit(math.sqrt(math.pi) / 2.0) * F.exp(x * x)
    # each step's value is computed once, however often the next one uses it
    return F.aggregate(F.array(*[F.lit(0)] * 3), start, lambda x, _: step(x))


def layer_thickness(phi: Column, sigma: float) -> Column:
    """2 sqrt(2) sigma erfinv(phi); null stands for unbounded, from 0.9999 on."""
    return F.when(phi < 0.9999, F.lit(2.0 * math.sqrt(2.0) * sigma) * erfinv(phi))


def hcp_point(i: Column, j: Column, k: Column, h: float) -> Point:
    """A point of the lattice of spacing h: rows of odd j and layers of odd k are each shifted by half a spacing."""
    odd_k, odd_j = F.pmod(k, F.lit(2)), F.pmod(j, F.lit(2))
    return (
        F.lit(h) * (i + 0.5 * odd_j + 0.5 * odd_k),
        F.lit(h * math.sqrt(3.0) / 2.0) * (j + F.lit(1.0 / 3.0) * odd_k),
        F.lit(h * math.sqrt(6.0) / 3.0) * k,
    )


def grade(h: Column, least: float, most: float, steps: int = 256) -> Column:
    """The logarithmic step of a size between least and most."""
    span = math.log(most / least) / (steps - 1)
    raw = F.floor(F.log(h / F.lit(least)) / F.lit(span) + 0.5)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(steps - 1)).cast("int")


def grade_size(g: Column, least: float, most: float, steps: int = 256) -> Column:
    return F.lit(least) * F.exp(g * F.lit(math.log(most / least) / (steps - 1)))


def seed_level(grade_: Column, levels: int, grades: int = 256) -> Column:
    """The coarse level of a size grade."""
    return F.lit(0) if levels <= 1 else F.floor(grade_ * (F.lit(float(levels - 1)) / F.lit(float(grades - 1))) + 0.5).cast("int")


def seed_spacing(level: Column, levels: int, least: float, most: float) -> Column:
    """The lattice spacing of a level, geometric from least to most."""
    return F.lit(float(least)) if levels <= 1 else F.lit(float(least)) * F.pow(F.lit(most / least), level / F.lit(float(levels - 1)))


def point_triangle_distance(p: Point, t: list[Point]) -> Column:
    """The distance from a point to a triangle: to its plane where the foot lies inside, else to the nearest side."""

    def to_segment(a: Point, b: Point) -> Column:
        ab, ap = sub(b, a), sub(p, a)
        along = F.least(F.greatest(dot(ap, ab) / F.greatest(dot(ab, ab), F.lit(1e-300)), F.lit(0.0)), F.lit(1.0))
        off = tuple(x - along * y for x, y in zip(ap, ab, strict=True))
        return norm(off)

    n = cross(sub(t[1], t[0]), sub(t[2], t[0]))
    sides = [dot(cross(sub(t[(k + 1) % 3], t[k]), sub(p, t[k])), n) for k in range(3)]
    inside = (dot(n, n) > 0) & (sides[0] >= 0) & (sides[1] >= 0) & (sides[2] >= 0)
    return F.when(inside, F.abs(dot(sub(p, t[0]), n)) / norm(n)).otherwise(F.least(*[to_segment(t[k], t[(k + 1) % 3]) for k in range(3)]))
