"""Signed distances of solids as column expressions: positive inside, combined by greatest and least."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions.geometry import Point, dot
from meshlake.operators.ordering import global_row_number


def _offset(p: Point, c: tuple[float, float, float]) -> Point:
    return tuple(a - F.lit(float(b)) for a, b in zip(p, c, strict=True))  # type: ignore[return-value]


def _length(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [x * x for x in parts]))


def sphere(p: Point, c, r: float) -> Column:
    return F.lit(float(r)) - _length(*_offset(p, c))


def box(p: Point, c, half) -> Column:
    """Exact outside as well: minus the distance to the box."""
    q = [F.abs(x) - F.lit(float(h)) for x, h in zip(_offset(p, c), half, strict=True)]
    outside = _length(*[F.greatest(x, F.lit(0.0)) for x in q])
    inside = F.least(F.greatest(*q), F.lit(0.0))
    return F.lit(0.0) - (outside + inside)


def cylinder(p: Point, c, r: float, half_height: float) -> Column:
    """Capped, along z."""
    x, y, z = _offset(p, c)
    return F.least(F.lit(float(r)) - _length(x, y), F.lit(float(half_height)) - F.abs(z))


def endless_cylinder(p: Point, c, r: float) -> Column:
    x, y, _ = _offset(p, c)
    return F.lit(float(r)) - _length(x, y)


def half_space(p: Point, normal, offset: float) -> Column:
    """Inside where normal . p <= offset."""
    return F.lit(float(offset)) - dot(p, tuple(F.lit(float(n)) for n in normal))


def slab(p: Point, axis: int, low: float, high: float) -> Column:
    return F.least(p[axis] - F.lit(float(low)), F.lit(float(high)) - p[axis])


def torus(p: Point, c, ring: float, tube: float) -> Column:
    x, y, z = _offset(p, c)
    return F.lit(float(tube)) - _length(_length(x, y) - F.lit(float(ring)), z)


def ellipsoid(p: Point, c, radii) -> Column:
    """First-order distance."""
    q = _offset(p, c)
    k0 = _length(*[x / F.lit(float(r)) for x, r in zip(q, radii, strict=True)])
    k1 = _length(*[x / F.lit(float(r) * float(r)) for x, r in zip(q, radii, strict=True)])
    return F.when(k1 > 0, k0 * (1.0 - k0) / k1).otherwise(F.lit(float(min(radii))))


def cone(p: Point, c, bottom: float, top: float, half_height: float) -> Column:
    """A frustum along z, bound by its slanted side and caps."""
    x, y, z = _offset(p, c)
    slope = (float(top) - float(bottom)) / (2.0 * float(half_height))
    side = (F.lit((float(top) + float(bottom)) / 2.0) + F.lit(slope) * z - _length(x, y)) / F.lit((1.0 + slope * slope) ** 0.5)
    return F.least(side, F.lit(float(half_height)) - F.abs(z))


def union(*s: Column) -> Column:
    return F.greatest(*s) if len(s) > 1 else s[0]


def intersection(*s: Column) -> Column:
    return F.least(*s) if len(s) > 1 else s[0]


def subtract(a: Column, b: Column) -> Column:
    return F.least(a, -b)


def soft_field(s: Column, width: float) -> Column:
    return F.least(F.greatest(F.lit(0.5) + s / F.lit(float(width)), F.lit(0.0)), F.lit(1.0))


def gray_membership(x: Column, low: float | None, high: float | None, width: float) -> Column:
    """How far an intensity lies within the levels of a label, softened over width."""
    sides = ([(x - F.lit(float(low))) / F.lit(float(width))] if low is not None else []) + ([(F.lit(float(high)) - x) / F.lit(float(width))] if high is not None else [])
    return F.least(F.greatest(F.lit(0.5) + intersection(*sides), F.lit(0.0)), F.lit(1.0))


def overlap_tag(fields: list[tuple[int, Column]], rule: str, order: list[int] | None = None) -> Column:
    """The tag of a point inside several objects, given (tag, field) in drawing order; 0 outside all.

    overwrite: the last drawn. max, min: the greatest or least tag. order: the first of
    order, then the others as drawn. union: the first object's tag for all. split: the
    greatest field, of equal ones the lowest tag. cells: the number formed by the membership
    bits; overlap_cells ranks those that occur. overlap_nest ranks objects by their size.
    """
    inside = [(tag, s > 0) for tag, s in fields]
    if rule == "cells":
        bits = reduce(lambda a, b: a + b, [F.when(s > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, s) in enumerate(fields)])
        return bits
    if rule == "union":
        return F.when(reduce(lambda a, b: a | b, [x for _, x in inside]), F.lit(fields[0][0])).otherwise(F.lit(0))
    if rule == "split":
        best = F.greatest(*[s for _, s in fields]) if len(fields) > 1 else fields[0][1]
        winner = F.coalesce(*[F.when((s == best) & (s > 0), F.lit(tag)) for tag, s in sorted(fields, key=lambda x: x[0])])
        return F.coalesce(winner, F.lit(0))
    ranked = {
        "overwrite": list(reversed(inside)),
        "max": sorted(inside, key=lambda x: -x[0]),
        "min": sorted(inside, key=lambda x: x[0]),
        "order": [x for t in order or [] for x in inside if x[0] == t] + [x for x in inside if x[0] not in (order or [])],
    }[rule]
    return F.coalesce(*[F.when(x, F.lit(tag)) for tag, x in ranked], F.lit(0))


def overlap_cells(points: DataFrame, fields: list[tuple[int, Column]]) -> DataFrame:
    """points with tag: each combination of objects that occurs is a region.

    Inside one object alone that is its tag; the other combinations follow the greatest tag
    in the order of their membership bits; outside all it is 0. At most 62 objects.
    """
    if len(fields) > 62:
        raise ValueError("cells are told apart by 62 bits")
    bits = reduce(lambda a, b: a + b, [F.when(s > 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, s) in enumerate(fields)])
    alone = F.coalesce(*[F.when(F.col("__bits") == (1 << k), F.lit(tag)) for k, (tag, _) in enumerate(fields)], F.when(F.col("__bits") == 0, F.lit(0)))
    marked = points.withColumn("__bits", bits)
    occurring = marked.select("__bits").distinct().where(alone.isNull())
    # as many rows as combinations occur
    ranked = global_row_number(occurring, [F.col("__bits")], "__rank", max(tag for tag, _ in fields) + 1)
    return marked.join(ranked, "__bits", "left").withColumn("tag", F.coalesce(alone, F.col("__rank")).cast("int")).drop("__bits", "__rank")


def overlap_nest(points: DataFrame, fields: list[tuple[int, Column]]) -> DataFrame:
    """points with tag: of the objects that a point is inside, the one that holds the fewest points; of equal ones the lowest tag."""
    counts = points.agg(*[F.count(F.when(s > 0, 1)).alias(f"n{tag}") for tag, s in fields]).first()
    order = sorted(fields, key=lambda x: (counts[f"n{x[0]}"], x[0]))
    return points.withColumn("tag", F.coalesce(*[F.when(s > 0, F.lit(tag)) for tag, s in order], F.lit(0)).cast("int"))
