"""Sizes of elements: by label, by curvature, by interface, and the user's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.operators.voxels import AXES

#: How far a competing label's field may be behind for a voxel to count as near the interface.
BAND = 0.45


def user_sizes(sizes: list[float], channel_labels: list[int]) -> dict[int, float]:
    """The size of each label from one a channel, or one a label but or with the exterior; a shared label takes the least."""
    labels = sorted(set(channel_labels))
    tissues = [x for x in labels if x]
    if len(sizes) == len(channel_labels) != len(labels):
        pairs = zip(channel_labels, sizes, strict=True)
    elif len(sizes) == len(tissues):
        pairs = zip(tissues, sizes, strict=True)
    elif len(sizes) == len(tissues) + 1:
        pairs = zip([0, *tissues], sizes, strict=True)
    else:
        raise ValueError(f"{len(sizes)} sizes for {len(channel_labels)} channels and {len(tissues)} labels")
    out: dict[int, float] = {}
    for label, size in pairs:
        out[label] = min(size, out.get(label, size))
    return out


def neighbourhood(dense: DataFrame, value: str) -> DataFrame:
    """dense (x, y, z, value) with f_ijk, the values of the 27 voxels around each, i, j, k in 0 .. 2; null outside."""
    moves = [(i, j, k) for i in range(3) for j in range(3) for k in range(3)]
    sent = F.explode(F.array(*[F.struct(*[F.lit(1 - m).alias(f"d{a}") for m, a in zip(move, AXES, strict=True)], F.lit("f_%d%d%d" % move).alias("n")) for move in moves]))
    tall = dense.select(*AXES, F.col(value).alias("v"), sent.alias("m")).select(*[(F.col(a) + F.col(f"m.d{a}")).alias(a) for a in AXES], "v", "m.n")
    return tall.groupBy(*AXES).agg(*[F.max(F.when(F.col("n") == "f_%d%d%d" % move, F.col("v"))).alias("f_%d%d%d" % move) for move in moves])


def max_curvature(spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """The greater principal curvature, by size, of the level set through a voxel, over the columns of neighbourhood.

    With the unit normal n and the Hessian H in the tangent plane, the curvatures' sum is
    (tr H - nHn) / |g| and the sum of their squares (tr HH - 2 nHHn + (nHn)^2) / |g|^2.
    """
    at = lambda *m: F.col("f_%d%d%d" % m)
    unit = lambda a, s: tuple(1 + (s if k == a else 0) for k in range(3))
    corner = lambda a, b, s, t: tuple(1 + (s if k == a else t if k == b else 0) for k in range(3))
    g = [(at(*unit(a, 1)) - at(*unit(a, -1))) / (2.0 * spacing[a]) for a in range(3)]

    def second(a: int, b: int) -> Column:
        if a == b:
            return (at(*unit(a, 1)) - 2.0 * at(1, 1, 1) + at(*unit(a, -1))) / (spacing[a] ** 2)
        mixed = at(*corner(a, b, 1, 1)) - at(*corner(a, b, 1, -1)) - at(*corner(a, b, -1, 1)) + at(*corner(a, b, -1, -1))
        return mixed / (4.0 * spacing[a] * spacing[b])

    names = [f"h{a}{b}" for a in range(3) for b in range(a, 3)]
    parts = F.struct(*[x.alias(f"g{a}") for a, x in enumerate(g)], *[second(int(n[1]), int(n[2])).alias(n) for n in names])

    def curvature(p: Column) -> Column:
        h = lambda a, b: p[f"h{min(a, b)}{max(a, b)}"]
        total = lambda parts: reduce(lambda u, v: u + v, parts)
        size = F.sqrt(total(p[f"g{a}"] * p[f"g{a}"] for a in range(3)))
        n = [p[f"g{a}"] / size for a in range(3)]
        hn = [total(h(a, b) * n[b] for b in range(3)) for a in range(3)]
        nhn = total(n[a] * hn[a] for a in range(3))
        both = (total(h(a, a) for a in range(3)) - nhn) / size
        squares = (total(h(a, b) * h(a, b) for a in range(3) for b in range(3)) - 2.0 * total(x * x for x in hn) + nhn * nhn) / (size * size)
        disc = F.greatest(2.0 * squares - both * both, F.lit(0.0))
        return F.when(size < 1e-6, F.lit(0.0)).otherwise(0.5 * (F.abs(both) + F.sqrt(disc)))

    return F.transform(F.array(parts), curvature)[0]


def voxel_size(label: Column, own: Column, best: Column, competitor: Column, label_sizes: dict[int, float], interface: Column, curvature: Column, base: float, least: float, most: float, per_radius: float = 3.0, curved_least: float = 0.0) -> Column:
    """The element size that a voxel asks for.

    The exterior asks for most. Else it is the label's size or base; near an interface (the
    best competing field less than BAND behind) also the competitor's size, the interface's
    own where there is one, and a per_radius-th of the radius of curvature, not below
    curved_least. Clamped to least .. most.
    """
    of = lambda c: F.coalesce(*[F.when(c == k, F.lit(float(v))) for k, v in label_sizes.items() if v > 0], F.lit(None).cast("double"))
    near = own - best < BAND
    curved = F.when(curvature > 0, F.greatest(1.0 / (F.lit(per_radius) * curvature), F.lit(float(curved_least))))
    # least ignores nulls
    h = F.least(F.coalesce(of(label), F.lit(float(base))), F.when(near, of(competitor)), F.when(near & (interface > 0), interface), F.when(near, curved))
    return F.when(label == 0, F.lit(float(most))).otherwise(F.least(F.greatest(h, F.lit(float(least))), F.lit(float(most))))
