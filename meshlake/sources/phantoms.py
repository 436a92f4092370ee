"""Label and gray volumes from closed forms, by spark.range and predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """(vid, x, y, z) of a dense grid, x fastest."""
    vid = spark.range(nx * ny * nz).withColumnRenamed("id", "vid")
    return vid.select("vid", F.pmod("vid", F.lit(nx)).cast("int").alias("x"), F.pmod(F.floor(F.col("vid") / nx), F.lit(ny)).cast("int").alias("y"), F.floor(F.col("vid") / (nx * ny)).cast("int").alias("z"))


def _inside(name: str, x: Column, y: Column, z: Column) -> Column:
    r2 = x * x + y * y + z * z
    r = F.sqrt(r2)
    one = lambda c, v=1: F.when(c, v).otherwise(0)
    if name == "sphere":
        return one(r2 < 0.49)
    if name == "twoballs":
        ball = lambda cx: (x - cx) * (x - cx) + y * y + z * z < 0.45 * 0.45
        return F.when(ball(-0.3) & (x < 0), 1).when(ball(0.3) & (x >= 0), 2).otherwise(0)
    if name == "corrsphere":
        theta, phi = F.acos(F.least(F.greatest(z / F.greatest(r, F.lit(1e-12)), F.lit(-1.0)), F.lit(1.0))), F.atan2(y, x)
        return one(r < 0.6 * (1 + 0.12 * F.sin(6 * theta) * F.sin(6 * phi)))
    if name == "tjunction":
        return F.when(r2 >= 0.49, 0).when(z < 0, 1).when(x < 0, 2).otherwise(3)
    if name == "shells":
        return F.when(r < 0.3, 3).when(r < 0.5, 2).when(r < 0.7, 1).otherwise(0)
    if name == "hollow":
        return one((r < 0.7) & (r >= 0.4))
    if name == "slab":
        return one((F.abs(z) < 0.06) & (F.abs(x) < 0.8) & (F.abs(y) < 0.8))
    if name == "torus":
        ring = F.sqrt(x * x + y * y) - 0.5
        return one(ring * ring + z * z < 0.2 * 0.2)
    if name == "gyroid":
        k = 2 * math.pi
        return F.when(r >= 0.8, 0).when(F.sin(k * x) * F.cos(k * y) + F.sin(k * y) * F.cos(k * z) + F.sin(k * z) * F.cos(k * x) > 0, 1).otherwise(2)
    if name == "disk2d":
        d = F.sqrt(x * x + y * y)
        return F.when(d >= 0.7, 0).when(y > 0.15, 3).when(x > 0, 2).otherwise(1)
    raise ValueError(f"unknown shape {name}")


LABELLED = ("sphere", "twoballs", "corrsphere", "tjunction", "shells", "hollow", "slab", "torus", "gyroid", "disk2d")


def phantom(spark: SparkSession, name: str, n: int) -> DataFrame:
    """(vid, x, y, z, label) of n^3 voxels whose centres fill (-1, 1); disk2d is one slice."""
    g = grid(spark, n, n, 1 if name == "disk2d" else n)
    at = [2.0 * (F.col(a) + 0.5) / n - 1.0 for a in "xyz"]
    return g.withColumn("label", _inside(name, *at).cast("int"))


def gray_phantom(spark: SparkSession, name: str, n: int) -> DataFrame:
    """(vid, x, y, z, intensity): graysphere and gray2d fall off from the centre by distance."""
    top = {"graysphere": 1.0, "gray2d": 0.8}
    if name not in top:
        raise ValueError(f"unknown shape {name}")
    g = grid(spark, n, n, 1 if name == "gray2d" else n)
    at = [2.0 * (F.col(a) + 0.5) / n - 1.0 for a in ("xy" if name == "gray2d" else "xyz")]
    square = at[0] * at[0]
    for x in at[1:]:
        square = square + x * x
    return g.withColumn("intensity", F.lit(top[name]) - F.sqrt(square))
