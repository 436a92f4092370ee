import math
import random

import pytest
from pyspark.sql import functions as F

from meshlake.functions import geometry as geo
from meshlake.functions import sdf
from meshlake.operators import cells, conformity, mesh, sizing, spatial, voxels


def test_erfinv_against_the_library(spark):
    values = [0.0, 1e-6, 0.1, 0.5, 0.9, 0.99, 0.999, 0.9998]
    got = spark.createDataFrame([(v,) for v in values], "y double").select("y", geo.erfinv(F.col("y")).alias("x")).collect()
    assert all(abs(math.erf(r.x) - r.y) < 1e-9 for r in got)


def test_lattice_points_are_a_spacing_apart(spark):
    p = spark.range(4).crossJoin(spark.range(4).toDF("j")).crossJoin(spark.range(4).toDF("k"))
    at = [tuple(r) for r in p.select(*[c.alias(n) for c, n in zip(geo.hcp_point(F.col("id"), F.col("j"), F.col("k"), 1.0), "xyz", strict=True)]).collect()]
    # rows of odd j and layers of odd k are each shifted by half a spacing along x
    assert any(abs(a - 1.0) < 1e-12 and abs(b - math.sqrt(3) / 2 * 4 / 3) < 1e-9 and abs(z - math.sqrt(2 / 3)) < 1e-9 for a, b, z in at)


def test_user_sizes():
    assert sizing.user_sizes([9, 2, 4], [0, 1, 1]) == {0: 9, 1: 2}
    assert sizing.user_sizes([2, 4], [0, 1, 2, 2]) == {1: 2, 2: 4} and sizing.user_sizes([9, 2, 4], [0, 1, 2]) == {0: 9, 1: 2, 2: 4}
    with pytest.raises(ValueError):
        sizing.user_sizes([1.0], [0, 1, 2])


def test_curvature_of_a_sphere_and_a_cylinder(spark):
    n = 9
    grid = spark.range(n**3).select((F.col("id") % n).cast("int").alias("x"), (F.floor(F.col("id") / n) % n).cast("int").alias("y"), F.floor(F.col("id") / n**2).cast("int").alias("z"))
    c = [F.col(a) + 20.0 for a in "xyz"]
    ball, tube = F.sqrt(c[0] ** 2 + c[1] ** 2 + c[2] ** 2), F.sqrt(c[0] ** 2 + c[1] ** 2)
    for field, r in ((ball, math.sqrt(3) * 24), (tube, math.sqrt(2) * 24)):
        near = sizing.neighbourhood(grid.withColumn("v", field), "v").where("x = 4 and y = 4 and z = 4")
        assert abs(near.select(sizing.max_curvature().alias("k")).first().k * r - 1) < 0.01


def test_validation(spark):
    dense = spark.createDataFrame([(x, y, z, 1) for x in range(2) for y in range(2) for z in range(2)], "x int, y int, z int, label int")
    conformity.validate(dense)
    for bad, options in ((dense.where("x = 0"), {}), (dense.withColumn("label", F.lit(0)), {}), (dense.limit(0), {}), (dense, {"thresholds": [1.0]})):
        with pytest.raises(ValueError):
            conformity.validate(bad, **options)
    conformity.validate(dense, [1.0], gray=True)
    with pytest.raises(ValueError):
        voxels.six_class_labels(17)


def test_cells_by_depth(spark):
    found = spark.createDataFrame([(0, 0.0), (1, 5.0), (2, 7.0), (3, 1.0), (4, 9.0)], "cell long, volume double")
    near = spark.createDataFrame([(0, 1), (2, 0), (1, 3)], "a long, b long")
    by = {r.cell: (r.depth, r.label) for r in cells.cell_labels(found, near).collect()}
    # cell 4 is not reached and counts as one level in
    assert by == {0: (0, 0), 1: (1, 3), 2: (1, 2), 3: (2, 4), 4: (1, 1)}
    assert {r.cell: r.label for r in cells.cell_labels(found, near, "depth").collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 1}


def test_report_sees_crossings(spark):
    def tet(k, x):
        return [(4 * k, x, 0.0, 0.0), (4 * k + 1, x + 1, 0.0, 0.0), (4 * k + 2, x, 1.0, 0.0), (4 * k + 3, x, 0.0, 1.0)]

    for x, crosses in ((3.0, False), (0.3, True)):
        nodes = spark.createDataFrame(tet(0, 0.0) + [(n, a, b + 0.1, c + 0.1) for n, a, b, c in tet(1, x)], "nid long, x double, y double, z double")
        tets = spark.createDataFrame([(0, 0, 1, 2, 3, 1), (1, 4, 5, 6, 7, 1)], "tid long, v0 long, v1 long, v2 long, v3 long, label int")
        row = mesh.check_report(tets, nodes).first()
        assert (row.n_crossings > 0, row.ok, row.n_open) == (crosses, not crosses, 0)


def test_point_triangle_distance(spark):
    rng = random.Random(2)
    rows = [tuple(rng.uniform(-1, 1) for _ in range(12)) for _ in range(60)]
    names = [f"{c}{a}" for c in "pabc" for a in "xyz"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    at = lambda c: tuple(F.col(f"{c}{a}") for a in "xyz")
    got = [r.d for r in df.select(geo.point_triangle_distance(at("p"), [at(c) for c in "abc"]).alias("d")).collect()]
    for row, d in zip(rows, got, strict=True):
        p, a, b, c = (row[k : k + 3] for k in (0, 3, 6, 9))
        near = min(math.dist(p, [a[k] + u * (b[k] - a[k]) + v * (c[k] - a[k]) for k in range(3)]) for i in range(41) for j in range(41 - i) for u, v in [(i / 40, j / 40)])
        assert d <= near + 1e-9 and near - d < 0.05


def test_thinning_equals_the_sequential_pass(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0, 3), rng.randint(0, 2)) for i in range(250)]
    kept = []
    for p in sorted(points, key=lambda p: (p[4], p[0])):
        if all(math.dist(p[1:4], q[1:4]) >= 1.1 for q in kept):
            kept.append(p)
    got = spatial.thin(spark.createDataFrame(points, "pid long, x double, y double, z double, first int"), 1.1, ["first"])
    assert sorted(r.pid for r in got.collect()) == sorted(p[0] for p in kept)


def test_cells_of_overlaps_keep_single_labels(spark):
    df = spark.createDataFrame([(1.0, -1.0), (-1.0, 1.0), (1.0, 1.0), (-1.0, -1.0)], "a double, b double")
    got = {(r.a, r.b): r.tag for r in sdf.overlap_cells(df, [(3, F.col("a")), (5, F.col("b"))]).collect()}
    assert got == {(1.0, -1.0): 3, (-1.0, 1.0): 5, (1.0, 1.0): 6, (-1.0, -1.0): 0}


def test_edges_that_leave_the_labels(spark):
    dense = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 0), (2, 0, 0, 1), (0, 1, 0, 2)], "x int, y int, z int, label int")
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.4, 0.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.0, 2.0, 0.0), (5, 0.6, 0.0, 0.0)], "nid long, x double, y double, z double")
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (3, 4), (0, 5), (1, 1)], "a long, b long")
    # 0-1 crosses the gap, 3-4 leaves the table; 0-5 has its last place at 0.4, still in the voxel of 0
    assert sorted(map(tuple, conformity.exterior_edges(edges, nodes, dense).collect())) == [(0, 1), (3, 4)]
    assert conformity.exterior_edges(edges.limit(0), nodes, dense).count() == 0


def test_balls_of_features_against_all_pairs(spark):
    rng = random.Random(5)
    pins = [(k, k % 4, rng.random(), *(rng.choice([1, 1, 9]) * rng.random() for _ in "xyz")) for k in range(40)]
    points = [(100 + k, 0, *(9 * rng.random() ** 2 for _ in "xyz")) for k in range(600)] + [(p[0], 2, *p[3:]) for p in pins]
    balls = spatial.feature_balls(spark.createDataFrame(pins, "pid long, curve int, t double, x double, y double, z double")).withColumn("h", F.lit(4.0))
    kept = spatial.protect(spark.createDataFrame(points, "pid long, typ int, x double, y double, z double"), balls, F.col("typ") == 2)
    want = []
    for curve in range(4):
        on = sorted((p for p in pins if p[1] == curve), key=lambda p: (p[2], p[0]))
        for a, b in zip(on, on[1:]):
            r2 = sum((u - v) ** 2 for u, v in zip(a[3:], b[3:])) / 4
            if 0 < r2 <= (0.8 * 4) ** 2:
                want.append(([(u + v) / 2 for u, v in zip(a[3:], b[3:])], r2))
    assert balls.count() == 36 and 0 < len(want) < 36
    stay = {p[0] for p in points if p[1] == 2 or not any(sum((u - v) ** 2 for u, v in zip(p[2:], c)) < r2 for c, r2 in want)}
    assert {r.pid for r in kept.collect()} == stay and 40 < len(stay) < 640
