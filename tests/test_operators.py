"""Operators against closed forms and brute force on small volumes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meshlake.functions import geometry as geo
from meshlake.operators import mesh, spatial, voxels
from meshlake.operators.graph import connected_components
from meshlake.operators.ordering import global_row_number
from meshlake.sources.phantoms import LABELLED, gray_phantom, phantom


@pytest.mark.parametrize("name", LABELLED)
def test_phantoms_have_labels(spark, name):
    labels = {r.label for r in phantom(spark, name, 20).select("label").distinct().collect()}
    assert 0 in labels and len(labels) >= 2


def test_sphere_volume_and_area(spark):
    n = 16
    v = phantom(spark, "sphere", n)
    count = v.where("label = 1").count()
    assert abs(count * (2 / n) ** 3 - 4 / 3 * math.pi * 0.7**3) < 0.1
    tets = mesh.voxel_tets(v, n, n)
    nodes = mesh.vertex_nodes(tets, n, n)
    volume = mesh.label_volumes(tets, nodes).first()
    assert volume.n_tets == 6 * count and volume.volume == pytest.approx(count)
    areas = mesh.interface_areas(mesh.extract_faces(tets), nodes).first()
    assert areas.enclosed == pytest.approx(count)
    assert areas.area == pytest.approx(mesh.voxel_faces(v).first().n)


def test_two_tets_share_a_face(spark):
    tets = spark.createDataFrame([(0, 0, 1, 2, 3, 1), (1, 1, 2, 3, 4, 2)], "tid long, v0 long, v1 long, v2 long, v3 long, label int")
    faces = mesh.extract_faces(tets).collect()
    assert len(faces) == 7
    inner = [f for f in faces if f.outer]
    assert [(f.inner, f.outer, {f.v0, f.v1, f.v2}) for f in inner] == [(2, 1, {1, 2, 3})]


def test_report_of_a_sound_mesh(spark):
    tets = mesh.voxel_tets(phantom(spark, "tjunction", 6), 6, 6)
    row = mesh.check_report(tets, mesh.vertex_nodes(tets, 6, 6)).first()
    assert row.ok and row.n_inverted == row.n_flat == row.n_open == row.n_region_open == 0


def test_regular_tetrahedron(spark):
    p = [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)]
    points = [tuple(F.lit(float(x)) for x in q) for q in p]
    row = spark.range(1).select(geo.joe_liu(points).alias("q"), geo.min_dihedral(points).alias("d"), geo.radius_edge(points).alias("r"), geo.tet_volume(points).alias("v"), geo.triangle_quality(points[:3]).alias("t")).first()
    assert row.q == pytest.approx(1) and row.d == pytest.approx(math.degrees(math.acos(1 / 3))) and row.r == pytest.approx(math.sqrt(6) / 4) and row.v == pytest.approx(8 / 3) and row.t == pytest.approx(1)


def test_inverse_error_function(spark):
    for x in (0.0, 0.1, 0.5, 0.9, 0.99):
        got = spark.range(1).select(geo.erfinv(F.lit(x)).alias("y")).first().y
        assert math.erf(got) == pytest.approx(x, abs=3e-3)


def test_thresholds_in_any_order(spark):
    ramp = gray_phantom(spark, "graysphere", 8)
    a = ramp.select(voxels.threshold_label(F.col("intensity"), [0.2, 0.5, 0.7]).alias("a"), voxels.threshold_label(F.col("intensity"), [0.7, 0.2, 0.5]).alias("b"))
    assert a.where("a <> b").count() == 0 and {r.a for r in a.select("a").distinct().collect()} == {0, 1, 2, 3}


def test_pocket_is_filled(spark):
    n = 8
    v = phantom(spark, "sphere", n).withColumn("label", F.when((F.col("x").between(1, 6)) & (F.col("y").between(1, 6)) & (F.col("z").between(1, 6)), 1).otherwise(0))
    v = v.withColumn("label", F.when((F.col("x").between(3, 4)) & (F.col("y").between(3, 4)) & (F.col("z").between(3, 4)), 0).otherwise(F.col("label")))
    assert v.where("label = 1").count() == 216 - 8
    assert voxels.fill_holes(v, (n, n, n)).where("label = 1").count() == 216


def test_channel_rules():
    assert voxels.channel_labels(["Background", "white", "air", "gray"]) == [0, 1, 0, 2]
    with pytest.raises(ValueError):
        voxels.channel_labels(["a"], [1, 2])
    assert [voxels.probability_scale(x) for x in (1.0, 200, 300)] == [1.0, 255.0, 300]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 140)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_row_numbers(spark):
    df = spark.createDataFrame([(random.Random(i).randint(0, 50),) for i in range(300)], "v int")
    rows = sorted(global_row_number(df, [F.col("v")]).collect(), key=lambda r: r.rn)
    assert [r.rn for r in rows] == list(range(300)) and [r.v for r in rows] == sorted(r.v for r in rows)


def cube(o, s, first=0):
    corners = [(o[0] + s * (n & 1), o[1] + s * (n >> 1 & 1), o[2] + s * (n >> 2 & 1)) for n in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    tris = [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    return [(first + k, *[float(x) for v in t for x in corners[v]]) for k, t in enumerate(tris)]


def test_winding_of_nested_cubes(spark):
    tris = spark.createDataFrame(cube((0, 0, 0), 10) + cube((3, 3, 3), 4, 100), "fid long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    points = [(0, -1.0, 5.0, 5.0), (1, 1.0, 5.0, 5.0), (2, 5.0, 5.0, 5.0), (3, 8.0, 8.5, 5.0), (4, 11.0, 5.0, 5.0), (5, 1.0, 3.0, 3.0)]
    got = {r.pid: r.w for r in spatial.winding(spark.createDataFrame(points, "pid long, x double, y double, z double"), tris, 2.0).collect()}
    assert {k: abs(w) for k, w in got.items()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 0, 5: 1}


def test_thinning_equals_the_sequential_pass(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0, 2), rng.randint(0, 3)) for i in range(150)]
    kept = []
    for p in sorted(points, key=lambda p: (p[4], p[0])):
        if all(math.dist(p[1:4], q[1:4]) >= 0.9 for q in kept):
            kept.append(p)
    got = spatial.thin(spark.createDataFrame(points, "pid long, x double, y double, z double, o int"), 0.9, ["o"]).collect()
    assert {r.pid for r in got} == {p[0] for p in kept}


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-1, 1)) for i in range(120)]
    got = {(r.i, r.j) for r in spatial.near_pairs(spark.createDataFrame(points, "pid long, x double, y double, z double"), 0.7).collect()}
    assert got == {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and math.dist(a[1:], b[1:]) < 0.7}
