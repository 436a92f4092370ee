"""Operators over meshes: node(nid, x, y, z), tet(tid, v0..v3, label), tri(fid, v0..v2, inner, outer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.functions.geometry import joe_liu, min_dihedral, radius_edge, tet_volume, tet_volume6
from meshlake.operators.graph import connected_components
from meshlake.operators.ordering import global_row_number
from meshlake.runtime import materialize

CORNERS = ("v0", "v1", "v2", "v3")
#: Corners of the face opposite each corner, turned so that the normal points out of a positive tetrahedron.
FACES = ((1, 2, 3), (0, 3, 2), (0, 1, 3), (0, 2, 1))
#: The six tetrahedra of a cube whose corners are numbered by bits x + 2y + 4z, all positive.
KUHN = ((0, 1, 3, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 6, 4, 7), (0, 4, 5, 7), (0, 5, 1, 7))


def vertex_id(x: Column, y: Column, z: Column, nx: int, ny: int) -> Column:
    return (x + F.lit(nx + 1) * (y + F.lit(ny + 1) * z)).cast("long")


def voxel_tets(voxels: DataFrame, nx: int, ny: int) -> DataFrame:
    """(tid, v0..v3, label): six conforming tetrahedra for each voxel of a label but 0."""
    corner = lambda n: vertex_id(F.col("x") + (n & 1), F.col("y") + (n >> 1 & 1), F.col("z") + (n >> 2 & 1), nx, ny)
    tets = F.posexplode(F.array(*[F.struct(*[corner(n).alias(c) for n, c in zip(t, CORNERS, strict=True)]) for t in KUHN]))
    cell = (F.col("x") + F.lit(nx) * (F.col("y") + F.lit(ny) * F.col("z"))).cast("long")
    return voxels.where("label <> 0").select(cell.alias("cell"), "label", tets.alias("k", "t")).select((F.col("cell") * 6 + F.col("k")).alias("tid"), *[F.col(f"t.{c}") for c in CORNERS], "label")


def vertex_nodes(tets: DataFrame, nx: int, ny: int) -> DataFrame:
    """(nid, x, y, z) of the grid vertices that the tetrahedra use."""
    used = tets.select(F.explode(F.array(*CORNERS)).alias("nid")).distinct()
    x = F.pmod(F.col("nid"), F.lit(nx + 1))
    rest = F.floor(F.col("nid") / F.lit(nx + 1))
    return used.select("nid", x.cast("double").alias("x"), F.pmod(rest, F.lit(ny + 1)).cast("double").alias("y"), F.floor(rest / F.lit(ny + 1)).cast("double").alias("z"))


def tet_points(tets: DataFrame, nodes: DataFrame) -> DataFrame:
    """tets with p0x .. p3z. Corners are gathered by one join and one aggregation over tid."""
    tall = tets.select("tid", F.posexplode(F.array(*CORNERS)).alias("k", "nid")).join(nodes.select("nid", "x", "y", "z"), "nid")
    wide = tall.groupBy("tid").agg(*[F.max(F.when(F.col("k") == k, F.col(a))).alias(f"p{k}{a}") for k in range(4) for a in "xyz"])
    return tets.join(wide, "tid")


def corner_points() -> list[tuple[Column, Column, Column]]:
    return [(F.col(f"p{k}x"), F.col(f"p{k}y"), F.col(f"p{k}z")) for k in range(4)]


def tet_sides(tets: DataFrame) -> DataFrame:
    """Four rows a tetrahedron: (tid, label, a, b, c sorted, f0, f1, f2 as the side is turned)."""
    sides = F.explode(F.array(*[F.struct(*[F.col(CORNERS[i]).alias(f"f{n}") for n, i in enumerate(f)]) for f in FACES]))
    s = tets.select("tid", "label", sides.alias("s")).select("tid", "label", "s.*")
    key = F.array_sort(F.array("f0", "f1", "f2"))
    return s.select("tid", "label", key[0].alias("a"), key[1].alias("b"), key[2].alias("c"), "f0", "f1", "f2")


def extract_faces(tets: DataFrame) -> DataFrame:
    """(v0, v1, v2, inner, outer): sides of one tetrahedron, and of two with different labels.

    inner is the larger label, outer the other or 0; the corners are turned so that the
    normal points from inner to outer. One shuffle over the sorted corners, in which at
    most two rows meet.
    """
    by = F.struct(F.col("label"), F.col("tid"), F.col("f0"), F.col("f1"), F.col("f2"))
    met = tet_sides(tets).groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"), F.max(by).alias("hi"), F.min(by).alias("lo"))
    kept = met.where("n = 1 or hi.label <> lo.label")
    return kept.select(F.col("hi.f0").alias("v0"), F.col("hi.f1").alias("v1"), F.col("hi.f2").alias("v2"), F.col("hi.label").alias("inner"), F.when(F.col("n") == 1, F.lit(0)).otherwise(F.col("lo.label")).alias("outer"))


def voxel_faces(voxels: DataFrame) -> DataFrame:
    """(inner, outer, n): unit faces between voxels of different labels, missing voxels counting as 0.

    Each voxel names its six sides by (axis, place); the two voxels of a side meet in one
    aggregation, so no neighbour join is needed.
    """
    sides = []
    for axis in "xyz":
        for step in (0, 1):
            sides.append(F.struct(F.lit(axis).alias("axis"), *[(F.col(a) + step if a == axis else F.col(a)).alias(f"s{a}") for a in "xyz"]))
    rows = voxels.where("label <> 0").select("label", F.explode(F.array(*sides)).alias("s")).select("label", "s.*")
    met = rows.groupBy("axis", "sx", "sy", "sz").agg(F.max("label").alias("inner"), F.when(F.count(F.lit(1)) == 2, F.min("label")).otherwise(F.lit(0)).alias("outer"))
    return met.where("inner <> outer").groupBy("inner", "outer").agg(F.count(F.lit(1)).alias("n"))


def label_volumes(tets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, n_tets, volume, largest)."""
    v = tet_points(tets, nodes).select("label", tet_volume(corner_points()).alias("v"))
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n_tets"), F.sum("v").alias("volume"), F.max("v").alias("largest"))


def quality_rows(tets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tid, label, volume6, quality, dihedral, radius_edge)."""
    p = corner_points()
    return tet_points(tets, nodes).select("tid", "label", tet_volume6(p).alias("volume6"), joe_liu(p).alias("quality"), min_dihedral(p).alias("dihedral"), radius_edge(p).alias("radius_edge"))


def positional(rows: DataFrame, value: str, places: dict[str, int | tuple[int, int]]) -> DataFrame:
    """One row with the 0-based element n div d of the sorted values for each (name, d); d = 0 is the least.

    A pair (k, d) stands for element n * k div d, the last one at most.

    No interpolation. Equal values are counted first, and positions are found from a
    running count over the distinct values, which are numbered without a global sort in
    one task.
    """
    counts = materialize(rows.groupBy(value).agg(F.count(F.lit(1)).alias("c")), "counts")
    ranked = materialize(global_row_number(counts, [F.col(value)], "__rn").withColumn("__bucket", F.floor(F.col("__rn") / 4096)), "ranked")
    sums = ranked.groupBy("__bucket").agg(F.sum("c").alias("s"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("off"))
    upto = F.sum("c").over(Window.partitionBy("__bucket").orderBy("__rn"))
    n = rows.count()
    placed = ranked.join(offsets, "__bucket").select(value, (F.col("off") + upto).alias("upto"))
    pair = lambda d: d if isinstance(d, tuple) else (1, d)
    at = lambda d: 0 if d == 0 else min(n * pair(d)[0] // pair(d)[1], max(n - 1, 0))
    return placed.agg(*[F.min(F.when(F.col("upto") > at(d), F.col(value))).alias(name) for name, d in places.items()])


def orientation_counts(quality: DataFrame, flat: float = 0.0) -> DataFrame:
    """(n_inverted, n_flat): the minority orientation and those of no volume."""
    pos, neg = F.count(F.when(F.col("volume6") > flat, 1)), F.count(F.when(F.col("volume6") < -flat, 1))
    return quality.agg(F.least(pos, neg).alias("n_inverted"), F.count(F.when(F.abs("volume6") <= flat, 1)).alias("n_flat"))


def unique_edges(tets: DataFrame) -> DataFrame:
    """(a, b): each edge of the tetrahedra once, a < b."""
    pairs = F.explode(F.array(*[F.struct(F.least(CORNERS[i], CORNERS[j]).alias("a"), F.greatest(CORNERS[i], CORNERS[j]).alias("b")) for i in range(4) for j in range(i + 1, 4)]))
    return tets.select(pairs.alias("e")).select("e.a", "e.b").distinct()


def face_edges(faces: DataFrame, *columns: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.least(f"v{i}", f"v{j}").alias("a"), F.greatest(f"v{i}", f"v{j}").alias("b")) for i, j in ((0, 1), (1, 2), (2, 0))]))
    return faces.select(*columns, pairs.alias("e")).select(*columns, "e.a", "e.b")


def edge_incidence(faces: DataFrame) -> DataFrame:
    """(region, n_edges, n_open, n_junction): for region -1 all faces, else those with the region on a side.

    An edge is open if one face uses it, for a region if an odd number does; a junction
    edge lies on more than two faces.
    """
    regions = F.explode(F.filter(F.array(F.lit(-1), F.col("inner"), F.col("outer")), lambda r: r != 0))
    uses = face_edges(faces.withColumn("region", regions), "region").groupBy("region", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    opened = F.when(F.col("region") == -1, F.col("n") == 1).otherwise(F.col("n") % 2 == 1)
    return uses.groupBy("region").agg(F.count(F.lit(1)).alias("n_edges"), F.count(F.when(opened, 1)).alias("n_open"), F.count(F.when(F.col("n") > 2, 1)).alias("n_junction"))


def pinched_edges(faces: DataFrame) -> DataFrame:
    """(a, b, inner, outer, n): edges on more than two faces of one label pair."""
    return face_edges(faces, "inner", "outer").groupBy("a", "b", "inner", "outer").agg(F.count(F.lit(1)).alias("n")).where("n > 2")


def node_label_sets(tets: DataFrame, faces: DataFrame) -> DataFrame:
    """(nid, labels, label, typ): labels of the tetrahedra at a node, and 0 on exterior faces.

    label is the smallest but 0; typ the number of other labels, 3 at most.
    """
    at = tets.select(F.explode(F.array(*CORNERS)).alias("nid"), "label")
    out = faces.where("outer = 0").select(F.explode(F.array("v0", "v1", "v2")).alias("nid"), F.lit(0).alias("label"))
    sets = at.unionByName(out).groupBy("nid").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    own = F.array_min(F.filter("labels", lambda x: x != 0))
    return sets.select("nid", "labels", own.alias("label"), F.least(F.size("labels") - 1, F.lit(3)).alias("typ"))


def majority_label(tets: DataFrame, node_labels: DataFrame) -> DataFrame:
    """(tid, label): the most frequent label of the four corners, of equally frequent ones the smallest."""
    corners = tets.select("tid", F.explode(F.array(*CORNERS)).alias("nid")).join(node_labels.select("nid", "label"), "nid")
    votes = corners.groupBy("tid", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("tid").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def tet_label_conflicts(tets: DataFrame, sets: DataFrame) -> DataFrame:
    """(tid, common, n_common): labels but 0 that all four corners' sets share."""
    corners = tets.select("tid", F.explode(F.array(*CORNERS)).alias("nid")).join(sets.select("nid", F.explode("labels").alias("l")), "nid").where("l <> 0")
    shared = corners.groupBy("tid", "l").agg(F.count(F.lit(1)).alias("n")).where("n = 4")
    common = shared.groupBy("tid").agg(F.array_sort(F.collect_list("l")).alias("common"))
    return tets.select("tid").join(common, "tid", "left").select("tid", F.coalesce("common", F.array().cast("array<int>")).alias("common")).withColumn("n_common", F.size("common"))


def face_points(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """faces with ax .. cz. Corners are gathered by one join and one aggregation over the corners themselves."""
    keys = ["v0", "v1", "v2", "inner", "outer"]
    tall = faces.select(*keys, F.posexplode(F.array("v0", "v1", "v2")).alias("k", "nid")).join(nodes.select("nid", "x", "y", "z"), "nid")
    return tall.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col(a))).alias(f"{c}{a}") for k, c in enumerate("abc") for a in "xyz"])


def interface_areas(faces: DataFrame, nodes: DataFrame) -> DataFrame:
    """(inner, outer, n, area) and the volume that the pair's faces enclose by the divergence theorem."""
    from meshlake.functions.geometry import det3, triangle_area

    p = [(F.col(f"{c}x"), F.col(f"{c}y"), F.col(f"{c}z")) for c in "abc"]
    return face_points(faces, nodes).select("inner", "outer", triangle_area(p).alias("s"), (det3(*p) / 6.0).alias("v")).groupBy("inner", "outer").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("area"), F.sum("v").alias("enclosed"))


def same_label_components(tets: DataFrame) -> DataFrame:
    """(tid, component): tetrahedra of one label joined through shared sides; component is the least tid."""
    pairs = tet_sides(tets).groupBy("a", "b", "c", "label").agg(F.min("tid").alias("x"), F.max("tid").alias("y"))
    return connected_components(pairs.select("x", "y"), "x", "y").select(F.col("node").alias("tid"), "component")


def compact_nodes(nodes: DataFrame, tets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are used, renumbered 0, 1, ... in their order, and the tetrahedra over the new numbers."""
    used = tets.select(F.explode(F.array(*CORNERS)).alias("nid")).distinct()
    kept = materialize(global_row_number(nodes.join(used, "nid", "left_semi"), [F.col("nid")], "new"), "compact")
    tall = tets.select("tid", "label", F.posexplode(F.array(*CORNERS)).alias("k", "nid")).join(kept.select("nid", "new"), "nid")
    out = tall.groupBy("tid", "label").agg(*[F.max(F.when(F.col("k") == k, F.col("new"))).alias(c) for k, c in enumerate(CORNERS)])
    return kept.drop("nid").withColumnRenamed("new", "nid"), out


def canonical_tets(tets: DataFrame) -> DataFrame:
    """Corners in an order that keeps the orientation: sorted, with the last two swapped if that was an odd permutation."""
    v = [F.col(c) for c in CORNERS]
    swaps = sum((F.when(v[i] > v[j], F.lit(1)).otherwise(F.lit(0)) for i in range(4) for j in range(i + 1, 4)), F.lit(0))
    s = F.array_sort(F.array(*v))
    odd = swaps % 2 == 1
    return tets.select("tid", s[0].alias("v0"), s[1].alias("v1"), F.when(odd, s[3]).otherwise(s[2]).alias("v2"), F.when(odd, s[2]).otherwise(s[3]).alias("v3"), "label")


def check_report(tets: DataFrame, nodes: DataFrame, cell: float = 1.0) -> DataFrame:
    """One row: counts of tetrahedra, inverted, flat, slivers, open and region-open edges, crossings of faces, and ok.

    cell is about the size of a face. The faces are written once for the three counts on them.
    """
    from meshlake.operators.surfaces import triangle_crossings

    faces = materialize(extract_faces(tets), "faces")
    counts = quality_rows(tets, nodes).agg(
        F.count(F.lit(1)).alias("n_tets"),
        F.least(F.count(F.when(F.col("volume6") > 0, 1)), F.count(F.when(F.col("volume6") < 0, 1))).alias("n_inverted"),
        F.count(F.when(F.col("volume6") == 0, 1)).alias("n_flat"),
        F.count(F.when(F.col("dihedral") < 10, 1)).alias("n_slivers"),
    )
    edges = edge_incidence(faces).agg(F.coalesce(F.sum(F.when(F.col("region") == -1, F.col("n_open")).otherwise(0)), F.lit(0)).alias("n_open"), F.coalesce(F.sum(F.when(F.col("region") != -1, F.col("n_open")).otherwise(0)), F.lit(0)).alias("n_region_open"))
    crossings = triangle_crossings(face_points(faces, nodes).withColumn("fid", F.struct("v0", "v1", "v2")), cell).agg(F.count(F.lit(1)).alias("n_crossings"))
    # three tables of one row
    one = lambda df: df.withColumn("__one", F.lit(1))
    sound = (F.col("n_inverted") == 0) & (F.col("n_open") == 0) & (F.col("n_region_open") == 0) & (F.col("n_crossings") == 0)
    return one(counts).join(one(edges), "__one").join(one(crossings), "__one").drop("__one").withColumn("ok", sound)
