"""Checks of a labelled mesh against the labels its nodes stand on, and checks before a plan is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.operators.mesh import CORNERS, tet_sides
from meshlake.operators.ordering import global_row_number


def bad_faces(faces: DataFrame, sets: DataFrame) -> DataFrame:
    """(v0, v1, v2, inner, outer, n_off): faces with corners that are not on both labels.

    sets is (nid, labels). Each face's corners meet their sets in one join; a corner without
    a set is off.
    """
    corner = F.explode(F.array("v0", "v1", "v2")).alias("nid")
    tall = faces.select("v0", "v1", "v2", "inner", "outer", corner).join(sets.select("nid", "labels"), "nid", "left")
    on = F.coalesce(F.array_contains("labels", F.col("inner")) & F.array_contains("labels", F.col("outer")), F.lit(False))
    return tall.groupBy("v0", "v1", "v2", "inner", "outer").agg(F.count(F.when(~on, 1)).alias("n_off")).where("n_off > 0")


def exterior_edges(edges: DataFrame, nodes: DataFrame, dense: DataFrame, size: tuple[float, float, float] = (1.0, 1.0, 1.0), step: float = 0.25) -> DataFrame:
    """(a, b): edges that pass through label 0 between their ends.

    An edge is looked at in equal parts no longer than step of the least voxel side, two
    at least, its ends left out. A place has the label of the voxel whose centre is
    nearest; a voxel that dense has not is exterior. Each voxel is asked for once an edge.
    """
    ends = edges.select("a", "b")
    for v in "ab":
        ends = ends.join(nodes.select(F.col("nid").alias(v), *[F.col(c).alias(f"{v}{c}") for c in "xyz"]), v)
    along = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]
    length = F.sqrt(along[0] * along[0] + along[1] * along[1] + along[2] * along[2])
    parts = F.greatest(F.lit(2), F.ceil(length / F.lit(step * min(size))).cast("int"))
    ends = ends.withColumn("parts", parts)

    def voxel(k):
        at = k.cast("double") / F.col("parts")
        return F.struct(*[F.floor((F.col(f"a{c}") + at * d) / F.lit(float(s)) + 0.5).cast("int").alias(c) for c, d, s in zip("xyz", along, size, strict=True)])

    met = ends.select("a", "b", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("parts") - 1), voxel))).alias("v")).select("a", "b", "v.*")
    return met.join(dense.where("label <> 0").select("x", "y", "z"), ["x", "y", "z"], "left_anti").select("a", "b").distinct()


def side_uses(tets: DataFrame) -> DataFrame:
    """(uses, n): how many sides lie on one tetrahedron, two, or more (which no sound mesh has)."""
    return tet_sides(tets).groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("uses")).groupBy("uses").agg(F.count(F.lit(1)).alias("n"))


def ordered_by_least_node(tets: DataFrame) -> DataFrame:
    """tets with rn, their place by smallest corner and then number."""
    least = tets.withColumn("least", F.least(*CORNERS))
    return global_row_number(least, [F.col("least"), F.col("tid")]).drop("least")


def surface_nodes(sets: DataFrame) -> DataFrame:
    """The nodes that lie on an interface: all a surface needs, kept before anything is built on them."""
    return sets.where("typ <> 0")


def label_by_centroid(tets: DataFrame, common: DataFrame, centroid: DataFrame) -> DataFrame:
    """(tid, label, conflict) from the labels that all corners share and those at the centroids.

    common is (tid, common), sorted; centroid (tid, at, fields), at the label there and fields
    the value of each label 1, 2, ... there. One common label is taken. With none the
    centroid's label is, as a conflict. Of several it is the centroid's if among them, else
    the one of the greatest field, of equal ones the lowest.
    """
    both = tets.select("tid").join(common, "tid").join(centroid, "tid")
    ranked = F.array_max(F.transform("common", lambda l: F.struct(F.get(F.col("fields"), l - 1).alias("v"), (-l).alias("l"))))
    several = F.when(F.array_contains("common", F.col("at")), F.col("at")).otherwise(-ranked["l"])
    label = F.when(F.size("common") == 1, F.col("common")[0]).when(F.size("common") == 0, F.col("at")).otherwise(several)
    return both.select("tid", label.cast("int").alias("label"), (F.size("common") == 0).alias("conflict"))


def validation(dense: DataFrame, thresholds: list[float] | None = None, gray: bool = False) -> DataFrame:
    """One row: dims_ok (two voxels or more along each axis), has_label, thresholds_ok (they need a gray volume)."""
    span = [F.max(a) - F.min(a) >= 1 for a in "xyz"]
    found = dense.agg(F.coalesce(span[0] & span[1] & span[2], F.lit(False)).alias("dims_ok"), F.coalesce(F.max(F.col("label") != 0), F.lit(False)).alias("has_label"))
    return found.withColumn("thresholds_ok", F.lit(not thresholds or gray))


def validate(dense: DataFrame, thresholds: list[float] | None = None, gray: bool = False) -> None:
    """Raise a ValueError that names what keeps a volume from being meshed."""
    row = validation(dense, thresholds, gray).first()
    for ok, what in ((row.dims_ok, "the volume has fewer than two voxels along an axis"), (row.has_label, "the volume has no label but 0"), (row.thresholds_ok, "thresholds need a gray volume")):
        if not ok:
            raise ValueError(what)
