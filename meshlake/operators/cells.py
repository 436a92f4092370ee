"""Labels of cells that surfaces bound, from the graph of cells that share a face."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.operators.ordering import global_row_number
from meshlake.runtime import counted, discard


def depths(cells: DataFrame, neighbours: DataFrame, root: int = 0) -> DataFrame:
    """(cell, depth): levels of breadth-first search from the root cell; cells it does not reach get 1.

    cells has cell; neighbours (a, b), either way round. A level reads what the last one
    added and is written once.
    """
    both = neighbours.select("a", "b").unionByName(neighbours.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    reached, n = counted(cells.where(F.col("cell") == root).select("cell", F.lit(0).alias("depth")), "depth")
    level = 0
    while n:
        level += 1
        new = both.join(reached.where(F.col("depth") == level - 1).select(F.col("cell").alias("a")), "a", "left_semi").select(F.col("b").alias("cell")).distinct()
        new = new.join(reached, "cell", "left_anti").select("cell", F.lit(level).alias("depth"))
        fresh, n = counted(new, "depth")
        if n:
            reached = reached.unionByName(fresh)
        else:
            discard(fresh)
    return cells.select("cell").join(reached, "cell", "left").select("cell", F.coalesce("depth", F.lit(1)).alias("depth"))


def cell_labels(cells: DataFrame, neighbours: DataFrame, mode: str = "cell", root: int = 0) -> DataFrame:
    """(cell, depth, label): cells has cell and volume.

    By depth the label is the depth. By cell the cells of depth above 0 are numbered 1, 2, ...
    by depth, greatest volume and number, the others are 0.
    """
    if mode not in ("cell", "depth"):
        raise ValueError(f"unknown mode {mode}")
    found = depths(cells, neighbours, root)
    if mode == "depth":
        return found.withColumn("label", F.col("depth"))
    inside = found.where("depth > 0").join(cells.select("cell", "volume"), "cell")
    numbered = global_row_number(inside, [F.col("depth").asc(), F.col("volume").desc(), F.col("cell").asc()], "rn", 1)
    return numbered.select("cell", "depth", F.col("rn").cast("int").alias("label")).unionByName(found.where("depth <= 0").select("cell", "depth", F.lit(0).alias("label")))
