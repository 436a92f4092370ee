"""Connected components by repeated local contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.runtime import counted, discard, materialize

#: Edges of a contracted graph that one task takes: some 16 bytes each, and as much again for its arrays.
AT_ONCE = 1 << 19


def _least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node reachable from each) by hooking roots and halving paths."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # every root takes the least root that an edge leads to
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while not np.array_equal(root[root], root):
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _at_once(edges: DataFrame) -> DataFrame:
    """(v, to): to is the least node that v reaches. edges are counted to fit one task."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            rows = pd.concat(held, ignore_index=True)
            nodes, least = _least_reachable(rows["a"].to_numpy(), rows["b"].to_numpy())
            yield pd.DataFrame({"v": nodes, "to": least})

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").coalesce(1).mapInPandas(each, f"v {kind}, to {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", seed: int = 1, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without edges are absent.

    Each round lets every node name the neighbour (or itself) that is least in a fresh
    random order, and contracts the edges along those names, so the number of nodes with
    edges falls by a constant factor whatever the shape: a path of n nodes takes about
    log n rounds, a star one. The order is a hash of round and node, so reruns agree.
    What is counted to be at_once edges or fewer is settled in one task. A round is two
    written tables; the names of all rounds are composed at the end, the small ones first.
    Self-loops and repeated edges are allowed; edges with a null end are ignored.
    Hubs are combined within each task before the shuffle and their joins left to
    adaptive skew handling.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    live, n = counted(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    names: list[DataFrame] = []
    while n > at_once:
        rounds = len(names)
        order = lambda c: F.struct(F.xxhash64(F.lit(seed * 1000 + rounds), c).alias("h"), c.alias("v"))  # noqa: B023, E731
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        named = materialize(least.select(F.col("a").alias("v"), F.least(F.col("m"), order(F.col("a"))).getField("v").alias("to")), "named")
        moved = live.join(named.withColumnsRenamed({"v": "a", "to": "a2"}), "a").join(named.withColumnsRenamed({"v": "b", "to": "b2"}), "b")
        contracted, n = counted(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        discard(live)
        live = contracted
        names.append(named)
    to = materialize(_at_once(live), "settled")
    discard(live)
    if not names:
        return to.toDF("node", "component")
    for named in reversed(names):
        on = to.toDF("to", "root")
        to = named.join(on, "to", "left").select("v", F.coalesce("root", "to").alias("to"))
    labels = materialize(to.toDF("node", "at"), "labels")
    smallest = labels.groupBy("at").agg(F.min("node").alias("component"))
    return labels.join(smallest, "at").select("node", "component")
