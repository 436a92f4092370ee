"""Line dedup by distinct-site spread (operator 10).

Each line's hash gets a HyperLogLog sketch of the sites that it occurs on; sketches are
filled within each task and merged by aggregation, so a line that every document holds
moves one sketch a task. Lines whose estimate is clear are decided by it. Those near the
threshold get exact counts of distinct sites. A boilerplate line stays in the document
with the smallest identifier that has it and is removed from all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import WORD, let, text_of
from meshlake.llm.filters import bitmap_filter, bits_for, maybe_in, surely_out
from meshlake.runtime import counted, materialize

#: log2 of a sketch's registers; its relative standard error is about 1.04 / 2^(LG_K / 2).
LG_K = 10
#: Estimates within this factor of the threshold are counted exactly: about six standard errors.
NEAR = 1.25


def _keys(line: Column) -> list[Column]:
    """Two independent 64-bit hashes: one line to one key at any corpus size."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("line"), line).alias("k2")]


def _identity() -> list[Column]:
    """What tells rows apart: the identifier, null too, and the text."""
    return [F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th")]


def numbered_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """(__id, __th, site, pos, k1, k2): the distinct places of each line that holds a word, trimmed at its ends."""
    lines = docs.select(*_identity(), F.coalesce(F.concat(F.lit("="), F.col(site)), F.lit("")).alias("site"), F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    own = lines.where(F.regexp_like("line", F.lit(WORD))).withColumn("line", F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return own.select("__id", "__th", "site", "pos", *_keys(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """(k1, k2, sites, first_id): lines on min_sites distinct sites or more."""
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("__id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # fewer occurrences than sites asked for need no sketch
    judged = spread.where(F.col("n") >= min_sites).select("k1", "k2", "first_id", F.hll_sketch_estimate("sketch").alias("estimate"))
    judged = materialize(judged.where(F.col("estimate") >= min_sites / NEAR), "spread")
    near = judged.where(F.col("estimate") < min_sites * NEAR)
    clear = judged.where(F.col("estimate") >= min_sites * NEAR).select("k1", "k2", F.col("estimate").cast("long").alias("sites"), "first_id")
    places = lines.join(near.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "site").distinct()
    exact = places.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return clear.unionByName(exact.join(near.select("k1", "k2", "first_id"), ["k1", "k2"]))


def line_dedup(docs: DataFrame, min_sites: int = 15, site: str = "source") -> DataFrame:
    """docs with text changed, and n_lines, n_removed: lines found and lines removed.

    Lines are split at \\n and compared without blanks at their ends; lines without a
    word are never removed. A line on at least min_sites distinct sites stays in the
    document with the smallest doc_id that holds it (all its rows and places), or in those
    of null doc_id if there are no others; elsewhere it goes with its line end. A null
    site is a site. Null texts stay null, with no lines. Repeated rows are treated
    alike, other columns pass unchanged (n_lines and n_removed are replaced), and an empty
    table gives no rows.
    """
    if min_sites < 2:
        raise ValueError("min_sites is at least 2")
    lines = numbered_lines(docs, site)
    found = materialize(boilerplate(lines, min_sites), "boilerplate")
    # Catalyst broadcasts the boilerplate only where its written size is known to be small
    hit = lines.join(found.select("k1", "k2", "first_id"), ["k1", "k2"]).where(~F.col("__id").eqNullSafe(F.col("first_id")))
    gone = hit.groupBy("__id", "__th").agg(F.collect_set("pos").alias("__gone"))
    gone, n = counted(gone, "gone")
    gone = gone.withColumnsRenamed({"__id": "__id2", "__th": "__th2"})
    extra = [c for c in ("n_lines", "n_removed") if c in docs.columns]
    keyed = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("__id"), F.xxhash64("row.text").alias("__th"))
    # only rows that may lose a line are shuffled
    bits, own = bits_for(n), F.xxhash64("__id", "__th")
    held = bitmap_filter(gone.select(F.xxhash64("__id2", "__th2").alias("h")), "h", bits)
    some = maybe_in(keyed, held, own, bits)
    some = some.join(gone, (some["__th"] == gone["__th2"]) & some["__id"].eqNullSafe(gone["__id2"]), "left").select("row", "__gone")
    both = surely_out(keyed, held, own, bits).select("row", F.lit(None).cast("array<int>").alias("__gone")).unionByName(some)
    lines_of = F.split(F.coalesce("row.text", F.lit("")), "\n")
    kept = let(F.split("row.text", "\n"), lambda parts: F.filter(parts, lambda x, i: ~F.array_contains(F.col("__gone"), i)))
    text = F.when(F.col("__gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.size(F.filter(lines_of, lambda x: F.regexp_like(x, F.lit(WORD)))).cast("long")
    columns = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in extra]
    return both.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))
