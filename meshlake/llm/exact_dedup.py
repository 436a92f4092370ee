"""Exact dedup by a log-structured merge index of digests (operator 3).

Built-in functions only. A task's share of the documents is a memtable: its digests
are sorted and flushed as one run, a Parquet file with a Bloom filter and bounds for
the digest. Compaction merges all runs into one that keeps, for each digest, the
identifier that stays and the number of rows; equal digests are combined within each
task before they are shuffled. Digests met more than once are hits. A filter of bounded
size over the hits picks the texts to verify, and grouping them by digest and text
compares their bytes; copies meet as one row a task, so a group that holds a third of
all documents costs no more than another. Texts that are met once are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import lower_ascii, text_of
from meshlake.llm.filters import bitmap_filter, bits_for, maybe_in
from meshlake.runtime import materialize

RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "1000000"}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """Sorted runs of (digest, doc_id) and what compaction has made of them."""

    def __init__(self, keep: str = "min", digest: Callable[[Column], Column] = sha256):
        if keep not in ("min", "max"):
            raise ValueError("keep is min or max")
        self.best = F.min if keep == "min" else F.max
        self.digest = digest
        self.runs: list[DataFrame] = []

    def entries(self, docs: DataFrame) -> DataFrame:
        norm = lower_ascii(text_of())
        return docs.select("doc_id", norm.alias("norm")).withColumn("digest", self.digest(F.col("norm")))

    def flush(self, docs: DataFrame) -> DataFrame:
        """Write one sorted run a task; nothing is shuffled."""
        own = [] if self.digest is sha256 else [sha256(F.col("norm")).alias("sha")]
        run = self.entries(docs).select("digest", "doc_id", *own).sortWithinPartitions("digest")
        self.runs.append(materialize(run, "run", options=RUN_OPTIONS))
        return self.runs[-1]

    def compact(self) -> DataFrame:
        """(digest, keep_id, n): all runs merged into one."""
        merged = self.runs[0]
        for run in self.runs[1:]:
            merged = merged.unionByName(run)
        level = merged.groupBy("digest").agg(self.best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        return materialize(level.sortWithinPartitions("digest"), "level", options=RUN_OPTIONS)

    def verified(self, docs: DataFrame, level: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Groups of more than one row by digest and bytes: (those of one text a digest, the others with their text)."""
        hits = level.where("n > 1").select(F.xxhash64("digest").alias("h"))
        bits = bits_for(hits.count())
        passed = maybe_in(self.entries(docs), bitmap_filter(hits, "h", bits), F.xxhash64("digest"), bits)
        groups = passed.groupBy("digest", "norm").agg(self.best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = materialize(groups, "groups")
        texts = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
        plain = groups.join(texts.where("texts = 1"), "digest", "left_semi").where("group_size > 1").select("digest", "keep_id", "group_size")
        clash = groups.join(texts.where("texts > 1"), "digest", "left_semi")
        return plain, clash


def exact_dedup(docs: DataFrame, keep: str = "max", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after lower-casing A-Z; null counts as empty. Of equal
    texts the row of the largest (keep="min": smallest) doc_id stays. A null doc_id
    stays only where all of its group are null. Rows that repeat the identifier that
    stays are one document, and all marked kept; each counts in group_size. An empty
    table gives no rows. Columns but doc_id and text are ignored.
    """
    index = DigestIndex(keep, digest)
    run = index.flush(docs)
    level = index.compact()
    plain, clash = index.verified(docs, level)
    if clash.limit(1).count():
        # digests that several texts share: those rows are told apart by their bytes
        shared = clash.select("digest").distinct()
        own = index.entries(docs).join(shared, "digest", "left_semi")
        apart = own.join(clash, ["digest", "norm"]).select("doc_id", "keep_id", "group_size", sha256(F.col("norm")).alias("sha"))
        run = run.join(shared, "digest", "left_anti")
    else:
        apart = None
    found = run.join(plain, "digest", "left")
    first = F.col("group_size").isNull()
    sha = F.col("digest" if digest is sha256 else "sha")
    out = found.select("doc_id", F.when(first, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), sha.alias("sha"))
    if apart is not None:
        out = out.unionByName(apart)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
