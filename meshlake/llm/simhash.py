"""SimHash near-dedup by deletion-variant signatures (operator 2).

Fingerprints of 64 bits are cut into three segments. Of two that differ in at most four
bits, one segment differs in one bit at most. The index holds, for each segment, its
value and its variants with one bit deleted: equal values meet by the first, and values
that differ in just that bit by the second, where the deleted bit tells the two sides of
the join apart, so that each pair meets once a segment. Every pair that meets is verified.

Equal fingerprints are one row. In each bucket all fingerprints are first compared with
its smallest, which makes at most one link a row; components of these links are found, and
large buckets that lie within one component are dropped. Only what is left is compared pair
by pair within its bucket, and only pairs across components leave the join. So no group of copies is expanded into
its pairs, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.filters import bitmap_filter, bits_for, maybe_in, surely_out
from meshlake.operators.graph import connected_components
from meshlake.runtime import counted, discard, materialize, observed, shuffled, worker_cache

SEED = 42
SHINGLES_A_STEP = 1 << 16
#: Near copies share at least this part of their shingles, as a whole-number ratio.
SHARE = (4, 5)
#: Cells of the count of common shingles, which only sets the order of keys.
CELLS = 1 << 18
#: Words whose hashes a worker keeps.
MOST_WORDS = 1 << 18
#: Times that sets are compared with heads before all pairs left are.
ROUNDS = 3
#: Fingerprints that a task gives their index keys.
EXPLODED = 1 << 16
#: Rows that a worker shingles at a time.
ROWS = 256


def fingerprint(text: str | None, words: int = 4) -> int:
    """The fingerprint of a whole text, as a signed 64-bit number.

    Words are split at the six ASCII blanks and A-Z lower-cased, both of which bytes do.
    A bit is set if over half the shingles' hashes set it; no shingle gives zero.
    """
    import xxhash

    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(found) - words + 1)
    spans = zip(starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes set, as a signed number; zero for none."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, SHINGLES_A_STEP):
        bits = np.unpackbits(hashes[k : k + SHINGLES_A_STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", doc_id: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """(doc_id, fp, extra columns) for each row."""
    kind = docs.schema[doc_id].dataType
    more = extra or []

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["doc_id", *more]].copy()
            out.insert(1, "fp", np.array([fingerprint(x, words) for x in batch["text"]], np.int64))
            yield out

    # a nullable identifier must not become a float on its way
    sent = T.StringType() if isinstance(kind, T.IntegralType) else kind
    own = docs.select(F.col(doc_id).cast(sent).alias("doc_id"), F.col(text).cast("string").alias("text"), *more)
    made = own.mapInPandas(each, T.StructType([T.StructField("doc_id", sent), T.StructField("fp", T.LongType()), *[docs.schema[c] for c in more]]))
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


class _Words(dict):
    """Hashes of words, kept while they are fewer than MOST_WORDS."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles, split as for fingerprint; of a shorter text its one.

    A shingle's hash is made from those of its words, in their order.
    """
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    known = worker_cache().setdefault("shingle words", _Words())
    own = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n, k = max(1, len(found) - words + 1), min(words, len(found))
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n])
    return np.unique(h)


def _each_text(docs: DataFrame, keep: list[str], schema: str, make) -> DataFrame:
    """The columns of keep and those that make gives for a text."""
    fields = T._parse_datatype_string(schema).fieldNames()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                out = part[keep].copy()
                for name, values in zip(fields, zip(*map(make, part["text"]), strict=True), strict=True):
                    out[name] = list(values)
                yield out

    # a nullable identifier must not become a float on its way
    whole = [c for c in keep if isinstance(docs.schema[c].dataType, T.IntegralType)]
    sent = docs.select(*[F.col(c).cast("string").alias(c) if c in whole else c for c in keep], F.col("text").cast("string").alias("text"))
    made = sent.mapInPandas(each, T.StructType([*[sent.schema[c] for c in keep], *T._parse_datatype_string(schema).fields]))
    return made.withColumns({c: F.col(c).cast(docs.schema[c].dataType) for c in whole})


def _set_id(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _may_be_alike(na: Column, nb: Column, shared: Column) -> Column:
    """Whether sets of na and nb shingles that share so many of their keys can reach SHARE.

    Behind the prefix that ends first in the order, its set has ceil(SHARE * n) - 1 shingles.
    """
    p, q = SHARE
    return (shared + F.ceil(F.greatest(na, nb) * p / q) - 1) * (p + q) >= (na + nb) * p


def common_cells(docs: DataFrame, words: int) -> np.ndarray:
    """Counts of the shingles of all rows in CELLS cells by hash, as thousandths of their binary logarithm; zero where nothing stands out.

    They only set the order in which a set's shingles become keys, so no result depends on them.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                hashes = [shingle_hashes(x, words) for x in batch["text"].iloc[at : at + ROWS]]
                n += np.bincount((np.concatenate(hashes) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        cells = np.flatnonzero(n)
        yield pd.DataFrame({"cell": cells, "n": n[cells]})

    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts, seen = observed(texts.mapInPandas(each, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells", {"total": F.sum("n")})
    total = seen["total"] or 0
    found = np.zeros(CELLS, np.uint16)
    for cell, n in counts.where(F.col("n") >= 4 + 2 * total // CELLS).collect():
        found[cell] = round(1000 * math.log2(n))
    discard(counts)
    return found


def keep_one(docs: DataFrame, words: int = 5, distance: int = 4) -> DataFrame:
    """The rows of docs less near copies: of each component the one with the smallest doc_id.

    A link is a Jaccard similarity of SHARE or more between the sets of distinct shingles of
    words, and no link is missed. Sets whose fingerprints differ in distance bits or fewer are
    candidates first, by deletion variants; what fingerprints cannot reach (sets at 0.8 differ
    in some ten bits of 64) meets by an index of shingles: two such sets share so many that
    they share one of the first n - ceil(SHARE * n) + 1 of each, in any one order of all
    shingles; those are indexed, by hash and with the common ones last. Every candidate is
    verified. Texts with equal sets are one set, told apart by 64 bits of hash; null, empty
    and blank texts are one set. A null doc_id comes last; of rows with the same identifier
    and text one stays. All columns are unchanged, whatever their names; an empty table gives
    no rows.
    """
    p, q = SHARE
    own = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.xxhash64("row.text").alias("th"))
    common = common_cells(own, words)

    def make(text):
        hashes = shingle_hashes(text, words)
        n = len(hashes)
        order = np.lexsort((hashes, common[hashes % np.uint64(CELLS)]))
        return _set_id(hashes), majority(hashes), n, hashes[order[: n - -(-n * p // q) + 1 if n else 0]].view(np.int64)

    rows = materialize(_each_text(own, ["doc_id", "th"], "sid long, fp long, n int, keys array<long>", make), "docs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th")))
    sizes = materialize(rows.groupBy("sid").agg(first.alias("first"), F.first("fp").alias("fp")), "sizes")
    index = shuffled(rows.select("sid", "n", F.explode("keys").alias("key")))
    members = sizes.join(copy_components(index, own, sizes, words, distance), "sid", "left")
    stays = members.groupBy(F.coalesce("component", "sid")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("id2"), F.col("first.th").alias("th2"))
    stays = materialize(stays, "stays")
    both = lambda df: (df["th"] == F.col("th2")) & df["doc_id"].eqNullSafe(F.col("id2"))
    repeated, n_repeated = counted(rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("id3"), F.col("th").alias("th3")), "repeated")
    # only rows that may go, or may be repeated, are shuffled with their texts
    goes, n_goes = counted(rows.select("doc_id", "th").join(stays, both(rows), "left_anti").select(_identity("doc_id", "th")), "goes")
    discard(rows, sizes)
    bits = bits_for(n_goes + n_repeated)
    held = bitmap_filter(goes.unionByName(repeated.select(_identity("id3", "th3"))), "h", bits)
    named = own.withColumn("h", _identity("doc_id", "th"))
    sure, asked = (f(named, held, F.col("h"), bits).drop("h") for f in (surely_out, maybe_in))
    # stays names a row but once; a semi-join would be planned below the filter, over all texts
    if not n_repeated:
        return sure.select("row").unionByName(asked.join(stays, both(asked)).select("row")).select("row.*")
    # only rows that repeat are compared with each other
    many = (F.col("th2") == F.col("th3")) & F.col("id2").eqNullSafe(F.col("id3"))
    one = asked.join(stays.join(repeated, many, "left_anti"), both(asked))
    some = asked.join(stays.join(repeated, many, "left_semi"), both(asked)).dropDuplicates(["doc_id", "th"])
    return sure.select("row").unionByName(one.select("row")).unionByName(some.select("row")).select("row.*")


def _identity(doc_id: str, th: str) -> Column:
    """One hash of what tells rows apart, for filters."""
    return F.xxhash64(doc_id, th).alias("h")


def alike(pairs: DataFrame, own: DataFrame, sizes: DataFrame, words: int) -> DataFrame:
    """The distinct pairs (a, b) of sets whose Jaccard similarity is SHARE or more; only texts of these sets are read."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    asked, n = counted(sizes.join(asked, "sid").select("sid", F.col("first.th").alias("th2"), _identity("first.doc_id", "first.th").alias("h2")), "asked")
    bits = bits_for(n)
    read = maybe_in(own.select(_identity("doc_id", "th"), "th", "text"), bitmap_filter(asked, "h2", bits), F.col("h"), bits)
    read = read.join(asked, (F.col("th") == F.col("th2")) & (F.col("h") == F.col("h2")))
    # texts travel, as they compress and their hashes do not
    texts = materialize(read.select("th2", "h2", "sid", F.col("text").cast("string").alias("text")).dropDuplicates(["th2", "h2"]).select("sid", "text"), "texts")
    p, q = SHARE

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            found = []
            for a, b, ta, tb in zip(*(batch[c] for c in ("a", "b", "ta", "tb")), strict=True):
                if len(held) >= ROWS:
                    held.clear()
                for sid, text in ((a, ta), (b, tb)):
                    if sid not in held:
                        held[sid] = shingle_hashes(text, words)
                ha, hb = held[a], held[b]
                shared = len(np.intersect1d(ha, hb, assume_unique=True))
                found.append(shared * (p + q) >= (len(ha) + len(hb)) * p)
            yield batch.loc[np.array(found, bool), ["a", "b"]]

    met = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    found = materialize(met.select("a", "b", "ta", "tb").mapInPandas(each, "a long, b long"), "alike")
    discard(pairs, asked, texts)
    return found


def _head_index(sizes: DataFrame, distance: int) -> DataFrame:
    whole, variants = _keys(F.col("fp"), distance)
    return shuffled(sizes.select("sid", "fp", F.explode(F.concat(whole, variants)).alias("k")).select("sid", "fp", "k.key"))


def key_heads(sizes: DataFrame, distance: int) -> DataFrame:
    """(key, b, fb): the least set of each index key that two or more share. Written, so its shuffle is gone when the index is dealt out again."""
    heads = _head_index(sizes, distance).groupBy("key").agg(F.min(F.struct("sid", "fp")).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return materialize(heads.select("key", F.col("h.sid").alias("b"), F.col("h.fp").alias("fb")), "heads")


def head_pairs(sizes: DataFrame, distance: int, heads: DataFrame | None = None) -> DataFrame:
    """(a, b) of sets whose fingerprints are near and meet in an index key: each with the least of its key."""
    met = _head_index(sizes, distance).join(key_heads(sizes, distance) if heads is None else heads, "key")
    return met.where((F.col("sid") != F.col("b")) & near(F.col("fp"), F.col("fb"), distance)).select(F.col("sid").alias("a"), "b")


def copy_components(index: DataFrame, own: DataFrame, sizes: DataFrame, words: int, distance: int) -> DataFrame:
    """(sid, component) of the sets that have a near copy.

    index has (key, sid, n); a pair is compared where both share enough keys. Links between
    near fingerprints come first. While buckets hold many pairs that are not within one
    component, each set is compared with one head of its buckets, another each round; after
    ROUNDS at most all pairs left are compared. So large groups of copies are seldom expanded
    into their pairs, and no link between components is lost.
    """
    shared = index.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("key")
    # of the index only keys that may be shared are shuffled again
    shared, n = counted(shared, "shared")
    bits = bits_for(n)
    shingled = shuffled(maybe_in(index, bitmap_filter(shared, "key", bits), F.col("key"), bits)).join(shared, "key").distinct()
    shingled = materialize(shingled, "index")
    discard(shared)
    heads = key_heads(sizes, distance)
    links = alike(head_pairs(sizes, distance, heads), own, sizes, words)
    discard(heads)
    for k in range(ROUNDS + 1):
        component = connected_components(links).toDF("sid", "component")
        parted = materialize(shingled.join(component, "sid", "left").select("key", "sid", "n", F.coalesce("component", "sid").alias("part")), "parts")
        parts = parted.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
        mixed = parts.groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("within")).where("within < c * c")
        mixed, seen = observed(mixed, "mixed", {"rows": F.sum("c"), "pairs": F.sum((F.col("c") * F.col("c") - F.col("within")) / 2)})
        if not seen["rows"]:
            return component
        last = k == ROUNDS or seen["pairs"] <= 8 * seen["rows"]
        live = parted.join(mixed.select("key"), "key")
        left = live.select("key", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa"))
        if last:
            right = live.select("key", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"))
        else:
            head = F.min(F.struct(F.xxhash64(F.lit(k), "sid"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"))).alias("h")
            right = live.groupBy("key").agg(head).select("key", "h.b", "h.nb", "h.pb")
        met = left.join(right, "key").where((F.col("pa") != F.col("pb")) & (F.col("na") * SHARE[1] >= F.col("nb") * SHARE[0]) & (F.col("nb") * SHARE[1] >= F.col("na") * SHARE[0]))
        if last:
            met = met.where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c")).where(_may_be_alike(F.col("na"), F.col("nb"), F.col("c")))
        else:
            met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        links = links.union(alike(met.select("a", "b"), own, sizes, words))
        discard(parted, mixed)
        if last:
            break
    return connected_components(links).toDF("sid", "component")


def segments(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, length) of the fewest segments, two at least, of which one differs by one bit at most."""
    n = max(2, distance // 2 + 1)
    return [(i * bits // n, (i + 1) * bits // n - i * bits // n) for i in range(n)]


def _value(fp: Column, first: int, length: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << length) - 1))


def _keys(fp: Column, distance: int) -> tuple[Column, Column]:
    """Arrays of the index keys: (value keys, variant keys with the deleted bit).

    A key holds the number of the segment and bit in its lowest byte and the value above it.
    """
    whole, variants = [], []
    for first, length in segments(distance):
        value = _value(fp, first, length)
        tag = lambda v, name: F.shiftleft(v, 8).bitwiseOR(F.lit(name))
        whole.append(tag(value, 128 + first))
        for bit in range(length):
            deleted = tag(value.bitwiseAND(F.lit(((1 << length) - 1) ^ (1 << bit))), first + bit)
            variants.append(F.struct(deleted.alias("key"), F.shiftright(value, bit).bitwiseAND(F.lit(1)).cast("byte").alias("bit")))
    whole = [F.struct(k.alias("key"), F.lit(2).cast("byte").alias("bit")) for k in whole]
    return F.array(*whole), F.array(*variants)


def near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def near_components(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, component) of distinct fingerprints linked at distance bits or fewer; component is a fingerprint."""
    distinct, n = counted(fps.select("fp").distinct(), "fps")
    # a row becomes some 66, so few rows are dealt over many tasks
    distinct = distinct.repartition(max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // EXPLODED), "fp")
    whole, variants = _keys(F.col("fp"), distance)
    index = shuffled(distinct.select("fp", F.explode(F.concat(whole, variants)).alias("k")).select("fp", "k.key", "k.bit"))

    # first pass: each bucket against its smallest fingerprint
    heads = index.groupBy("key").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = materialize(heads, "heads")
    links = index.join(heads.drop("n"), "key").where((F.col("fp") != F.col("head")) & near(F.col("fp"), F.col("head"), distance))
    first = connected_components(links.select(F.col("fp").alias("a"), F.col("head").alias("b")))
    part = distinct.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("part"))
    part = materialize(part, "parts").repartition(max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // EXPLODED), "fp")

    # second pass: what differs in component within a bucket. Large buckets that lie within one
    # component are left out first; large is well above what chance puts into a bucket
    index = shuffled(part.select("fp", "part", F.explode(F.concat(whole, variants)).alias("k")).select("fp", "part", "k.key", "k.bit"))
    by_chance = n >> (64 // len(segments(distance)) - 1)
    large = materialize(heads.where(F.col("n") >= 16 + 8 * by_chance).select("key"), "large")
    within = index.join(large, "key").groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low = high").select("key")
    index = shuffled(index.join(materialize(within, "within"), "key", "left_anti"))
    left = index.where("bit in (0, 2)").select("key", F.col("fp").alias("fa"), F.col("part").alias("a"), F.col("bit").alias("side"))
    right = index.where("bit in (1, 2)").select("key", F.col("fp").alias("fb"), F.col("part").alias("b"))
    across = left.join(right, (left["key"] == right["key"]) & (F.col("a") != F.col("b")) & ((F.col("side") == 0) | (F.col("fa") < F.col("fb"))) & near(F.col("fa"), F.col("fb"), distance))
    second = connected_components(across.select("a", "b"))
    return part.join(second.withColumnRenamed("node", "part"), "part", "left").select("fp", F.coalesce("component", "part").alias("component"))


def near_dedup(docs: DataFrame, distance: int = 4, words: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, component_id, component_size.

    component_id is the smallest doc_id reachable over links, the document's own
    included. Null, empty and blank texts have fingerprint zero and link like any
    other. A null doc_id is never the smallest unless all of the component are null.
    Repeated rows share a fingerprint and count each. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, words), "docs")
    # rows of one fingerprint are combined within each task before they meet
    sizes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "sizes")
    members = sizes.join(near_components(sizes, distance), "fp")
    per = members.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    ids = materialize(members.select("fp", "component").join(per, "component").select("fp", "component_id", "component_size"), "ids")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id", "component_size")
