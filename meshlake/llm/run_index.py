"""Repeated passages by run-length indexes (operator 9).

Each window of `least` bytes has an anchor: the place of its least hashed k-mer. Equal
windows have equal anchors at equal places, so they meet under the hash of that k-mer. The
windows of one anchor in one document are consecutive; together they span its context.
Contexts are first compared by hash: one that occurs twice repeats as a whole, and one
whose anchor occurs nowhere else repeats nowhere. What is left, each distinct context once,
is dealt out by anchor and indexed block by block: the Burrows-Wheeler transform of the
block is kept as runs with the suffix positions at the runs' ends. Streaming these samples
in text order gives the matching statistics of every position - how long a string starts
there that also starts elsewhere in the block - and those of `least` or more are marked.

An anchor with more distinct contexts than fill a block is split: its windows that reach
far to the left share the bytes left of the anchor with all their copies, the others those
to the right. Each half is dealt out anew by the hash of the shared bytes, with contexts cut
to its windows. What then is alone, or alike, needs no index; what is still too large is
halved again, until it fits a block or is single windows that are compared as a whole.

A context that a document holds more than once (text of a short period has one a byte)
repeats within the document, which marks its places at once and passes it on once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.common import text_of
from meshlake.llm.filters import bitmap_filter, bits_for, maybe_in
from meshlake.runtime import counted, materialize, observed

LEAST = 400
KMER = 48
#: Positions handled at a time; a position takes the lowest 20 bits of an anchor's rank.
STEP = 1 << 19
LOW = np.uint64((1 << 20) - 1)
#: Bytes of an index's block, and of a batch on its way to Spark. An index takes some 100 bytes a byte while it is built.
BLOCK = 1 << 20
BATCH = 8 << 20
#: Samples that are streamed at a time.
SAMPLES = 1 << 16

_ODD = 0x9E3779B97F4A7C15
KEYS = "g long, ch long, lo long, hi long, left long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Anchors of byte strings. Tables of powers are kept for the longest string so far, up to STEP."""

    def __init__(self, least: int = LEAST, kmer: int = KMER):
        if not 0 < kmer < least:
            raise ValueError("an anchor is shorter than a window")
        self.least, self.kmer, self.window = least, kmer, least - kmer + 1
        self.up = self.down = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 12)
            self.up = _powers(_ODD, n)
            self.down = _powers(pow(_ODD, -1, 1 << 64), n)

    def hashes(self, b: np.ndarray) -> np.ndarray:
        """A mixed hash of the k-mer at each position."""
        self._tables(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.down[: len(b)], out=sums[1:])
        h = (sums[self.kmer :] - sums[: -self.kmer]) * self.up[: len(b) - self.kmer + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def contexts(self, data: bytes, places: bool = False) -> tuple[np.ndarray, ...]:
        """(start, length, anchor hash, with places the anchor's place) of each context; none if data is shorter than a window."""
        n = len(data) - self.least + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * (4 if places else 3)
        b = np.frombuffer(data, np.uint8)
        out = []
        for first in range(0, n, STEP):
            windows = min(STEP, n - first)
            h = self.hashes(b[first : first + windows + self.least - 1])
            low = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
            size = 1
            while size * 2 <= self.window:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if size < self.window:
                low = np.minimum(low[: windows], low[self.window - size : self.window - size + windows])
            at = (low[:windows] & LOW).astype(np.int64)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
            ends = np.append(starts[1:], windows)
            out.append((starts + first, ends - starts + self.least - 1, h[at[starts]].view(np.int64), *([at[starts] + first] if places else [])))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


class RunIndex:
    """The run-length index of a block of strings.

    Of the transform only its runs are kept, as samples in text order: heads and ends are the
    suffix positions at the first row of each run and at the last row of the run before, and
    reach is what these two suffixes share.
    """

    def __init__(self, parts: list[bytes]):
        lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        total = int(lengths.sum() + len(parts))
        x = np.empty(total, np.int64)
        x_bytes = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        x[:] = x_bytes.astype(np.int64) + len(parts)
        # a separator of its own after each string: no match crosses it
        x[self.starts + lengths] = np.arange(len(parts))
        order, levels = self._sort(x, len(parts) + 256)
        before = x[order - 1]
        row = np.flatnonzero(before[1:] != before[:-1]) + 1
        heads, ends = order[row], order[row - 1]
        reach = self._shared(heads, ends, levels)
        by_text = np.argsort(heads)
        self.heads, self.ends, self.reach = heads[by_text], ends[by_text], reach[by_text]

    @staticmethod
    def _sort(x: np.ndarray, symbols: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by doubling, and the ranks of prefixes of each length on the way."""
        n = len(x)

        def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
            order = np.argsort(key)
            in_order = key[order]
            new = np.empty(n, np.int64)
            new[0] = 0
            np.cumsum(in_order[1:] != in_order[:-1], out=new[1:])
            rank = np.empty(n, np.int64)
            rank[order] = new
            return order, rank, bool(new[-1] == n - 1)

        order, rank, done = ranked(x)
        levels, h = [(1, rank.astype(np.int32))], 1
        while not done:
            ahead = np.full(n, -1, np.int64)
            ahead[: n - h] = rank[h:]
            order, rank, done = ranked(rank * (n + 1) + ahead + 1)
            h *= 2
            levels.append((h, rank.astype(np.int32)))
        return order, levels

    @staticmethod
    def _shared(i: np.ndarray, j: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Lengths of the common prefixes of suffixes i and j."""
        out = np.zeros(len(i), np.int64)
        for h, rank in reversed(levels):
            padded = np.append(rank, -1)
            a, b = np.minimum(i + out, len(rank)), np.minimum(j + out, len(rank))
            out += np.where(padded[a] == padded[b], h, 0)
        return out

    def statistics(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays (p, q, n) in text order: from p on, n bytes are those from q on, and no longer match starts in p's run.

        A position i between p and the next sample has the statistic n - (i - p).
        """
        for k in range(0, len(self.heads), SAMPLES):
            yield self.heads[k : k + SAMPLES], self.ends[k : k + SAMPLES], self.reach[k : k + SAMPLES]

    def marks(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, start, end): merged runs of bytes in matches of least or more, by string and start."""
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p, q, n in self.statistics():
            long = n >= least
            starts += [p[long], q[long]]
            ends += [p[long] + n[long], q[long] + n[long]]
        s, e = merged(np.concatenate(starts), np.concatenate(ends))
        part = np.searchsorted(self.starts, s, "right") - 1
        return part, s - self.starts[part], e - self.starts[part]


def merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of spans that overlap or touch, in order."""
    if not len(s):
        return s, e
    by = np.lexsort((e, s))
    s, e = s[by], e[by]
    upto = np.maximum.accumulate(e)
    first = np.flatnonzero(np.concatenate([[True], s[1:] > upto[:-1]]))
    return s[first], np.append(upto[first[1:] - 1], upto[-1])


def _hashes(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(data[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)], np.uint64).view(np.int64)


def _once(anchors: np.ndarray, contents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first place of each distinct context in a document, whether each place is of one held more than once)."""
    mixed = (anchors.view(np.uint64) * np.uint64(_ODD)) ^ contents.view(np.uint64)
    by = np.argsort(mixed, kind="stable")
    same = mixed[by[1:]] == mixed[by[:-1]]
    again = np.zeros(len(mixed), bool)
    if not same.any():
        return np.arange(len(mixed)), again
    again[by[1:][same]] = again[by[:-1][same]] = True
    return np.sort(by[np.concatenate([[True], ~same])]), again


def _anchored(docs: DataFrame, least: int, kmer: int) -> DataFrame:
    """(doc_id, th, starts, lengths, anchors, contents, ss, es): a document's distinct contexts, and what repeats within it."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Anchors(least, kmer)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                data = text.encode("utf-8")
                starts, lengths, anchors = own.contexts(data)
                contents = _hashes(data, starts, lengths)
                first, again = _once(anchors, contents)
                spans = merged(starts[again], (starts + lengths)[again])
                rows.append((starts[first], lengths[first], anchors[first], contents[first], *spans))
            out = batch[["doc_id", "th"]].copy()
            for k, name in enumerate(("starts", "lengths", "anchors", "contents", "ss", "es")):
                out[name] = [r[k] for r in rows]
            yield out

    return docs.mapInPandas(each, "doc_id string, th long, starts array<long>, lengths array<long>, anchors array<long>, contents array<long>, ss array<long>, es array<long>")


def _context_bytes(docs: DataFrame, least: int, kmer: int) -> DataFrame:
    """(g, ch, lo, hi, left, part): the bytes of the contexts, each once for a batch of documents.

    left is how many bytes of part lie before its anchor; a window that holds lo to hi of
    them lies within it.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Anchors(least, kmer)
        for batch in batches:
            held: dict[tuple[int, int], tuple[int, int, int, bytes]] = {}
            size = 0
            for text in batch["text"]:
                data = text.encode("utf-8")
                starts, lengths, anchors, places = own.contexts(data, places=True)
                contents = _hashes(data, starts, lengths)
                first, _ = _once(anchors, contents)
                for s, n, g, at, ch in zip(*(x[first].tolist() for x in (starts, lengths, anchors, places, contents)), strict=True):
                    if (g, ch) not in held:
                        # the first window has left bytes before the anchor, each next one fewer
                        held[g, ch] = (at - s - (n - least), at - s, at - s, data[s : s + n])
                        size += n
                    if size > BATCH:
                        yield frame(held)
                        held, size = {}, 0
            if held:
                yield frame(held)

    def frame(held: dict) -> pd.DataFrame:
        out = pd.DataFrame(np.array(list(held), np.int64).reshape(-1, 2), columns=["g", "ch"])
        for k, name in enumerate(("lo", "hi", "left")):
            out[name] = np.array([v[k] for v in held.values()], np.int64)
        out["part"] = [v[3] for v in held.values()]
        return out

    return docs.select("text").mapInPandas(each, f"{KEYS}, part binary")


def _halves(contexts: DataFrame, least: int, kmer: int, level: int) -> DataFrame:
    """Contexts of hot keys under two new ones, each with a half of the windows that the key stands for.

    A key stands for windows with a to b bytes before their anchor. base is where a half
    begins within the context (og, of) that it was cut from.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        width = least - kmer
        for batch in batches:
            rows = []
            for g, ch, lo, hi, left, part, a, b in zip(*(batch[c] for c in ("g", "ch", "lo", "hi", "left", "part", "a", "b")), strict=True):
                middle = (a + b + 1) // 2
                for u, v in ((a, middle - 1), (middle, b)):
                    x, y = max(lo, u), min(hi, v)
                    if u > v or x > y:
                        continue
                    # every window of this half holds u bytes before the anchor and width - v after it
                    core = part[left - u : left + kmer + width - v]
                    key = xxhash.xxh64_intdigest(core, seed=level + 1) ^ (g & (1 << 64) - 1) ^ (u << 32 | v)
                    # what its windows cover
                    begin, end = left - y, left + kmer + width - x
                    cut = part[begin:end]
                    rows.append((key, xxhash.xxh64_intdigest(cut), x, y, y, cut, u, v, begin, ch, g))
            out = pd.DataFrame(rows, columns=["g", "ch", "lo", "hi", "left", "part", "a", "b", "base", "of", "og"])
            for c in ("g", "ch"):
                out[c] = np.array(out[c].tolist(), np.uint64).view(np.int64)
            yield out

    return contexts.select("g", "ch", "lo", "hi", "left", "part", "a", "b").mapInPandas(each, f"{KEYS}, part binary, a long, b long, base long, of long, og long")


def _indexed(contents: DataFrame, least: int) -> DataFrame:
    """(g, ch, s, e) of marked bytes within each context, from indexes of whole anchors a block."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        index = RunIndex(rows["part"].tolist())
        part, s, e = index.marks(least)
        return pd.DataFrame({"g": rows["g"].to_numpy()[part], "ch": rows["ch"].to_numpy()[part], "s": s, "e": e})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while held["part"].map(len).sum() > 2 * BLOCK:
                upto = int(np.searchsorted(held["part"].map(len).cumsum().to_numpy(), BLOCK)) + 1
                g = held["g"].to_numpy()
                border = np.flatnonzero(np.diff(g)) + 1
                later = border[border >= upto]
                if not len(later):
                    break
                yield block(held.iloc[: later[0]])
                held = held.iloc[later[0] :].reset_index(drop=True)
        if held is not None and len(held):
            yield block(held)

    return contents.repartition("g").sortWithinPartitions("g").mapInPandas(each, "g long, ch long, s long, e long")


def _marks(contents: DataFrame, least: int, kmer: int, block: int, level: int = 0) -> DataFrame:
    """(g, ch, s, e) of marked bytes within each context; contents has each distinct one of a key once."""
    sizes = contents.groupBy("g").agg(F.sum(F.length("part")).alias("bytes"))
    hot, n = counted(sizes.where(F.col("bytes") > block).select("g"), "hot")
    if not n:
        return _indexed(contents.select("g", "ch", "part"), least)
    found = _indexed(contents.join(hot, "g", "left_anti").select("g", "ch", "part"), least)
    halves = materialize(_halves(contents.join(hot, "g", "left_semi"), least, kmer, level), "halves")
    groups = halves.groupBy("g").agg(F.min("ch").alias("low"), F.max("ch").alias("high")).where("low < high").select("g")
    twice = halves.groupBy("g", "ch").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g", "ch")
    deeper = halves.groupBy("g", "ch").agg(F.first(F.struct("lo", "hi", "left", "part", "a", "b")).alias("x")).join(groups, "g", "left_semi")
    inner = _marks(materialize(deeper.select("g", "ch", "x.*"), "contents"), least, kmer, block, level + 1)
    at = halves.select("g", "ch", "og", "of", "base", F.length("part").alias("n"))
    whole = at.join(twice, ["g", "ch"], "left_semi").select(F.col("og").alias("g"), F.col("of").alias("ch"), F.col("base").alias("s"), (F.col("base") + F.col("n")).alias("e"))
    some = at.join(inner, ["g", "ch"]).select(F.col("og").alias("g"), F.col("of").alias("ch"), (F.col("base") + F.col("s")).alias("s"), (F.col("base") + F.col("e")).alias("e"))
    return found.unionByName(whole).unionByName(some)


def _cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each document without the bytes of its spans."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            rows = []
            for text, starts, ends in zip(batch["text"], batch["ss"], batch["es"], strict=True):
                data = text.encode("utf-8")
                gone = merged(starts, ends) if starts is not None else (np.zeros(0, np.int64),) * 2
                gone = [x.tolist() for x in gone]
                digest, at = hashlib.sha256(), 0
                for s, e in zip(*gone, strict=True):
                    digest.update(data[at:s])
                    at = e
                digest.update(data[at:])
                rows.append((len(data), sum(gone[1]) - sum(gone[0]), *gone, digest.hexdigest()))
            out = batch[["doc_id"]].copy()
            for k, name in enumerate(("n_bytes", "n_removed", "starts", "ends", "kept_sha256")):
                out[name] = [r[k] for r in rows]
            yield out

    own = spans.withColumnsRenamed({"doc_id": "id2", "th": "th2"})
    both = docs.join(own, (docs["th"] == own["th2"]) & docs["doc_id"].eqNullSafe(own["id2"]), "left").select("doc_id", "text", "ss", "es")
    return both.mapInPandas(each, "doc_id string, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string")


def repeated_passages(docs: DataFrame, least: int = LEAST, kmer: int = KMER, block: int = BLOCK, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, starts, ends, kept_sha256.

    starts and ends are the maximal runs of bytes that lie in a string of least bytes
    starting at two places or more, in one document or several; kept_sha256 is of the
    bytes that remain. Strings do not cross documents and are judged on the input. Null
    counts as empty; texts shorter than least keep all. Repeated rows are documents of
    their own and so repeat each other. Null identifiers are allowed, other columns are
    ignored, and an empty table gives no rows. block bounds the bytes of one anchor's
    index. Contexts are told apart by 64 bits of hash within an anchor's 64.
    """
    kind = docs.schema[doc_id].dataType
    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), text_of(text).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    anchored = materialize(_anchored(own, least, kmer), "anchors")
    places = anchored.select("doc_id", "th", F.explode(F.arrays_zip("starts", "lengths", "anchors", "contents")).alias("c")).select("doc_id", "th", F.col("c.starts").alias("at"), F.col("c.lengths").alias("len"), F.col("c.anchors").alias("g"), F.col("c.contents").alias("ch"))
    within = anchored.select("doc_id", "th", F.explode(F.arrays_zip(F.col("ss").alias("s"), F.col("es").alias("e"))).alias("x"))
    groups = places.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("ch").alias("low"), F.max("ch").alias("high")).where("n > 1")
    alike = F.col("low") == F.col("high")
    groups, seen = observed(groups.select("g", alike.alias("alike")), "groups", {"mixed": F.count_if(~F.col("alike"))})
    shared = materialize(places.join(groups, "g"), "places")
    mixed = groups.where("not alike").select("g")
    bits = bits_for(seen["mixed"] or 0)
    bloom = bitmap_filter(mixed.select(F.xxhash64("g").alias("h")), "h", bits)
    likely = maybe_in(_context_bytes(own, least, kmer), bloom, F.xxhash64("g"), bits)
    contents = likely.groupBy("g", "ch").agg(F.first(F.struct("lo", "hi", "left", "part")).alias("x")).join(mixed, "g", "left_semi")
    contents = materialize(contents.select("g", "ch", "x.*", F.lit(0).cast("long").alias("a"), F.lit(least - kmer).cast("long").alias("b")), "contents")
    marks = _marks(contents, least, kmer, block).groupBy("g", "ch").agg(F.collect_set(F.struct("s", "e")).alias("m"))
    marks = materialize(marks, "marks")

    differing = shared.where("not alike")
    again = differing.groupBy("g", "ch").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "ch")
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e")).alias("x")
    full = span(F.col("at"), F.col("at") + F.col("len"))
    whole = shared.where("alike").select("doc_id", "th", full)
    whole = whole.unionByName(differing.join(again, ["g", "ch"], "left_semi").select("doc_id", "th", full))
    some = differing.join(marks, ["g", "ch"]).select("doc_id", "th", "at", F.explode("m").alias("y")).select("doc_id", "th", span(F.col("at") + F.col("y.s"), F.col("at") + F.col("y.e")))
    # a document's own places: at most one a byte of it
    spans = whole.unionByName(some).unionByName(within).groupBy("doc_id", "th").agg(F.collect_set("x").alias("x"))
    spans = materialize(spans.select("doc_id", "th", F.col("x.s").alias("ss"), F.col("x.e").alias("es")), "spans")
    return _cut(own, spans).withColumn("doc_id", F.col("doc_id").cast(kind))
