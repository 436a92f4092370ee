"""Secret scans by a trigram inverted index (operator 7).

From each rule's regular expression a Boolean query over trigrams is derived: every match
must hold the trigrams of one of its alternatives. The documents of a batch are indexed
once: each trigram that some rule asks for gets the posting list of the documents that
hold it. A rule's query intersects and unites posting lists; only those candidates are
scanned with its expression. Rules without mandatory trigrams scan every document. The
index lives as long as its batch, so memory is bounded by a batch's texts, nothing is
shuffled, and a lost executor costs its batches alone.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and what a match must have to count.

    A match counts if group group has at least least characters. Letters written in
    lower case within (?i:...) match in either case, ASCII only.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: What the scan finds beyond them.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"(sk|rk)_live_[A-Za-z0-9]+", 0, 24),
)
#: A trigram query: alternatives, each a set of trigrams that all occur. An empty alternative asks for nothing.
Query = frozenset[frozenset[bytes]]
#: An expression with more literal forms than this counts as having no exact set.
MOST_EXACT = 64


def _grams(s: bytes) -> frozenset[bytes]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> Query:
    """The Boolean query that every match of the pattern satisfies, over lower-cased ASCII.

    Literal runs are followed exactly through sequences, groups, small classes and
    alternatives; whatever has no bounded set of literal forms ends a run.
    """
    anything: set[bytes] | None = None

    def literal(code: int) -> set[bytes]:
        return {chr(code).encode("utf-8").lower()}

    def exact(node) -> set[bytes] | None:
        """All lower-cased strings that the node matches, or None."""
        op, arg = node
        if op is rc.LITERAL:
            return literal(arg)
        if op is rc.IN:
            found: set[bytes] = set()
            for kind, value in arg:
                if kind is rc.LITERAL:
                    found |= literal(value)
                elif kind is rc.RANGE and value[1] - value[0] < MOST_EXACT:
                    found |= {x for c in range(value[0], value[1] + 1) for x in literal(c)}
                else:
                    return anything
            return found if len(found) <= MOST_EXACT else anything
        if op is rc.SUBPATTERN:
            return sequence(arg[-1])
        if op is rc.BRANCH:
            parts = [sequence(p) for p in arg[1]]
            return anything if any(p is None for p in parts) else set().union(*parts)
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] <= 4:
            once = sequence(arg[2])
            if once is None:
                return anything
            found, power = set(), {b""}
            for n in range(arg[1] + 1):
                found |= power if n >= arg[0] else set()
                power = {a + b for a in power for b in once}
                if len(found) + len(power) > MOST_EXACT * 4:
                    return anything
            return found
        if op is rc.AT:
            return {b""}
        return anything

    def sequence(nodes) -> set[bytes] | None:
        runs = {b""}
        for node in nodes:
            own = exact(node)
            if own is None or len(runs) * len(own) > MOST_EXACT * 4:
                return anything
            runs = {a + b for a in runs for b in own}
        return runs

    def of_runs(runs: set[bytes]) -> Query:
        return frozenset(_grams(r) for r in runs)

    def both(a: Query, b: Query) -> Query:
        return frozenset(x | y for x in a for y in b)

    everything: Query = frozenset([frozenset()])

    def query(nodes) -> Query:
        """Conjunction over the runs of a sequence and what lies within its other parts."""
        out, runs = everything, {b""}
        for node in nodes:
            own = exact(node)
            if own is not None and len(runs) * len(own) <= MOST_EXACT * 4:
                runs = {a + b for a in runs for b in own}
                continue
            op, arg = node
            inner = everything
            if op is rc.SUBPATTERN:
                inner = query(arg[-1])
            elif op is rc.BRANCH:
                inner = frozenset().union(*[query(p) for p in arg[1]])
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
                inner = query(arg[2])
            out, runs = both(both(out, of_runs(runs)), inner), {b""}
        out = both(out, of_runs(runs))
        if len(out) > 256:
            return everything
        # an alternative that asks for more than another is covered by it
        return frozenset(a for a in out if not any(b < a for b in out))

    return query(rp.parse(pattern))


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Spans of the rule, leftmost and non-overlapping; matches that are too short use up their place."""
    return [m.span() for m in compiled.finditer(text) if len(m.group(rule.group)) >= rule.least]


class Scanner:
    """The rules compiled: expressions, trigram queries and the table of trigrams asked for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.grams = sorted({g for q in self.queries for alternative in q for g in alternative})
        self.number = {g: i + 1 for i, g in enumerate(self.grams)}
        self.table = np.zeros(1 << 24, np.uint8 if len(self.grams) < 255 else np.uint16)
        for g, i in self.number.items():
            self.table[int.from_bytes(g, "big")] = i

    def postings(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each trigram asked for, the sorted numbers of the texts that hold it."""
        found: list[list[int]] = [[] for _ in range(len(self.grams) + 1)]
        for n, text in enumerate(texts):
            if len(text) < 3:
                continue
            b = np.frombuffer(text.lower(), np.uint8)
            hits = np.zeros(len(self.grams) + 1, bool)
            for k in range(0, len(b) - 2, 1 << 20):
                part = b[k : k + (1 << 20) + 2].astype(np.uint32)
                hits[self.table[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]] = True
            for g in np.flatnonzero(hits):
                found[g].append(n)
        return [np.array(x, np.int64) for x in found]

    def candidates(self, q: Query, postings: list[np.ndarray], n: int) -> np.ndarray:
        if any(not alternative for alternative in q):
            return np.arange(n)
        parts = []
        for alternative in q:
            lists = sorted((postings[self.number[g]] for g in alternative), key=len)
            own = lists[0]
            for other in lists[1:]:
                own = np.intersect1d(own, other, assume_unique=True)
            parts.append(own)
        return np.unique(np.concatenate(parts)) if parts else np.arange(0)

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end), by start and then rule."""
        whole = [t or "" for t in texts]
        postings = self.postings([t.encode("utf-8") for t in whole])
        spans: list[list[tuple[int, int, int]]] = [[] for _ in whole]
        for k, (rule, compiled, q) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            for n in self.candidates(q, postings, len(whole)).tolist():
                spans[n].extend((s, k, e) for s, e in matches(rule, compiled, whole[n]))
        return [sorted(x) for x in spans]


SPANS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans): the spans array of each row, by start and then by the rules' order.

    Positions count code points, ends are exclusive. Null and empty texts have no spans.
    A null doc_id stays null, repeated rows are scanned each, other columns are ignored
    and an empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(rules)
        for batch in batches:
            found = scanner.scan(batch["text"].tolist())
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInPandas(each, SPANS).withColumn("doc_id", F.col("doc_id").cast(kind))
