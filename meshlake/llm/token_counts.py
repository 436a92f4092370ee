"""Token counts by a compiled finite-state tokenizer (operator 6).

Merging by rank has this property: a sequence of tokens is the encoding of its text if
and only if each two neighbours are the encoding of theirs. So after each character the
last token of the encoding so far is settled by the tokens that were last a few characters
before. A state holds the last characters, the last token at each of them and the counts
relative to now; both are bounded by the longest piece, so the states are finite in number
and each character leads to one state. A transition is annotated with the tokens that it
adds (a merge may take some away). States and transitions are compiled when they are first
met, up to a bound, after which the tables start afresh; whole units between cutting
points are kept as macro transitions in the same way.

A text is processed in chunks. Characters at which no piece crosses reset the state, so a
chunk's map from any entry state is: what it does up to its first reset, a count, and the
state that it starts after its last reset. Such maps compose associatively and are combined
pairwise in a tree, as a parallel prefix scan does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.pieces import Generations, Vocabulary, default_model, vocabulary
from meshlake.runtime import worker_cache

#: Bounds of what a worker keeps compiled.
MOST_STATES = 200_000
MOST_UNITS = 400_000
#: Units longer than this are run through the transitions each time.
LONG_UNIT = 64
CHUNK = 1 << 16


class Transducer:
    """Transitions (state, character) to (state, tokens added), compiled on demand.

    A state is (the last characters, the borders before or between them from which a piece
    may still reach beyond now, the last token at each, the tokens up to each counted back
    from now). At the border where a unit starts there is no token. Borders that no longer
    matter are left out, so words that end alike share their states.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.units = _Units(self)
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.start = self.number(("", (0,), (None,), (0,)))

    def number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[state]

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by its merges: best score first, leftmost of equals."""
        parts, scores = list(text), self.vocab.scores
        while True:
            options = [(scores[joined], -i) for i in range(len(parts) - 1) if (joined := parts[i] + parts[i + 1]) in scores]
            if not options:
                return parts
            at = -max(options)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, token: str) -> bool:
        """Whether the token is its own encoding; a character always is."""
        if token not in self.whole:
            self.whole[token] = len(token) == 1 or (token in self.vocab.ids and self.merged(token) == [token])
            if len(self.whole) > 4 * MOST_STATES:
                self.whole = {}
                return self.stands(token)
        return self.whole[token]

    def follow(self, left: str, right: str) -> bool:
        """Whether the two tokens are the encoding of their text."""
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) > 4 * MOST_STATES:
                self.pairs = {}
            self.pairs[key] = self.merged(left + right) == [left, right]
        return self.pairs[key]

    def weight(self, token: str) -> int:
        """One, or a token for each byte of a character that no piece covers."""
        return 1 if token in self.vocab.ids else len(token.encode("utf-8"))

    def compile(self, number: int, c: str) -> tuple[int, int]:
        chars, borders, last, back = self.states[number]
        chars += c
        for border, before, behind in zip(borders, last, back, strict=True):
            token = chars[border:]
            if self.stands(token) and (before is None or self.follow(before, token)):
                break
        else:
            raise AssertionError("no token ends here")
        added = behind + self.weight(token)
        alive = [(b, t, n - added) for b, t, n in zip(borders, last, back, strict=True) if chars[b:] in self.vocab.prefixes]
        alive.append((len(chars), token, 0))
        first = alive[0][0]
        state = (chars[first:], tuple(b - first for b, _, _ in alive), tuple(t for _, t, _ in alive), tuple(n for _, _, n in alive))
        if len(self.states) > MOST_STATES:
            self.reset()
            return self.number(state), added
        self.steps[number][c] = found = (self.number(state), added)
        return found

    def run(self, unit: str) -> int:
        """Tokens of a unit, stepping from the start state."""
        state, total = self.start, 0
        for c in unit:
            state, added = self.steps[state].get(c) or self.compile(state, c)
            total += added
        return total

    def chunk(self, text: str) -> tuple[str, int, str | None]:
        """The map of a chunk: (what comes before its first reset, tokens between, what its last reset starts).

        A chunk without a reset is (text, 0, None).
        """
        units = self.vocab.units(text)
        if len(units) < 2:
            return text, 0, None
        first = units[0]
        return first, sum(map(self.units.__getitem__, units[1:-1])), units[-1]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two adjacent chunks; this is associative."""
        if a[2] is None:
            head = a[0] + b[0]
            # the border may itself be a reset
            cut = self.vocab.units(head)
            if len(cut) < 2:
                return head, b[1], b[2]
            if b[2] is None:
                return cut[0], sum(map(self.units.__getitem__, cut[1:-1])), cut[-1]
            return cut[0], sum(map(self.units.__getitem__, cut[1:])) + b[1], b[2]
        cut = self.vocab.units(a[2] + b[0])
        if b[2] is None:
            return a[0], a[1] + sum(map(self.units.__getitem__, cut[:-1])), cut[-1]
        return a[0], a[1] + sum(map(self.units.__getitem__, cut)) + b[1], b[2]

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        """Tokens of a whole text: the maps of its chunks, combined pairwise."""
        normal = self.vocab.normalize(text)
        if len(normal) <= chunk:
            return sum(map(self.units.__getitem__, self.vocab.units(normal)))
        maps = [self.chunk(normal[i : i + chunk]) for i in range(0, len(normal), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, between, tail = maps[0]
        return self.units[head] + between + (self.units[tail] if tail is not None else 0)


class _Units(Generations):
    """Macro transitions: the tokens of whole units met before."""

    def __init__(self, owner: Transducer):
        super().__init__(MOST_UNITS)
        self.owner = owner

    def make(self, key: str) -> int:
        return self.owner.run(key)

    def keeps(self, key: str) -> bool:
        return len(key) <= LONG_UNIT


def transducer(model: str) -> Transducer:
    cache = worker_cache()
    key = f"transducer:{model}"
    if key not in cache:
        cache[key] = Transducer(vocabulary(model))
    return cache[key]


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the model's own library for the whole text, without begin and
    end tokens. model is a path that holds on every executor. Null counts as empty, which
    has no tokens. A null doc_id stays null, repeated rows are counted each, other columns
    are ignored and an empty table gives no rows.
    """
    path = model or default_model()
    kind = docs.schema[doc_id].dataType

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = transducer(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": [counter.count(t) for t in batch["text"]]})

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    counted = own.mapInPandas(each, "doc_id string, n_bytes long, n_tokens long")
    return counted.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("over_limit", F.col("n_tokens") > limit)
