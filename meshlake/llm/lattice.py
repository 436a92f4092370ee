"""SentencePiece encoding and decoding by N-best segmentation of the piece lattice (operator 4).

The identifiers of a text are the library's own. Beside them come its n best segmentations
over the lattice of pieces. A unit of text has an edge for each piece that fits, scored by
the model (a merge model's ranks count as logarithms of Zipf's law), and one for each
character that no piece covers. A forward Viterbi pass gives each position the best score of
any path to it; a backward A* search from the end uses these scores as its heuristic. As
they are exact, paths leave the search in order of their score, and the first n are the n
best. No piece crosses the border of two units, so the best path of a text is that of its
units, and its next best ones change the units whose own next paths lose least; all n are
given with their identifiers. Units that repeat are solved once a worker, within a bound,
and short ones of like length are searched side by side. Edges of a
long unit are walked anew where the search stands, so it takes a few numbers a character.
"""

from __future__ import annotations

import heapq
import itertools
import operator
from array import array
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.pieces import MILLION, SPACE, Vocabulary, default_model, vocabulary
from meshlake.runtime import worker_cache

#: What a character without a piece costs below the worst piece.
UNKNOWN_PENALTY = 10 * MILLION
MOST_UNITS = 500_000
MOST_IDS = 8_000_000
#: Below any score.
LOWEST = -(1 << 62)
#: What stands for a unit that has no other path.
NEVER = np.iinfo(np.int64).max
#: Above what any place of a search loses; more can be added.
CLOSED = np.int64(1 << 61)
#: Rows handled at a time, so that a worker holds few texts and paths.
ROWS = 256
#: Units longer than this are solved without holding their edges.
LONG_UNIT = 64

#: Characters that the tables of the walk hold, and units that are walked at a time.
ALPHABET, WALKED = 256, 4096
#: The greatest lengths of units that are walked together.
CLASSES = np.array([3, 5, 7, 9, 12, 16, 21, 28, 37, 49, 64])

#: A path: score in millionths and identifiers.
Path = tuple[int, tuple[int, ...]]
#: A next path of a text by its best one: again and again a place in it, how many pieces from there, and identifiers behind them.
Parts = list[tuple[int, int, np.ndarray]]


class Walk:
    """The trie of pieces as tables, in which units of like length are walked at once.

    It knows the ALPHABET - 1 characters most in use that are pieces; units with others are left to n_paths.
    Rows of letters end in zeros where a unit is shorter than the longest beside it.
    """

    def __init__(self, vocab: Vocabulary, trie: dict):
        uses = Counter("".join(vocab.ids))
        letters = [c for c, _ in uses.most_common() if c in vocab.ids and c != "\0"][: ALPHABET - 1]
        own = {c: k + 1 for k, c in enumerate(letters)}
        self.letter = np.zeros(0x110000, np.uint8)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        # node 0 is no node, node 1 the root
        nodes, steps = [{}, trie], []
        for at, node in enumerate(nodes):
            for c, below in node.items():
                if c in own:
                    steps.append((at, own[c], len(nodes)))
                    nodes.append(below)
        self.next = np.zeros((len(nodes), ALPHABET), np.uint16 if len(nodes) < 1 << 16 else np.int32)
        if steps:
            x, y, to = np.array(steps).T
            self.next[x, y] = to
        pieces = [node.get("", (LOWEST, (-1,))) for node in nodes]
        self.score = np.array([x[0] for x in pieces], np.int64)
        self.piece = np.array([x[1][0] for x in pieces], np.int32)
        self.longest = vocab.longest

    def known(self, letters: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """The rows whose letters, as many as sizes says or all, are known."""
        return (letters > 0).sum(axis=1) == (letters.shape[1] if sizes is None else sizes)

    def letters(self, units: list[str]) -> np.ndarray:
        """A row of letters for each of some units."""
        longest = max(map(len, units))
        joined = "".join([u.ljust(longest, "\0") for u in units])
        return self.letter[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].reshape(len(units), -1)

    def forward(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best scores of any path to each position, pieces by end and length less 1, or -1) of each row."""
        rows, length = letters.shape
        best = np.full((rows, length + 1), LOWEST, np.int64)
        best[:, 0] = 0
        into = np.full((rows, length + 1, min(length, self.longest)), -1, np.int32)
        for start in range(length):
            row, node = np.arange(rows), np.ones(rows, np.int32)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                node = self.next[node, letters[row, end - 1]]
                alive = node > 0
                row, node = row[alive], node[alive]
                if not len(row):
                    break
                hit = self.piece[node] >= 0
                at, own = row[hit], node[hit]
                into[at, end, end - start - 1] = own
                best[at, end] = np.maximum(best[at, end], best[at, start] + self.score[own])
        return best, into

    def n_best(self, letters: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n best scores, LOWEST where there are fewer; identifiers of all their paths, one after another; how many each has) of each row.

        The search of n_paths in all rows at once: a round takes each row's first open place.
        Places are ordered by what they lose and by position, in one number; of equal ones the older goes first.
        """
        rows, length = letters.shape
        best, into = self.forward(letters)
        places, back = length + 1, np.arange(1, into.shape[2] + 1)
        # what an edge adds to that number: by how much it misses the best score of its end, and the way back
        added = best[:, :, None] - best[:, np.maximum(np.arange(places)[:, None] - back, 0)] - self.score[into]
        added = np.where(into >= 0, added * places - back, CLOSED)
        scores, last = np.full((rows, n), LOWEST, np.int64), np.full((rows, n), -1, np.int64)
        # links are (node of the trie, next link); the search goes backward, so they lead from the first piece to the last
        order, link = np.full((rows, n), CLOSED), np.full((rows, n), -1, np.int64)
        order[:, 0] = lengths
        top = best[np.arange(rows), lengths]
        links, n_links, found, row = [], 0, np.zeros(rows, np.int64), np.arange(rows)
        while len(row):
            at, first = order[:, 0] % places, link[:, 0]
            done = np.flatnonzero(at == 0)
            ended = row[done]
            scores[ended, found[ended]], last[ended, found[ended]] = top[ended] - order[done, 0] // places, first[done]
            found[ended] += 1
            # no edge ends at position 0, so that place goes and none comes
            open_ = np.concatenate([order[:, 1:], order[:, :1] + added[row, at]], axis=1)
            keep = np.argsort(open_, axis=1, kind="stable")[:, :n]
            of = np.arange(len(row))[:, None]
            order, link = open_[of, keep], link[of, np.minimum(keep + 1, n - 1)]
            x, y = np.nonzero((keep >= n - 1) & (order < CLOSED))
            links.append((into[row[x], at[x], keep[x, y] - (n - 1)], first[x]))
            link[x, y] = n_links + np.arange(len(x))
            n_links += len(x)
            go = (found[row] < n) & (order[:, 0] < CLOSED)
            if not go.all():
                row, order, link = row[go], order[go], link[go]
        node, following = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.empty(0, np.int32), np.empty(0, np.int64))
        ids, sizes = np.zeros((rows * n, length), np.int32), np.zeros(rows * n, np.int64)
        path = np.flatnonzero(last.ravel() >= 0)
        at = last.ravel()[path]
        while len(path):
            ids[path, sizes[path]] = self.piece[node[at]]
            sizes[path] += 1
            at = following[at]
            path, at = path[at >= 0], at[at >= 0]
        return scores, ids[np.arange(length) < sizes[:, None]], sizes.reshape(rows, n)


class Segmenter:
    def __init__(self, vocab: Vocabulary, n_best: int):
        if n_best < 1:
            raise ValueError("n_best is at least 1")
        self.vocab, self.n_best = vocab, n_best
        self.solved = _Solved(self)
        # pieces from their first character on, and from their last
        self.trie: dict = {}
        self.back: dict = {}
        for name, i in vocab.ids.items():
            for root, spelt in ((self.trie, name), (self.back, name[::-1])):
                node = root
                for c in spelt:
                    node = node.setdefault(c, {})
                node[""] = (vocab.log_scores[name], (i,))
        self.unknown = min(vocab.log_scores.values()) - UNKNOWN_PENALTY
        self.walk = Walk(vocab, self.trie)

    def forward(self, unit: str) -> list[int]:
        """The best score of any path to each position; positions are settled in order."""
        return self.lattice(unit, None)

    def lattice(self, unit: str, ending: list[list] | None) -> list[int]:
        """forward; to the list of each position the edges (start, (score, identifiers)) are added that end there, longer ones first."""
        trie, single, unknown = self.trie, self.vocab.ids, self.unknown
        best = [0] + [LOWEST] * len(unit)
        for start, first in enumerate(unit):
            base, node, end = best[start], trie, start
            if first not in single:
                if ending is not None:
                    ending[start + 1].append((start, (unknown, self._bytes(first))))
                if base + unknown > best[start + 1]:
                    best[start + 1] = base + unknown
            for c in unit[start : start + self.vocab.longest]:
                node = node.get(c)
                if node is None:
                    break
                end += 1
                piece = node.get("")
                if piece is not None:
                    if ending is not None:
                        ending[end].append((start, piece))
                    total = base + piece[0]
                    if total > best[end]:
                        best[end] = total
        return best

    def _bytes(self, character: str) -> tuple[int, ...]:
        return tuple(self.vocab.byte_ids[b] for b in character.encode("utf-8"))

    def into(self, unit: str, end: int) -> list[tuple[int, tuple[int, tuple[int, ...]]]]:
        """The edges (start, (score, identifiers)) that end at a position, longer ones first."""
        node, out, known = self.back, [], False
        for start in range(end - 1, -1, -1):
            node = node.get(unit[start])
            if node is None:
                break
            if (piece := node.get("")) is not None:
                known = known or start == end - 1
                out.append((start, piece))
        if not known:
            out.insert(0, (end - 1, (self.unknown, self._bytes(unit[end - 1]))))
        out.reverse()
        return out

    def n_paths(self, unit: str) -> list[Path]:
        """The n best paths, best first; of equal ones those met first, longer pieces before shorter.

        Every place of the search can be completed with just the score that it is ordered by,
        and no two lead to the same path. So of the open places only as many as paths are
        still wanted can matter, and the search never holds more.
        """
        if len(unit) <= LONG_UNIT:
            ending: list[list] = [[] for _ in range(len(unit) + 1)]
            best, into = self.lattice(unit, ending), ending.__getitem__
        else:
            # of a long unit no edges are held
            best, into = array("q", self.forward(unit)), lambda at: self.into(unit, at)
        want, pushed, found = self.n_best, 0, []
        # (minus what a completed path can reach, position, number, score behind it, path behind it);
        # of equal paths the one nearest to its end goes first, so that equals are not searched in breadth
        open_: list[tuple] = [(-best[-1], len(unit), 0, 0, None)]
        while open_ and len(found) < want:
            _, at, _, behind, path = open_.pop(0)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                found.append((behind, tuple(ids)))
                continue
            wanted = want - len(found)
            for start, (score, own) in into(at):
                score += behind
                cost = -best[start] - score
                if len(open_) >= wanted:
                    if cost > open_[-1][0]:
                        continue
                    pushed += 1
                    insort(open_, (cost, start, pushed, score, (own, path)))
                    del open_[wanted:]
                else:
                    pushed += 1
                    insort(open_, (cost, start, pushed, score, (own, path)))
        return found

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """(the library's identifiers, those of the best segmentation, scores of the n best) of a whole text."""
        library, best, _, scores = self.encode_all([text])[0]
        return library, best, scores

    def encode_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, list[Parts], list[float]]]:
        """(the library's identifiers, those of the best segmentation, the next of the n best by it, scores of all n) of each of some texts.

        Units are looked up one by one, what they stand for is gathered at once.
        """
        own = self.solved
        own.make_room()
        units = [self.vocab.units(self.vocab.normalize(t)) for t in texts]
        ends = np.cumsum([0, *map(len, units)])
        try:
            at = np.fromiter(map(own.__getitem__, itertools.chain.from_iterable(units)), np.int64, ends[-1])
            own.learn()
        except BaseException:
            # no unit keeps a number without what it stands for
            own.renew()
            raise
        upto = np.concatenate([[0], np.cumsum(_view(own.score)[at])])
        score = (upto[ends[1:]] - upto[ends[:-1]]).tolist()
        (library, _), (best, places) = (own.gather(at, ends, column) for column in (own.library, own.lattice))
        losses = _view(own.losses).reshape(len(own), self.n_best - 1)
        out = []
        for k, (s, e) in enumerate(itertools.pairwise(ends.tolist())):
            changed = self._changed(losses[at[s:e], 0]) if self.n_best > 1 else []
            lost = losses[at[s + np.array(changed, np.int64)]].tolist()
            sums = self._next_best([[y for y in x if y != NEVER] for x in lost])
            begin = int(places[s])
            following = []
            for _, choices in sums[1:]:
                parts, upon = [], begin
                for i, choice in zip(changed, choices, strict=True):
                    if choice:
                        parts.append((upon - begin, int(places[s + i]) - upon, own.path(int(at[s + i]), choice)))
                        upon = int(places[s + i + 1])
                following.append([*parts, (upon - begin, int(places[e]) - upon, best[k][:0])])
            out.append((library[k], best[k], following, [(score[k] - x) / MILLION for x, _ in sums]))
        return out

    def _changed(self, loss: np.ndarray) -> list[int]:
        """The n-1 units whose next choice loses least, in their order; of equal ones the later.

        Only they can differ from their best in the first n sums: each alone makes a sum that
        is no worse than any with another unit's next choice.
        """
        most = self.n_best - 1
        if len(loss) <= most:
            return np.flatnonzero(loss < NEVER).tolist()
        bound = np.partition(loss, most - 1)[most - 1]
        under = np.flatnonzero(loss < bound)
        equal = np.flatnonzero(loss == bound)[len(under) - most :] if bound < NEVER else []
        return sorted([*under.tolist(), *map(int, equal)])

    def _next_best(self, losses: list[list[int]]) -> list[tuple[int, tuple[int, ...]]]:
        """The n least sums of one choice for each unit, 0 or what a next one loses, with the choices; equal ones as in n_encodings."""
        sums: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        for own in losses:
            sums = heapq.nsmallest(self.n_best, [(s + x, (*c, k)) for s, c in sums for k, x in enumerate((0, *own))], key=operator.itemgetter(0))
        return sums

    def n_encodings(self, text: str | None) -> list[tuple[int, list[int]]]:
        """The n best segmentations of a text, with identifiers; scores are in millionths."""
        units = self.vocab.units(self.vocab.normalize(text))
        out: list[tuple[int, tuple]] = [(0, ())]
        for unit in units:
            paths = self.n_paths(unit)
            out = heapq.nlargest(self.n_best, [(a + s, (b, p)) for a, b in out for s, p in paths], key=lambda x: x[0])

        def flat(node) -> list[int]:
            parts = []
            while node:
                parts.append(node[1])
                node = node[0]
            return [i for p in reversed(parts) for i in p]

        return [(s, flat(node)) for s, node in out]


def _view(column: array) -> np.ndarray:
    """The numbers of an array without a copy; it must be gone before the array grows."""
    return np.frombuffer(column, np.int32 if column.typecode == "i" else np.int64) if column else np.empty(0, np.int64)


class _Solved(dict):
    """For each unit a number, under which its best score, next losses and the identifiers of all its paths are kept.

    What its next paths lose stands in n_best - 1 places, NEVER where it has fewer. Its paths
    stand one after another, and how many pieces the next ones have in places like those. All starts
    afresh when there are MOST_UNITS units or identifiers of MOST_IDS, between slices.
    """

    def __init__(self, owner: Segmenter):
        super().__init__()
        self.owner = owner
        self.renew()

    def renew(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.score, self.losses, self.next_sizes = array("q"), array("q"), array("i")
        self.ids = array("i")
        # where the identifiers of each unit begin, and how many there are
        self.library, self.lattice = (array("q"), array("i")), (array("q"), array("i"))

    def make_room(self) -> None:
        if len(self) >= MOST_UNITS or len(self.ids) >= MOST_IDS:
            self.renew()

    def __missing__(self, unit: str) -> int:
        """The number of a new unit, which learn then solves."""
        self[unit] = k = len(self)
        self.new.append(unit)
        return k

    def learn(self) -> None:
        """Solves the new units: short ones of like length at once."""
        units, first, walk, n = self.new, len(self.score), self.owner.walk, self.owner.n_best
        self.new = []
        zeros = np.zeros(len(units), np.int64).tobytes()
        self.losses.frombytes(zeros * (n - 1))
        self.next_sizes.frombytes(zeros[: len(zeros) // 2] * (n - 1))
        for column in (self.score, self.lattice[0], self.library[0]):
            column.frombytes(zeros)
        for column in (self.lattice[1], self.library[1]):
            column.frombytes(zeros[: len(zeros) // 2])
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        short = lengths <= LONG_UNIT
        # beside the longest of a class a unit is short by a quarter at most, or by one
        classes = np.where(short, np.searchsorted(CLASSES, lengths), -1)
        for own in np.unique(classes).tolist():
            same = np.flatnonzero(classes == own)
            for k in range(0, len(same), WALKED):
                at = same[k : k + WALKED]
                part, sizes = [units[x] for x in at.tolist()], lengths[at]
                libraries = self.owner.vocab.merged_all(part)
                letters = walk.letters(part) if own >= 0 else np.zeros((len(part), 1), np.uint8)
                known = walk.known(letters, sizes)
                if known.any():
                    self.add(first + at[known], *walk.n_best(letters[known], sizes[known], n), [libraries[x] for x in np.flatnonzero(known).tolist()])
                for x in np.flatnonzero(~known).tolist():
                    paths = self.owner.n_paths(part[x])
                    none = n - len(paths)
                    scores = np.array([[*[p[0] for p in paths], *[LOWEST] * none]])
                    sizes = np.array([[*[len(p[1]) for p in paths], *[0] * none]])
                    self.add(first + at[x : x + 1], scores, np.fromiter(itertools.chain.from_iterable(p[1] for p in paths), np.int32, int(sizes.sum())), sizes, [libraries[x]])

    def add(self, numbers: np.ndarray, scores: np.ndarray, own: np.ndarray, sizes: np.ndarray, libraries: list[list[int]]) -> None:
        """What units of these numbers have: their best scores, and one after another the identifiers of their paths and of the library's."""
        there = scores > LOWEST // 2
        lost = scores[:, :1] - scores
        _view(self.score)[numbers] = scores[:, 0]
        if scores.shape[1] > 1:
            _view(self.losses).reshape(-1, scores.shape[1] - 1)[numbers] = np.where(there, lost, NEVER)[:, 1:]
            _view(self.next_sizes).reshape(-1, scores.shape[1] - 1)[numbers] = sizes[:, 1:]
        lengths = np.fromiter(map(len, libraries), np.int64, len(libraries))
        library = np.fromiter(itertools.chain.from_iterable(libraries), np.int32, int(lengths.sum()))
        for column, flat, n, first in ((self.lattice, own, sizes.sum(axis=1), sizes[:, 0]), (self.library, library, lengths, lengths)):
            _view(column[0])[numbers] = len(self.ids) + np.cumsum(n) - n
            _view(column[1])[numbers] = first
            self.ids.frombytes(flat.astype(np.int32).tobytes())

    def gather(self, at: np.ndarray, ends: np.ndarray, column: tuple[array, array]) -> tuple[list[np.ndarray], np.ndarray]:
        """(the identifiers of units one after another, cut at ends; where those of each unit begin before the cuts)."""
        sizes = _view(column[1])[at].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        places = np.repeat(_view(column[0])[at] - upto[:-1], sizes) + np.arange(upto[-1])
        return np.split(_view(self.ids)[places], upto[ends[1:-1]]), upto

    def path(self, number: int, choice: int) -> np.ndarray:
        """The identifiers of a unit's path: 0 is its best, 1 the next."""
        most = self.owner.n_best - 1
        sizes = [self.lattice[1][number], *self.next_sizes[number * most : number * most + choice]]
        start = self.lattice[0][number] + sum(sizes[:choice])
        # a copy, as the array grows
        return np.array(self.ids[start : start + sizes[choice]], np.int32)


def spliced(best: np.ndarray, parts: Parts) -> np.ndarray:
    """The identifiers of a next path."""
    return np.concatenate([x for start, size, ids in parts for x in (best[start : start + size], ids)])


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    """The text of identifiers: marks become spaces, runs of byte pieces characters, and the first space goes."""
    if not vocab.partial.isdisjoint(ids):
        parts, run = [], bytearray()
        for i in ids:
            byte = vocab.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(vocab.names[i])
        parts.append(run.decode("utf-8", "replace"))
    else:
        # every byte piece is a whole ASCII character
        parts = map(vocab.plain.__getitem__, ids)
    return "".join(parts).replace(SPACE, " ").removeprefix(" ")


def segmenter(model: str, n_best: int) -> Segmenter:
    cache = worker_cache()
    key = f"segmenter:{model}:{n_best}"
    if key not in cache:
        cache[key] = Segmenter(vocabulary(model), n_best)
    return cache[key]


def _compact(ids: np.ndarray) -> array:
    """Identifiers in a form that Spark takes apart much faster than numpy's numbers."""
    return array("i", ids.tobytes())


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            yield batch.iloc[k : k + ROWS]


def _mapped(docs: DataFrame, keep: list[str], each, extra: list[T.StructField]) -> DataFrame:
    """mapInPandas over keep and what each adds; whole numbers that may be null travel as text."""
    kinds = {c: docs.schema[c].dataType for c in keep}
    as_text = [c for c in keep if isinstance(kinds[c], T.IntegralType)]
    sent = docs.withColumns({c: F.col(c).cast("string") for c in as_text}) if as_text else docs
    fields = [T.StructField(c, T.StringType() if c in as_text else kinds[c]) for c in keep]
    made = sent.mapInPandas(each, T.StructType(fields + extra))
    return made.select(*[F.col(c).cast(kinds[c]) if c in as_text else F.col(c) for c in keep], *[f.name for f in extra])


def encode_documents(docs: DataFrame, keep: list[str], model: str | None = None, n_best: int = 3, text: str = "text", paths: bool = True, decoded: str | None = None) -> DataFrame:
    """keep, ids array<int>, n_pieces, scores array<double>, with paths lattice_ids array<int> and next_ids array<array<int>>, under the name in decoded what ids stand for.

    ids are the library's, scores those of the n best segmentations of the lattice,
    lattice_ids the best of them and next_ids the others in their order; of equal ones that
    which keeps to the best for longer. scores has fewer than n_best entries where a text has fewer
    segmentations. Null and empty texts have no pieces, one segmentation and score 0. Rows
    are encoded each, repeated or not; columns other than keep and text are ignored, and
    those of keep named like the new ones are replaced. An empty table gives no rows.
    decoded is decode_documents in the same pass: two passes in one stage take two Python
    workers a task from one pool, each of which then holds a segmenter and its solved units.
    """
    path = model or default_model()
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType()))]
    if paths:
        # the next paths come as what sets them apart from the best, and are put together below
        part = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
        extra += [T.StructField("lattice_ids", T.ArrayType(T.IntegerType())), T.StructField("next_ids", T.ArrayType(T.ArrayType(part)))]
    if decoded:
        extra.append(T.StructField(decoded, T.StringType()))
    kept = [c for c in keep if c not in {f.name for f in extra}]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = segmenter(path, n_best)
        for batch in _slices(batches):
            made = own.encode_all(batch["__text"].tolist())
            out = batch[kept].copy()
            out["ids"] = [_compact(m[0]) for m in made]
            out["n_pieces"] = [len(m[0]) for m in made]
            out["scores"] = [m[3] for m in made]
            if paths:
                out["lattice_ids"] = [_compact(m[1]) for m in made]
                out["next_ids"] = [m[2] for m in made]
            if decoded:
                out[decoded] = [decode(own.vocab, m[0].tolist()) for m in made]
            yield out

    made = _mapped(docs.select(*kept, F.col(text).cast("string").alias("__text")), kept, each, extra)
    if not paths:
        return made
    whole = F.transform("next_ids", lambda path: F.flatten(F.transform(path, lambda x: F.concat(F.slice("lattice_ids", x["start"] + 1, x["size"]), x["ids"]))))
    return made.withColumn("next_ids", whole)


def decode_documents(encoded: DataFrame, keep: list[str], model: str | None = None, ids: str = "ids") -> DataFrame:
    """keep and text: what the identifiers of each row stand for. Null identifiers give an empty text.

    A column text in keep is replaced; rows are decoded each, and an empty table gives no rows.
    """
    path, keep = model or default_model(), [c for c in keep if c != "text"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for batch in _slices(batches):
            out = batch[keep].copy()
            out["text"] = [decode(vocab, [] if x is None else x.tolist()) for x in batch["__ids"]]
            yield out

    return _mapped(encoded.select(*keep, F.col(ids).alias("__ids")), keep, each, [T.StructField("text", T.StringType())])
