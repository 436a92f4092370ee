"""The pieces of a SentencePiece model, and where its texts may be cut."""

from __future__ import annotations

import math
import re

from meshlake.runtime import worker_cache

SPACE = "▁"
MILLION = 1_000_000


def default_model() -> str:
    """The place of the public model on this machine; every executor has it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Normal pieces with identifiers and scores, bytes for what no piece covers."""

    def __init__(self, model: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        n = processor.get_piece_size()
        own = [i for i in range(n) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))]
        self.names = [processor.id_to_piece(i) for i in range(n)]
        self.ids = {self.names[i]: i for i in own}
        self.scores = {self.names[i]: float(processor.get_score(i)) for i in own}
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if processor.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        #: Byte pieces that are no character by themselves, and what all others stand for.
        self.partial = {i for i, b in self.byte_of.items() if b >= 128}
        self.plain = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else name for i, name in enumerate(self.names)]
        self.longest = max(map(len, self.ids))
        self.processor = processor
        #: A character that no piece joins to another, and what the model makes of it: units are encoded behind it.
        self.mark = next(c for c in "\n\t\x01\x02\x03" if not any(c in name and len(name) > 1 for name in self.names))
        self.marked = processor.encode(self.mark)
        # merge models score by rank, 0, -1, -2, ...: that is read as a logarithm of Zipf's law
        ranks = all(x <= 0 and x == int(x) for x in self.scores.values())
        #: Logarithms of how likely each piece is, for paths over the lattice, in whole
        #: millionths: sums of whole numbers are exact, and equal paths compare as equal.
        self.log_scores = {name: round(MILLION * (-math.log(2.0 - x) if ranks else x)) for name, x in self.scores.items()}
        if any(SPACE in name.lstrip(SPACE) for name in self.ids):
            raise ValueError("the model has pieces with a space inside, so words are not independent")
        #: Every start of a piece, whole pieces included.
        self.prefixes = {name[:k] for name in self.ids for k in range(1, len(name) + 1)}
        #: No piece crosses the border of two units.
        self.unit = re.compile(self._unit_pattern())

    def _unit_pattern(self) -> str:
        """Spaces and then a run of characters that pieces may join, or one that none joins to another.

        Two characters that stand side by side in a piece are of one class, and so are
        those linked through others; a border between classes is crossed by no piece.
        """
        parent: dict[str, str] = {}

        def find(c: str) -> str:
            while parent.setdefault(c, c) != c:
                parent[c] = c = parent[parent[c]]
            return c

        for name in self.ids:
            core = name.lstrip(SPACE)
            for x, y in zip(core, core[1:], strict=False):
                parent[find(x)] = find(y)
        classes: dict[str, list[str]] = {}
        for c in parent:
            classes.setdefault(find(c), []).append(c)
        runs = sorted(("".join(sorted(c)) for c in classes.values()), key=lambda c: (-len(c), c))
        joined = "|".join(f"[{re.escape(c)}]+" for c in runs)
        return f"(?s:{SPACE}*(?:{joined}|[^{SPACE}])|{SPACE}+)"

    def normalize(self, text: str | None) -> str:
        """The text as the model sees it: spaces marked, and one in front. Empty stays empty."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merged(self, unit: str) -> list[int]:
        """The library's identifiers of a unit: merges do not cross its borders, so a text's are those of its units."""
        return self.processor.encode(self.mark + unit.replace(SPACE, " "))[len(self.marked) :]

    def merged_all(self, units: list[str]) -> list[list[int]]:
        """merged for each of some units."""
        cut = len(self.marked)
        return [x[cut:] for x in self.processor.encode([self.mark + u.replace(SPACE, " ") for u in units], num_threads=1)]

    def units(self, normal: str) -> list[str]:
        return self.unit.findall(normal)


def vocabulary(model: str) -> Vocabulary:
    cache = worker_cache()
    key = f"vocabulary:{model}"
    if key not in cache:
        cache[key] = Vocabulary(model)
    return cache[key]


class Generations(dict):
    """A bounded cache: what was not used since the last change of generation goes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if self.keeps(key):
            if len(self) >= self.most // 2:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def make(self, key):
        raise NotImplementedError

    def keeps(self, key) -> bool:
        return True
