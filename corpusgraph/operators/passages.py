"""Passages looked for in the blocks of one document, all in match form (T.match_form), as helpers of a task."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate

#: Needles times characters of a document up to which each needle is looked for in all of it; beyond, words lead to the blocks that can hold it.
DIRECT = 1 << 26


def needle_words(needle: str) -> tuple[list[str], int]:
    """The first 12 distinct words of four characters at least, and how many of them a block must hold."""
    words = list(dict.fromkeys(w for w in needle.split(" ") if len(w) >= 4))[:12]
    return words, max(2, math.ceil(0.4 * len(words)))


def needle_keys(needle: str) -> list[str]:
    """Its words or, if it has none, its longest one: a block that holds the needle whole holds all of them."""
    return needle_words(needle)[0] or [max(needle.split(" "), key=len)]


class Blocks:
    """Blocks of a document by number. Of equal ones the first is all that can be found."""

    def __init__(self, blocks: Iterable[tuple], needles: Iterable[str], direct: int = DIRECT):
        first: dict = {}
        for number, text in sorted(blocks):
            first.setdefault(text, number)
        self.texts, self.numbers = list(first), list(first.values())
        self.all = "\n".join(self.texts)
        self.starts = list(accumulate((len(t) + 1 for t in self.texts), initial=0))
        needles = set(needles)
        self.direct = len(needles) * len(self.all) <= direct
        if not self.direct:
            self._index({w for n in needles for w in needle_keys(n)})

    def _index(self, wanted: set[str]) -> None:
        """Blocks by token, and the tokens that hold each wanted word (found over the grams of the words' lengths)."""
        self.at: dict[str, list[int]] = {}
        for i, text in enumerate(self.texts):
            for token in set(text.split(" ")):
                self.at.setdefault(token, []).append(i)
        lengths, self.inside = sorted({len(w) for w in wanted}), {w: [] for w in wanted}
        for token in self.at:
            for n in lengths:
                for gram in {token[i : i + n] for i in range(len(token) - n + 1)} & wanted:
                    self.inside[gram].append(token)

    def _holding(self, words: Iterable[str]) -> list[int]:
        return sorted({i for w in words for token in self.inside[w] for i in self.at[token]})

    def _rarest(self, words: list[str]) -> list[str]:
        return sorted(words, key=lambda w: (sum(len(self.at[token]) for token in self.inside[w]), w))

    def _whole(self, needle: str) -> int | None:
        """The first block that holds the needle."""
        if self.direct:  # blocks are parted by a character that no needle has
            at = self.all.find(needle)
            return None if at < 0 else bisect_right(self.starts, at) - 1
        return next((i for i in self._holding(self._rarest(needle_keys(needle))[:1]) if needle in self.texts[i]), None)

    def _most(self, needle: str) -> tuple[int, int] | None:
        """The first of the blocks with most of the needle's words, and how many; a block without the rarest ones (all but the needed number less one) has too few."""
        words, need = needle_words(needle)
        if len(words) < need:
            return None
        among = range(len(self.texts)) if self.direct else self._holding(self._rarest(words)[: len(words) - need + 1])
        found, first = max(((sum(w in self.texts[i] for w in words), -i) for i in among), default=(0, 0))
        return (-first, found) if found >= need else None

    def find(self, needle: str) -> tuple | None:
        """block_no and score, as documents.locate_passage gives them."""
        at = self._whole(needle)
        at, score = (at, 1000) if at is not None else self._most(needle) or (None, 0)
        return None if at is None else (self.numbers[at], score)
