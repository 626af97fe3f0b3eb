"""Suffix automata of word sequences, and matching statistics against them.

``Suffixes`` builds; ``packed`` turns an automaton into bytes that are sent to whatever matches against it, and ``Packed`` reads these.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Sequence

import numpy as np


class Suffixes:
    """The automaton of all substrings of some sequences of hashable words."""

    def __init__(self, sequences: Iterable[Sequence] = ()):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        for s in sequences:
            self.add(s)

    def _state(self, size: int, steps: dict, link: int) -> int:
        self.next.append(steps)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A state of its own for the shorter strings of q that p leads to."""
        twin = self._state(self.size[p] + 1, self.next[q].copy(), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, sequence: Sequence) -> None:
        steps, link, size = self.next, self.link, self.size
        last = 0
        for word in sequence:
            q = steps[last].get(word)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(size[last] + 1, {}, 0), last
            while p >= 0 and word not in steps[p]:
                steps[p][word] = new
                p = link[p]
            if p >= 0:
                q = steps[p][word]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, word, q)
            last = new

    def packed(self) -> bytes:
        """The automaton in arrays, words (64-bit hashes) by their place in a sorted vocabulary."""
        count = np.fromiter((len(s) for s in self.next), np.int64, len(self.next))
        words = np.fromiter((w for s in self.next for w in s), np.uint64, int(count.sum()))
        to = np.fromiter((t for s in self.next for t in s.values()), np.int32, len(words))
        vocabulary, place = np.unique(words, return_inverse=True)
        out = io.BytesIO()
        np.savez_compressed(out, vocabulary=vocabulary, count=count.astype(np.int32), place=place.astype(np.int32), to=to, link=np.array(self.link, np.int32), size=np.array(self.size, np.int32))
        return out.getvalue()


class Packed:
    """An automaton read from bytes: one table from state and word to state."""

    def __init__(self, data: bytes):
        held = np.load(io.BytesIO(data))
        self.vocabulary = held["vocabulary"]
        state = np.repeat(np.arange(len(held["count"])), held["count"])
        self.width = max(1, len(self.vocabulary))
        self.step = dict(zip((state * self.width + held["place"]).tolist(), held["to"].tolist(), strict=True))
        self.link, self.size = held["link"].tolist(), held["size"].tolist()

    def statistics(self, hashes: np.ndarray) -> list[int]:
        """For each word, how many words that end with it are a substring of what was added: as many as possible."""
        if not len(self.vocabulary):
            return [0] * len(hashes)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        places = np.where(self.vocabulary[at] == hashes, at, -1).tolist()
        step, link, size, width = self.step, self.link, self.size, self.width
        state = length = 0
        out = []
        for place in places:
            if place < 0:
                state = length = 0
                out.append(0)
                continue
            to = step.get(state * width + place)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step.get(state * width + place)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            out.append(length)
        return out
