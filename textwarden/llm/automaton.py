"""Generalised suffix automaton over word numbers, and matching statistics of streamed words against it.

Built on the driver from a bounded block of query texts; workers get it once. Words are numbered by hash, and only runs of words
that the automaton knows are walked: an unknown word empties the match anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from textwarden.llm.wordstream import PLAIN_WORDS, U, Words


def plain_words(text: str | None) -> np.ndarray:
    """Hashes of a text's plain words."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return Words(raw, np.array([0, len(raw)]), PLAIN_WORDS, True).hashes()


class SuffixAutomaton:
    """States of all substrings of the added sequences; ``length``, ``link`` and transitions by word number."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The part of q whose substrings end in p's and the word."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int]) -> list[int]:
        """Add a sequence; the state after each of its words (later additions may split states)."""
        last, states = 0, []
        for w in words:
            p = last
            if (q := self.next[p].get(w)) is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            else:
                last = self._state(self.length[p] + 1, 0, {})
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            states.append(last)
        return states

    def holding(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, longest match that ends here) after each word."""
        state, n = 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if (to := self.next[state].get(w)) is not None:
                state, n = to, n + 1
            yield state, n


class TextIndex:
    """Automaton of some texts with numbered words, windows of ``width`` words and the texts that hold each."""

    def __init__(self, texts: list[tuple[object, np.ndarray]], width: int):
        self.width, self.sam = width, SuffixAutomaton()
        self.hashes = np.unique(np.concatenate([h for _, h in texts] or [np.zeros(0, dtype=U)]))
        self.screen = np.zeros(1 << 16, dtype=bool)
        self.screen[(self.hashes >> U(48)).astype(np.int64)] = True
        numbered = [(key, np.searchsorted(self.hashes, h).tolist()) for key, h in texts if len(h)]
        for _, words in numbered:
            self.sam.add(words)
        #: State of a window -> (words, texts) of the windows that it stands for.
        self.windows: dict[int, dict[int, set]] = {}
        self.ends: dict[int, list[tuple[object, int]]] = {}
        for key, words in numbered:
            size = min(width, len(words))
            for i, (state, n) in enumerate(self.sam.statistics(words)):
                self.ends.setdefault(state, []).append((key, i + 1))
                if n >= size:
                    self.windows.setdefault(self.sam.holding(state, size), {}).setdefault(size, set()).add(key)
        self.least = min((min(width, len(w)) for _, w in numbered), default=1)
        self._chain: dict[int, tuple[tuple[int, frozenset], ...]] = {}

    def number(self, words: Words) -> np.ndarray:
        """Number of each word, -1 for those that no text has."""
        h = words.hashes()
        out = np.full(len(h), -1, dtype=np.int64)
        if len(self.hashes):
            maybe = np.flatnonzero(self.screen[(h >> U(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            known = self.hashes[at] == h[maybe]
            out[maybe[known]] = at[known]
        return out

    def runs(self, words: Words, numbers: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
        """(first, end) of every run of known words of one document, at least ``least`` long."""
        known = numbers >= 0
        if not known.any():
            return
        starts = known.copy()
        starts[1:] &= ~known[:-1]
        heads = words.bounds[:-1][words.counts > 0]
        starts[heads] = known[heads]
        first = np.flatnonzero(starts)
        stop = known.copy()
        stop[:-1] &= ~known[1:]
        tails = words.bounds[1:][words.counts > 0] - 1
        stop[tails] = known[tails]
        end = np.flatnonzero(stop) + 1
        long = end - first >= least
        yield from zip(first[long].tolist(), end[long].tolist(), strict=True)

    def _standing(self, state: int) -> tuple[tuple[int, frozenset], ...]:
        """(words, texts) of all windows that end with this state's match, on it and its suffixes."""
        if state not in self._chain:
            found, s = [], state
            while s > 0:
                found += [(size, frozenset(keys)) for size, keys in self.windows.get(s, {}).items()]
                s = self.sam.link[s]
            self._chain[state] = tuple(found)
        return self._chain[state]

    def hits(self, words: Words) -> Iterator[tuple[int, int, frozenset]]:
        """(first word, end word, texts) of every occurrence of a window; words count through the chunk."""
        numbers = self.number(words)
        for first, end in self.runs(words, numbers, self.least):
            for i, (state, n) in enumerate(self.sam.statistics(numbers[first:end].tolist()), first + 1):
                if n >= self.least:
                    for size, keys in self._standing(state):
                        if size <= n:
                            yield i - size, i, keys

    def long_matches(self, words: Words, least: int) -> Iterator[tuple[int, int, list[tuple[object, int]]]]:
        """(first word, end word, (text, end in it)...) of every match of ``least`` words or more that can't go on."""
        numbers = self.number(words)
        for first, end in self.runs(words, numbers, least):
            before = (0, 0)
            for i, (state, n) in enumerate([*self.sam.statistics(numbers[first:end].tolist()), (0, 0)], first):
                if before[1] >= least and n != before[1] + 1:
                    yield i - before[1], i, self.places(before[0])
                before = state, n

    def places(self, state: int) -> list[tuple[object, int]]:
        """Where the state's match ends in the texts: its own places and those of the states it is a suffix of."""
        if not hasattr(self, "_children"):
            self._children: dict[int, list[int]] = {}
            for s, to in enumerate(self.sam.link):
                self._children.setdefault(to, []).append(s)
        out, open_states = [], [state]
        while open_states:
            s = open_states.pop()
            out += self.ends.get(s, [])
            open_states += self._children.get(s, [])
        return out
