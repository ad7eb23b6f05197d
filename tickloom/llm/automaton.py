"""A suffix automaton over words, with the smallest document that each of its runs occurs in."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence


class SuffixAutomaton:
    """All runs of words of the added pieces; ``close`` must be called before it is asked."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least: list = [None]

    def _state(self, length: int, follow: dict[bytes, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.least.append(None)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A state of its own for the runs that reach ``q`` from ``p``, which are shorter than its longest."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        following, link, length = self.next, self.link, self.length
        q = following[last].get(word)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p >= 0:
            q = following[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, words: Iterable[bytes], document: int) -> None:
        last, least = 0, self.least
        for word in words:
            last = self._extend(last, word)
            if least[last] is None or document < least[last]:
                least[last] = document

    def close(self) -> None:
        """Hand documents down to the states of shorter runs."""
        least, link = self.least, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            above = link[state]
            if above > 0 and (least[above] is None or least[state] < least[above]):
                least[above] = least[state]

    def matches(self, words: Sequence[bytes], most: int) -> Iterator[tuple[int, int | None]]:
        """Matching statistics: for each word the longest run ending with it that occurs, up to ``most`` words.

        With it comes the smallest document in which that run occurs.
        """
        following, link, length, least = self.next, self.link, self.length, self.least
        state = matched = 0
        for word in words:
            q = following[state].get(word)
            while q is None and state:
                state = link[state]
                matched = length[state]
                q = following[state].get(word)
            if q is not None:
                state = q
                matched += 1
                if matched > most:
                    matched = most
                while length[link[state]] >= matched:
                    state = link[state]
            yield matched, least[state]
