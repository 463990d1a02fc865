"""An Aho-Corasick automaton over words: which of many patterns can stand in a text.

Symbols are ASCII words in lower case, so one step passes a word.  A pattern that stands in a
text at word boundaries has its words there in a row; a pattern without words is just what stands between two
words.  The goto, fail and output links are flat arrays, which are cheap to send to workers.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np

_WORDS = re.compile(r"[A-Za-z0-9_]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)]


def gaps_of(text: str) -> list[str]:
    """What stands between one word and the next."""
    return _WORDS.split(text)[1:-1]


class WordAutomaton:
    """Over patterns, numbered by their places; found() gives the numbers of those whose words stand in a text."""

    def __init__(self, patterns: Iterable[str]) -> None:
        number: dict[str, int] = {}
        edges: list[dict[int, int]] = [{}]
        ends: dict[int, list[int]] = defaultdict(list)
        gaps: dict[str, list[int]] = defaultdict(list)
        for k, pattern in enumerate(patterns):
            words, state = words_of(pattern), 0
            if not words:
                gaps[pattern].append(k)
                continue
            for w in words:
                t = number.setdefault(w, len(number))
                if t not in edges[state]:
                    edges[state][t] = len(edges)
                    edges.append({})
                state = edges[state][t]
            ends[state].append(k)
        fail, link = [0] * len(edges), [0] * len(edges)  # the longest suffix that is a state, and that ends a pattern
        todo = deque(edges[0].values())
        while todo:
            state = todo.popleft()
            for t, to in edges[state].items():
                back = fail[state]
                while back and t not in edges[back]:
                    back = fail[back]
                fail[to] = edges[back].get(t, 0)
                link[to] = fail[to] if fail[to] in ends else link[fail[to]]
                todo.append(to)
        self.vocabulary, self.gaps = list(number), dict(gaps)
        self.edge_keys = np.array([s * len(number) + t for s, own in enumerate(edges) for t in own], np.int64)
        self.edge_ends = np.array([to for own in edges for to in own.values()], np.int32)
        self.fail, self.link = np.array(fail, np.int32), np.array(link, np.int32)
        self.out_states = np.array(list(ends), np.int32)
        self.out_starts = np.cumsum([0, *map(len, ends.values())])
        self.outs = np.array([k for own in ends.values() for k in own], np.int32)
        self._index()

    def _index(self) -> None:
        self._number = {w: k for k, w in enumerate(self.vocabulary)}
        self._goto = dict(zip(self.edge_keys.tolist(), self.edge_ends.tolist(), strict=True))
        self._fail, self._link = self.fail.tolist(), self.link.tolist()
        starts, outs = self.out_starts.tolist(), self.outs.tolist()
        self._out = {s: outs[a:b] for s, a, b in zip(self.out_states.tolist(), starts[:-1], starts[1:], strict=True)}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._index()

    def knows(self, text: str) -> bool:
        """Whether a word of the text is one of a pattern, or what stands between two of its words is a pattern."""
        return any(w in self._number for w in words_of(text)) or any(g in self.gaps for g in gaps_of(text))

    def found(self, text: str) -> Iterator[int]:
        """Numbers of patterns whose words stand in the text, once for each place."""
        number, goto, fail, link, out, size = self._number, self._goto, self._fail, self._link, self._out, len(self.vocabulary)
        state = 0
        for w in _WORDS.findall(text):
            t = number.get(w.lower())
            if t is None:
                state = 0
                continue
            to = goto.get(state * size + t)
            while to is None and state:
                state = fail[state]
                to = goto.get(state * size + t)
            state = to or 0
            s = state if state in out else link[state]
            while s:
                yield from out[s]
                s = link[s]
        if self.gaps:
            for gap in gaps_of(text):
                yield from self.gaps.get(gap, ())
