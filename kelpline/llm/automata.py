"""Probabilistic automata inferred from example strings by state merging.

The examples make a prefix tree with counts.  Its states are visited from the
root; a state merges into an earlier one where the shares of strings that end
there, and that go on with each symbol, agree within Hoeffding's bound, there
and in all states below; of several such the one that makes its continuations
likeliest.  Symbols are characters, or classes of them.
"""

from __future__ import annotations

import math

import numpy as np

#: Character classes of a credential's format, in this order.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
CLASS_OF = np.full(256, -1, np.int8)
for _k, _chars in enumerate(CLASSES):
    for _c in _chars:
        CLASS_OF[ord(_c)] = _k
#: Each character of a token as a symbol of its own.
CHARACTERS = "".join(CLASSES)
CHARACTER_OF = np.full(256, -1, np.int8)
for _k, _c in enumerate(CHARACTERS):
    CHARACTER_OF[ord(_c)] = _k


class Automaton:
    """Log-probabilities by state and symbol; a last, shared state takes what no example showed, or the first, with ``restart``."""

    def __init__(self, examples: list[str], alpha: float = 0.05, of: np.ndarray = CLASS_OF, restart: bool = False):
        self.restart = restart
        self.of, self.symbols = of, int(of.max()) + 1
        self.count, self.final, self.next, self.passes = [0], [0], [{}], [{}]
        for text in examples:
            state = 0
            self.count[0] += 1
            for s in of[np.frombuffer(text.encode("latin-1"), np.uint8)].tolist():
                child = self.next[state].get(s)
                if child is None:
                    child = self.next[state][s] = len(self.count)
                    self.count.append(0)
                    self.final.append(0)
                    self.next.append({})
                    self.passes.append({})
                self.passes[state][s] = self.passes[state].get(s, 0) + 1
                state = child
                self.count[state] += 1
            self.final[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._tables()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.final[a], self.count[a], self.final[b], self.count[b]):
                return False
            for s in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(s), self.next[b].get(s)
                if self._differ(self.passes[a].get(s, 0), self.count[a], self.passes[b].get(s, 0), self.count[b]):
                    return False
                if x is not None and y is not None and x != y:
                    todo.append((x, y))
        return True

    def _likelihood(self, a: int, b: int) -> float:
        """Of b's continuations and ends, as state a has them."""
        total = self.count[a] + 0.1 * (self.symbols + 1)
        out = self.final[b] * math.log((self.final[a] + 0.1) / total)
        return out + sum(n * math.log((self.passes[a].get(s, 0) + 0.1) / total) for s, n in self.passes[b].items())

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.final[a] += self.final[b]
            for s, child in self.next[b].items():
                self.passes[a][s] = self.passes[a].get(s, 0) + self.passes[b][s]
                if s in self.next[a]:
                    todo.append((self.next[a][s], child))
                else:
                    self.next[a][s] = child

    def _merge(self) -> None:
        red = [0]
        while True:
            owners = {child: (r, s) for r in red for s, child in self.next[r].items() if child not in red}
            if not owners:
                break
            fringe = max(owners, key=lambda q: (self.count[q], -q))
            parent, symbol = owners[fringe]
            alike = [r for r in red if self._alike(r, fringe)]
            if alike:
                r = max(alike, key=lambda r: self._likelihood(r, fringe))
                self.next[parent][symbol] = r
                self._fold(r, fringe)
            else:
                red.append(fringe)
        self.states = red

    def _tables(self) -> None:
        place = {q: i for i, q in enumerate(self.states)}
        n = len(place)
        self.step = np.full((n + 1, self.symbols), 0 if self.restart else n, np.int32)
        self.log_p = np.full((n + 1, self.symbols), math.log(0.02 / self.symbols))
        self.log_end = np.full(n + 1, math.log(0.02))
        for q, i in place.items():
            total = self.count[q] + 0.1 * (self.symbols + 1)
            for s in range(self.symbols):
                self.log_p[i, s] = math.log((self.passes[q].get(s, 0) + 0.1) / total)
                if s in self.next[q]:
                    self.step[i, s] = place[self.next[q][s]]
            self.log_end[i] = math.log((self.final[q] + 0.1) / total)


def log_likelihoods(automata: list[Automaton], codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per string (rows of ``codes``, padded, longest first) the best automaton's log-likelihood of its symbols."""
    best = np.full(len(codes), -np.inf)
    for a in automata:
        state = np.zeros(len(codes), np.int64)
        total = np.zeros(len(codes))
        for j in range(codes.shape[1]):
            live = int(np.searchsorted(-lengths, -j, "left"))  # strings longer than j
            if not live:
                break
            c = codes[:live, j]
            total[:live] += a.log_p[state[:live], c]
            state[:live] = a.step[state[:live], c]
        best = np.maximum(best, total + a.log_end[state])
    return best


def padded(strings: list[str], of: np.ndarray = CLASS_OF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, symbols, lengths) of the strings, longest first."""
    lengths = np.array([len(s) for s in strings])
    order = np.argsort(-lengths, kind="stable")
    codes = np.zeros((len(strings), int(lengths.max(initial=0))), np.int8)
    for i, k in enumerate(order):
        codes[i, : lengths[k]] = of[np.frombuffer(strings[k].encode("latin-1"), np.uint8)]
    return order, codes, lengths[order]
