"""Probabilistic automata inferred from examples by merging the states of a prefix tree.

The tree counts how often each prefix is reached, ends, and goes on with each symbol. States are compared by Hoeffding's
bound on the frequencies of ending and of every symbol, here and in all that follows; two that cannot be told apart are
merged, and what hangs below them is folded together so that the automaton stays deterministic. Merged states are taken
breadth first: a red core of settled states, and the blue ones next to it, which either join a red state or become one.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np

#: Symbols are ASCII codes; one more for all other characters and one for the end.
OTHER, END = 128, 129
SYMBOLS = 130
#: Error of a comparison of two frequencies, and pseudo-counts a state shares among all symbols.
ALPHA = 0.01
PRIOR = 2.0


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts behind each other, and where each begins."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.where(flat < 128, flat, OTHER).astype(np.int64), begin


class _Tree:
    """States with counts of visits and ends, and children by symbol."""

    def __init__(self, texts: list[str]):
        self.visits, self.ends, self.next = [0], [0], [{}]
        for text in texts:
            state = 0
            self.visits[0] += 1
            for c in text:
                symbol = min(ord(c), OTHER)
                child = self.next[state].get(symbol)
                if child is None:
                    child = len(self.next)
                    self.next[state][symbol] = child
                    self.visits.append(0)
                    self.ends.append(0)
                    self.next.append({})
                state = child
                self.visits[state] += 1
            self.ends[state] += 1

    def flow(self, state: int, symbol: int) -> int:
        child = self.next[state].get(symbol)
        return self.visits[child] if child is not None else 0


class _Merger:
    """Merged states keep their own counts per symbol, because a child may be shared after a merge."""

    def __init__(self, texts: list[str], alpha: float):
        tree = _Tree(texts)
        self.next = tree.next
        self.ends = tree.ends
        self.out = [{s: tree.visits[c] for s, c in own.items()} for own in tree.next]
        self.total = tree.visits
        self.bound = float(np.sqrt(0.5 * np.log(2 / alpha)))

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.bound * (n**-0.5 + m**-0.5)

    def compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        seen = set()
        while todo:
            p, q = todo.pop()
            if p == q or (p, q) in seen:
                continue
            seen.add((p, q))
            n, m = self.total[p], self.total[q]
            if not n or not m:
                continue
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for s in self.out[p].keys() | self.out[q].keys():
                if self._differ(self.out[p].get(s, 0), n, self.out[q].get(s, 0), m):
                    return False
                if s in self.next[p] and s in self.next[q]:
                    todo.append((self.next[p][s], self.next[q][s]))
        return True

    def fold(self, red: int, blue: int) -> None:
        """Add the counts of the tree below ``blue`` to the automaton at ``red``."""
        todo = [(red, blue)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            self.total[p] += self.total[q]
            for s, n in self.out[q].items():
                self.out[p][s] = self.out[p].get(s, 0) + n
                if s in self.next[p]:
                    todo.append((self.next[p][s], self.next[q][s]))
                else:
                    self.next[p][s] = self.next[q][s]

    def run(self) -> list[int]:
        red = [0]
        blue = deque((0, s) for s in sorted(self.next[0]))
        core = {0}
        while blue:
            parent, symbol = blue.popleft()
            state = self.next[parent][symbol]
            if state in core:
                continue
            goal = next((r for r in red if self.compatible(r, state)), None)
            if goal is None:
                red.append(state)
                core.add(state)
                blue += ((state, s) for s in sorted(self.next[state]))
            else:
                self.next[parent][symbol] = goal
                self.fold(goal, state)
                # Folding may have given settled states new children.
                blue += ((r, s) for r in red for s in sorted(self.next[r]) if self.next[r][s] not in core)
        return red


@dataclass
class Automaton:
    """``step[state, symbol]`` and ``cost[state, symbol]`` (log probability; ``END`` ends). The last state is the one after an
    unseen symbol: every symbol is equally likely there."""

    step: np.ndarray
    cost: np.ndarray

    @property
    def states(self) -> int:
        return len(self.step) - 1

    @staticmethod
    def inferred(texts: list[str], alpha: float = ALPHA) -> Automaton:
        merger = _Merger(texts, alpha)
        red = merger.run()
        place = {r: i for i, r in enumerate(red)}
        lost = len(red)
        step = np.full((lost + 1, SYMBOLS), lost, np.int64)
        count = np.zeros((lost + 1, SYMBOLS))
        for r, i in place.items():
            count[i, END] = merger.ends[r]
            for s, n in merger.out[r].items():
                count[i, s] = n
                step[i, s] = place[merger.next[r][s]]
        # Unseen symbols: a share of what the whole automaton sees, and that of uniform ones.
        overall = count.sum(0) + 1
        prior = PRIOR * overall / overall.sum()
        cost = np.log((count + prior) / (count.sum(1, keepdims=True) + PRIOR))
        cost[lost] = -np.log(SYMBOLS)
        return Automaton(step, cost)

    def scores(self, symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log likelihood of each text (as from ``codes``), whole texts, one array step per position."""
        sizes = np.diff(begin)
        order = np.argsort(-sizes, kind="stable")
        first, left = begin[:-1][order], sizes[order]
        state = np.zeros(len(order), np.int64)
        total = np.zeros(len(order))
        for t in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -t))  # texts longer than t
            s = symbols[first[:n] + t]
            total[:n] += self.cost[state[:n], s]
            state[:n] = self.step[state[:n], s]
        total += self.cost[state, END]
        out = np.empty(len(order))
        out[order] = total
        return out
