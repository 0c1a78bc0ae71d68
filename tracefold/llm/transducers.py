"""Small weighted finite-state transducers over symbols, and their composition.

A transducer is deterministic: in a state, a symbol leads to a next state, is
rewritten to another symbol, and adds a weight. Symbols it doesn't name pass
unchanged and leave the state. Composition feeds one transducer's output to the
next, in one table built once.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field


@dataclass
class Transducer:
    start: int = 0
    #: (state, symbol) -> (next state, symbol out, weight)
    arcs: dict[tuple[int, str], tuple[int, str, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def run(self, symbols) -> tuple[float, list[str]]:
        """Total weight and output of a whole input."""
        state, total, out = self.start, 0.0, []
        for s in symbols:
            state, s, w = self.step(state, s)
            total += w
            out.append(s)
        return total, out


def compose(a: Transducer, b: Transducer, alphabet: list[str]) -> Transducer:
    """The transducer that gives ``b`` what ``a`` puts out."""
    names = {(a.start, b.start): 0}
    todo, out = deque(names), Transducer()
    while todo:
        pair = todo.popleft()
        for s in alphabet:
            na, mid, wa = a.step(pair[0], s)
            nb, end, wb = b.step(pair[1], mid)
            to = (na, nb)
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            out.arcs[names[pair], s] = (names[to], end, wa + wb)
    return out
