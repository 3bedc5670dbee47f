"""The deterministic automaton of all words within a distance of one query: sizes, viability of prefixes, single words.

A state is the set of distances that prefixes of the query can still have, cut off above the limit; bytes that the query lacks are one
class, so a state has a transition for each different byte of the query and one for the rest.  The join needs no automaton;
this is for single queries on the driver, and for what its size tells about a query.
"""

from __future__ import annotations

from .distance import METRICS


class QueryAutomaton:
    """``num_states`` states after compiling; ``distance(word)`` is None beyond ``max_distance``; ``viable(prefix)`` tells if any word with it can match."""

    def __init__(self, query: str, max_distance: int, metric: str = "levenshtein") -> None:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
        self.query, self.limit, self.swaps = query.encode(), max_distance, metric == "damerau"
        self.symbols = {byte: k for k, byte in enumerate(dict.fromkeys(self.query))}
        start = (tuple(min(k, max_distance + 1) for k in range(len(self.query) + 1)), None, None)
        self.rows, numbers, self.steps = [start[0]], {start: 0}, []
        todo = [start]
        for state in todo:  # grows as states are found
            out = []
            for symbol in [*self.symbols, None]:
                after = self._after(state, symbol)
                if after is not None and after not in numbers:
                    numbers[after] = len(numbers)
                    self.rows.append(after[0])
                    todo.append(after)
                out.append(-1 if after is None else numbers[after])
            self.steps.append(out)

    def _after(self, state: tuple, symbol: int | None) -> tuple | None:
        """The state after ``symbol``: distances, and for swaps those before it and the symbol; None if no word can match any more."""
        row, earlier, last = state
        new = [min(row[0] + 1, self.limit + 1)]
        for k, byte in enumerate(self.query, 1):
            best = min(new[-1] + 1, row[k] + 1, row[k - 1] + (byte != symbol))
            if self.swaps and earlier is not None and k > 1 and symbol == self.query[k - 2] and last == byte:
                best = min(best, earlier[k - 2] + 1)
            new.append(min(best, self.limit + 1))
        live = min(new) <= self.limit
        if self.swaps:
            # a swap that begins with this symbol may still be cheaper than the row tells
            live = live or (symbol is not None and min(row) < self.limit)
            return (tuple(new), row, symbol) if live else None
        return (tuple(new), None, None) if live else None

    @property
    def num_states(self) -> int:
        return len(self.rows)

    def _walk(self, word: str) -> int:
        at, rest = 0, len(self.symbols)
        for byte in word.encode():
            at = self.steps[at][self.symbols.get(byte, rest)]
            if at < 0:
                break
        return at

    def viable(self, prefix: str) -> bool:
        return self._walk(prefix) >= 0

    def distance(self, word: str) -> int | None:
        at = self._walk(word)
        found = self.limit + 1 if at < 0 else self.rows[at][-1]
        return found if found <= self.limit else None
