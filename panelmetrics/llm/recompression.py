"""Recompression of a word sequence: locally consistent symbols and the words they depend on.

One round names short runs of equal words, the next rounds name pairs: a hash of a symbol
puts it in the left or the right class, and a left symbol joins a right symbol that follows
it. Names are 64-bit hashes of what they stand for, so equal runs and pairs get equal names
in every document and task, without a table of names.

Every symbol knows the words that decided it (its context). Where the same context words stand, the same
symbol stands. So two equal windows hold the same symbols with contexts inside the window, and
the least of these (by hash) is the anchor of both.
"""

from __future__ import annotations

import numpy as np

from panelmetrics.llm.words import Powers, mixed

RUN = 2
PAIR_ROUNDS = 2


class Symbols:
    """Symbols of a text: name, context [low, high) in words; a context may reach beyond the text."""

    def __init__(self, words: np.ndarray):
        count = len(words)
        start, stop, name = np.arange(count), np.arange(1, count + 1), mixed(words + np.uint64(1))
        change = np.flatnonzero(words[1:] != words[:-1]) + 1
        starts = np.concatenate([[0], change])
        lengths = np.diff(np.concatenate([starts, [count]]))
        merged = starts[(lengths > 1) & (lengths <= RUN)]
        if len(merged):  # longer runs stay single words: RUN + 1 equal words around a word show it
            sizes = lengths[(lengths > 1) & (lengths <= RUN)]
            stop[merged] = merged + sizes
            name[merged] = mixed(words[merged] + sizes.astype(np.uint64))
            keep = np.ones(count, dtype=bool)
            for shift in range(1, RUN):
                keep[(merged + shift)[sizes > shift]] = False
            start, stop, name = start[keep], stop[keep], name[keep]
        self.low, self.high, self.name = start - RUN, stop + RUN, name
        for number in range(PAIR_ROUNDS):
            self.pair(np.uint64(number + 1))

    def pair(self, number: np.uint64) -> None:
        """Join each left symbol with a right symbol behind it; contexts grow by what decided."""
        if len(self.name) < 2:
            self.low, self.high = self.low - 1, self.high + 1
            return
        left = mixed(self.name * np.uint64(2) + number) >> np.uint64(63) == 0
        joins = left[:-1] & ~left[1:]
        first = np.concatenate([joins, [False]])
        second = np.concatenate([[False], joins])
        # a left symbol is decided with the symbol behind it, a right one with the symbol before it
        after_high = np.concatenate([self.high[1:], [self.high[-1] + 1]])
        before_low = np.concatenate([[self.low[0] - 1], self.low[:-1]])
        high = np.where(left, after_high, self.high)
        low = np.where(left, self.low, before_low)
        following = np.concatenate([self.name[1:], [np.uint64(0)]])
        name = np.where(first, mixed(self.name * np.uint64(3) + mixed(following + number)), self.name)
        keep = ~second
        self.name, self.low, self.high = name[keep], low[keep], high[keep]


class Anchors:
    """The anchor of each window of `width` words, as a hash of the anchor's context words."""

    def __init__(self, width: int):
        self.width = width
        self.powers = Powers()

    def __call__(self, words: np.ndarray, edges: np.ndarray | None = None):
        """Per window: its start, a hash of its words, the key of its anchor, whether the window before has another anchor.

        The words may be those of several texts one behind the other, text i from edges[i] to edges[i + 1]. Windows
        over two texts are left out, and as contexts lie inside windows, words of another text decide nothing.
        """
        count = len(words) - self.width + 1
        if count < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
        self.powers.need(len(words) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * self.powers.up[: len(words)], dtype=np.uint64)])
        at = np.arange(count)
        if edges is not None:
            inside = np.repeat(np.append(edges[1:], edges[-1]), np.diff(edges, append=edges[-1]))[:count]
            at = at[at + self.width <= inside]
        whole = mixed((sums[at + self.width] - sums[at]) * self.powers.down[at])
        symbols = Symbols(words)
        first = np.searchsorted(symbols.low, at, side="left")
        last = np.searchsorted(symbols.high, at + self.width, side="right")
        keys = whole.copy()  # a window without a symbol of its own is its own anchor
        place = -at - 1  # where the anchor is: a symbol, or the window itself
        some = np.flatnonzero(last > first)
        if len(some):
            place[some] = chosen = least_symbol(symbols.name, first[some], last[some])
            low, high = symbols.low[chosen], symbols.high[chosen]
            keys[some] = mixed((sums[high] - sums[low]) * self.powers.down[low] + (high - low).astype(np.uint64))
        return at, whole, keys, np.concatenate([[True], place[1:] != place[:-1]]) if len(at) else np.zeros(0, bool)


def least_symbol(names: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the symbol with the least hash in each range [first, last); the leftmost of equal ones."""
    bits = np.uint64(max(1, len(names).bit_length()))
    table = [(mixed(names + np.uint64(7)) >> bits << bits) | np.arange(len(names), dtype=np.uint64)]
    spans = last - first
    while 2 ** len(table) <= spans.max():
        half = 2 ** (len(table) - 1)
        above = table[-1]
        table.append(np.minimum(above[:-half], above[half:]))
    level = np.floor(np.log2(spans)).astype(np.int64)
    least = np.empty(len(first), dtype=np.uint64)
    for k, row in enumerate(table):
        of_level = level == k
        if of_level.any():
            least[of_level] = np.minimum(row[first[of_level]], row[last[of_level] - 2**k])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
