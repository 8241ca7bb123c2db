"""Words of a text as 64-bit numbers, and shingles of them."""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20
RUN_BYTES = 1 << 18


class Powers:
    """Powers of an odd factor and of its inverse modulo 2**64, grown as longer texts come."""

    FACTOR = 0x9E3779B97F4A7C15
    INVERSE = pow(FACTOR, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def need(self, count: int) -> None:
        if len(self.up) < count:
            size = max(count, 2 * len(self.up), 4096)
            self.up, self.down = (self.of(base, size) for base in (self.FACTOR, self.INVERSE))

    @staticmethod
    def of(base: int, count: int) -> np.ndarray:
        """base**0, base**1, ... modulo 2**64."""
        held = np.full(count, base, dtype=np.uint64)
        held[:1] = 1
        return np.cumprod(held, dtype=np.uint64)


class WordHashes:
    """64-bit hashes of all words of a run of texts at once, from prefix sums over their bytes.

    Every byte stands for a fixed 64-bit number, a word for the sum of its bytes' numbers times powers of an
    odd factor, mixed with its length.
    """

    def __init__(self):
        self.powers = Powers()
        self.values = mixed(np.arange(1, 257, dtype=np.uint64))
        self.white = np.zeros(256, dtype=bool)
        self.white[[32, *range(9, 14)]] = True

    def of_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of several texts, one text behind the other, and where each text starts (and the end)."""
        held = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # a space after each text
        begins = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
        white = self.white[held]
        change = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(held) and not white[0]:
            change = np.r_[0, change]
        start, stop = change[0::2], change[1::2]  # every text ends with a space, so each word has a stop
        hashes, first = np.zeros(len(start), dtype=np.uint64), 0
        while first < len(start):  # words of one segment at a time, so that long texts don't take sums of their size
            last = max(first + 1, int(np.searchsorted(stop, start[first] + SEGMENT, side="right")))
            hashes[first:last] = self.of_words(held, start[first:last], stop[first:last])
            first = last
        return hashes, np.searchsorted(start, begins)

    def of_words(self, held: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        base = int(start[0])
        count = int(stop[-1]) - base
        self.powers.need(count + 1)
        sums = np.zeros(count + 1, dtype=np.uint64)
        np.cumsum(self.values[held[base : base + count]] * self.powers.up[:count], out=sums[1:])
        spans = (sums[stop - base] - sums[start - base]) * self.powers.down[start - base]
        return mixed(spans + (stop - start).astype(np.uint64))

    def of_texts(self, column, lower: bool = False):
        """Hashes of the words of each text of a column; `lower` takes A-Z as a-z."""
        for _, texts in text_runs(column, RUN_BYTES):
            words, edges = self.of_many([t.lower() for t in texts] if lower else texts)
            yield from (words[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist()))


def text_runs(column, size: int):
    """(first row, texts) of runs of consecutive rows with about `size` bytes each; a long text is a run of its own."""
    held, total, first = [], 0, 0
    for row, text in enumerate(column):
        raw = text.as_buffer().to_pybytes()
        if held and total + len(raw) > size:
            yield first, held
            held, total, first = [], 0, row
        held.append(raw)
        total += len(raw)
    if held:
        yield first, held


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finish of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def windows(numbers: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit number per window of `width` consecutive words."""
    count = len(numbers) - width + 1
    if count < 1:
        return np.zeros(0, dtype=np.uint64)
    held = np.zeros(count, dtype=np.uint64)
    for shift in range(width):
        held = mixed(held + numbers[shift : shift + count])
    return held
