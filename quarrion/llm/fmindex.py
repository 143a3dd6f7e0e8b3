"""An FM-index over words: suffix order, Burrows-Wheeler transform, wavelet matrix."""

from __future__ import annotations

import numpy as np

#: Masks of the bits below each place of a word.
_LOW = (np.uint64(1) << np.arange(32, dtype=np.uint64)).astype(np.uint32) - np.uint32(1)


class Bits:
    """A bit vector with rank: 32-bit words and the count of ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 32) * 32, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint32)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 5
        low = _LOW[i & 31]
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class Wavelet:
    """A wavelet tree in matrix form over symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows, self.zeros = levels, [], []
        for k in range(levels - 1, -1, -1):
            bit = (symbols >> k) & 1
            self.rows.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(np.int32(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i goes at the last level on the way of the symbol."""
        for k, (row, zeros) in enumerate(zip(self.rows, self.zeros)):
            ones = row.rank(i)
            bit = (symbol >> (self.levels - 1 - k)) & 1
            i = np.where(bit == 1, zeros + ones, i - ones)
        return i


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` symbols or more that stand there, by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, h = rank.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        after = np.zeros(n, np.int64)
        after[:-h] = rank[h:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable" if h == 1 else "quicksort")
        own = key[order]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        rank[order] = np.cumsum(new)
        h *= 2
        if new.all():
            break
    return order


def _groups(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Where, in the suffix order, the first ``depth`` symbols differ from those of the suffix before."""
    new = np.ones(len(order), bool)
    alike = np.arange(1, len(order))
    padded = np.append(text, np.zeros(depth, text.dtype))
    for k in range(depth):
        alike = alike[padded[order[alike] + k] == padded[order[alike - 1] + k]]
    new[alike] = False
    return new


class FmIndex:
    """Compressed index of a sequence of symbols in 1..alphabet, 0 being the separator, for matches of ``depth`` symbols at most.

    It keeps the wavelet matrix of the Burrows-Wheeler transform, the symbols'
    first places, and for each interval of suffixes that share ``depth``
    symbols its beginning and its smallest position if it has two suffixes or
    more. The text and the suffix order are not kept.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.n, self.depth = len(text), depth
        order = suffix_order(text, depth).astype(np.int32)
        top = int(text.max()) if self.n else 0
        # Position 0 is preceded by the last symbol, a separator.
        self.wavelet = Wavelet(text[order - 1].astype(np.int32), max(1, top.bit_length()))
        count = np.bincount(text, minlength=top + 1)
        self.first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int32)
        every = np.arange(top + 1, dtype=np.int32)
        self.base = self.wavelet.follow(every, np.zeros(top + 1, np.int32))
        begin = np.flatnonzero(_groups(text, order, depth))
        many = np.diff(np.append(begin, self.n)) > 1
        self.begin = begin[many].astype(np.int32)
        self.least = np.minimum.reduceat(order, begin)[many] if self.n else order

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of symbol + pattern from those of the patterns."""
        both = self.wavelet.follow(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.first[symbol] - self.base[symbol]
        return both[: len(low)] + shift, both[len(low) :] + shift

    def statistics(self, stream: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(matching statistics, smallest positions) of the windows of ``depth`` symbols that begin at ``starts`` of a streamed sequence.

        The statistic of a window is the number of its last symbols, ``depth``
        at most, that occur twice or more in the index; a window that reaches
        ``depth`` has an interval of occurrences, whose smallest position goes
        along (else n). All windows are extended to the left together, a symbol a step; one whose
        interval has shrunk to a single suffix is done.
        """
        reach = np.zeros(len(starts), np.int32)
        least = np.full(len(starts), self.n, np.int64)
        todo = np.arange(len(starts))
        low, high = np.zeros(len(todo), np.int32), np.full(len(todo), self.n, np.int32)
        for k in range(self.depth - 1, -1, -1):
            low, high = self.step(stream[starts[todo] + k], low, high)
            alive = high - low > 1
            if not alive.all():
                todo, low, high = todo[alive], low[alive], high[alive]
            if not len(todo):
                return reach, least
            reach[todo] += 1
        least[todo] = self.least[np.searchsorted(self.begin, low)]
        return reach, least
