"""A compressed FM-index over sequences of integers: the Burrows-Wheeler transform in a wavelet matrix of packed bits, a bit for
each suffix of a sequence that occurs more than once, and the sorted symbols. The text is not kept: what is searched is streamed past
the index. With 2^16 symbols that is about 3 bytes a position, besides 28 bytes a different symbol.

Searches run for many patterns at a time, a step of all of them by a few array operations.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)
        self.zeros = len(bits) - int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, Bits]] = []
        for shift in range(max(1, (n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1
            self.levels.append((shift, Bits(bit.astype(np.uint8))))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(n_symbols)
        self.starts = self._trace(every, np.zeros(n_symbols, np.int64)).astype(np.int32)

    def _trace(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1 == 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._trace(symbol, at) - self.starts[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes, sorted by their first symbols up to the next 0, at least depth of them.

    Prefix doubling. A suffix has the rank of the first place of its group of so far equal ones; only groups of two or more are
    sorted on, without suffixes whose 0 has been reached.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) if n else ends  # symbols before the next 0
    rank = np.empty(n, np.int64)
    at, known = np.arange(n), 1
    suffix, key = order, text[order]
    while True:
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        rank[suffix] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))] if len(at) else at
        alone = first & np.append(first[1:], True)
        more = ~alone & (left[suffix] >= known)
        at, suffix = at[more], suffix[more]
        if known >= depth or not len(at):
            return order
        # `at` may have lost some of a group's places: what is left of a group takes its places in order.
        key = rank[suffix] * (n + 1) + rank[suffix + known] + 1
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[at] = suffix
        known *= 2


class FMIndex:
    """Index of sequences, each marked if it occurs more than once. Patterns may have up to depth symbols; none runs over the end
    of a sequence."""

    def __init__(self, sequences: list[np.ndarray], often: np.ndarray, depth: int):
        lengths = np.array([len(x) + 1 for x in sequences], np.int64)
        starts = np.cumsum(lengths) - lengths
        self.values = np.unique(np.concatenate(sequences)) if sequences else np.zeros(0, np.uint64)
        text = np.zeros(int(lengths.sum()), np.int64)  # 0 ends each sequence
        for start, x in zip(starts, sequences, strict=True):
            text[start : start + len(x)] = np.searchsorted(self.values, x) + 1
        order = suffix_order(text, depth + 1)
        n_symbols = len(self.values) + 1
        self.wavelet = WaveletMatrix(text[order - 1], n_symbols)
        self.counts = np.bincount(text, minlength=n_symbols)
        self.smaller = np.cumsum(self.counts) - self.counts
        self.often = Bits(np.repeat(often, lengths)[order].astype(np.uint8))
        self.size = len(text)

    def bytes_held(self) -> int:
        bits = [b for _, b in self.wavelet.levels] + [self.often]
        return sum(b.words.nbytes + b.before.nbytes for b in bits) + self.wavelet.starts.nbytes + self.values.nbytes + self.smaller.nbytes + self.counts.nbytes

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the suffix ranges of the patterns with symbol put before them."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        n = len(symbol)
        return self.smaller[symbol] + both[:n], self.smaller[symbol] + both[n:]

    def again(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each range holds two occurrences or more."""
        return (high - low >= 2) | (self.often.rank(high) > self.often.rank(low))

    def repeats(self, patterns: list[np.ndarray], window: int, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics above a threshold, of sequences of the index that are streamed past it, about chunk symbols at a time:
        their intervals (number of the sequence, from, to), in which every window occurs at least twice."""
        lengths = np.array([len(x) for x in patterns], np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // chunk)) + 1
        found = [self._repeats(np.searchsorted(self.values, np.concatenate(patterns[own[0] : own[-1] + 1])) + 1, lengths[own], window, own[0]) for own in np.split(np.arange(len(patterns)), cuts) if len(own)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def _backward(self, text: np.ndarray, ends: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """From each end in text, the number of symbols, steps at most, that a search goes back while what it matches occurs again."""
        done = np.zeros(len(ends), np.int64)
        live = np.flatnonzero(steps > 0)
        symbol = text[ends[live] - 1]
        low, high = self.smaller[symbol], self.smaller[symbol] + self.counts[symbol]
        while len(live):
            more = self.again(low, high)
            live, low, high = live[more], low[more], high[more]
            done[live] += 1
            more = done[live] < steps[live]
            live, low, high = live[more], low[more], high[more]
            if len(live):
                low, high = self.extend(text[ends[live] - done[live] - 1], low, high)
        return done

    def _repeats(self, text: np.ndarray, lengths: np.ndarray, window: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One search goes back from each sequence's end; what it matches is settled. The windows that begin before are searched for from
        their own ends, all at once."""
        base, seq = np.cumsum(lengths) - lengths, np.arange(len(lengths))
        reached = lengths - self._backward(text, base + lengths, lengths)
        wide = seq[lengths - reached >= window]
        left = np.minimum(reached, np.maximum(lengths - window + 1, 0))
        which = np.repeat(seq, left)
        start = np.arange(len(which)) - np.repeat(np.cumsum(left) - left, left)
        whole = self._backward(text, base[which] + start + window, np.full(len(which), window)) == window
        which, start = which[whole], start[whole]
        return np.concatenate([wide, which]) + number, np.concatenate([reached[wide], start]), np.concatenate([lengths[wide], start + window])
