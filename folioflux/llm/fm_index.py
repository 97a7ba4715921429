"""An FM-index over integer symbols: wavelet-tree ranks, backward search of many patterns at once, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `text` in order, by prefix doubling. The last symbol must be the smallest and unique."""
    n = len(text)
    bits = max(1, int(n).bit_length())
    if 3 * bits > 63:
        raise ValueError("a shard has 2**20 symbols at most")
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], text[order][1:] != text[order][:-1]]))
    step, place = 1, np.arange(n, dtype=np.int64)
    while rank.max() < n - 1:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        packed = np.sort((rank << (2 * bits)) | (second << bits) | place)
        order = packed & ((1 << bits) - 1)
        pair = packed >> bits
        rank[order] = np.cumsum(np.concatenate([[0], pair[1:] != pair[:-1]]))
        step *= 2
    return np.argsort(rank)


class WaveletTree:
    """A wavelet tree laid out by levels (a wavelet matrix): rank and access in as many steps as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift) & 1
            ones = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((shift, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at.copy()
        for shift, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol, at = np.zeros_like(at), at.copy()
        for _, ones, zeros in self.levels:
            a = ones[at]
            one = ones[at + 1] > a
            symbol = symbol * 2 + one
            at = np.where(one, zeros + a, at - a)
        return symbol


class FMIndex:
    """Counts and places of patterns in a sequence of symbols 1..top. Every `sample`-th position is stored."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = 8):
        text = np.concatenate([symbols.astype(np.int64), [0]])
        suffixes = suffix_array(text)
        last = text[suffixes - 1]
        self.size = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        self.tree = WaveletTree(last, max(1, int(top).bit_length()))
        kept = suffixes % sample == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = suffixes[kept]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each pattern. Patterns stand in the rows of a matrix,
        right-aligned; the search runs backward from their last symbol, for all at once."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.size, dtype=np.int64)
        live = np.arange(len(patterns))
        width = patterns.shape[1] if len(patterns) else 0
        for step in range(width):
            live = live[(sizes[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = patterns[live, width - 1 - step].astype(np.int64)
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the sequence of each row's suffix: steps back until a stored position is met."""
        rows, found, steps = rows.copy(), np.full(len(rows), -1, dtype=np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            stored = self.kept[at + 1] > self.kept[at]
            found[live[stored]] = self.places[self.kept[at[stored]]] + steps
            live, at = live[~stored], at[~stored]
            symbol = self.tree.access(at)
            rows[live] = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return found
