"""A compressed full-text index over a set of symbol sequences, with weights.

The Burrows-Wheeler transform of the sequences is kept as a wavelet matrix of packed bits.
Backward search steps are taken for many searches at once, so that numpy does the work.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of `text`, by prefix doubling."""
    n, k = len(text), 1
    rank = text.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1 if k < n else 0
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.r_[False, key[order][1:] != key[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if k >= n or rank[order[-1]] == n - 1:
            return order
        k *= 2


class Bits:
    """A sequence of bits that tells how many are set before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class FmIndex:
    """Index of sequences `flat` (of lengths `sizes`); each counts `weights` times."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> None:
        symbols, codes = np.unique(flat, return_inverse=True)
        # 0 ends each sequence
        self.starts = np.cumsum(sizes) - sizes + np.arange(len(sizes))
        self.sizes = sizes
        self.text = np.zeros(len(flat) + len(sizes), np.int64)
        inside = np.ones(len(self.text), bool)
        inside[self.starts + sizes] = False
        self.text[inside] = codes + 1
        order = suffix_array(self.text)
        self.weight = np.r_[0, np.cumsum(np.repeat(weights, sizes + 1)[order])]
        last = self.text[order - 1]
        top = len(symbols) + 1
        self.smaller = np.r_[0, np.cumsum(np.bincount(self.text, minlength=top))]
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            bits = (last >> level) & 1
            self.levels.append((level, Bits(bits.astype(np.uint8)), int((bits == 0).sum())))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        # where each symbol begins in the last level
        self.begins = self._down(np.zeros(top, np.int64), np.arange(top))

    def _down(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def back(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that `symbol` and then one of [low, high) begin."""
        both = self._down(np.concatenate([low, high]), np.concatenate([symbol, symbol])) - np.concatenate([self.begins[symbol]] * 2) + np.concatenate([self.smaller[symbol]] * 2)
        return both[: len(low)], both[len(low) :]

    def repeats(self, least: int, weight: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """sequence, start, stop: intervals of `least` symbols or more whose content weighs `weight`; every such window of `least` lies in one.

        Each sequence is taken from its end. A search goes back from an end for as long as what it
        matches weighs enough (the matching statistic of that end). Where it stops at f, shorter
        searches that must reach f halve the way to the first g for which [f, g) is too light, as no
        window may hold that, and the next end is g - 1.
        """
        seq = np.flatnonzero(self.sizes >= least)
        base, end = self.starts[seq], self.sizes[seq].copy()
        place, floor = end.copy(), np.zeros(len(seq), np.int64)
        light, heavy, probing = end.copy(), floor.copy(), np.zeros(len(seq), bool)
        low, high = floor.copy(), np.full(len(seq), len(self.text))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(seq):
            new_low, new_high = self.back(low, high, self.text[base + place - 1])
            on = self.weight[new_high] - self.weight[new_low] >= weight
            low, high, place = np.where(on, new_low, low), np.where(on, new_high, high), place - on
            j = np.flatnonzero(~on | (place == floor))
            if not len(j):
                continue
            through, probe, p, e = on[j], probing[j], place[j], end[j]
            long = ~probe & (e - p >= least)
            if long.any():
                found.append((seq[j[long]], p[long], e[long]))
            # a probe narrows (heavy, light]; a plain search that stopped opens that interval
            stop = np.where(probe, floor[j], p - 1)
            heavy[j] = np.where(probe, np.where(through, e, heavy[j]), stop)
            light[j] = np.where(probe & through, light[j], e)
            a, b = heavy[j], light[j]
            settled = ~long & (b - a <= 1)
            done = (~probe & through) | (~long & (b <= least))
            ahead = np.where(long, stop + least, np.where(settled, b - 1, np.where(~probe & (stop < least) & (least < b), least, (a + b) // 2)))
            probing[j] = ~long & ~settled
            floor[j] = np.where(probing[j], stop, 0)
            end[j] = place[j] = ahead
            low[j], high[j] = 0, len(self.text)
            if done.any():
                keep = np.ones(len(seq), bool)
                keep[j[done]] = False
                seq, base, end, place, floor, light, heavy, probing, low, high = (x[keep] for x in (seq, base, end, place, floor, light, heavy, probing, low, high))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found))
