"""A compressed FM-index over words: Burrows-Wheeler transform in a wavelet matrix, backward search,
matching statistics up to a depth. Vectorised over many patterns."""

from __future__ import annotations

import numpy as np

_MASKS = np.array([(1 << i) - 1 for i in range(64)], np.uint64)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one packed bit vector a level."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.levels = []
        n = len(sequence)
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (sequence >> bit & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words)[:-1], out=counts[1:])
            self.levels.append((bit, words, counts, n - int(ones.sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        self.base = self._walk(np.zeros(top + 1, np.int64), np.arange(top + 1))

    def _walk(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for bit, words, counts, zeros in self.levels:
            word = at >> 6
            ones = counts[word] + np.bitwise_count(words[word] & _MASKS[at & 63])
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._walk(at, symbol) - self.base[symbol]


class FMIndex:
    """Index of segments of words (64-bit hashes). Suffixes are sorted by their first ``depth`` words, which
    is all that backward search for patterns of up to ``depth`` words needs."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owner: np.ndarray, depth: int):
        """words: of all segments, joined; owner: a number for each segment, of which the least is reported."""
        self.depth = depth
        self.alphabet, symbol = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths)
        n = len(words) + len(lengths)
        text = np.zeros(n, np.int32)  # every segment ends with a 0; numbers of words and places fit 32 bits
        text[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = symbol + 1
        del symbol
        stop = np.repeat((ends + np.arange(len(lengths))).astype(np.int32), lengths + 1)
        ranks, k = {1: text}, 1
        while 2 * k <= depth:
            ranks[2 * k] = self._paired(ranks[k], k, stop)[0]
            k *= 2
        final, order = self._paired(ranks[k], depth - k, stop) if depth > k else (ranks[k], np.argsort(ranks[k], kind="stable").astype(np.int32))
        del final, stop
        self.lcp = self._common_prefixes(ranks, order, n)
        del ranks
        self.wavelet = WaveletMatrix(text[order - 1], len(self.alphabet))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self.n = n
        segment = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
        edges = np.flatnonzero(self.lcp[:-1] < depth)
        self.block = np.cumsum(self.lcp[:-1] < depth, dtype=np.int32) - 1
        self.least = np.minimum.reduceat(owner[segment[order]], edges)
        del segment, order, text
        shorter = np.flatnonzero(self.lcp < depth - 1).astype(np.int32)
        which = np.cumsum(self.lcp[:-1] < depth - 1, dtype=np.int32) - 1
        self.low, self.high = shorter[which], shorter[which + 1]
        self.minima = [self.lcp]
        while 2 ** len(self.minima) <= n:
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _paired(rank: np.ndarray, shift: int, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(rank)
        key = rank.astype(np.int64) << 32
        at = np.arange(n, dtype=np.int32) + np.int32(shift)
        inside = at <= stop
        key[inside] |= rank[at[inside]]
        del at, inside
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        out = np.empty(n, np.int32)
        out[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]), dtype=np.int32)
        return out, order

    def _common_prefixes(self, ranks: dict, order: np.ndarray, n: int) -> np.ndarray:
        """Words that neighbours in the order share, at most depth; 0 before the first and after the last."""
        a, b = order[:-1].copy(), order[1:].copy()
        total = np.zeros(n - 1, np.int32)
        for k in sorted(ranks, reverse=True):
            rank = ranks[k]
            again = True
            while again:
                inside = (a < n) & (b < n)
                same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
                step = np.int32(k) * same
                total += step
                a += step
                b += step
                again = 2 * k > self.depth - 1 and k > 1 and bool((same & (total < self.depth)).any())
        out = np.zeros(n + 1, np.uint8 if self.depth < 256 else np.int32)
        out[1:n] = np.minimum(total, self.depth)
        return out

    def _parents(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest ranges around [low, high) whose suffixes share ``length`` words."""
        low, high = low.copy(), high.copy()
        for k in range(len(self.minima) - 1, -1, -1):
            table, span = self.minima[k], 1 << k
            start = low - span + 1
            go = (start >= 0) & (table[np.clip(start, 0, len(table) - 1)] >= length)
            low[go] -= span
            go = (high < len(table)) & (table[np.minimum(high, len(table) - 1)] >= length)
            high[go] += span
        return low, high

    def matching_statistics(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of each pattern: the longest prefix of its suffix (up to depth words) that the
        index holds, and the least owner of its occurrences where that is ``depth`` words, else -1."""
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1).astype(np.int32)
        symbol = np.where(self.alphabet[at] == words, at + np.int32(1), np.int32(0))
        del at
        ends = np.cumsum(lengths)
        found, least = np.zeros(len(words), np.int32), np.full(len(words), -1, np.int64)
        live = np.argsort(-lengths, kind="stable")
        low, high, length = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64), np.zeros(len(lengths), np.int64)
        count = np.searchsorted(-lengths[live], -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
        for step, m in enumerate(count.tolist()):
            own = live[:m]
            place = ends[own] - 1 - step
            c, lo, hi, q = symbol[place], low[own], high[own], length[own]
            full = q == self.depth
            first = lo[full]
            lo[full], hi[full], q[full] = self.low[first], self.high[first], self.depth - 1
            todo = np.flatnonzero(c > 0)
            lost = c == 0
            lo[lost], hi[lost], q[lost] = 0, self.n, 0
            while len(todo):
                both = self.wavelet.rank(np.concatenate([lo[todo], hi[todo]]), np.concatenate([c[todo], c[todo]]))
                start, stop = self.before[c[todo]] + both[: len(todo)], self.before[c[todo]] + both[len(todo) :]
                good = start < stop
                hit = todo[good]
                lo[hit], hi[hit], q[hit] = start[good], stop[good], q[hit] + 1
                todo = todo[~good]
                if len(todo):  # drop last words until the match can be extended
                    shorter = np.maximum(self.lcp[lo[todo]], self.lcp[hi[todo]]).astype(np.int64)
                    shorter = np.minimum(shorter, q[todo] - 1)
                    zero = shorter <= 0
                    wide = self._parents(lo[todo], hi[todo], np.maximum(shorter, 1))
                    lo[todo], hi[todo] = np.where(zero, 0, wide[0]), np.where(zero, self.n, wide[1])
                    q[todo] = np.maximum(shorter, 0)
            low[own], high[own], length[own] = lo, hi, q
            found[place] = q
            whole = q == self.depth
            least[place[whole]] = self.least[self.block[lo[whole]]]
        return found, least
