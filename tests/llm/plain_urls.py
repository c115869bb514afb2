"""A model of URLs that one process holds, plainly: what the operator's scores and threshold are held against."""

import numpy as np

from tracelake.llm._shared import mix
from tracelake.llm.url_filter import ORDER, _lay_out


class Markov:
    """Counts of (context, byte) for contexts of 0 to ``order`` bytes, as sorted hash tables."""

    def __init__(self, texts: list[bytes], order: int = ORDER):
        self.order = order
        symbols, scored, _ = _lay_out(texts, order)
        self.tables = []
        for k in range(order + 1):
            context, pair = _keys(symbols, scored, k)
            pairs, first, n = np.unique(pair, return_index=True, return_counts=True)
            contexts, where, total = np.unique(context, return_inverse=True, return_counts=True)
            kinds = np.bincount(where[first], minlength=len(contexts))
            self.tables.append((pairs, n.astype(np.int32), contexts, total.astype(np.int32), kinds.astype(np.int32)))

    def log_likelihood(self, texts: list[bytes]) -> np.ndarray:
        symbols, scored, row = _lay_out(texts, self.order)
        p = np.full(len(scored), 1 / 256)
        for k, (pairs, n, contexts, total, kinds) in enumerate(self.tables):
            if not len(pairs):
                continue
            context, pair = _keys(symbols, scored, k)
            at, found = _find(contexts, context)
            of, hit = _find(pairs, pair)
            count = np.where(hit, n[of], 0)
            p = np.where(found, (count + kinds[at] * p) / (total[at] + kinds[at]), p)
        return np.bincount(row, np.log(p), minlength=len(texts))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _keys(symbols: np.ndarray, scored: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    context = np.full(len(scored), k + 1, np.uint64)
    for j in range(1, k + 1):
        context = context * np.uint64(0x9E3779B97F4A7C15) + symbols[scored - j]
    context = mix(context)
    return context, mix(context * np.uint64(0xD6E8FEB86659FD93) + symbols[scored])


def ratio(accepted: Markov, rejected: Markov, texts: list[bytes]) -> np.ndarray:
    """Difference of log-likelihoods a byte; 0 for an empty text."""
    length = np.array([max(1, len(t)) for t in texts])
    return (accepted.log_likelihood(texts) - rejected.log_likelihood(texts)) / length


def calibrate(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold with the best mean of both classes' accuracies; the middle of the best gap."""
    if not len(good) or not len(bad):
        return 0.0
    scores = np.concatenate([good, bad])
    order = np.argsort(scores, kind="stable")
    scores, accepted = scores[order], (np.arange(len(order)) < len(good))[order]
    # cut before position i: everything from i on is accepted
    kept = len(good) - np.concatenate([[0], np.cumsum(accepted)])
    dropped = np.concatenate([[0], np.cumsum(~accepted)])
    balanced = kept / len(good) + dropped / len(bad)
    edges = np.concatenate([[scores[0] - 1], (scores[1:] + scores[:-1]) / 2, [scores[-1] + 1]])
    usable = np.concatenate([[True], scores[1:] > scores[:-1], [True]])
    best = np.flatnonzero(usable & (balanced >= balanced[usable].max() - 1e-12))
    return float(edges[best].mean()) if len(best) == 1 else float((edges[best[0]] + edges[best[-1]]) / 2)
