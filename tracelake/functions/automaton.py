"""Finite automata over whole arrays: each symbol is a function of states, functions compose associatively, and
their closure is small. So an array is run in blocks: the product of each block, the products before each block by
doubling, then the states inside all blocks at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Symbols in a block.
BLOCK = 64
#: Functions that a closure may have; one that grows beyond is no use here.
FUNCTIONS = 4096


class Automaton:
    """``step(state, symbol)`` gives the next state; sequences begin in state 0."""

    def __init__(self, step: Callable[[int, int], int], states: int, symbols: int):
        # Each symbol has a twin that begins a sequence: a constant function.
        moves = [tuple(step(s, x) for s in range(states)) for x in range(symbols)]
        moves += [(m[0],) * states for m in moves]
        known = {tuple(range(states)): 0}
        queue = [*known]
        for f in queue:
            for g in moves:
                product = tuple(g[s] for s in f)
                if product not in known:
                    if len(known) >= FUNCTIONS:
                        raise ValueError("too many functions")
                    known[product] = len(known)
                    queue.append(product)
        self.symbols, functions = symbols, [*known]
        self.images = np.array(functions, np.uint16)
        self.products = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
        self.of = np.array([0, *(known[m] for m in moves)], np.uint16)  # the first stands for no symbol

    def states(self, symbols: np.ndarray, starts: np.ndarray, state: int = 0) -> np.ndarray:
        """The state after each symbol. starts: where sequences begin; ``state`` holds before the first symbol."""
        n = len(symbols)
        if not n:
            return np.empty(0, np.uint16)
        height = -(-n // BLOCK)
        grid = np.zeros(height * BLOCK, np.uint16)
        grid[:n] = self.of[1 + symbols + self.symbols * starts]
        grid = np.ascontiguousarray(grid.reshape(height, BLOCK).T)
        whole = np.zeros(height, np.uint16)
        for row in grid:
            whole = self.products[whole, row]
        shift = 1
        while shift < height:
            whole[shift:] = self.products[whole[:-shift], whole[shift:]]
            shift *= 2
        now = np.full(height, state, np.uint16)
        now[1:] = self.images[whole[:-1], state]
        out = np.empty((BLOCK, height), np.uint16)
        for i, row in enumerate(grid):
            now = self.images[row, now]
            out[i] = now
        return out.T.reshape(-1)[:n]
