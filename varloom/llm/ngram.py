"""Back-off n-gram tables in sorted hash arrays, looked up for whole batches.

A table answers log P(symbol | last n-1 symbols) for several models at once
(one column each). For order N down to 1: if the n-gram is stored, its value
ends the search; if not, the weight that its context passes on to the shorter
one is added (nothing, where the context is not stored) and n falls by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from varloom.llm.common import U64, mix64, stream64

_M = stream64(101, 32) | U64(1)
_TAG = stream64(103, 32)


def lags_of(symbols: np.ndarray, starts: np.ndarray, lens: np.ndarray, n: int, pad: int) -> list[np.ndarray]:
    """``symbols`` and its n-1 shifts; what lies before a row's start is ``pad``."""
    symbols = symbols.astype(U64)
    out = [symbols]
    for j in range(1, n):
        lag = np.empty_like(symbols)
        lag[:j], lag[j:] = pad, symbols[:-j] if j < len(symbols) else symbols[:0]
        for r in range(j):
            lag[starts[lens > r] + r] = pad
        out.append(lag)
    return out


def gram_hash(lags: list[np.ndarray], n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = lags[0] * _M[0] + _TAG[n]
        for j in range(1, n):
            h += lags[j] * _M[j]
        return mix64(h)


def context_hash(lags: list[np.ndarray], n: int) -> np.ndarray:
    """The hash of the n-1 symbols before the current one."""
    with np.errstate(over="ignore"):
        h = np.full(len(lags[0]), _TAG[n] ^ U64(0x5555), dtype=U64)
        for j in range(1, n):
            h += lags[j] * _M[j]
        return mix64(h)


class HashIndex:
    """Row numbers of hashes in a sorted array, from an index of its first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = U64(64 - max(1, min(24, int(len(keys)).bit_length())))
        edges = np.arange((1 << int(64 - int(self.bits))) + 1, dtype=np.float64) * 2.0 ** int(self.bits)
        self.start = np.searchsorted(keys, np.minimum(edges, 2.0**64 - 2048).astype(U64)).astype(np.int32)
        self.start[-1] = len(keys)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, whether it is there); the row is 0 where it isn't."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = self.start[(h >> self.bits).astype(np.int64)].astype(np.int64)
        last = len(self.keys) - 1
        np.minimum(at, last, out=at)
        live = np.flatnonzero(self.keys[at] < h)
        while len(live):
            at[live] += 1
            live = live[at[live] <= last]
            live = live[self.keys[at[live]] < h[live]]
        np.minimum(at, last, out=at)
        hit = self.keys[at] == h
        at[~hit] = 0
        return at, hit


@dataclass
class BackoffTable:
    """``grams[n]`` and ``contexts[n]``: hashes (sorted) and a row of values for each; ``floor``: for symbols never seen."""

    order: int
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray

    def __post_init__(self):
        self._grams = {n: HashIndex(k) for n, (k, _) in self.grams.items()}
        self._contexts = {n: HashIndex(k) for n, (k, _) in self.contexts.items()}

    def __reduce__(self):
        return BackoffTable, (self.order, self.grams, self.contexts, self.floor)

    def score(self, lags: list[np.ndarray]) -> np.ndarray:
        """A row of log-probabilities for each position."""
        out = np.zeros((len(lags[0]), len(self.floor)), dtype=np.float32)
        live = None
        for n in range(self.order, 0, -1):
            at, hit = self._grams[n].find(gram_hash(lags, n))
            values = self.grams[n][1]
            if live is None:
                out[hit] = values[at[hit]]
                live = np.flatnonzero(~hit)
            else:
                out[live[hit]] += values[at[hit]]
                live = live[~hit]
            if not len(live):
                return out
            lags = [x[~hit] for x in lags[: n if n > 1 else 1]]
            at, hit = self._contexts[n].find(context_hash(lags, n))
            out[live[hit]] += self.contexts[n][1][at[hit]]
        out[live] += self.floor
        return out


def sum_rows(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the rows [start, start + len); rows follow each other without gaps."""
    out = np.zeros((len(starts), values.shape[1]))
    full = lens > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=np.float64)
    return out
