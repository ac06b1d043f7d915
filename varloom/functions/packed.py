"""Packed genotypes as blocks of bytes: a row for each variant, four samples to the byte, the first in the lowest bits.

A block is a two-dimensional numpy array over the bytes as they were read.
Codes: 0 hom-a1, 1 missing, 2 het, 3 hom-a2. Bits behind the last sample are 0.
"""

from __future__ import annotations

import numpy as np

from varloom.functions.genotypes import HET, HOM_A1, HOM_A2, MISSING

_LANES = np.arange(4, dtype=np.uint8) * 2
#: The four codes of every byte.
CODES = (np.arange(256, dtype=np.uint8)[:, None] >> _LANES) & 3


def width(n_samples: int) -> int:
    return -(-n_samples // 4)


def pack(codes: np.ndarray) -> np.ndarray:
    rows, n = codes.shape
    full = np.zeros((rows, 4 * width(n)), np.uint8)
    full[:, :n] = codes
    return np.bitwise_or.reduce(full.reshape(rows, -1, 4) << _LANES, axis=2)


def unpack(block: np.ndarray, n_samples: int) -> np.ndarray:
    return CODES[block].reshape(len(block), -1)[:, :n_samples]


#: Every byte with its homozygotes exchanged.
SWAPPED = pack(np.where(CODES == HOM_A1, HOM_A2, np.where(CODES == HOM_A2, HOM_A1, CODES)))[:, 0]


def clear_padding(block: np.ndarray, n_samples: int) -> np.ndarray:
    if n_samples % 4 and len(block):
        block[:, -1] &= (1 << 2 * (n_samples % 4)) - 1
    return block


def swap(block: np.ndarray, n_samples: int) -> np.ndarray:
    return clear_padding(SWAPPED[block], n_samples)


def missing_row(n_samples: int) -> np.ndarray:
    return pack(np.full((1, n_samples), MISSING, np.uint8))[0]


class Gather:
    """Rows of a shard on the output's sample axis: where each output sample is in a row, found once for all rows."""

    def __init__(self, local_of: np.ndarray, n_local: int):
        """``local_of``: the place of each output sample in the shard, -1 where it is not there."""
        self.n = len(local_of)
        self.same = self.n == n_local and bool((local_of == np.arange(self.n)).all())
        at = np.maximum(local_of, 0)
        self.byte, self.shift, self.absent = at // 4, (at % 4 * 2).astype(np.uint8), np.flatnonzero(local_of < 0)

    def __call__(self, block: np.ndarray) -> np.ndarray:
        if self.same:
            return clear_padding(block, self.n)
        codes = (block[:, self.byte] >> self.shift) & 3
        codes[:, self.absent] = MISSING
        return pack(codes)


def ploidy_issues(block: np.ndarray, sexes: np.ndarray, male: int, female: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(heterozygotes of haploid samples, genotypes of samples that have no copy, samples skipped as their sex is unknown) of each row; the last is the same for all."""
    ploidy = np.where(sexes == 1, male, np.where(sexes == 2, female, male if male == female else -1))
    codes = unpack(block, len(sexes))
    het = (codes[:, ploidy == 1] == HET).sum(axis=1)
    there = (codes[:, ploidy == 0] != MISSING).sum(axis=1)
    return het, there, int((ploidy == -1).sum())
