"""Runs of repeated words, found by internal pattern matching.

The words of a piece of text (some documents, parted by words that occur once)
get a suffix array by doubling, which leaves for every length L = 2^k the
class of the L words at each place. A run of period q holds a block of L words
that starts at a multiple of L, with L the largest power of two up to q (or 8
words for smaller q), and the block occurs again q words on. So each block asks
for its next occurrences in the window of L to 2L words after it: a range successor
query, by a wavelet tree over the suffix array, in the block's interval of it.
Occurrences that overlap by half a block or more form a progression, whose step is
the period of the block; a longer period can only map the ends of the
block's own progression to the ends of that one, so a progression gives two
candidates and not one for each occurrence. A candidate is extended both ways by
comparing classes of powers of two, and what is long enough is a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import CHUNK_BYTES, bound_batches, chunks, exact_word_hashes, word_bounds

#: Words of the shortest block, and the least length of a run in words and in periods.
LEAST_BLOCK, LEAST_WORDS, LEAST_PERIODS = 8, 24, 3


class Classes:
    """``of[k][i]``: where in the suffix array the suffixes begin that share the first 2^k words of suffix ``i``."""

    def __init__(self, words: np.ndarray, deepest: int):
        n = len(words)
        _, inverse, count = np.unique(words, return_inverse=True, return_counts=True)
        rank = (np.cumsum(count) - count)[inverse]
        self.n, self.of = n, [rank.astype(np.int32)]
        size = count[inverse]
        active = np.flatnonzero(size > 1)
        while 1 << len(self.of) <= deepest and len(active):
            step = 1 << (len(self.of) - 1)
            after = np.full(len(active), -1, np.int64)
            inside = active + step < n
            after[inside] = rank[active[inside] + step]
            order = np.argsort(rank[active] * np.int64(n + 1) + after, kind="stable")
            place, first, second = active[order], rank[active][order], after[order]
            fresh = np.ones(len(place), bool)
            fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            begins = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            parent = np.ones(len(place), bool)
            parent[1:] = first[1:] != first[:-1]
            offset = begins - np.flatnonzero(parent)[np.cumsum(parent)[begins] - 1]
            rank = rank.copy()
            rank[place] = first + offset[group]
            many = np.diff(np.append(begins, len(place)))
            active = place[many[group] > 1]
            self.of.append(rank.astype(np.int32))
        self.last = rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on are the same."""
        length, top = np.zeros(len(i), np.int64), len(self.of) - 1
        for k in (top, *range(top - 1, -1, -1)):
            live, at = np.arange(len(i)), self.of[k]
            while len(live):
                x, y = i[live] + length[live], j[live] + length[live]
                same = np.maximum(x, y) + (1 << k) <= self.n
                same[same] = at[x[same]] == at[y[same]]
                live = live[same]
                length[live] += 1 << k
                if k < top:
                    break
        return length

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before ``i`` and before ``j`` are the same."""
        length, top = np.zeros(len(i), np.int64), len(self.of) - 1
        for k in (top, *range(top - 1, -1, -1)):
            live, at = np.arange(len(i)), self.of[k]
            while len(live):
                x, y = i[live] - length[live] - (1 << k), j[live] - length[live] - (1 << k)
                same = np.minimum(x, y) >= 0
                same[same] = at[x[same]] == at[y[same]]
                live = live[same]
                length[live] += 1 << k
                if k < top:
                    break
        return length


class WaveletTree:
    """Range successors over an array of distinct values 0 to n-1."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.split = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1 == 1
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.zeros.append(zeros)
            self.split.append(int(zeros[-1]))
            values = np.concatenate((values[~one], values[one]))

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at ``low`` to ``high`` - 1 are less than ``x``."""
        total = np.zeros(len(x), np.int64)
        beyond = x >= 1 << self.bits
        total[beyond] = (high - low)[beyond]
        for b, zeros, split in zip(range(self.bits - 1, -1, -1), self.zeros, self.split, strict=True):
            a, c = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = (x >> b) & 1 == 1
            total += np.where(one & ~beyond, c - a, 0)
            low, high = np.where(one, split + low - a, a), np.where(one, split + high - c, c)
        return total

    def smallest(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of this rank among those at ``low`` to ``high`` - 1."""
        value = np.zeros(len(rank), np.int64)
        for zeros, split in zip(self.zeros, self.split, strict=True):
            a, c = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = rank >= c - a
            value = value * 2 + one
            rank = np.where(one, rank - (c - a), rank)
            low, high = np.where(one, split + low - a, a), np.where(one, split + high - c, c)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """The smallest value of at least ``x`` there, or ``none``."""
        rank = self.below(low, high, x)
        out = np.full(len(x), none, np.int64)
        some = np.flatnonzero(rank < high - low)
        out[some] = self.smallest(low[some], high[some], rank[some])
        return out


def candidates(classes: Classes, tree: WaveletTree, size_of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of blocks of 2^k words, candidate periods)."""
    length = 1 << k
    rank = classes.of[k].astype(np.int64)
    b = np.arange(0, classes.n - length + 1, length)
    b = b[size_of[b] > 1]
    low, high = rank[b], rank[b] + size_of[b]
    end = b + 2 * length
    at = b + (1 if length == LEAST_BLOCK else length)
    out_b, out_q = [], []
    while len(b):
        at = tree.successor(low, high, at, classes.n + 2 * length)
        live = at < end
        b, low, high, end, at = (x[live] for x in (b, low, high, end, at))
        if not len(b):
            break
        out_b.append(b)
        out_q.append(at - b)
        following = tree.successor(low, high, at + 1, classes.n + 2 * length)
        step = following - at
        # One occurrence by itself, and the first of a progression, is a candidate as it is.
        row = np.flatnonzero(step <= length // 2)
        p, x, y = step[row], at[row], b[row]
        here_low, here_high = y - classes.common_before(y, y + p), y + p + classes.common(y, y + p)
        there_low, there_high = x - classes.common_before(x, x + p), x + p + classes.common(x, x + p)
        for q in (p, there_low - here_low, there_high - here_high):
            good = (q > 0) & (q < 2 * length)
            out_b.append(y[good])
            out_q.append(q[good])
        at = following
        at[row] = there_high - length + 1
    if not out_b:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_b), np.concatenate(out_q)


def runs(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period. ``words``: numbers; ``longest``: the words of the longest text of them."""
    deepest = max(LEAST_BLOCK, longest // LEAST_PERIODS)
    classes = Classes(words, deepest)
    found: list[np.ndarray] = []
    tree = None
    for k in range(LEAST_BLOCK.bit_length() - 1, len(classes.of)):
        rank = classes.of[k]
        size_of = np.bincount(rank, minlength=classes.n)[rank]
        if tree is None:
            tree = WaveletTree(np.argsort(classes.last, kind="stable").astype(np.int32))
        b, q = candidates(classes, tree, size_of, k)
        if not len(b):
            continue
        b, q = np.unique(np.stack((b, q)), axis=1)
        inside = b + q < classes.n
        b, q = b[inside], q[inside]
        before, after = classes.common_before(b, b + q), classes.common(b, b + q)
        length = before + q + after
        good = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        if good.any():
            found.append(np.stack((b - before, length, q))[:, good])
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    # The same stretch is a run of its smallest period only.
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def rewritten(n: int, h: int) -> np.ndarray | None:
    """Which word stands at each place of a text of ``n`` words after the trial edit of hash ``h``; None: no edit."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def piece_runs(data: np.ndarray, at: np.ndarray, hashes: list[int | None]) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]]:
    """(edit, starts, lengths, periods) of each text of a piece; starts are word numbers of the text."""
    starts, ends, row_at = word_bounds(data, at)
    h = exact_word_hashes(data, starts, ends)
    many = np.diff(row_at)
    edits = [None if x is None else rewritten(int(n), x) for n, x in zip(many, hashes, strict=True)]
    for r, edit in enumerate(edits):
        if edit is not None:
            h[row_at[r] : row_at[r + 1]] = h[row_at[r] : row_at[r + 1]][edit]
    _, number = np.unique(h, return_inverse=True)
    # A word that occurs once follows each text.
    text_at = row_at + np.arange(len(row_at))
    words = np.empty(len(number) + len(many), np.int64)
    is_end = np.zeros(len(words), bool)
    is_end[text_at[1:] - 1] = True
    words[~is_end] = number
    words[is_end] = len(number) + np.arange(len(many))
    longest = int(many.max(initial=0))
    start, length, period = runs(words, longest) if longest >= LEAST_WORDS else (np.zeros(0, np.int64),) * 3
    cut = np.searchsorted(start, text_at)
    for r, edit in enumerate(edits):
        a, b = cut[r], cut[r + 1]
        yield edit, start[a:b] - text_at[r], length[a:b], period[a:b]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words are in no run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:n] == 0


def sharpest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run of the greatest length for its period; of equal ones the first, then the one of the smallest period."""
    best = 0
    for i in range(1, len(start)):
        left, right = int(length[i]) * int(period[best]), int(length[best]) * int(period[i])
        if left > right or (left == right and (start[i], period[i]) < (start[best], period[best])):
            best = i
    return best


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    for batch in batches:
        edits = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(batch)
        for first, data, at in chunks(batch.column(1), CHUNK_BYTES):
            n = len(at) - 1
            rows = []
            for r, (edit, start, length, period) in enumerate(piece_runs(data, at, edits[first : first + n])):
                rows.append((data[at[r] : at[r + 1]], edit, start, length, period))
            yield batch.column(0).slice(first, n), rows


def word_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, period): all runs of repeated words of each text, a row for each run.

    Words are stretches without space or U+0009 to U+000D and are compared byte by byte, numbered from 0. A run
    is a stretch with smallest period q, of at least 24 words and 3 q words,
    that no word beside it extends. Texts that are null, empty or shorter
    have none. Every row is a text of its own, also where ids repeat or are null.
    A task takes about 200 bytes for each word of 0.5 MB of texts, or of the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _walk(batches):
            take = pa.array(np.repeat(np.arange(len(rows)), [len(x[2]) for x in rows]))
            cols = [np.concatenate([x[c] for x in rows]) if rows else np.zeros(0, np.int64) for c in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([ids.take(take), *map(pa.array, cols)], names=["id", "start", "length", "period"])

    bound_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = named.mapInArrow(run, f"id {dict(named.dtypes)['id']}, start long, length long, period long")
    return out.select(F.col("id").alias(id_col), "start", "length", "period")


def collapse_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edit_col: str | None = None, digest: bool = False) -> DataFrame:
    """One row for each text: (id, n_runs, start, length, period, exponent_milli, runs, collapsed).

    ``start`` to ``exponent_milli`` are those of the run with the greatest
    length for its period (null without a run), ``runs`` lists all runs as lines
    of ``start,length,period``, ``collapsed`` has the words, joined by one space, that are in no run after
    its first period. With ``digest`` the last two are their SHA-256 in hexadecimal. ``edit_col`` names a column of
    unsigned hashes of a trial edit that makes runs (see ``rewritten``); null: no edit. Nulls, short texts and repeated rows as
    in ``word_runs``; a text without words collapses to an empty one.
    """
    id_type = dict(docs.dtypes)[id_col]
    names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _walk(batches):
            out: list[tuple] = []
            for text, edit, start, length, period in rows:
                words = text.tobytes().split()
                if edit is not None:
                    words = [words[i] for i in edit.tolist()]
                kept = words
                if len(start):
                    kept = [w for w, on in zip(words, kept_words(len(words), start, length, period).tolist(), strict=True) if on]
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
                best: tuple = (None,) * 4
                if len(start):
                    i = sharpest(start, length, period)
                    best = (int(start[i]), int(length[i]), int(period[i]), 1000 * int(length[i]) // int(period[i]))
                joined = b" ".join(kept)
                if digest:
                    out.append((len(start), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(joined).hexdigest()))
                else:
                    out.append((len(start), *best, lines, joined.decode()))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            cols = [pa.array([x[c] for x in out], kinds[c]) for c in range(7)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=names)

    bound_batches(docs.sparkSession)
    edit = [F.col(edit_col).cast("long").alias("edit")] if edit_col else []
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *edit)
    out = named.mapInArrow(run, f"id {id_type}, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string")
    return out.select(F.col("id").alias(id_col), *names[1:])
