"""Shared pieces of the corpus operators: scratch tables and a numpy word kernel.

The kernel works on the UTF-8 buffers of an Arrow string column, so that the
text of a batch is cut into words and hashed without making Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.scratch import materialize, scratch_dir

__all__ = ["materialize", "scratch_dir"]

#: The white space that separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text is worked through in pieces of about this many bytes (or one document).
CHUNK_BYTES = 1 << 19

U64 = np.uint64


#: Bytes of a batch that goes to Python. Rows of text differ too much for a bound on rows.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than one in so many of all rows is spread.
SPREAD_SHARE = 1000


def join_spread(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, parts: int = 64) -> DataFrame:
    """``rows`` joined with their row of ``groups``, which has ``keys`` once each and in ``size`` how many rows have them.

    The rows of a key that more than one in ``SPREAD_SHARE`` of all rows have are dealt over ``parts`` copies of its
    group's row. Fewer than ``SPREAD_SHARE`` keys can be so common; their hashes are sent to all tasks.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    common = [r[0] for r in groups.filter(F.col(size) * SPREAD_SHARE > total).select(F.xxhash64(*keys)).collect()]
    if not common:
        return rows.join(groups, keys)
    hot = F.xxhash64(*keys).isin(common)
    spread = lambda yes, no: F.when(hot, yes).otherwise(no)
    left = rows.withColumn("__part", spread(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"), F.lit(0)))
    right = groups.withColumn("__part", F.explode(spread(F.sequence(F.lit(0), F.lit(parts - 1)), F.array(F.lit(0)))))
    return left.join(right, [*keys, "__part"]).drop("__part")


def lower_ascii(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream64(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True
_BYTE64 = stream64(7, 256)[FOLD]
_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        up, down = np.full(size, _BASE, dtype=U64), np.full(size, pow(_BASE, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    n = len(col)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of successive whole rows of about ``limit`` bytes."""
    data, at = text_buffer(col)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_bounds(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets into words) of the words of some rows; ``breaks``: the bytes between words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = breaks[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE64[data] * up[: len(data)], dtype=U64, out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix64(h + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


_EXACT64 = stream64(13, 256)


def exact_word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(_EXACT64[data] * up[: len(data)], dtype=U64, out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


_STEP = stream64(11, 64) | U64(1)


def window_hashes(words: np.ndarray, row_at: np.ndarray, k: int, whole_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets) of the ``k``-word windows that lie within rows.

    With ``whole_short`` a row of 1 to k-1 words has one window, of all its words.
    """
    lens = np.diff(row_at)
    many = np.maximum(lens - k + 1, 0)
    short = whole_short & (lens > 0) & (many == 0)
    out_at = np.concatenate(([0], np.cumsum(many + short)))
    n = len(words)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(n - k + 1, 0), dtype=U64)
        for j in range(k):
            rolled += words[j : j + len(rolled)] * _STEP[j]
        out = np.empty(out_at[-1], dtype=U64)
        first = np.repeat(row_at[:-1] - out_at[:-1], many + short) + np.arange(out_at[-1])
        is_short = np.repeat(short, many + short)
        out[~is_short] = rolled[first[~is_short]]
        for row in np.flatnonzero(short):
            w = words[row_at[row] : row_at[row + 1]]
            out[out_at[row]] = (w * _STEP[: len(w)]).sum(dtype=U64) + U64(len(w))
    return mix64(out), out_at
