"""Line dedup with two Bloom filters and exact confirmation of the suspects.

Lines are cut, trimmed and hashed on the bytes of whole batches. Every task
puts the hashes of its lines' keys into a filter of keys seen once and, on a
second sighting, into a filter of keys seen twice. Filters of different tasks
merge bit by bit: what is in both "once" filters may have been seen twice. Only
lines whose key the merged "twice" filter holds are shuffled; they are compared
as whole strings, so a filter's error costs work and never a line.

A corpus of more lines than one broadcast filter can tell apart gets filters by
ranges of hashes, each filled by the task that the range is dealt to, so that
the bits grow with the lines; the hashes are shuffled then, and not their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import FOLD, bound_batches, chunks, materialize, text_buffer, word_bounds, word_hashes

#: Bits of a filter for each line, hash functions, and the largest filter that is broadcast.
BITS_PER_LINE, HASHES, MAX_BITS = 8, 2, 1 << 29
#: Bits of the filter of one range of hashes, where one filter is not enough.
RANGE_BITS = 1 << 26
#: A filter travels in pieces of this many bits.
PIECE_BITS = 1 << 20
#: Rows of one key that a task confirms, at least; beyond, they are dealt over more tasks, for at most ``HOT_KEYS`` keys.
PART_ROWS, HOT_KEYS = 500, 10_000


def line_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(starts, ends, key starts, key ends, row offsets into lines) of the lines of some rows.

    A line ends at its newline or its row's end; a key is the line without white space at its ends.
    """
    rows = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    # A line ends at each newline and at each row's end, where a newline may stand right before.
    many = np.searchsorted(breaks, at)
    line_at = many + np.arange(rows + 1)
    ends = np.empty(line_at[-1], np.int64)
    last = line_at[1:] - 1
    inner = np.ones(len(ends), bool)
    inner[last] = False
    ends[last], ends[inner] = at[1:], breaks
    starts = np.empty(len(ends), np.int64)
    starts[1:] = ends[:-1] + 1
    starts[line_at[:-1]] = at[:-1]
    words, word_ends, _ = word_bounds(data, at)
    a = np.searchsorted(words, starts)
    b = np.searchsorted(words, ends)  # the words of a line are a to b - 1
    full = b > a
    low, high = starts.copy(), starts.copy()
    low[full], high[full] = words[a[full]], word_ends[b[full] - 1]
    return starts, ends, low, high, line_at


def long_keys(data: np.ndarray, low: np.ndarray, high: np.ndarray, min_chars: int) -> np.ndarray:
    """Which keys have ``min_chars`` code points or more."""
    n = high - low
    if (data >= 128).any():
        first = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=first[1:])
        n = first[high] - first[low]
    return n >= min_chars


def hashed_keys(data: np.ndarray, at: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """(row, hash, key start, key end) of every line with a key of ``min_chars`` code points or more."""
    _, _, low, high, line_at = line_spans(data, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(line_at))
    keep = long_keys(data, low, high, min_chars)
    row, low, high = row[keep], low[keep], high[keep]
    return row, word_hashes(data, low, high).view(np.int64), low, high


def filter_bits(lines: int) -> int:
    bits = PIECE_BITS
    while bits < min(lines * BITS_PER_LINE, MAX_BITS):
        bits *= 2
    return bits


def positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ``HASHES`` bit positions of each hash."""
    u = h.view(np.uint64)
    step = (u >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [(u + np.uint64(j) * step) & np.uint64(bits - 1) for j in range(HASHES)]


def holds(bitmap: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    hit = np.ones(len(at[0]), dtype=bool)
    for p in at:
        hit &= (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 != 0
    return hit


def put(bitmap: np.ndarray, at: list[np.ndarray]) -> None:
    for p in at:
        np.bitwise_or.at(bitmap, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))


def twice_seen(hashes: DataFrame, bits: int) -> np.ndarray:
    """The merged filter of hashes that may stand in two documents.

    ``hashes`` has an array column ``hs``: the distinct hashes of a document.
    The result has ``MAX_BITS`` bits at most, a bound that does not grow with the data.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            if not len(h):
                continue
            h, n = np.unique(h, return_counts=True)
            at = positions(h, bits)
            again = holds(once, at) | (n > 1)
            put(twice, [p[again] for p in at])
            put(once, at)
        size = PIECE_BITS // 8
        for piece in range(bits // PIECE_BITS):
            a, b = once[piece * size : (piece + 1) * size], twice[piece * size : (piece + 1) * size]
            if a.any():
                yield pa.RecordBatch.from_pydict({"piece": [piece], "once": [zlib.compress(a.tobytes(), 1)], "twice": [zlib.compress(b.tobytes(), 1)]}, schema=arrow)

    arrow = pa.schema([("piece", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def merge(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by piece; a task holds one piece at a time."""
        now, once, twice = None, None, None
        done = lambda: pd.DataFrame({"piece": [now], "once": [b""], "twice": [zlib.compress(twice.tobytes(), 1)]})
        for pdf in groups:
            for piece, a, b in zip(pdf["piece"], pdf["once"], pdf["twice"], strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if piece != now:
                    if now is not None:
                        yield done()
                    now, once, twice = piece, a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if now is not None:
            yield done()

    parts = hashes.mapInArrow(fill, "piece int, once binary, twice binary")
    merged = parts.repartition("piece").sortWithinPartitions("piece").mapInPandas(merge, "piece int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.select("piece", "twice").toLocalIterator():
        bitmap = np.frombuffer(zlib.decompress(row.twice), np.uint8)
        out[row.piece * len(bitmap) : (row.piece + 1) * len(bitmap)] = bitmap
    return out


def key_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(hs): the distinct hashes of each text's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at in chunks(batch.column(0)):
                row, h, _, _ = hashed_keys(data, at, min_chars)
                by = np.lexsort((h, row))
                row, h = row[by], h[by]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                row, h = row[new], h[new]
                upto = np.searchsorted(row, np.arange(len(at))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(upto), pa.array(h))], names=["hs"])

    return docs.mapInArrow(run, "hs array<long>")


def pick_lines(docs: DataFrame, doc: list[str], chosen, min_chars: int) -> DataFrame:
    """(*doc, key): the distinct keys of each text whose (row of the batch, hash) ``chosen`` holds for.

    ``docs``: the columns ``doc``, then the text, then what else ``chosen`` reads from the batch.
    """
    width = len(doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column(width)):
                row, h, low, high = hashed_keys(data, at, min_chars)
                hit = np.flatnonzero(chosen(batch, first + row, h))
                small = FOLD[data]
                found = list(dict.fromkeys((r, small[a:b].tobytes()) for r, a, b in zip((first + row[hit]).tolist(), low[hit].tolist(), high[hit].tolist(), strict=True)))
                rows = pa.array([r for r, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in range(width)], pa.array([k for _, k in found], pa.binary()).cast(pa.string())], names=[*doc, "key"])

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*[f"{c} {types[c]}" for c in doc], "key string"]))


def seen_in_ranges(hashes: DataFrame, ranges: int) -> DataFrame:
    """(h): the hashes that may stand in two texts, by a filter for each of ``ranges`` parts of all hashes.

    Each task sends a hash once for each of its batches, so a very common line costs no task much.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n > 1)], names=["h", "again"])

    bits = RANGE_BITS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h, again = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            every = np.unique(h)
            marks = positions(every, bits)
            more = holds(once, marks) | np.isin(every, h[again])
            if len(every) < len(h):
                value, n = np.unique(h, return_counts=True)
                more |= n > 1
            put(twice, [p[more] for p in marks])
            put(once, marks)
            sure = every[holds(twice, marks)]
            yield pa.RecordBatch.from_arrays([pa.array(sure)], names=["h"])

    return hashes.mapInArrow(distinct, "h long, again boolean").repartition(ranges, "h").mapInArrow(fill, "h long").distinct()


def suspected_keys(docs: DataFrame, doc: list[str], min_chars: int) -> DataFrame:
    """(*doc, key) of the keys that may stand in two texts."""
    hashes = materialize(key_hashes(docs.select("text"), min_chars))
    total = hashes.agg(F.sum(F.size("hs"))).first()[0] or 0
    if total * BITS_PER_LINE <= MAX_BITS:
        bits = filter_bits(total)
        seen = docs.sparkSession.sparkContext.broadcast(twice_seen(hashes, bits))
        return pick_lines(docs.select(*doc, "text"), doc, lambda batch, row, h: holds(seen.value, positions(h, bits)), min_chars)
    repeats = materialize(seen_in_ranges(hashes, -(-total * BITS_PER_LINE // RANGE_BITS)))
    flat = docs.select(*doc, "text").mapInArrow(_with_hashes(doc, min_chars), ", ".join([*[f"{c} {dict(docs.dtypes)[c]}" for c in doc], "h long"]))
    marked = flat.join(repeats, "h", "left_semi").groupBy(*doc).agg(F.collect_set("h").alias("hs"))
    marked = marked.select(*[F.col(c).alias(f"m_{c}") for c in doc], "hs")
    same = F.lit(True)
    for c in doc:
        same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    joined = docs.join(marked, same).select(*doc, "text", "hs")

    def chosen(batch: pa.RecordBatch, row: np.ndarray, h: np.ndarray) -> np.ndarray:
        lists = batch.column(len(doc) + 1)
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        held = pd.MultiIndex.from_arrays([np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False)])
        return pd.MultiIndex.from_arrays([row, h]).isin(held)

    return pick_lines(joined, doc, chosen, min_chars)


def _with_hashes(doc: list[str], min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column(len(doc))):
                row, h, _, _ = hashed_keys(data, at, min_chars)
                by = np.lexsort((h, row))
                row, h = row[by], h[by]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                rows = pa.array(first + row[new])
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in range(len(doc))], pa.array(h[new])], names=[*doc, "h"])

    return run


def lost_keys(suspects: DataFrame) -> DataFrame:
    """(id, fp, lost): the keys that each document loses, of (id, fp, key) suspects.

    The rows of a common key are dealt over several tasks. How many keys can be
    common is bounded, so the table of them is broadcast.
    """
    # One row with an id and one without are two documents; all rows without an id are one.
    ids = F.max("id").isNotNull() & (F.min("id") < F.max("id")) | (F.count("id") < F.count(F.lit(1))) & (F.count("id") > 0)
    per = materialize(suspects.groupBy("key").agg(F.min("id").alias("first"), ids.alias("many"), F.count(F.lit(1)).alias("n")).filter("many").select("key", "first", "n"))
    rows = per.agg(F.sum("n")).first()[0] or 0
    part = max(PART_ROWS, -(-rows // HOT_KEYS))
    hot = per.filter(F.col("n") > part).groupBy(F.xxhash64("key").alias("kh")).agg(F.ceil(F.max("n") / part).cast("int").alias("parts"))
    hot = F.broadcast(materialize(hot))
    dealt = lambda df: df.withColumn("kh", F.xxhash64("key")).join(hot, "kh", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    firsts = dealt(per).select("key", "first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    placed = dealt(suspects).withColumn("salt", F.pmod(F.xxhash64("id", "fp"), F.col("parts")).cast("int"))
    lost = placed.join(firsts, ["key", "salt"]).filter(~F.col("id").eqNullSafe(F.col("first")))
    return lost.groupBy("id", "fp").agg(F.collect_set("key").alias("lost"))


def cut_lines(texts: pa.Array, lost: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(texts without the lines whose key is in the row's ``lost``, lines dropped); rows without lost keys are null."""
    n = pc.fill_null(pc.list_value_length(lost), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lost_row = np.repeat(np.arange(len(n)), n)
    keys = lost.flatten()
    kd, k_at = text_buffer(keys)
    kh = word_hashes(kd, k_at[:-1], k_at[1:]).view(np.int64) if len(keys) else np.zeros(0, np.int64)
    first_key = np.concatenate(([0], np.cumsum(n)))
    gone = np.zeros(len(n), np.int64)
    parts: list[bytes | None] = []
    for first, data, at in chunks(texts):
        starts, ends, low, high, line_at = line_spans(data, at)
        rows = len(at) - 1
        row = np.repeat(np.arange(rows), np.diff(line_at))
        h = word_hashes(data, low, high).view(np.int64)
        mine = slice(first_key[first], first_key[first + rows])
        held = pd.MultiIndex.from_arrays([lost_row[mine] - first, kh[mine]])
        hit = np.flatnonzero(pd.MultiIndex.from_arrays([row, h]).isin(held)) if len(held) else np.zeros(0, np.int64)
        small = FOLD[data]
        drop = np.zeros(len(row), bool)
        now, own = -1, set()
        for i in hit.tolist():
            if row[i] != now:
                now = int(row[i])
                own = set(keys.slice(first_key[first + now], n[first + now]).cast(pa.binary()).to_pylist())
            drop[i] = small[low[i] : high[i]].tobytes() in own
        gone[first : first + rows] = np.bincount(row[drop], minlength=rows)
        for r in range(rows):
            if not n[first + r]:
                parts.append(None)
                continue
            a, b = line_at[r], line_at[r + 1]
            if not drop[a:b].any():
                parts.append(data[at[r] : at[r + 1]].tobytes())
            else:
                left = np.flatnonzero(~drop[a:b]) + a
                # Runs of kept lines are one slice each.
                runs = np.flatnonzero(np.concatenate(([True], np.diff(left) > 1))) if len(left) else np.zeros(0, np.int64)
                stops = np.concatenate((runs[1:], [len(left)])).astype(np.int64) if len(left) else runs
                parts.append(b"\n".join(data[starts[left[x]] : ends[left[y - 1]]].tobytes() for x, y in zip(runs, stops, strict=True)))
    return pa.array(parts, pa.binary()).cast(pa.string()), gone


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Drop lines that an earlier document has.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    A key of ``min_chars`` code points or more that two or more documents hold
    loses its lines in all of them but the one with the smallest id. Returns
    all columns of ``docs`` with the new text, and ``n_lines`` (before),
    ``n_dropped``; columns of these names in ``docs`` are replaced.

    A null or empty text is one empty line and comes back empty. Rows that
    share an id count as one document; rows without an id count as one
    document that comes last. A document whose lines all go keeps its row with
    an empty text. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    doc_id, text = F.col(id_col), F.col(text_col)
    # What a row without an id loses depends on its lines alone, so such rows are kept apart by their text.
    fp = F.when(doc_id.isNull(), F.xxhash64(text))
    named = docs.select(doc_id.alias("id"), fp.alias("fp"), text.alias("text"))
    suspects = materialize(suspected_keys(named, ["id", "fp"], min_chars))
    lost = lost_keys(suspects).select(F.col("id").alias("__lost_id"), F.col("fp").alias("__lost_fp"), F.col("lost").alias("__lost"))

    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in own if c != text_col]).alias("__row"), doc_id.alias("__id"), fp.alias("__fp"), text.alias("__text"))
    joined = whole.join(lost, F.col("__id").eqNullSafe(F.col("__lost_id")) & F.col("__fp").eqNullSafe(F.col("__lost_fp")), "left")

    @F.arrow_udf("struct<text:string,n_dropped:long>")
    def without(text: pa.Array, lost: pa.Array) -> pa.Array:
        kept, gone = cut_lines(text, lost)
        return pa.StructArray.from_arrays([kept, pa.array(gone)], ["text", "n_dropped"])

    loses = F.col("__lost").isNotNull()
    cut = joined.withColumn("__cut", without(F.when(loses, F.col("__text")), F.col("__lost")))
    n_lines = F.octet_length("__text") - F.octet_length(F.replace("__text", F.lit("\n"), F.lit(""))) + 1
    return cut.select(
        *[F.when(loses, F.col("__cut.text")).otherwise(F.coalesce("__text", F.lit(""))).alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in own],
        F.coalesce(n_lines, F.lit(1)).cast("long").alias("n_lines"),
        F.when(loses, F.col("__cut.n_dropped")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )
