"""Benchmark decontamination by greedy string tiling.

Windows of ``min_tile`` words are the seeds. A filter of the benchmark's seeds
picks the windows of documents that may be among them; these are joined with
the table of seeds, and a document and an item with enough seeds in common are
tiled: the longest run of words that both have and that is not marked yet is
marked, again and again, and the share of an item's words that ends up marked is
its coverage. Order does not matter, so a passage whose sentences were shuffled
is covered all the same. Runs are found by rolling hashes and compared as words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import FOLD, U64, bound_batches, chunks, materialize, mix64, powers, text_buffer, window_hashes, word_bounds, word_hashes
from varloom.llm.linededup import holds, positions, put

#: Words are runs of letters and digits: any other ASCII byte separates them.
_ALNUM = [*range(48, 58), *range(65, 91), *range(97, 123)]
BREAKS = np.ones(256, dtype=bool)
BREAKS[[*_ALNUM, *range(128, 256)]] = False
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Bits of the filter for each seed, its least and its largest size. Beyond the
#: largest size more windows of documents meet the seeds in the join; the result stays the same.
BITS_PER_SEED, LEAST_BITS, MAX_BITS = 16, 1 << 20, 1 << 28


#: A seed is common if more documents than this have it, and more than one in COMMON_SHARE of all rows of seeds; parts that its rows are dealt over.
COMMON, COMMON_SHARE, PARTS = 1000, 20_000, 32


def windows(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, window hashes, row offsets into them, words of each row) of successive pieces of a column."""
    for first, data, at in chunks(texts):
        starts, ends, row_at = word_bounds(data, at, BREAKS)
        h, h_at = window_hashes(word_hashes(data, starts, ends), row_at, k)
        yield first, h.view(np.int64), h_at, np.diff(row_at)


def seed_table(items: DataFrame, k: int) -> DataFrame:
    """(h, no, n, size): the seeds of each (no, text) item, how often it has them, and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, h, h_at, size in windows(batch.column(1), k):
                for r in range(len(size)):
                    seeds, n = np.unique(h[h_at[r] : h_at[r + 1]], return_counts=True)
                    if len(seeds):
                        no = batch.column(0)[first + r].as_py()
                        yield pa.RecordBatch.from_pydict({"h": seeds, "no": np.full(len(seeds), no), "n": n.astype(np.int64), "size": np.full(len(seeds), size[r])})

    return items.select("no", "text").mapInArrow(run, "h long, no long, n long, size long")


def common_cover(items: DataFrame, common: np.ndarray, k: int) -> DataFrame:
    """(no, cover): how many words of each (no, text) item lie in windows of ``common`` (sorted) hashes; items without one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, h, h_at, size in windows(batch.column(1), k):
                hit = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                cover = [int(covered_by(np.flatnonzero(hit[h_at[r] : h_at[r + 1]]), k, int(size[r])).sum()) for r in range(len(size))]
                some = np.flatnonzero(cover)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + some)), pa.array(np.array(cover, np.int64)[some])], names=["no", "cover"])

    return items.select("no", "text").mapInArrow(run, "no long, cover long")


def seed_filter(seeds: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the seeds, of ``MAX_BITS`` bits at most."""
    bits = LEAST_BITS
    while bits < min(count * BITS_PER_SEED, MAX_BITS):
        bits *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            put(own, positions(batch.column(0).to_numpy(zero_copy_only=False), bits))
        if own.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for row in seeds.select("h").mapInArrow(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return out


def seeds_udf(sent, k: int):
    @F.arrow_udf("array<long>")
    def seeds(texts: pa.Array) -> pa.Array:
        """The distinct windows of each text that may be seeds."""
        bitmap = sent.value
        bits, upto, flat = len(bitmap) * 8, [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for _, h, h_at, size in windows(texts, k):
            at = np.flatnonzero(holds(bitmap, positions(h, bits)[:1]))
            at = at[holds(bitmap, positions(h[at], bits))]
            row = np.searchsorted(h_at, at, "right") - 1
            by = np.lexsort((h[at], row))
            row, found = row[by], h[at][by]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            flat.append(found[new])
            upto.append(upto[-1][-1] + np.searchsorted(row[new], np.arange(1, len(size) + 1)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(upto).astype(np.int32)), pa.array(np.concatenate(flat)))

    return seeds


class Rolling:
    """Hashes of all runs of a length of some codes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = powers(len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(mix64(codes.astype(U64) + U64(1)) * up[: len(codes)], dtype=U64, out=self.total[1:])

    def runs(self, starts: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[starts + length] - self.total[starts]) * self.down[starts]


def inside(free: np.ndarray, length: int) -> np.ndarray:
    """The starts of the runs of ``length`` that are wholly free."""
    upto = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(upto[length:] - upto[:-length] == length)


def covered_by(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:size] > 0


def tile(text: np.ndarray, item: np.ndarray, k: int, need: float) -> tuple[int, int]:
    """(words of the item covered, tiles) of two sequences of word codes.

    The longest common run of unmarked words comes first; of equally long ones
    that which is first in the item, and then in the text. (0, 0) if runs of
    ``k`` cannot cover ``need`` words. Memory and each step go with the two
    lengths, however often words repeat.
    """
    size, most = len(item), min(len(text), len(item))
    if most < k:
        return 0, 0
    a, b = Rolling(text), Rolling(item)
    every_a, every_b = np.arange(len(text) - k + 1), np.arange(size - k + 1)
    ha, hb = a.runs(every_a, k), b.runs(every_b, k)
    free_b = covered_by(every_b[np.isin(hb, ha)], k, size)
    if free_b.sum() < need or not free_b.any():
        return 0, 0
    free_a = covered_by(every_a[np.isin(ha, hb)], k, len(text))
    covered = tiles = 0
    while most >= k:
        low, length = k, 0
        while low <= most:  # the longest length with a common run
            mid = (low + most) // 2
            if np.isin(b.runs(inside(free_b, mid), mid), a.runs(inside(free_a, mid), mid)).any():
                length, low = mid, mid + 1
            else:
                most = mid - 1
        if not length:
            break
        y = inside(free_a, length)
        hy = a.runs(y, length)
        by = np.argsort(hy, kind="stable")
        y, hy = y[by], hy[by]
        x = inside(free_b, length)
        hx = b.runs(x, length)
        low_at, high_at = np.searchsorted(hy, hx), np.searchsorted(hy, hx, "right")
        tried: dict[int, int] = {}  # of a hash: the first run of the text that may still be free
        for i in np.flatnonzero(high_at > low_at).tolist():
            s = int(x[i])
            if not free_b[s : s + length].all():
                continue
            at, stop = tried.get(int(low_at[i]), int(low_at[i])), int(high_at[i])
            while at < stop and not free_a[y[at] : y[at] + length].all():
                at += 1
            tried[int(low_at[i])] = at
            while at < stop and not (free_a[y[at] : y[at] + length].all() and np.array_equal(text[y[at] : y[at] + length], item[s : s + length])):
                at += 1
            if at < stop:
                free_a[y[at] : y[at] + length] = False
                free_b[s : s + length] = False
                covered += length
                tiles += 1
        most = length - 1
    return covered, tiles


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text)


def tiles_udf(k: int, threshold: float):
    @F.arrow_udf("struct<covered:long,tiles:long>")
    def tiles(texts: pa.Array, items: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), 2), np.int64)
        (x, x_at), (y, y_at) = text_buffer(texts), text_buffer(items)
        held: tuple[bytes, list[bytes]] = (b"", [])
        for i in range(len(out)):
            raw = FOLD[x[x_at[i] : x_at[i + 1]]].tobytes()
            if raw != held[0]:  # a document stands beside each of its items
                held = raw, words_of(raw)
            item = words_of(FOLD[y[y_at[i] : y_at[i + 1]]].tobytes())
            code = {w: n for n, w in enumerate(dict.fromkeys(item))}
            text = np.array([code.get(w, -1) for w in held[1]], np.int64)
            out[i] = tile(text, np.array([code[w] for w in item], np.int64), k, threshold * len(item))
        return pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["covered", "tiles"])

    return tiles


class Benchmark:
    """The items of a benchmark as tables: items (no, item_id, text), seeds, and the filter of seeds."""

    def __init__(self, benchmark: DataFrame, item_col: str, item_text: str, k: int):
        bound_batches(benchmark.sparkSession)
        self.k = k
        items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
        self.items = materialize(items.withColumn("no", F.monotonically_increasing_id()))
        self.seeds = materialize(seed_table(self.items, k))
        self.sent = benchmark.sparkSession.sparkContext.broadcast(seed_filter(self.seeds, self.seeds.count()))

    def hits(self, rows: DataFrame, threshold: float) -> DataFrame:
        """(rid, item_id, coverage, covered, tiles) of (rid, text, seeds) rows, for items covered to ``threshold`` or more.

        A seed that many documents and many items have would make a pair of each with each. Such seeds are common:
        more than ``COMMON`` documents have them, and more than one in ``COMMON_SHARE`` of all rows of seeds. An item whose words in common seeds
        are less than ``threshold`` of it can only be covered with the help of another seed, so it is joined
        on its other seeds alone. The few items that consist of common seeds are joined on all of theirs, which are dealt over parts.
        """
        each = rows.select("rid", F.explode("seeds").alias("h"))
        held = each.join(self.seeds.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.count("*").alias("docs"))
        held = materialize(held)
        total = held.agg(F.sum("docs")).first()[0] or 0
        # No more than COMMON_SHARE seeds can be above this bound.
        found = held.filter(F.col("docs") > max(COMMON, total / COMMON_SHARE)).select("h").toArrow().column("h").to_numpy()
        seeds = self.seeds.withColumn("cover", F.lit(0).cast("long"))
        met = each.join(seeds, "h").select("rid", "no", "n", "size", "cover")
        if len(found):
            common = np.sort(found)
            cover = materialize(common_cover(self.items, common, self.k))
            seeds = self.seeds.join(cover, "no", "left").withColumn("cover", F.coalesce("cover", F.lit(0)).cast("long"))
            whole = F.col("cover") >= F.lit(threshold) * F.col("size")
            is_common = F.col("h").isin([int(x) for x in common])
            # Of items that have a seed that is not common the rest need not be counted: it may be there.
            met = each.filter(~is_common).join(seeds.filter(~is_common & ~whole), "h").select("rid", "no", "n", "size", "cover")
            part = F.when(is_common, F.pmod(F.xxhash64("rid"), F.lit(PARTS))).otherwise(0).cast("int")
            dealt = seeds.filter(whole).withColumn("part", F.explode(F.when(is_common, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))))
            more = each.withColumn("part", part).join(dealt, ["h", "part"])
            met = met.union(more.select("rid", "no", "n", "size", F.lit(0).cast("long")))
        # No more words than the windows in common have, and the words in common seeds, can be covered.
        sums = met.groupBy("rid", "no").agg(F.sum("n").alias("n"), F.first("size").alias("size"), F.first("cover").alias("cover"))
        likely = sums.filter(F.col("n") * self.k + F.col("cover") >= F.lit(threshold) * F.col("size")).select("rid", "no", "size")
        pairs = likely.join(self.items.withColumnRenamed("text", "item_text"), "no").join(rows.select("rid", "text"), "rid")
        made = pairs.select("rid", "item_id", "size", tiles_udf(self.k, threshold)("text", "item_text").alias("t"))
        found = made.filter((F.col("t.covered") > 0) & (F.col("t.covered") >= F.lit(threshold) * F.col("size")))
        return found.select("rid", "item_id", (F.col("t.covered") / F.col("size")).alias("coverage"), "t.covered", "t.tiles")


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_tile: int = 4, threshold: float = 0.5
) -> DataFrame:
    """(id, item_id, coverage, covered, tiles): documents and the items that they give away.

    Clean documents have no row; a document that is there twice has its rows
    twice. Items without text or with fewer than ``min_tile`` words match
    nothing, and neither do null or empty texts. Items that share an id are
    compared one by one. Ids of both are of any type and may be null. Texts of
    any length are read whole; only documents with a seed are written or shuffled.
    """
    bench = Benchmark(benchmark, item_col, item_text, min_tile)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("seeds", seeds_udf(bench.sent, min_tile)("text"))
    rows = materialize(rows.filter(F.size("seeds") > 0).withColumn("rid", F.monotonically_increasing_id()))
    found = bench.hits(rows, threshold).join(rows.select("rid", "id"), "rid")
    return found.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "coverage", "covered", "tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_tile: int = 4, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that give no item away; see ``contaminated_pairs``."""
    bench = Benchmark(benchmark, item_col, item_text, min_tile)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    every = docs.select(row, F.col(text_col).alias("text")).withColumn("seeds", seeds_udf(bench.sent, min_tile)("text"))
    rows = materialize(every.filter(F.size("seeds") > 0).withColumn("rid", F.monotonically_increasing_id()))
    kept = rows.join(bench.hits(rows, threshold).select("rid").distinct(), "rid", "left_anti")
    clean = every.filter(F.size("seeds") == 0)
    return clean.select("row").union(kept.select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
