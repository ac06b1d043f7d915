"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or nothing (0) on every document.
How often each vote pattern occurs in the whole corpus is all that expectation
maximisation needs to estimate every labeller's accuracy and the share of bad
documents. The posterior labels of a bounded sample then train a linear scorer
over hashed words and word shapes, which scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import IS_SPACE, U64, bound_batches, chunks, mix64, word_bounds, word_hashes

# Bytes by kind. Bytes of more than ASCII count as letters.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#$%&*+/<=>@[]\\^_`{|}~")] = True
#: A byte of the shape of a word: A for upper case, a for other letters, 0 for digits, others as they are.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[LETTER], SHAPE[UPPER], SHAPE[DIGIT] = ord("a"), ord("A"), ord("0")

#: (name, statistic, bad from, good up to, fewest words): bad at or above the
#: first value and good at or below the second, the other way round where the first is the smaller.
LABELLERS = (
    ("symbols", "symbol_share", 0.05, 0.01, 1),
    ("shouting", "upper_share", 0.3, 0.1, 5),
    ("stutter", "repeat_share", 0.2, 0.03, 10),
    ("variety", "distinct_share", 0.25, 0.45, 50),
    ("exclamations", "bangs_per_word", 0.2, 0.05, 5),
    ("tables", "bars_per_word", 0.05, 0.0, 5),
    ("line_copies", "line_copy_share", 0.4, 0.05, 1),
    ("odd_ends", "plain_end_share", 0.6, 0.95, 5),
    ("digits", "digit_share", 0.3, 0.05, 1),
)
BUCKET_BITS = 18


def totals(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), at)).astype(float)


def distinct(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The number of distinct values in each row."""
    by = np.lexsort((h, row))
    h, r = h[by], row[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=rows).astype(float)


def votes(data: np.ndarray, at: np.ndarray, words: tuple) -> np.ndarray:
    """(rows, labellers) of -1, 0 and 1; a row without words has no vote."""
    starts, ends, row_at, hashes = words
    rows = len(at) - 1
    n = np.diff(row_at).astype(float)
    row = np.repeat(np.arange(rows), np.diff(row_at))
    many = np.maximum(n, 1)
    letters = totals(LETTER[data], at)
    black = np.maximum(totals(~IS_SPACE[data], at), 1)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    last = data[ends - 1]
    plain = LETTER[last] | DIGIT[last] | np.isin(last, np.frombuffer(b".,;:!?'\")", np.uint8))
    breaks = np.ones(256, bool)
    breaks[:] = False
    breaks[10] = True
    line_starts, line_ends, line_at = word_bounds(data, at, breaks)
    lines = np.diff(line_at)
    line_row = np.repeat(np.arange(rows), lines)
    stats = {
        "symbol_share": totals(SYMBOL[data], at) / black,
        "upper_share": totals(UPPER[data], at) / np.maximum(letters, 1),
        "repeat_share": np.bincount(row[again], minlength=rows) / many,
        "distinct_share": distinct(hashes, row, rows) / many,
        "bangs_per_word": totals(data == ord("!"), at) / many,
        "bars_per_word": totals(data == ord("|"), at) / many,
        "line_copy_share": 1 - distinct(word_hashes(data, line_starts, line_ends), line_row, rows) / np.maximum(lines, 1),
        "plain_end_share": np.bincount(row[plain], minlength=rows) / many,
        "digit_share": totals(DIGIT[data], at) / black,
    }
    out = np.zeros((rows, len(LABELLERS)), np.int8)
    for j, (_, stat, bad, good, fewest) in enumerate(LABELLERS):
        x, sign = stats[stat], 1 if bad > good else -1
        out[:, j] = (n >= fewest) * ((sign * x <= sign * good) * 1 - (sign * x >= sign * bad) * 1)
    out[n == 0] = 0
    return out


def features(data: np.ndarray, words: tuple) -> np.ndarray:
    """(words, 3) buckets: a word, its shape without repeated signs, and whether it repeats the one before."""
    starts, ends, _, hashes = words
    shape = SHAPE[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    keep = first[:-1] | np.concatenate(([True], shape[1:] != shape[:-1]))
    upto = np.concatenate(([0], np.cumsum(keep)))
    # In lower case "A" and "a" would be one.
    cut = np.where(shape == ord("A"), 1, shape).astype(np.uint8)[keep]
    shapes = word_hashes(cut, upto[starts], upto[ends])
    mask = U64((1 << BUCKET_BITS) - 1)
    same = np.zeros(len(hashes), np.int64)
    same[1:] = hashes[1:] == hashes[:-1]
    kinds = (1 << BUCKET_BITS) * np.arange(2)
    return np.stack([(hashes & mask).astype(np.int64) + kinds[0], (mix64(shapes) & mask).astype(np.int64) + kinds[1], (2 << BUCKET_BITS) + same], axis=1)


WIDTH = (2 << BUCKET_BITS) + 2


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(bad) of each pattern, P(vote -1, 0, 1 | good or bad) of each labeller, the share of bad).

    A labeller that does not vote says nothing: its 0 has the weight 1 for either class.
    """
    bad = np.where((patterns < 0).any(axis=1), 0.6 + 0.05 * (patterns < 0).sum(axis=1), 0.1).clip(0, 0.95)
    seen = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    emit, share = np.zeros((2, patterns.shape[1], 3)), 0.5
    for _ in range(rounds):
        w = np.stack([counts * (1 - bad), counts * bad])
        share = (w[1].sum() + 1) / (counts.sum() + 2)
        emit = np.einsum("cp,pjv->cjv", w, seen) + 0.1
        emit /= emit[:, :, [0, 2]].sum(axis=2)[:, :, None]
        emit[:, :, 1] = 1
        log = np.einsum("pjv,cjv->cp", seen, np.log(emit)) + np.log([1 - share, share])[:, None]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        done = np.abs(new - bad).max() < 1e-9
        bad = new
        if done:
            break
    return bad, emit, share


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of mean features, by AdaGrad on soft labels."""
    buckets = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    label = np.array([r[2] for r in rows])
    used, col = np.unique(buckets, return_inverse=True)
    w, b, sw, sb = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(row, value * w[col], len(rows)) - b))
        e = (p - label) / len(rows)
        g = np.bincount(col, value * e[row], len(used)) + decay * w / len(rows)
        sw += g * g
        w -= rate * g / np.sqrt(sw)
        gb = e.sum()
        sb += gb * gb
        b -= rate * gb / np.sqrt(sb)
    out = np.zeros(WIDTH, np.float32)
    out[used] = w
    return out, float(b)


def distinct_sample(texts: DataFrame, most: int) -> DataFrame:
    """(text): the ``most`` different texts with the smallest hashes. Copies of a text are one before anything is sent."""
    h = F.xxhash64(F.lit(29), "text")
    last = texts.select(h.alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return texts.limit(0)
    return texts.filter(h <= last).groupBy(h.alias("h")).agg(F.first("text").alias("text")).select("text")


def classify_quality(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_train_docs: int = 4000,
    rounds: int = 300,
    rate: float = 0.3,
    decay: float = 1e-3,
    keep_from: float = 0.5,
) -> DataFrame:
    """(id, votes, posterior, quality, keep) of every row.

    ``votes``: those of ``LABELLERS``; ``posterior``: the probability of good
    quality by the label model; ``quality``: that of the trained scorer;
    ``keep``: ``quality`` of ``keep_from`` or more. The label model's pattern counts cover
    all documents (3 to the number of labellers at most); the scorer learns
    from ``max_train_docs`` whole texts at most, those with the smallest hashes.
    Texts that many documents share are one of them.

    A null, empty or wordless text has no votes, quality 0 and is not kept.
    Repeated rows get the same result and each counts. Where all or no
    documents are bad the scorer still learns the posteriors. An empty table
    gives no rows. Other columns of ``docs`` are left out.
    """
    bound_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(named.dtypes)["id"]

    def parsed(col: pa.Array) -> Iterator[tuple]:
        for first, data, at in chunks(col):
            starts, ends, row_at = word_bounds(data, at)
            yield first, data, at, (starts, ends, row_at, word_hashes(data, starts, ends))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at, words in parsed(batch.column(0)):
                full = np.diff(words[2]) > 0
                found, n = np.unique(votes(data, at, words)[full], axis=0, return_counts=True)
                flat = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([flat, pa.array(n.astype(np.int64))], names=["votes", "n"])

    seen = named.select("text").mapInArrow(vote, "votes array<byte>, n long").groupBy("votes").agg(F.sum("n").alias("n")).toArrow()
    if not seen.num_rows:
        return named.select(F.col("id").alias(id_col), F.array().cast("array<byte>").alias("votes"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("quality"), F.lit(False).alias("keep"))
    seen = seen.sort_by([("n", "descending")])
    counts = seen.column("n").to_numpy().astype(float)
    _, emit, share = expectation_maximisation(np.array(seen.column("votes").to_pylist(), np.int8), counts)
    log = np.log(emit), np.log([1 - share, share])

    def good(v: np.ndarray) -> np.ndarray:
        each = np.take_along_axis(np.broadcast_to(log[0][:, None], (2, len(v), *log[0].shape[1:])), (v.astype(np.int64) + 1)[None, :, :, None], axis=3)[..., 0]
        z = each.sum(axis=2) + log[1][:, None]
        return 1 / (1 + np.exp(np.clip(z[1] - z[0], -50, 50)))

    def mean_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at, words in parsed(batch.column(0)):
                label, f, row_at = good(votes(data, at, words)), features(data, words), words[2]
                for i in np.flatnonzero(np.diff(row_at) > 0):
                    bucket, n = np.unique(f[row_at[i] : row_at[i + 1]], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"bucket": [bucket.astype(np.int32)], "value": [(n / (row_at[i + 1] - row_at[i])).astype(np.float32)], "label": [label[i]]})

    sample = distinct_sample(named.select("text").filter("text is not null"), max_train_docs)
    got = sample.mapInArrow(mean_features, "bucket array<int>, value array<float>, label double").toArrow()
    rows = [(np.asarray(b.values), np.asarray(v.values), y.as_py()) for b, v, y in zip(got.column(0), got.column(1), got.column(2), strict=True)]
    model = train(rows, rounds, rate, decay) if rows else (np.zeros(WIDTH, np.float32), float(np.log((1 - share) / share)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = sent.value
        for batch in batches:
            for first, data, at, words in parsed(batch.column(1)):
                v, row_at = votes(data, at, words), words[2]
                n = np.diff(row_at)
                full = n > 0
                z = np.zeros(len(n))
                z[full] = np.add.reduceat(w[features(data, words)].sum(axis=1, dtype=np.float64), row_at[:-1][full]) / n[full] + b if full.any() else 0.0
                quality = np.where(full, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
                flat = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * v.shape[1], pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), flat, pa.array(np.where(full, good(v), 0.0)), pa.array(quality)], names=["id", "votes", "posterior", "quality"])

    out = named.mapInArrow(score, f"id {id_type}, votes array<byte>, posterior double, quality double")
    return out.select(F.col("id").alias(id_col), "votes", "posterior", "quality", (F.col("quality") >= keep_from).alias("keep"))
