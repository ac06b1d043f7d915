"""Language-model scoring with a probabilistic suffix tree over words.

A text is its words (A-Z lower-cased) and an end. The alphabet of the tree are
the commonest words and one symbol for all others, which share its probability
as their counts have it; words that training lacks are one of those. At the root a
symbol has its smoothed count, (c + 0.5) / (N + 0.5 (V + 1)). Longer contexts are
the last word and the last two. Training texts are cut into (context, next
symbol) codes; packed runs of sorted codes with their counts go to the task that
has their context, where the context is tested: its n * KL against its parent,
the longest shorter state, which is the log-likelihood that it gains on
positions left out one by one, must pass a fixed threshold. In a state, the
symbols that pass such a test themselves have discounted counts plus a share of the
parent's probability, others that share alone. A word is scored in the longest state that
the words before it end with.

States stay in a table. The commonest are broadcast, up to a bound; positions
that may be in one of the others (a filter tells) meet these in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import U64, bound_batches, chunks, materialize, mix64, word_bounds, word_hashes
from varloom.llm.linededup import holds, positions, put
from varloom.llm.ngram import HashIndex

#: The end mark as a token of the base score.
END_HASH = U64(0x9E3779B97F4A7C15)
#: Symbols have 21 bits: places in the dictionary, then the rare words, the place before a text, and no word (of a context of one).
BITS, MAX_WORDS = 21, 1 << 20
RARE, START, NONE = MAX_WORDS, MAX_WORDS + 1, MAX_WORDS + 2
MASK = (1 << BITS) - 1
#: Codes that a task holds before it merges them, and training tokens of a shard of contexts.
HELD_CODES, SHARD_TOKENS = 4_000_000, 1 << 20
#: Bits of the filter for each state that is not broadcast, its least and its largest size.
BITS_PER_STATE, LEAST_BITS, MAX_BITS = 16, 1 << 16, 1 << 29


def token_stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words and ends, row offsets into them) of some rows."""
    starts, ends, row_at = word_bounds(data, at)
    return np.insert(word_hashes(data, starts, ends), row_at[1:], END_HASH), row_at + np.arange(len(at))


def word_counts(texts: DataFrame) -> DataFrame:
    """(code, c): counts of words, by hash, and of ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def emit() -> Iterator[pa.RecordBatch]:
            codes, n = merged()
            for i in range(0, len(codes), 1 << 16):
                yield pa.RecordBatch.from_pydict({"code": codes[i : i + (1 << 16)].view(np.int64), "c": n[i : i + (1 << 16)]})

        for batch in batches:
            for _, data, at in chunks(batch.column(0)):
                held.append(np.unique(token_stream(data, at)[0], return_counts=True))
            if sum(len(x[0]) for x in held) > HELD_CODES:
                held = [merged()]
                if len(held[0][0]) > HELD_CODES // 2:
                    yield from emit()
                    held = []
        if held:
            yield from emit()

    return texts.mapInArrow(count, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, and the sums of their counts."""
    by = np.argsort(codes, kind="stable")
    codes, n = codes[by], n[by]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def hot_words(vocab: DataFrame, distinct: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The commonest words, ``most`` at most: (sorted hashes, counts, the count that they exceed)."""
    least = 0
    if distinct > most:
        least = int(vocab.agg(F.expr(f"percentile_approx(c, {1 - most / distinct}, 10000)")).first()[0])
        while vocab.filter(F.col("c") > least).count() > most:
            least += max(1, least // 20)
    got = vocab.filter(F.col("c") > least).select("code", "c").toArrow()
    h, c = got.column(0).to_numpy().view(U64), got.column(1).to_numpy()
    by = np.argsort(h)
    return h[by], c[by], least


@dataclass
class Dictionary:
    """The words of the alphabet (sorted hashes) and the root's probabilities: of words by place, of the rare ones at the end."""

    hashes: np.ndarray
    root: np.ndarray

    def __post_init__(self):
        self.index = HashIndex(self.hashes)

    def __reduce__(self):
        return Dictionary, (self.hashes, self.root)

    def symbols(self, tokens: np.ndarray) -> np.ndarray:
        at, there = self.index.find(tokens)
        return np.where(there, at, RARE)

    def probability(self, symbols: np.ndarray) -> np.ndarray:
        return self.root[np.minimum(symbols, len(self.root) - 1)]


def contexts(symbols: np.ndarray, token_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the word before, the one before that) of each token."""
    out = []
    for _ in range(2):
        last = out[-1] if out else symbols
        now = np.empty_like(last)
        now[1:] = last[:-1]
        now[token_at[:-1]] = START
        out.append(now)
    return out[0], out[1]


def codes_of(symbols: np.ndarray, token_at: np.ndarray, level: int) -> np.ndarray:
    """(context, symbol) codes of all tokens, contexts being of one word or of two."""
    b, a = contexts(symbols, token_at)
    return (a if level == 2 else np.full_like(b, NONE)) << (2 * BITS) | b << BITS | symbols


def pack(codes: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted codes and counts as compressed byte planes of their differences."""
    planes = np.diff(codes, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=12 * size, codec="zstd", asbytes=True), np.uint8)
    codes = np.ascontiguousarray(planes[: 8 * size].reshape(8, -1).T).view("<i8").ravel().cumsum()
    return codes, np.ascontiguousarray(planes[8 * size :].reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def packed_counts(texts: DataFrame, words, level: int, shards: int) -> DataFrame:
    """(shard, size, blob): packed codes and counts of the texts; the codes of a context are all in one shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit() -> Iterator[pa.RecordBatch]:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            shard = ((mix64((codes >> BITS).astype(U64)) >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            shard, codes, n = shard[by], codes[by], n[by]
            at = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            rows = list(zip(at, [*at[1:], len(shard)], strict=True))
            for i in range(0, len(rows), 64):
                some = rows[i : i + 64]
                blobs = [pack(codes[a:b], n[a:b]) for a, b in some]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([int(shard[a]) for a, _ in some], pa.int32()), "size": pa.array([int(b - a) for a, b in some], pa.int64()), "blob": pa.array(blobs, pa.binary())})

        for batch in batches:
            for _, data, at in chunks(batch.column(0)):
                tokens, token_at = token_stream(data, at)
                held.append(codes_of(words.value.symbols(tokens), token_at, level))
            if sum(map(len, held)) > HELD_CODES:
                yield from emit()
        if sum(map(len, held)):
            yield from emit()

    return texts.mapInArrow(count, "shard int, size long, blob binary")


@dataclass
class Contexts:
    """Contexts with their n, and the symbols that each has seen twice or more (``of``: the place of the symbol's context)."""

    ctx: np.ndarray
    n: np.ndarray
    of: np.ndarray
    sym: np.ndarray
    c: np.ndarray


def contexts_of(codes: np.ndarray, count: np.ndarray) -> Contexts:
    """The contexts of distinct sorted codes that have a symbol twice or more."""
    ctx = codes >> BITS
    first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
    of = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(codes)]))))
    twice = count >= 2
    full, at = np.unique(of[twice], return_inverse=True)
    return Contexts(ctx[first][full], np.add.reduceat(count, first)[full], at, (codes & MASK)[twice], count[twice])


@dataclass
class Tests:
    """What a state keeps: the symbols of its own (a mask), each one's probability, and of the context its parent's share and its gain."""

    kept: np.ndarray
    p: np.ndarray
    share: np.ndarray
    gain: np.ndarray


def tests(x: Contexts, parent: np.ndarray, discount: float, min_symbol_gain: float) -> Tests:
    """The divergence tests of contexts, given the parent's probability of each symbol.

    A symbol stays if its own positions, each left out of the counts in its
    turn, gain ``min_symbol_gain`` nats over the parent. A context's gain is that of
    all its positions; those of other symbols have the parent's share alone.
    """
    size = len(x.ctx)
    left_out = (x.c - 1 - discount) / np.maximum(x.n[x.of] - 1, 1) / parent
    kept = x.c * np.log(left_out) >= min_symbol_gain
    of, c = x.of[kept], x.c[kept]
    share = 1 - np.bincount(of, c - discount, size) / x.n
    rest = x.n - np.bincount(of, c, size)
    gain = np.bincount(of, c * np.log(left_out[kept] + share[of]), size) + rest * np.log(share)
    return Tests(kept, (x.c - discount) / x.n[x.of] + share[x.of] * parent, share, gain)


STATES = "ctx long, n long, share double, tested boolean, sym array<int>, c array<long>, p array<float>"


def fit_level(blobs: DataFrame, words, parts: int, discount: float, min_gain: float, min_symbol_gain: float, shorter=None) -> DataFrame:
    """The states of one level, and contexts whose test waits for their parent's (``tested`` false; p is the root's), from packed counts.

    ``shorter``: the tree of the states of one word. Contexts whose parent may
    be one that is not broadcast wait for it.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = words.value

        def finish(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            found = contexts_of(*summed(*(np.concatenate(x) for x in zip(*held, strict=True))))
            parent, waits = dictionary.probability(found.sym), np.zeros(len(found.ctx), bool)
            if shorter is not None and len(found.sym):
                code = NONE << (2 * BITS) | (found.ctx & MASK)[found.of] << BITS | found.sym
                log, unsure = np.zeros(len(code)), np.zeros(len(code), bool)
                left = shorter.value.level(code, np.arange(len(code)), log, unsure)
                log[left] += np.log10(parent[left])
                waits[found.of[unsure]] = True
                # What waits is kept as it is: no parent's probability is too small.
                parent = np.where(unsure, 1e-30, 10.0**log)
            t = tests(found, parent, discount, min_symbol_gain)
            stays = waits | (t.gain >= min_gain)
            mask = t.kept & stays[found.of]
            of, sym, c, p = found.of[mask], found.sym[mask], np.where(waits[found.of], found.c, 0)[mask], np.where(waits[found.of], dictionary.probability(found.sym), t.p)[mask]
            keep = np.flatnonzero(stays)
            for first in range(0, len(keep), 4096):
                some = keep[first : first + 4096]
                upto = np.append(np.searchsorted(of, some), np.searchsorted(of, some[-1], "right"))
                part = slice(upto[0], upto[-1])
                listed = lambda x, kind: pa.ListArray.from_arrays(pa.array((upto - upto[0]).astype(np.int32)), pa.array(x[part], kind))  # noqa: B023, E731
                cols = [pa.array(x[some]) for x in (found.ctx, found.n, t.share, ~waits)]
                yield pa.RecordBatch.from_arrays([*cols, listed(sym, pa.int32()), listed(c, pa.int64()), listed(p.astype(np.float32), pa.float32())], names=[x.split()[0] for x in STATES.split(", ")])

        shard, held, codes = None, [], 0
        for batch in batches:
            for now, size, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if now != shard and held:
                    yield from finish(held)
                    held, codes = [], 0
                shard = now
                held.append(unpack(blob, size))
                codes += size
                if codes > 2 * HELD_CODES:
                    held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    codes = len(held[0][0]) // 2
        if held:
            yield from finish(held)

    return blobs.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(reduce, STATES)


def fit_states(texts: DataFrame, words, n_train: int, *, discount: float, min_gain: float, min_symbol_gain: float, max_hot_symbols: int) -> DataFrame:
    """(ctx, n, share, sym, p): the states, with the probabilities of the symbols of their own."""
    shards = max(1, -(-n_train // SHARD_TOKENS))
    spark = texts.sparkSession
    one = materialize(fit_level(packed_counts(texts, words, 1, shards), words, shards, discount, min_gain, min_symbol_gain))
    two = materialize(fit_level(packed_counts(texts, words, 2, shards), words, shards, discount, min_gain, min_symbol_gain, spark.sparkContext.broadcast(broadcast_tree(one, hot_above(one, max_hot_symbols)))))
    cols = ["ctx", "n", "share", "sym", "p"]
    done = one.select(*cols).union(two.filter("tested").select(*cols))
    waiting = two.filter("not tested")
    if waiting.isEmpty():
        return done
    # The others are tested against their parent's own probabilities; what the parent lacks has its share of the root.
    key = lambda sym: F.shiftleft(F.col("ctx").bitwiseAND(MASK), BITS).bitwiseOR(sym.cast("long"))
    each = waiting.select("ctx", "n", F.explode(F.arrays_zip("sym", "c", "p")).alias("x")).select("ctx", "n", "x.sym", "x.c", F.col("x.p").cast("double").alias("root")).withColumn("key", key(F.col("sym")))
    own = one.select("ctx", F.explode(F.arrays_zip("sym", "p")).alias("x")).select(key(F.col("x.sym")).alias("key"), F.col("x.p").alias("known"))
    met = each.join(own, "key", "left").withColumn("b", F.col("ctx").bitwiseAND(MASK))
    shares = F.broadcast(one.select(F.col("ctx").bitwiseAND(MASK).alias("b"), F.col("share").alias("shared")))  # a row for each symbol at most
    met = met.join(shares, "b", "left").withColumn("parent", F.coalesce(F.col("known").cast("double"), F.coalesce("shared", F.lit(1.0)) * F.col("root")))
    left_out = (F.col("c") - 1 - discount) / F.greatest(F.col("n") - 1, F.lit(1)) / F.col("parent")
    kept = met.withColumn("left_out", left_out).filter(F.col("c") * F.log("left_out") >= min_symbol_gain)
    listed = F.array_sort(F.collect_list(F.struct("sym", "c", "parent", "left_out")))  # no longer than the dictionary
    sums = kept.groupBy("ctx").agg(F.first("n").alias("n"), F.sum("c").alias("of"), (1 - F.sum(F.col("c") - discount) / F.first("n")).alias("share"), listed.alias("x"))
    gain = F.aggregate("x", F.lit(0.0), lambda acc, x: acc + x["c"] * F.log(x["left_out"] + F.col("share"))) + (F.col("n") - F.col("of")) * F.log("share")
    p = F.transform("x", lambda x: ((x["c"] - discount) / F.col("n") + F.col("share") * x["parent"]).cast("float"))
    return done.union(sums.filter(gain >= min_gain).select("ctx", "n", "share", F.col("x.sym").alias("sym"), p.alias("p")))


def hot_above(states: DataFrame, most: int) -> float:
    """The count above which states have ``most`` symbols at most, all together: 0 if all have."""
    step = F.floor(F.log2("n") * 4)
    sizes = states.groupBy(step.alias("step")).agg(F.sum(F.size("sym")).alias("size"), F.max("n").alias("n")).orderBy(F.col("step").desc()).collect()  # a row for each quarter of a power of two
    total = 0
    for r in sizes:
        total += r["size"]
        if total > most:
            return float(r["n"])
    return 0.0


def places(ctx: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of contexts in a filter."""
    return positions(mix64(ctx.astype(U64)).view(np.int64), bits)


@dataclass
class Tree:
    """The broadcast states as sorted hash arrays, and a filter of the others."""

    grams: np.ndarray
    logs: np.ndarray
    ctx: np.ndarray
    share: np.ndarray
    others: np.ndarray | None

    def __post_init__(self):
        self._grams, self._ctx = HashIndex(self.grams), HashIndex(self.ctx)

    def __reduce__(self):
        return Tree, (self.grams, self.logs, self.ctx, self.share, self.others)

    def level(self, codes: np.ndarray, open_: np.ndarray, log: np.ndarray, cold: np.ndarray) -> np.ndarray:
        """Look positions ``open_`` up: a symbol of a state ends the search, a state alone adds its share; those left. ``cold`` marks what may be in another state."""
        at, state = self._ctx.find(mix64((codes[open_] >> BITS).astype(U64)))
        gram_at, gram = self._grams.find(mix64(codes[open_].astype(U64)))
        gram &= state
        log[open_] += np.where(gram, self.logs[gram_at] if len(self.logs) else 0, np.where(state, self.share[at] if len(self.share) else 0, 0))
        if self.others is not None:
            rest = open_[~state]
            cold[rest] = holds(self.others, places(codes[rest] >> BITS, len(self.others) * 8))
        return open_[~gram]


def broadcast_tree(states: DataFrame, above: float) -> Tree:
    got = states.filter(F.col("n") > above).select("ctx", F.log10("share").alias("share"), "sym", "p").toArrow()
    ctx, share = got.column(0).to_numpy(), got.column(1).to_numpy()
    size = got.column(2).combine_chunks().value_lengths().to_numpy() if len(ctx) else np.zeros(0, np.int64)
    sym, p = (got.column(k).combine_chunks().flatten().to_numpy() if len(ctx) else np.zeros(0) for k in (2, 3))
    got = None  # its memory is needed
    grams = mix64((np.repeat(ctx, size) << BITS | sym.astype(np.int64)).astype(U64))
    by, by_ctx = np.argsort(grams), np.argsort(mix64(ctx.astype(U64)))
    others = None
    if above > 0:
        rest = states.filter(F.col("n") <= above).select("ctx")
        bits, count = LEAST_BITS, rest.count()
        while bits < min(count * BITS_PER_STATE, MAX_BITS):
            bits *= 2

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                put(own, places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits))
            if own.any():
                yield pa.RecordBatch.from_pydict({"bits": pa.array([pa.compress(own, codec="zstd", asbytes=True)], pa.binary())})

        others = np.zeros(bits // 8, np.uint8)
        for row in rest.mapInArrow(fill, "bits binary").toLocalIterator():
            others |= np.frombuffer(pa.decompress(bytes(row.bits), decompressed_size=bits // 8, codec="zstd", asbytes=True), np.uint8)
    return Tree(grams[by], np.log10(p[by]).astype(np.float32), mix64(ctx.astype(U64))[by_ctx], share[by_ctx].astype(np.float32), others)


#: A position that may be in a state that is not broadcast: its contexts of two words and of one where they may be it (else -1),
#: its symbol, the shares of states that it has passed, what the tree says of it otherwise, against the root, and the root's logarithm.
ASIDE = pa.struct([("two", pa.int64()), ("one", pa.int64()), ("sym", pa.int32()), ("passed", pa.float32()), ("tail", pa.float32()), ("root", pa.float32())])


def looked_up(tail: DataFrame, states: DataFrame) -> DataFrame:
    """(rid, s): what the tree says of positions set aside (``ASIDE``), against the root."""
    c = F.col
    table = states.select("ctx", F.log10("share").alias("share"), c("sym").alias("syms"), "p")
    at = F.coalesce(F.array_position("syms", c("sym")), F.lit(0))
    own = F.when(at > 0, F.log10(F.get("p", (at - 1).cast("int"))))
    first = tail.filter("two >= 0").join(table, c("two") == c("ctx"), "left").withColumn("own", own)
    first = first.withColumn("passed", c("passed") + F.coalesce("share", F.lit(0.0)))
    # A table, as both results read it: the positions and the states are shuffled once for them.
    first = materialize(first.select("rid", "one", "sym", "passed", "tail", "root", "own"))
    ended = first.filter("own is not null or one < 0").select("rid", F.coalesce(c("own") - c("root"), c("passed") + c("tail")).alias("s"))
    names = ["rid", "one", "sym", "passed", "root"]
    second = first.filter("own is null and one >= 0").select(*names).union(tail.filter("two < 0").select(*names))
    met = second.join(table, c("one") == c("ctx"), "left").withColumn("own", own)
    return ended.union(met.select("rid", (c("passed") + F.coalesce(c("own") - c("root"), c("share"), F.lit(0.0))).alias("s")))


def score_texts(
    docs: DataFrame,
    train: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    discount: float = 0.75,
    min_gain: float = 10.0,
    min_symbol_gain: float = 3.0,
    max_words: int = MAX_WORDS,
    max_hot_symbols: int = 1 << 21,
) -> DataFrame:
    """Fit a suffix tree on the rows where ``train`` holds and score every row.

    Returns (id, train, n_tokens, n_known, train_tokens, base_score, score),
    one row for each input row. Tokens are words and one end. ``score`` is the
    tree's log10 probability of the text, ``base_score`` that of smoothed word
    counts, the tree's root. Words are counted by 64-bit hash over all training texts. The
    commonest ``max_words`` are the tree's alphabet; of the other words a text's
    own meet their counts in a join. States and their symbols are what the thresholds
    ``min_gain`` and ``min_symbol_gain`` leave, at any size of the corpus; ``max_hot_symbols`` of their symbols are
    broadcast, and this bound changes the way alone.

    A null or empty text is the end token alone. A null in ``train`` is false.
    Repeated rows are scored each for itself. Without training rows, N and V
    are 0 and both scores are 0. Further columns of ``docs`` are not returned.
    """
    if not 0 < max_words <= MAX_WORDS:
        raise ValueError(f"max_words must be from 1 to {MAX_WORDS}")
    spark = docs.sparkSession
    bound_batches(spark)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    texts = named.filter("train").select("text")
    vocab = materialize(word_counts(texts))
    total = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train, v_train = int(total[0]), int(total[1])
    hot, hot_c, least = hot_words(vocab, v_train, max_words)
    base = 0.5 * (v_train + 1) + n_train
    root = (hot_c + 0.5) / base
    words = spark.sparkContext.broadcast(Dictionary(hot, np.append(root, max(1 - root.sum(), 0.5 / base))))
    states = materialize(fit_states(texts, words, n_train, discount=discount, min_gain=min_gain, min_symbol_gain=min_symbol_gain, max_hot_symbols=max_hot_symbols)) if n_train else spark.createDataFrame([], "ctx long, n long, share double, sym array<int>, p array<float>")
    above = hot_above(states, max_hot_symbols)
    sent = spark.sparkContext.broadcast(broadcast_tree(states, above))
    unseen = math.log10(0.5 / base)
    rest_too = least > 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, dictionary = sent.value, words.value
        root_log = np.log10(dictionary.root)
        kinds = {"n_tokens": np.int64, "known": np.int64, "base": np.float64, "score": np.float64}
        for batch in batches:
            cols: dict[str, list] = {k: [np.zeros(0, t)] for k, t in kinds.items()}
            rare, rare_at = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            aside, aside_at = {f.name: [np.zeros(0, f.type.to_pandas_dtype())] for f in ASIDE}, [np.zeros(1, np.int64)]
            for _, data, at in chunks(batch.column(2)):
                tokens, token_at = token_stream(data, at)
                sums = lambda x: np.add.reduceat(x, token_at[:-1])  # noqa: B023, E731
                sym = dictionary.symbols(tokens)
                there = sym < RARE
                at_root = root_log[np.minimum(sym, len(root_log) - 1)]
                log, cold2, cold1 = np.zeros(len(sym), np.float64), np.zeros(len(sym), bool), np.zeros(len(sym), bool)
                two, one = codes_of(sym, token_at, 2), codes_of(sym, token_at, 1)
                left = tree.level(two, np.arange(len(sym)), log, cold2)
                left = tree.level(one, left, log, cold1)
                log[left] += at_root[left]
                log -= at_root
                out = np.flatnonzero(cold2 | cold1)
                passed = np.where(cold1[out] & ~cold2[out], log[out], 0.0)
                tail = np.where(cold1[out], 0.0, log[out])
                log[out] = 0
                base_log = np.where(there, at_root, 0.0 if rest_too else unseen)
                cols["base"].append(sums(base_log))
                cols["score"].append(sums(log + base_log))
                cols["known"].append(sums(there.astype(np.int64)))
                cols["n_tokens"].append(np.diff(token_at))
                if rest_too:
                    away = np.flatnonzero(~there)
                    rare.append(tokens[away].view(np.int64))
                    rare_at.append(rare_at[-1][-1] + np.searchsorted(away, token_at[1:]))
                else:
                    rare_at.append(np.full(len(token_at) - 1, rare_at[-1][-1]))
                aside["two"].append(np.where(cold2[out], two[out] >> BITS, -1))
                aside["one"].append(np.where(cold1[out], one[out] >> BITS, -1))
                aside["sym"].append(sym[out].astype(np.int32))
                aside["passed"].append(passed.astype(np.float32))
                aside["tail"].append(tail.astype(np.float32))
                aside["root"].append(at_root[out].astype(np.float32))
                aside_at.append(aside_at[-1][-1] + np.searchsorted(out, token_at[1:]))
            offsets = lambda x: pa.array(np.concatenate(x).astype(np.int32))
            asides = pa.ListArray.from_arrays(offsets(aside_at), pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in aside.values()], fields=list(ASIDE)))
            rares = pa.ListArray.from_arrays(offsets(rare_at), pa.array(np.concatenate(rare)))
            arrays = [pa.array(np.concatenate(x)) for x in cols.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *arrays, rares, asides], names=["rid", "id", "train", *cols, "rare", "aside"])

    id_type = dict(named.dtypes)["id"]
    rows = named.select(F.monotonically_increasing_id().alias("rid"), "id", "text", "train")
    schema = f"rid long, id {id_type}, train boolean, n_tokens long, known long, base double, score double, rare array<long>, aside array<struct<two:long,one:long,sym:int,passed:float,tail:float,root:float>>"
    out = rows.mapInArrow(score, schema)
    if rest_too or above > 0:
        out = materialize(out)
    more = None
    if rest_too:
        tail = out.select("rid", F.explode("rare").alias("code"))
        met = tail.join(vocab.filter(F.col("c") <= least), "code", "left")
        log = F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.5) / F.lit(base))
        more = met.select("rid", log.alias("b"), F.when(F.col("c").isNotNull(), 1).otherwise(0).alias("k"), log.alias("s"))
    if above > 0:
        tail = out.select("rid", F.explode("aside").alias("x")).select("rid", "x.*")
        found = looked_up(tail, states.filter(F.col("n") <= above)).select("rid", F.lit(0.0).alias("b"), F.lit(0).alias("k"), F.col("s"))
        more = found if more is None else more.union(found)
    out = out.drop("rare", "aside")
    if more is not None:
        per = more.groupBy("rid").agg(F.sum("b").alias("b"), F.sum("k").alias("k"), F.sum("s").alias("s"))
        out = out.join(per, "rid", "left")
    else:
        out = out.withColumns({"b": F.lit(0.0), "k": F.lit(0), "s": F.lit(0.0)})
    plus = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "train", "n_tokens",
        (F.col("known") + plus("k")).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + plus("b")).alias("base_score"),
        (F.col("score") + plus("s")).alias("score"),
    )
