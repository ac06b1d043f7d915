"""Near-duplicate documents by BagMinHash signatures.

A document is the bag of its five-word shingles. Every (shingle, weight
interval [0,1), [1,2), [2,4), [4,8), ...) has its own Poisson process of points
in time, with a rate in proportion to the interval's length; a point has a
level within the interval and a register. A shingle with count w takes part
with the points of levels below w, and a register holds the first point that
any shingle has for it. Two bags agree in a register with the probability of
their weighted Jaccard similarity. Signatures are cut into bands; documents
that share a band meet, and pairs are verified on their whole bags.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import U64, bound_batches, chunks, materialize, mix64, stream64, text_buffer, window_hashes, word_bounds, word_hashes
from varloom.llm.components import components, link_buckets
from varloom.llm.linededup import filter_bits, holds, positions, twice_seen

BANDS, ROWS = 25, 5
_KIND = stream64(211, 64)
_TURN = U64(0x9E3779B97F4A7C15)


def bags(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the distinct shingles of some rows, in order, and the rows' bag sizes."""
    starts, ends, row_at = word_bounds(data, at)
    h, h_at = window_hashes(word_hashes(data, starts, ends), row_at, k, whole_short=True)
    size = np.diff(h_at)
    for a, b in zip(h_at[:-1], h_at[1:], strict=True):
        h[a:b].sort()
    row = np.repeat(np.arange(len(size)), size)
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.concatenate((first, [len(h)]))), size


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, size: np.ndarray, m: int) -> np.ndarray:
    """(rows, m) registers: the bits of the time of the first point."""
    rows = len(size)
    # One process for each weight interval that the count reaches into.
    levels = 1 + np.ceil(np.log2(count)).astype(np.int64)
    which = np.repeat(np.arange(len(count)), levels)
    interval = np.arange(len(which)) - np.repeat(np.concatenate(([0], np.cumsum(levels)[:-1])), levels)
    low = np.where(interval == 0, 0.0, 2.0 ** (interval - 1))
    length = np.maximum(low, 1.0)
    seed = mix64(shingle[which] ^ _KIND[interval])
    weight = count[which].astype(float)
    row = row[which]
    out = np.full(rows * m, np.inf)
    reach = (np.log(m) + 5.0) / np.maximum(size, 1)  # by then all registers are likely filled
    todo = np.ones(rows, dtype=bool)
    while todo.any():
        live = np.flatnonzero(todo[row])
        at, s = np.zeros(len(live)), seed[live].copy()
        while len(live):
            with np.errstate(over="ignore"):
                s = mix64(s + _TURN)
            u = ((s >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
            at -= np.log(u) / (m * length[live])
            on = at < reach[row[live]]
            live, at, s = live[on], at[on], s[on]
            mark = mix64(s ^ _KIND[63])
            taken = low[live] + length[live] * ((mark >> U64(32)).astype(np.float64) * 2.0**-32) < weight[live]
            register = ((mark & U64(0xFFFFFFFF)) * U64(m) >> U64(32)).astype(np.int64)
            np.minimum.at(out, (row[live] * m + register)[taken], at[taken])
        todo &= np.isinf(out.reshape(rows, m)).any(axis=1) & (size > 0)
        reach[todo] *= 2
    return out.reshape(rows, m).view(U64)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) hashes; a band's number goes into its hash."""
    with np.errstate(over="ignore"):
        h = np.tile(_KIND[:bands], (len(sig), 1))
        for j in range(rows):
            h = mix64(h + sig[:, j::rows][:, :bands] * _TURN)
    return h


def sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, fp1, fp2, n, bands): a fingerprint of each document's bag, its size and its band keys. Rows without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in chunks(batch.column(1)):
                row, shingle, count, size = bags(data, at, k)
                full = np.flatnonzero(size > 0)
                if not len(full):
                    continue
                keys = band_keys(signatures(row, shingle, count, size, bands * rows)[full], bands, rows)
                begin = np.searchsorted(row, full)
                with np.errstate(over="ignore"):
                    fp = [np.add.reduceat(mix64(shingle ^ _KIND[60 + j]) * count.astype(U64), begin) for j in (0, 1)]
                flat = pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * bands, pa.array(keys.ravel().view(np.int64)))
                ids = batch.column(0).slice(first, len(at) - 1).take(pa.array(full))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x.view(np.int64)) for x in fp], pa.array(size[full]), flat], names=["id", "fp1", "fp2", "n", "bands"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, fp1 long, fp2 long, n long, bands array<long>")


def similarity_udf(k: int):
    @F.arrow_udf("double")
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        """The weighted Jaccard similarity of whole bags."""
        out = np.zeros(len(left))
        (x, x_at), (y, y_at) = text_buffer(left), text_buffer(right)
        held: tuple[bytes, tuple] = (b"", ())
        for i in range(len(out)):
            text = x[x_at[i] : x_at[i + 1]].tobytes()
            if not held[1] or held[0] != text:  # one side of many pairs is the same document
                held = text, bags(x[x_at[i] : x_at[i + 1]], np.array([0, x_at[i + 1] - x_at[i]]), k)[1:3]
            a, ca = held[1]
            _, b, cb, _ = bags(y[y_at[i] : y_at[i + 1]], np.array([0, y_at[i + 1] - y_at[i]]), k)
            _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            common = np.minimum(ca[ia], cb[ib]).sum()
            total = ca.sum() + cb.sum() - common
            out[i] = common / total if total else 0.0
        return pa.array(out)

    return similarity


def differences(bag: tuple[np.ndarray, np.ndarray], hub: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What stands in one of two bags (sorted shingles, counts) and not in the other, each copy by itself, as hashes."""
    every = np.union1d(bag[0], hub[0])
    own, other = (np.zeros(len(every), np.int64) for _ in range(2))
    own[np.searchsorted(every, bag[0])] = bag[1]
    other[np.searchsorted(every, hub[0])] = hub[1]
    many = np.abs(own - other)
    which = np.repeat(np.arange(len(every)), many)
    copy = np.minimum(own, other)[which] + np.arange(len(which)) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many)
    side = np.where(own > other, _KIND[61], _KIND[62])[which]
    with np.errstate(over="ignore"):
        return mix64(every[which] ^ side ^ (copy.astype(U64) * _TURN)).view(np.int64)


#: Members whose common shingles make a group's middle, and the most rounds in which a group loses the members around a middle.
MIDDLE_OF, ROUNDS = 255, 6
#: So many members that are left over, or nine in ten of those before, are paired in one round, the last.
FEW = 32
#: So many differences go without a filter of those that are seen twice.
UNFILTERED = 1 << 16
#: Members meet by classes of their slack, so many for a doubling of what it lacks from the largest, and so many in all.
CLASS_STEP, CLASSES = 4, 12


def near_pairs(groups: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b): pairs of members of a (hub, rep) group, among them a path between any two that are linked.

    A group gets a middle: the shingles that most of some 255 of its members have. It is no document, and any bag would do.
    Let D be a member's differences from it. Two bags x and y differ in |Dx| + |Dy| - 2 |Dx & Dy| shingles,
    and are linked if these are no more than q = (1 - threshold) / (1 + threshold) of both sizes. With the slack
    s = q n - |D| they are linked for sure if s_x + s_y >= 0, and else need -(s_x + s_y) / 2 differences in common. So every pair that is linked for sure
    is linked with the member c of the largest slack, too: the members with s + s_c >= 0 are paired with c alone. A member x
    that is left over is paired with those y that share one of its rarest differences: two sets with o in common meet in their
    first |D| - o + 1 elements in any fixed order, and o is -(s_x + s_y) / 2, of which each knows the other's class (see ``meet``). First
    come the differences that a filter of elements seen twice does not know, as a member has them to itself alone. The members left over
    are a group again, with one of them as its middle, so that families within a group don't meet in all pairs; when that takes hardly anyone away, the last round pairs all that is left
    by shared differences, from a middle of most again.
    """
    q = (1 - threshold) / (1 + threshold)
    pairs, left = None, materialize(groups.distinct())
    before = left.count()
    last = before <= FEW
    for turn in range(ROUNDS + 1):
        last = last or turn == ROUNDS
        made = materialize(from_middle(left, texts, k, turn > 0 and not last))
        best = materialize(made.groupBy("hub").agg(F.min_by(F.struct("rep", (q * F.col("n") - F.size("d")).alias("s")), F.struct(F.size("d") - q * F.col("n"), "rep")).alias("c")))
        own = made.join(best, "hub").select("hub", "rep", "d", (q * F.col("n") - F.size("d")).alias("s"), F.col("c.s").alias("s_c"), F.col("c.rep").alias("c"))
        own = materialize(own.withColumn("sure", F.col("s") + F.col("s_c") >= 1e-9))
        found = own.filter("sure and rep <> c").select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b"))
        found = found.union(meet(own, last))
        pairs = found if pairs is None else pairs.union(found)
        left = materialize(own.filter("not sure").select("hub", "rep"))
        many = left.count()
        if last or not many:
            break
        # Another middle pays while it takes members away.
        last, before = many <= FEW or (turn > 0 and many > 0.9 * before), many
    return pairs.distinct()


def from_middle(groups: DataFrame, texts: DataFrame, k: int, member: bool) -> DataFrame:
    """(hub, rep, n, d): the bag size of every member of a (hub, rep) group and its differences from the group's middle, or from a ``member``."""
    id_type = dict(texts.dtypes)["id"]
    if member:
        some = groups.groupBy("hub").agg(F.min_by("rep", F.xxhash64("rep")).alias("rep"))
    else:
        sized = groups.join(groups.groupBy("hub").agg(F.count("*").alias("size")), "hub")
        some = sized.filter(F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / MIDDLE_OF)) == 0)

    def middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, []  # the bags of one group's members, some MIDDLE_OF at most

        def finish() -> Iterator[pa.RecordBatch]:
            shingle, count = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((-count, shingle))
            shingle, count = shingle[by], count[by]
            first = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1]))) if len(shingle) else np.zeros(0, np.int64)
            # A shingle has the largest count that more than half of them reach.
            half = len(held) // 2
            at = first[np.diff(np.append(first, len(shingle))) > half] + half
            if len(at):
                pairs = pa.StructArray.from_arrays([pa.array(shingle[at].view(np.int64)), pa.array(count[at])], names=["shingle", "count"])
                yield pa.RecordBatch.from_arrays([pa.array([hub], kind), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pairs)], names=["hub", "middle"])

        for batch in batches:
            hubs, kind = batch.column(0).to_pylist(), batch.schema.field(0).type
            for begin, data, at in chunks(batch.column(1)):
                row, shingle, count, size = bags(data, at, k)
                upto = np.searchsorted(row, np.arange(len(size) + 1))
                for i in range(len(size)):
                    if held and hubs[begin + i] != hub:
                        yield from finish()
                        held = []
                    hub = hubs[begin + i]
                    held.append((shingle[upto[i] : upto[i + 1]], count[upto[i] : upto[i + 1]]))
        if held:
            yield from finish()

    told = some.join(texts.withColumnRenamed("id", "rep"), "rep").select("hub", "text")
    middle = materialize(told.repartition("hub").sortWithinPartitions("hub").mapInArrow(middles, f"hub {id_type}, middle array<struct<shingle:long,count:long>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = [], []
            texts_, at = text_buffer(batch.column(2))
            for i in range(len(batch)):
                own = bags(texts_[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]), k)[1:3]
                held = batch.column(3)[i].values
                if held is None:
                    other = np.zeros(0, U64), np.zeros(0, np.int64)
                else:
                    x, c = (held.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                    order = np.argsort(x.view(U64))
                    other = x.view(U64)[order], c[order]
                d = differences(own, other)
                with np.errstate(over="ignore"):  # elements of other middles are others
                    out.append(mix64(d.view(U64) ^ mix64(other[0]).sum(dtype=U64)).view(np.int64))
                sizes.append(int(own[1].sum()))
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["hub", "rep", "n", "d"])

    full = groups.join(texts.withColumnRenamed("id", "rep"), "rep").join(middle, "hub", "left").select("hub", "rep", "text", "middle")
    return full.mapInArrow(run, f"hub {id_type}, rep {id_type}, n long, d array<long>")


def meet(own: DataFrame, last: bool) -> DataFrame:
    """(a, b): members that are not sure with the sure ones, and in the last round with each other, by a rare difference in common.

    Two with the slacks s_x and s_y need o = -(s_x + s_y) / 2 in common, and meet in the first |D| - o + 1 of both. Members are
    dealt to classes of their slack, and each goes to those of the other side with the differences that count as the first for the
    largest slack there. So two members with many differences meet in few of these, however many others lack the same shingles.
    """
    kinds = dict(own.dtypes)
    total = own.agg(F.sum(F.size("d"))).first()[0] or 0
    bits = filter_bits(total)
    # Few differences may all meet: without the filter none is taken to be of one member alone, and the pairs are the same.
    seen = own.sparkSession.sparkContext.broadcast(twice_seen(own.select(F.col("d").alias("hs")), bits) if total > UNFILTERED else None)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, s_c = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
            sure = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))))
            e = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            size, row = np.diff(at), np.repeat(np.arange(len(s)), np.diff(at))
            maybe = holds(seen.value, positions(e, bits)) if len(e) and seen.value is not None else np.ones(len(e), bool)
            alone = size - np.bincount(row[maybe], minlength=len(s))
            common = np.where(sure, (s_c - s) / 2, -(s + s_c) / 2)
            long = (size - np.maximum(1, np.ceil(common - 1e-6)) + 1).astype(np.int64)
            go = maybe & (alone < long)[row]
            to = pa.array(row[go])
            cols = [batch.column(0).take(to), batch.column(1).take(to), *[pa.array(x[row[go]]) for x in (sure, s, s_c, size, alone.astype(np.int64), long)], pa.array(e[go])]
            yield pa.RecordBatch.from_arrays(cols, names=["hub", "rep", "sure", "s", "s_c", "size", "alone", "long", "e"])

    schema = f"hub {kinds['hub']}, rep {kinds['rep']}, sure boolean, s double, s_c double, size long, alone long, long long, e long"
    flat = own.select("hub", "rep", "d", "s", "s_c", "sure").mapInArrow(shared, schema)
    each = materialize(flat)
    # A class goes by what the slack lacks from the largest, in parts of that; its first member lacks the least.
    c = F.col
    unit = F.greatest(F.abs("s_c"), F.lit(1.0))
    own_class = F.least(F.floor(F.log2(1 + F.greatest(c("s_c") - c("s"), F.lit(0.0)) / unit) * CLASS_STEP + 1e-9), F.lit(CLASSES - 1)).cast("int")
    bit = lambda k: F.call_function("shiftleft", F.lit(1), k)
    # Only differences that a member left over has can bring a pair; which classes have them, as bits.
    both = each.groupBy("hub", "e").agg(F.count("*").alias("times"), F.count_if(~F.col("sure")).alias("over"), F.bit_or(bit(own_class)).alias("in_class")).filter("times > 1 and over > 0" if last else "times > over and over > 0")
    place = F.row_number().over(Window.partitionBy("hub", "rep").orderBy(F.coalesce("times", F.lit(1)), "e")) + F.col("alone")
    names = ("sure", "s", "s_c", "size", "rank", "in_class")
    kept = materialize(each.join(both, ["hub", "e"], "left").withColumn("rank", place).filter("times > 1 and rank <= long").select("hub", "rep", "e", *names))
    most = lambda k: c("s_c") - unit * (F.pow(F.lit(2.0), (k - 1e-9) / CLASS_STEP) - 1)
    upto = lambda size, common: size - F.greatest(F.lit(1), F.ceil(common - 1e-6)) + 1
    # The other side's classes that have this difference and with which it can be among the first; members left over have slacks below -s_c.
    bound = lambda k, over: F.least(most(k), -c("s_c")) if over else most(k)
    fits = lambda over, there: F.filter(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: (c(there).bitwiseAND(bit(k)) != 0) & (c("rank") <= upto(c("size"), -(c("s") + bound(k, over)) / 2)))
    over = kept.filter("not sure").select("hub", "e", "rep", "s", "size", "rank", own_class.alias("i"), F.explode(fits(False, "in_class")).alias("k"))
    over = materialize(over)
    # Members of the other side go to classes that wait for theirs.
    waiting = over.groupBy("hub", "e", "k").agg(F.bit_or(bit(c("i"))).alias("waits"))
    other = kept if last else kept.filter("sure")
    other = other.withColumn("k", own_class).join(waiting, ["hub", "e", "k"])
    other = other.select("hub", "e", "sure", "k", F.explode(fits(True, "waits")).alias("i"), *[c(x).alias(f"y_{x}") for x in ("s", "size", "rank")], c("rep").alias("y"))
    # Two that are left over meet once, the one of the lesser slack as the first.
    other = other.filter("sure or k <= i")
    common = -(c("s") + c("y_s")) / 2
    first = (c("rank") <= upto(c("size"), common)) & (c("y_rank") <= upto(c("y_size"), common))
    met = over.join(other, ["hub", "i", "k", "e"]).filter((c("sure") | (c("k") < c("i")) | (c("rep") < c("y"))) & first)
    return met.select(F.least("rep", "y").alias("a"), F.greatest("rep", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id): the class of every document, named by its smallest id.

    A class is a connected set of links, pairs of documents whose bags of
    ``shingle``-word shingles have a weighted Jaccard similarity of
    ``threshold`` or more. Documents with equal bags are joined first and go on
    as one. Documents that share a band are compared as ``link_buckets`` says:
    no bucket is cut and no link between classes is left out.

    Texts of fewer than ``shingle`` words have one shingle of all their words.
    A null, empty or wordless text is in a class of its own, and so is a row
    without an id (its class is null). Rows that share an id are one document;
    they are returned once. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = materialize(sketch(named.filter("id is not null and text is not null"), shingle, bands, rows))
    same = made.groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    same = materialize(same)
    cut = same.select("rep", "n", F.explode("bands").alias("key"))
    shared = cut.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least <> most").select("key")
    buckets = materialize(cut.join(shared, "key"))
    meeting = buckets.select("rep").distinct()
    texts = materialize(named.join(meeting.withColumnRenamed("rep", "id"), "id").join(made.select("id", "fp1", "fp2").distinct(), "id").join(same.select(F.col("rep").alias("id"), "fp1", "fp2"), ["id", "fp1", "fp2"]).select("id", "text"))
    similarity = similarity_udf(shingle)

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        full = pairs.join(right, "b").join(left, "a")
        return full.select("a", "b", (similarity("text_a", "text_b") >= threshold).alias("linked"))

    one_text = texts.dropDuplicates(["id"])
    links, found = link_buckets(buckets, verify, lambda x, y, common: common / (x + y - common) >= threshold, lambda groups: near_pairs(groups, one_text, shingle, threshold))
    by_bag = made.join(same.drop("bands"), ["fp1", "fp2", "n"]).select("id", "rep").filter("id <> rep")
    # Rows that share an id but not a bag tie their bags together.
    split = made.groupBy("id").agg(F.min("fp1").alias("p"), F.max("fp1").alias("q")).filter("p <> q").select("id")
    if not split.isEmpty():
        tied = made.join(same.drop("bands"), ["fp1", "fp2", "n"]).select("id", "rep").join(split, "id", "left_semi")
        found = materialize(components(links.union(tied.select(F.col("rep").alias("a"), F.col("id").alias("b")))))
    reps = by_bag.groupBy("id").agg(F.min("rep").alias("rep"))
    ids = named.filter("id is not null").select("id").distinct()
    out = ids.join(reps, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    out = out.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("id").alias(id_col), F.coalesce("component", "rep").alias("class_id"))
    none = named.filter("id is null").select(F.col("id").alias(id_col), F.col("id").alias("class_id"))
    return out.union(none)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, the one with the smallest id, with all columns; rows without an id stay.

    Of rows that share that id the one with the smallest text stays, then that with the smallest hash of all columns.
    """
    classes = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    keep = classes.filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias("keep"))
    # A row travels as one column, so no name of its columns can clash.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]).alias("hash"))
    kept = packed.join(keep, F.col("id") == F.col("keep"), "left_semi")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("text", "hash"))
    first = kept.withColumn("rank", rank).filter("rank = 1")
    return first.select(*[F.col("row")[c].alias(c) for c in docs.columns]).union(docs.filter(F.col(f"`{id_col}`").isNull()))
