"""Mixing sources to target weights by nested hash-threshold histograms.

Each document has a hash that spreads it evenly over [0, 2^60). A source that
is to give R words more than its whole repeats takes the documents below a
threshold on that hash. The threshold is found without a sort of documents:
words are summed by (source, top 12 bits), the bucket in which the budget runs
out is split by the next 12 bits, and in that last bucket by the whole hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import WORD, materialize

#: Sources whose thresholds are broadcast; with more, Spark may shuffle the join.
BROADCAST_SOURCES = 100_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    total_ratio: float = 1.5,
    max_repeats: int = 2,
    carry: Sequence[str] = (),
) -> DataFrame:
    """How many words of each document a mix of given source weights takes.

    Returns (id, source, *carry, size, source_size, target, taken), one row for
    each input row; a carried column with the name of another of these is ``carried_<name>``. ``taken`` is ``q * size`` for a source that gives q whole
    repeats, plus ``size`` below the source's hash threshold. The rows whose
    hash equals the threshold (one document, or copies of one row) share what is left
    of the budget, so a source's sum misses its target by less than a word and
    one word for each such row.

    A null or wordless text has size 0 and takes 0. A null source is a source
    of its own, the last in order. Repeated rows have one hash and are
    treated alike. Columns other than the named ones are left out unless
    carried. An empty table gives no rows.
    """
    taken = (id_col, "source", "size", "source_size", "target", "taken")
    names = [f"carried_{c}" if c in taken else c for c in carry]
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.col(text_col))
    slim = materialize(
        docs.select(
            F.col(id_col).alias(id_col),
            F.col(source_col).alias("source"),
            F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)]).alias("__carry"),
            word_count(F.col(text_col)).alias("size"),
            F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("__h"),
        )
    )
    plan = materialize(thresholds(slim, weights, total_ratio, max_repeats))
    small = plan.count() <= BROADCAST_SOURCES
    plan = plan.withColumnRenamed("source", "__source")
    joined = slim.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("__source")))
    share = F.expr("cast(size as decimal(19,0)) * __left div __atom")
    extra = F.when(F.col("__h") < F.col("__at"), F.col("size")).when(F.col("__h") == F.col("__at"), share).otherwise(0)
    return joined.select(
        id_col, "source", *[F.col("__carry")[n].alias(n) for n in names], "size", "source_size", "target",
        (F.col("__whole") * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long").alias("taken"),
    )


def targets(slim: DataFrame, weights: Sequence[int], total_ratio: float, max_repeats: int) -> DataFrame:
    """(source, source_size, target): the level at which capped shares use the whole budget.

    With shares min(cap, level * weight) the right level is the largest of
    those that come from taking the first k sources by cap / weight as capped.
    The windows run over one row for each source.
    """
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("__rank") - 1) % len(weights) + 1)
    per = per.withColumn("__rank", rank).withColumn("__w", weight.cast("long"))
    every = Window.partitionBy()
    before = Window.orderBy((F.col("source_size") / F.col("__w")).asc(), F.col("__rank")).rowsBetween(Window.unboundedPreceding, -1)
    capped, used = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("source_size", "__w"))
    level = (F.lit(float(total_ratio)) * F.sum("source_size").over(every) - max_repeats * capped) / (F.sum("__w").over(every) - used)
    return (
        per.withColumn("__level", level)
        .withColumn("__level", F.max("__level").over(every))
        .select("source", "source_size", F.least(F.col("source_size") * F.lit(float(max_repeats)), F.col("__level") * F.col("__w")).alias("target"))
    )


def thresholds(slim: DataFrame, weights: Sequence[int], total_ratio: float, max_repeats: int) -> DataFrame:
    """(source, source_size, target, __whole, __at, __left, __atom), one row for each source."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = targets(slim, weights, total_ratio, max_repeats).withColumn("__whole", whole)
    budget = materialize(budget.withColumn("__left", F.floor(F.col("target") - F.col("__whole") * F.col("source_size") + 0.5).cast("long")))
    small = budget.count() <= BROADCAST_SOURCES
    h = F.col("__h")
    sized = slim.filter("size > 0").select("source", "size", "__h")

    def boundary(rows: DataFrame, at: DataFrame, bucket, on) -> DataFrame:
        """The bucket of each source in which its budget runs out."""
        at = at.withColumnRenamed("source", "__source")
        kept = rows.join(F.broadcast(at) if small else at, F.col("source").eqNullSafe(F.col("__source")) & on)
        sums = kept.groupBy("source", "__left", bucket.alias("__bucket")).agg(F.sum("size").alias("__size"))
        upto = F.sum("__size").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0))
        return (
            sums.withColumn("__upto", upto)
            .filter((F.col("__upto") >= F.col("__left")) & (F.col("__upto") - F.col("__size") < F.col("__left")))
            .select("source", (F.col("__left") - F.col("__upto") + F.col("__size")).alias("__left"), "__bucket", "__size")
        )

    start = budget.filter("__left > 0").select("source", "__left")
    high = F.shiftright(h, 48)
    middle = F.shiftright(h, 36)
    first = boundary(sized, start, high, F.lit(True))
    second = boundary(sized, first.select("source", "__left", F.col("__bucket").alias("__in")), middle, high == F.col("__in"))
    third = boundary(sized, second.select("source", "__left", F.col("__bucket").alias("__in")), h, middle == F.col("__in"))
    found = third.select(F.col("source").alias("__source"), F.col("__bucket").alias("__at"), "__left", F.col("__size").alias("__atom"))
    return budget.drop("__left").join(found, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
