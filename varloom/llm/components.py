"""Connected components of an edge table, and links among the members of buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round hangs every node's larger neighbours under its smallest
    neighbour, then does the same with its smaller ones, until all edges point
    at a root. Rounds are few (logarithmic); edges and labels stay in tables.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        edges = materialize(small.distinct())
        # Stars have one parent for each node, and no parent has a parent.
        up = edges.groupBy("a").agg(F.count("*").alias("n"))
        if edges.select("b").distinct().join(up.withColumnRenamed("a", "b"), "b").isEmpty() and up.filter("n > 1").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Larger buckets are searched by their members' differences from the centre, not by pairs.
SMALL_BUCKET = 64


def link_buckets(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], may_link: Callable | None = None, near: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), components) of what ``verify`` finds among members of the same bucket.

    ``buckets``: (key, rep, n), with a size of the member. ``verify`` takes
    pairs (a, b) and returns (a, b, linked). ``may_link`` on two sizes and the
    most that the two can have in common rules pairs out beforehand. ``near``
    takes groups (hub, rep) and returns the pairs (a, b) of members of a group
    that can be linked, apart from those that both are linked to the hub.

    First every member is compared with its bucket's centre, the member that
    shares most buckets with others. In a group of edited copies that is the
    text that they were made from, or the one closest to it. Of buckets that then still hold several
    classes, those of up to ``SMALL_BUCKET`` members compare all pairs of
    different classes, and the members of larger ones, grouped by their centres,
    go to ``near`` (without it they compare all such pairs, too). No link between classes is left out. Pairs
    are compared once.
    """
    fits = may_link or (lambda x, y, common: F.lit(True))
    size = buckets.groupBy("key").agg(F.count("*").alias("size"))
    placed = materialize(buckets.join(size, "key"))
    known = placed.groupBy("rep").agg(F.sum("size").alias("known"))
    first = F.min_by(F.struct("rep", "n"), F.struct(-F.col("known"), F.col("rep"))).alias("other")
    centre = materialize(placed.join(known, "rep").groupBy("key").agg(first))
    pairs = placed.join(centre, "key").filter((F.col("rep") != F.col("other.rep")) & fits(F.col("n"), F.col("other.n"), F.least("n", "other.n")))
    tested = materialize(verify(pairs.select(F.least("rep", "other.rep").alias("a"), F.greatest("rep", "other.rep").alias("b")).distinct()))
    links = tested.filter("linked").select("a", "b")
    found = materialize(components(links))

    labelled = placed.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "size", F.coalesce("component", "rep").alias("c"))
    several = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
    rest = materialize(labelled.join(several, "key"))
    small = rest.filter(F.col("size") <= SMALL_BUCKET) if near else rest
    # The members of a bucket are dealt over its parts, and each part meets the whole bucket.
    parts = F.ceil(F.col("size") / max(1, SMALL_BUCKET)).cast("int")
    one = small.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    two = small.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("rep").alias("y"), F.col("n").alias("n_y"), F.col("c").alias("c_y"))
    on = (F.col("rep") < F.col("y")) & (F.col("c") != F.col("c_y")) & fits(F.col("n"), F.col("n_y"), F.least("n", "n_y"))
    more = one.join(two, ["key", "part"]).filter(on).select(F.col("rep").alias("a"), F.col("y").alias("b"))
    if near:
        large = rest.filter(F.col("size") > SMALL_BUCKET)
        if not large.isEmpty():
            groups = large.join(centre, "key").select(F.col("other.rep").alias("hub"), "rep").filter("hub <> rep").distinct()
            of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"class_{c}"))
            met = materialize(near(groups)).join(of("a"), "a", "left").join(of("b"), "b", "left")
            more = more.union(met.filter(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b"))
    more = materialize(more.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    if not more.isEmpty():
        new = materialize(verify(more)).filter("linked").select("a", "b")
        if not new.isEmpty():
            links = links.union(new)
            found = materialize(components(links))
    return links, found
