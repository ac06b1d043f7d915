"""Filters, duplicates, order, sets and matching of variant objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.alleles import KEY, MISSING, classify_op, compose_op, is_strand_ambiguous
from varloom.functions.contigs import NAMINGS, canonical, canonical_any, contig_list, naming_of, normalize_label, rank, render
from varloom.functions.ploidy import splitx_label
from varloom.model import PROVENANCE, TABLE, VariantObject, check_naming, duplicate_targets, require_naming, require_same_frame, status_qc
from varloom.scratch import materialize

# Filters


def restrict_contigs(vo: VariantObject, spec: str) -> VariantObject:
    """Rows on the contigs of a text like ``1-22,X``; order and provenance stay."""
    return vo.with_df(vo.df.filter(canonical(F.col("chrom"), require_naming(vo)).isin(contig_list(spec))))


def drop_strand_ambiguous(vo: VariantObject) -> VariantObject:
    """Without rows whose allele pair is its own reverse complement."""
    return vo.with_df(vo.df.filter(~is_strand_ambiguous(F.col("a1"), F.col("a2"))))


def only_mapped(vo: VariantObject) -> VariantObject:
    """Rows of a vmap that have a source. None left is an error."""
    df = vo.df.filter("source_index <> -1")
    if df.isEmpty():
        raise ValueError("no row has a source")
    return vo.with_df(df)


def classified(rows: DataFrame, spec: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vmap rows, import QC) of parsed rows with a ``reason``, which is null where a row is good.

    Rows outside the contigs ``spec``, by labels of any naming, and all but the first of each key get a reason too. What is parsed is
    written once as a table, which both results read: the parsing and the shuffle by key run once.
    """
    if spec is not None:
        inside = F.coalesce(canonical_any(F.col("chrom")).isin(contig_list(spec)), F.lit(False))
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(~inside, "filtered_by_chr2use")))
    # Rows that have a reason share keys such as a missing position: each is by itself, and they are spread.
    apart = F.when(F.col("reason").isNotNull(), F.xxhash64("source_shard", "source_index"))
    n = F.row_number().over(Window.partitionBy(*KEY, "__apart").orderBy("ord"))
    late = F.when(F.col("reason").isNull() & (F.col("__n") > 1), "duplicate_target")
    said = rows.withColumn("__apart", apart).withColumn("__n", n).withColumn("reason", F.coalesce("reason", late)).drop("__apart", "__n")
    said = materialize(said.withColumn("allele_op", F.lit("identity")))
    good = said.filter("reason is null").select(*TABLE, *PROVENANCE, "ord")
    return good, said.filter("reason is not null").select("source_shard", "source_index", "reason")


# Duplicates


def first_of_key(df: DataFrame, *order: str | Column, keys=KEY) -> DataFrame:
    """The first row of each key, by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def split_first(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, QC of later rows as ``duplicate_target``)."""
    n = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))
    later = n.filter("__n > 1").select("source_shard", "source_index", F.lit("duplicate_target").alias("reason"))
    return n.filter("__n = 1").drop("__n"), later


def drop_collisions(vo: VariantObject, df: DataFrame | None = None) -> tuple[VariantObject, DataFrame]:
    """A vmap without any row whose key another row has, and the QC of those rows; a vtable stays as it is."""
    df = vo.df if df is None else df
    if not vo.is_vmap:
        return vo.with_df(df), status_qc(vo, df.limit(0), "duplicate_target")
    n = df.withColumn("__n", F.count("*").over(Window.partitionBy(*KEY)))
    return vo.with_df(n.filter("__n = 1").drop("__n")), status_qc(vo, n.filter("__n > 1"), "duplicate_target")


# Order


def reorder(df: DataFrame, *by: str | Column) -> DataFrame:
    """``ord`` becomes 0, 1, 2, ... in the order of ``by``: a range sort, then the sizes of its partitions; no single task sees all rows."""
    ranked = materialize(df.drop("ord").orderBy(*by).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__m", 33)
    sizes = ranked.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"), F.min("__m").alias("__least"))
    # A row for each partition.
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", (before - F.col("__least")).alias("__shift"))
    return ranked.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("ord", F.col("__m") + F.col("__shift")).drop("__m", "__part", "__shift")


def sort_variants(vo: VariantObject, drop_duplicates: bool = False) -> VariantObject:
    """Order by contig, position and alleles; ties keep their order. ``drop_duplicates`` keeps the first of each key."""
    check_naming(vo)
    df = vo.df.withColumn("__old", F.col("ord")).withColumn("__rank", rank(canonical(F.col("chrom"), vo.contig_naming)))
    if drop_duplicates:
        df = first_of_key(df, "__old")
    return vo.with_df(reorder(df, "__rank", "pos", "a1", "a2", "__old").drop("__rank", "__old"))


def sample_rows(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows at most, the same ones each time: those with the smallest digests of seed, place and key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ord").cast("string"), *[F.col(k).cast("string") for k in KEY]))
    return df.orderBy(digest, "ord").limit(n)


# Sets


def to_target(vo: VariantObject) -> VariantObject:
    """The target side of a vmap, without provenance."""
    return vo.with_df(vo.df.select(*TABLE, "ord"))


def intersect_variants(first: VariantObject, second: VariantObject, *more: VariantObject) -> VariantObject:
    """Rows of the first object whose key all others have; its ids, order and duplicates stay."""
    require_same_frame(first, second, *more)
    df = first.df.select(*TABLE, "ord")
    for other in (second, *more):
        df = df.join(other.df.select(*KEY), list(KEY), "left_semi").select(*TABLE, "ord")
    return first.with_df(df)


def union_variants(first: VariantObject, second: VariantObject, *more: VariantObject) -> VariantObject:
    """All keys, sorted; the id is that of the first object, and in it the first row, with the key."""
    vos = (first, second, *more)
    require_same_frame(*vos)
    every = None
    for i, vo in enumerate(vos):
        part = vo.df.select(*TABLE, F.struct(F.lit(i).alias("i"), F.col("ord").alias("o")).alias("__at"))
        every = part if every is None else every.unionByName(part)
    df = every.groupBy(*KEY).agg(F.min_by("id", "__at").alias("id")).select(*TABLE, F.lit(0).cast("long").alias("ord"))
    return sort_variants(first.with_df(df))


def concat_groups(*vos: VariantObject) -> VariantObject:
    """Objects of different contigs, one after another in contig order; nothing is dropped."""
    require_same_frame(*vos)
    every = None
    for i, vo in enumerate(vos):
        part = check_naming(vo).df.select(*vo.columns).withColumn("__i", F.lit(i)).withColumn("__old", F.col("ord"))
        every = part if every is None else every.unionByName(part)
    every = every.withColumn("__rank", rank(canonical(F.col("chrom"), vos[0].contig_naming)))
    at = every.groupBy("__i").agg(F.min("__rank").alias("__first"))
    return vos[0].with_df(reorder(every.join(F.broadcast(at), "__i"), "__first", "__i", "__old").drop("__first", "__i", "__old", "__rank"))


def match_to_target(source: VariantObject, target: VariantObject, repeated: bool = False) -> VariantObject:
    """A vmap with a row for each target row, in target order.

    Its source is the first source row at the same position with the same two
    alleles in either order; the operation is the source's own and then a swap
    where the order differs. Source rows without a source of their own don't
    match. A target without a match is ``missing``. The unordered pair is part of
    the join key, so sites with many alleles make no further pairs. A target key that occurs twice is an error,
    unless with ``repeated`` each of its rows is to have the match.
    """
    require_same_frame(source, target)
    if not repeated and (twice := duplicate_targets(target.df).first()) is not None:
        raise ValueError(f"target {twice.chrom}:{twice.pos}:{twice.a1}:{twice.a2} occurs {twice['count']} times")
    pair = lambda df: df.withColumn("__low", F.least("a1", "a2")).withColumn("__high", F.greatest("a1", "a2"))
    t = pair(target.df.select(*TABLE, "ord"))
    s = pair(source.df.filter("source_index <> -1")).select(
        "chrom", "pos", "__low", "__high",
        F.struct(F.col("ord").alias("o"), F.col("a1").alias("s1"), F.col("a2").alias("s2"), *PROVENANCE).alias("__s"),
    )
    # The first source row of each site and pair, before the join.
    s = s.groupBy("chrom", "pos", "__low", "__high").agg(F.min_by("__s", "__s.o").alias("__s"))
    op = classify_op(F.col("__s.s1"), F.col("__s.s2"), F.col("a1"), F.col("a2"))
    found = F.col("__s").isNotNull()
    out = t.join(s, ["chrom", "pos", "__low", "__high"], "left").select(
        *TABLE,
        F.when(found, F.col("__s.source_shard")).otherwise(".").alias("source_shard"),
        F.when(found, F.col("__s.source_index")).otherwise(-1).cast("long").alias("source_index"),
        F.when(found, compose_op(F.col("__s.allele_op"), op)).otherwise(MISSING).alias("allele_op"),
        "ord",
    )
    return target.with_df(out)


# Labels


def infer_contig_naming(df: DataFrame) -> str | None:
    """The first naming that knows every label of the table, or None."""
    seen = df.select(F.trim("chrom").alias("chrom")).filter("chrom <> ''").distinct()
    row = seen.agg(F.count("*").alias("n"), *[F.bool_and(canonical(F.col("chrom"), n).isNotNull()).alias(n) for n in NAMINGS]).first()
    return naming_of(bool(row[n]) for n in NAMINGS) if row["n"] else None


def normalize_contigs(vo: VariantObject, to: str) -> tuple[VariantObject, DataFrame, DataFrame]:
    """(object with labels of naming ``to``, status QC, one row of counts).

    Labels of any spelling are repaired; rows whose label stays unknown go and
    are only counted. A vmap loses all rows that collide afterwards. Splitting
    X needs a known build.
    """
    contig = normalize_label(F.col("chrom"))
    label = render(contig, to)
    if to == "plink_splitx":
        if vo.genome_build == "unknown":
            raise ValueError("splitting X needs a known genome build")
        label = F.coalesce(splitx_label(contig, F.col("pos"), vo.genome_build), label)
    named = vo.df.withColumn("__label", label)
    counts = named.agg(
        F.count("*").alias("input_rows"),
        F.count_if(F.col("__label").isNull()).alias("dropped_rows"),
        F.count_if(F.col("__label") != F.col("chrom")).alias("changed_rows"),
    )
    kept = named.filter("__label is not null").withColumn("chrom", F.col("__label")).drop("__label")
    out, qc = drop_collisions(vo.with_df(kept, contig_naming=to))
    return out, qc, counts


def status_counts(qc: DataFrame, column: str = "status") -> DataFrame:
    return qc.groupBy(column).count()


def contig_shards(vo: VariantObject) -> DataFrame:
    """(chrom, first, rows): the output shards, ``first`` being the place of the first row of each."""
    return vo.df.groupBy("chrom").agg(F.min("ord").alias("first"), F.count("*").alias("rows"))
