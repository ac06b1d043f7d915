"""Operators that read a reference genome or a chain of another build.

The genome is a table of blocks (contig, block, seq) with canonical contigs;
block b has the bases b * size + 1 to (b + 1) * size. It is joined on (contig,
block) and never sent whole to a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.alleles import KEY, compose_op, is_acgt, op_name, revcomp
from varloom.functions.contigs import canonical, render
from varloom.functions.ploidy import ploidy_pair
from varloom.model import PROVENANCE, VariantObject, check_naming, require_naming, status_qc
from varloom.operators.variants import drop_collisions, first_of_key, sample_rows, sort_variants
from varloom.scratch import materialize

BLOCK = 256
#: Chain blocks that may be broadcast.
BROADCAST_ROWS = 2_000_000
BIN_BITS = 14


def with_base(df: DataFrame, contig: Column, blocks: DataFrame, name: str = "ref", size: int = BLOCK) -> DataFrame:
    """Add the reference base at ``pos``: empty where there is none."""
    at = F.col("pos") - 1
    keyed = df.withColumn("__contig", contig).withColumn("__block", F.when(F.col("pos") > 0, F.floor(at / size)))
    right = blocks.select(F.col("contig").alias("__contig"), F.col("block").alias("__block"), F.col("seq").alias("__seq"))
    base = F.upper(F.substring("__seq", (at % size + 1).cast("int"), 1))
    return keyed.join(right, ["__contig", "__block"], "left").withColumn(name, F.coalesce(base, F.lit(""))).drop("__contig", "__block", "__seq")


def with_window(df: DataFrame, contig: Column, start: Column, length: Column, blocks: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """Add ``seq``, the bases from ``start`` on, and ``seq_start``, its first position (1 where the window would start before it)."""
    begin = F.greatest(start, F.lit(1))
    rows = df.withColumn("__contig", contig).withColumn("seq_start", begin)
    last = F.floor((F.col("seq_start") + length - 2) / size)
    parts = rows.select(key, "__contig", "seq_start", F.explode(F.sequence(F.floor((F.col("seq_start") - 1) / size), F.greatest(last, F.floor((F.col("seq_start") - 1) / size)))).alias("__block"))
    right = blocks.select(F.col("contig").alias("__contig"), F.col("block").alias("__block"), "seq")
    got = parts.join(right, ["__contig", "__block"]).groupBy(key, "seq_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__block", "seq"))), lambda x: x["seq"]), "").alias("seq"), F.min("__block").alias("__b"))
    got = got.select(key, F.upper(F.substr("seq", (F.col("seq_start") - F.col("__b") * size).cast("int"))).alias("seq"))
    return rows.join(got, key, "left").withColumn("seq", F.coalesce("seq", F.lit(""))).drop("__contig")


def orient(a1: Column, a2: Column, ref: Column, allow_flips: bool) -> Column:
    """0 to 3: the operation after which a2 is the reference base; null if there is none. The base must be a whole allele."""
    out = F.when(ref == "", None).when(a2 == ref, 0).when(a1 == ref, 1)
    if allow_flips:
        out = out.when(revcomp(a2) == ref, 2).when(revcomp(a1) == ref, 3)
    return out


def apply_op(df: DataFrame, code: Column) -> DataFrame:
    """Turn the alleles by an operation and compose it into ``allele_op`` where there is one."""
    df = df.withColumn("__code", code)
    flip, swap = F.col("__code").isin(2, 3), F.col("__code").isin(1, 3)
    x, y = F.when(flip, revcomp(F.col("a1"))).otherwise(F.col("a1")), F.when(flip, revcomp(F.col("a2"))).otherwise(F.col("a2"))
    df = df.withColumns({"__x": F.when(swap, y).otherwise(x), "__y": F.when(swap, x).otherwise(y)})
    cols = {"a1": F.col("__x"), "a2": F.col("__y")}
    if "allele_op" in df.columns:
        cols["allele_op"] = compose_op(F.col("allele_op"), op_name(F.col("__code")))
    return df.withColumns(cols).drop("__code", "__x", "__y")


def guess_build(vo: VariantObject, blocks: dict[str, DataFrame], sample: int = 10_000, force: bool = False) -> tuple[VariantObject, DataFrame]:
    """(object with its build, one row of evidence for each build), from a bounded sample.

    A row counts for a build if the build has a base there, and speaks for it if that base is one
    of its alleles. The best build needs a rate of 0.6 and a lead of 0.1; 0.85 is high confidence.
    """
    spark = vo.df.sparkSession
    contig = canonical(F.col("chrom"), require_naming(vo))
    rows = materialize(sample_rows(vo.df.select("chrom", "pos", "id", "a1", "a2", "ord"), sample))
    # The blocks that the sample needs are picked by its keys, which are few; no genome is shuffled.
    keys = rows.select(contig.alias("contig"), F.floor((F.col("pos") - 1) / BLOCK).alias("block")).distinct()
    per = None
    for build, ref in blocks.items():
        based = with_base(rows, contig, ref.join(F.broadcast(keys), ["contig", "block"], "left_semi"))
        part = based.agg(
            F.lit(build).alias("build"),
            F.count_if(F.col("ref").isin("A", "C", "G", "T")).alias("considered"),
            F.count_if(F.col("ref").isin("A", "C", "G", "T") & ((F.col("ref") == F.col("a1")) | (F.col("ref") == F.col("a2")))).alias("compatible"),
        )
        per = part if per is None else per.union(part)
    got = {r.build: (r.considered, r.compatible) for r in per.collect()}
    guess, confidence, rate = decide_build(got)
    evidence = spark.createDataFrame([(b, *got[b], rate[b], guess, confidence) for b in got], "build string, considered long, compatible long, rate double, guess string, confidence string")
    return (vo.with_df(vo.df, genome_build=guess) if force or vo.genome_build == "unknown" else vo), evidence


def decide_build(got: dict[str, tuple[int, int]]) -> tuple[str, str, dict[str, float]]:
    """(build or unknown, confidence, rates) from (considered, compatible) of each build."""
    rate = {b: (k / n if n else 0.0) for b, (n, k) in got.items()}
    order = sorted(rate, key=lambda b: -rate[b])
    lead = rate[order[0]] - (rate[order[1]] if len(order) > 1 else 0.0)
    if rate[order[0]] < 0.6 or lead < 0.1:
        return "unknown", "low", rate
    return order[0], "high" if rate[order[0]] >= 0.85 else "medium", rate


def guess_builds(vo: VariantObject, group: Column, blocks: dict[str, DataFrame], sample: int = 10_000) -> tuple[dict[str, str], DataFrame]:
    """({group: build}, a row of evidence for each group and build): ``guess_build`` for every group of rows in one pass.

    Rows of a null group are left out. A group's sample are its rows with the smallest digests: a bound on the digest, from
    the group's size, leaves little more than the sample to be ranked.
    """
    spark = vo.df.sparkSession
    rows = vo.df.select("chrom", "pos", "id", "a1", "a2", "ord", group.alias("group")).filter("group is not null")
    digest = F.md5(F.concat_ws(":", F.lit("1"), F.col("ord").cast("string"), *[F.col(k).cast("string") for k in KEY]))
    size = rows.groupBy("group").agg(F.count("*").alias("size"))
    near, slack = None, 1.0
    while near is None or near.groupBy("group", "size").count().filter(F.col("count") < F.least(F.col("size"), F.lit(sample))).count():
        share = F.least(F.lit(1.0), F.lit(slack * (sample + 8 * sample**0.5 + 64)) / F.col("size"))
        place = F.conv(F.substr("digest", F.lit(1), F.lit(12)), 16, 10).cast("double") / F.lit(16.0**12)
        near = materialize(rows.withColumn("digest", digest).join(F.broadcast(size), "group").filter(place <= share))  # a row for each group
        slack *= 4
    first = Window.partitionBy("group").orderBy("digest", "ord")
    picked = materialize(near.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= sample).select("group", "pos", "a1", "a2", canonical(F.col("chrom"), require_naming(vo)).alias("contig"), F.floor((F.col("pos") - 1) / BLOCK).alias("block")))
    keys = F.broadcast(picked.select("contig", "block").distinct())  # no more than the samples have
    every = None
    for build, ref in blocks.items():
        part = ref.select("contig", "block", "seq").join(keys, ["contig", "block"], "left_semi").withColumn("build", F.lit(build))
        every = part if every is None else every.union(part)
    seen = picked.withColumn("build", F.explode(F.array(*[F.lit(b) for b in blocks]))).join(every, ["build", "contig", "block"])
    base = F.upper(F.substring("seq", ((F.col("pos") - 1) % BLOCK + 1).cast("int"), 1))
    known = base.isin("A", "C", "G", "T")
    per = seen.groupBy("group", "build").agg(F.count_if(known).alias("considered"), F.count_if(known & ((base == F.col("a1")) | (base == F.col("a2")))).alias("compatible"))
    found: dict[str, dict[str, tuple[int, int]]] = {r[0]: dict.fromkeys(blocks, (0, 0)) for r in size.select("group").collect()}
    for r in per.collect():  # a row for each group and build
        found[r.group][r.build] = (r.considered, r.compatible)
    decided = {g: decide_build(got) for g, got in found.items()}
    listed = [(g, b, *got[b], decided[g][2][b], decided[g][0], decided[g][1]) for g, got in found.items() for b in got]
    evidence = spark.createDataFrame(listed, "group string, build string, considered long, compatible long, rate double, guess string, confidence string")
    return {g: d[0] for g, d in decided.items()}, evidence


def same_from_start(x: Column, y: Column) -> Column:
    """How many characters two strings have in common from their start. Only strings whose first 16 agree are cut whole."""

    def same(x: Column, y: Column) -> Column:
        # With an end that differs in any case the place is found, and the costly comparison stands in the plan once.
        alike = F.concat(F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: a == b), F.array(F.lit(False)))
        shorter = F.least(F.length(x), F.length(y))
        return F.when(shorter == 0, 0).otherwise(F.least(F.array_position(alike, False) - 1, shorter)).cast("int")

    near_x, near_y = F.substr(x, F.lit(1), F.lit(16)), F.substr(y, F.lit(1), F.lit(16))
    return F.when(near_x == near_y, same(x, y)).otherwise(same(near_x, near_y))


def left_align(rows: DataFrame) -> DataFrame:
    """Trim and left-align REF (``ref``) and ALT (``alt``) at ``at`` in the window ``seq`` from ``seq_start`` on; ``short``: the window ended first.

    In closed form: without their common end, one allele of a pure insertion or
    deletion is empty and the other is U. U moves left as far as the bases before it, read backwards, agree with U
    read backwards again and again, and is turned by the rest of that distance. The base before it is the anchor.
    Alleles that both remain lose what they have in common at the start, but for one base.
    """
    c = F.col
    rows = rows.withColumn("__cut", same_from_start(F.reverse("ref"), F.reverse("alt")))
    rows = rows.withColumns({"__r": F.expr("left(ref, length(ref) - __cut)"), "__a": F.expr("left(alt, length(alt) - __cut)")})
    rows = rows.withColumns({"__u": F.when(c("__r") == "", c("__a")).when(c("__a") == "", c("__r")), "__w": F.least(c("at") - c("seq_start"), F.length("seq")).cast("int")})
    again = F.expr("substr(repeat(reverse(__u), cast(ceil(__w / length(__u)) as int)), 1, __w)")
    rows = rows.withColumn("__k", F.when(c("__u").isNotNull() & (c("__u") != ""), same_from_start(F.expr("reverse(left(seq, __w))"), again)))
    rows = rows.withColumns({"__m": c("__k") % F.length("__u"), "__anchor": F.expr("case when __k < __w then substr(seq, __w - __k, 1) else '' end")})
    turned = F.expr("concat(right(__u, __m), left(__u, length(__u) - __m))")
    most = F.greatest(F.least(F.length("__r"), F.length("__a")) - 1, F.lit(0))
    rows = rows.withColumn("__p", F.least(same_from_start(c("__r"), c("__a")), most))
    pure = c("__k").isNotNull()
    allele = lambda x, was: F.when(pure, F.concat("__anchor", F.when(c(x) == "", "").otherwise(turned))).when(c("ref") == c("alt"), c(was)).otherwise(F.expr(f"substr({x}, __p + 1)"))
    at = F.when(pure, c("at") - c("__k") - F.length("__anchor")).when(c("ref") == c("alt"), c("at")).otherwise(c("at") + c("__p"))
    rows = rows.withColumns({"__ref": allele("__r", "ref"), "__alt": allele("__a", "alt"), "__at": at, "short": F.coalesce(pure & (c("__k") == c("__w")) & (c("seq_start") > 1), F.lit(False))})
    rows = rows.withColumns({"ref": c("__ref"), "alt": c("__alt"), "at": c("__at")})
    return rows.drop("__cut", "__r", "__a", "__u", "__w", "__k", "__m", "__anchor", "__p", "__ref", "__alt", "__at")


def normalize_indels(rows: DataFrame, contig: Column, blocks: DataFrame, flank: int = 256) -> DataFrame:
    """``ref``, ``alt`` and ``at`` of rows (key ``__row``) after left alignment; windows grow until every row has ended."""
    done, todo = None, rows
    while True:
        window = with_window(todo, contig, F.col("at") - flank, F.lit(flank).cast("int") + F.greatest(F.length("ref"), F.length("alt")), blocks, "__row")
        out = materialize(left_align(window))
        ended = out.filter(~F.col("short") | (F.col("seq_start") <= 1)).select("__row", "at", "ref", "alt")
        done = ended if done is None else done.union(ended)
        more = out.filter(F.col("short") & (F.col("seq_start") > 1)).select("__row")
        if more.isEmpty():
            return done
        todo = rows.join(more, "__row", "left_semi")
        flank *= 4


def restrict_build_compatible(
    vo: VariantObject, blocks: DataFrame, allow_strand_flips: bool = False, norm_indels: bool = False, sort: bool = False, drop_duplicates: bool = False
) -> tuple[VariantObject, DataFrame, DataFrame]:
    """(rows that agree with the reference, with a2 the reference allele; status QC; one row of counts).

    Rows that don't agree go without a QC row and are counted. With
    ``norm_indels`` rows with a longer allele are left-aligned, those with
    two longer alleles take the orientation whose REF the genome has.
    """
    if vo.genome_build == "unknown":
        raise ValueError("a known genome build is needed")
    if drop_duplicates and not sort:
        raise ValueError("drop_duplicates needs sort")
    if norm_indels and vo.contig_naming == "plink_splitx":
        raise ValueError("indels are not normalised under plink_splitx; change the naming first")
    check_naming(vo)
    contig = canonical(F.col("chrom"), vo.contig_naming)
    df = vo.df.select(*vo.columns)
    both_long = (F.length("a1") > 1) & (F.length("a2") > 1)
    plain = with_base(df.filter(~both_long) if norm_indels else df, contig, blocks)
    code = orient(F.col("a1"), F.col("a2"), F.col("ref"), allow_strand_flips)
    kept = apply_op(plain.withColumn("__local", code).filter("__local is not null"), F.col("__local")).withColumnRenamed("__local", "local").drop("ref")
    qc = status_qc(vo, vo.df.limit(0), "")
    if norm_indels:
        # SNVs and longer alleles part here: the join with the genome is made once for both.
        kept, more = _with_indels(vo, materialize(kept), df.filter(both_long), contig, blocks)
        qc = qc.union(more)
    kept = materialize(kept)
    out, collided = drop_collisions(vo, kept)
    summary = kept.agg(F.count("*").alias("compatible_rows"), F.count_if(F.col("local").isin(2, 3)).alias("flip_rows"), F.count_if(F.col("local").isin(1, 3)).alias("swap_rows"))
    summary = summary.crossJoin(df.agg(F.count("*").alias("input_rows"))).crossJoin(collided.agg(F.count("*").alias("duplicate_rows")))  # one row each
    out = out.with_df(out.df.select(*vo.columns))
    if sort:
        out = sort_variants(out, drop_duplicates=drop_duplicates)
    return out, qc.union(collided), summary


def _with_indels(vo: VariantObject, kept: DataFrame, complex_rows: DataFrame, contig: Column, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    single = kept.filter((F.length("a1") == 1) & (F.length("a2") == 1))
    anchored = kept.filter((F.length("a1") > 1) | (F.length("a2") > 1)).select("*", F.col("a2").alias("ref"), F.col("a1").alias("alt"))
    # A longer REF must be there as a whole.
    both = complex_rows.withColumn("local", F.explode(F.array(F.lit(0), F.lit(1))))
    both = both.withColumns({"ref": F.when(F.col("local") == 0, F.col("a2")).otherwise(F.col("a1")), "alt": F.when(F.col("local") == 0, F.col("a1")).otherwise(F.col("a2"))})
    if vo.is_vmap:
        both = both.withColumn("allele_op", compose_op(F.col("allele_op"), op_name(F.col("local"))))
    cand = anchored.unionByName(both.select(*anchored.columns)).withColumn("__row", F.concat_ws(":", "ord", "local")).withColumn("at", F.col("pos"))
    cand = materialize(cand)
    seen = with_window(cand, contig, F.col("pos"), F.length("ref"), blocks, "__row")
    fits = seen.filter((F.substr("seq", F.lit(1), F.length("ref")) == F.col("ref")) & (F.col("ref") != F.col("alt"))).select(*cand.columns)
    moved = normalize_indels(fits, contig, blocks)
    same = cand.filter("ref = alt").select("ord", F.lit("norm_identical_ref_alt_alleles").alias("status"))
    lost = cand.join(fits.select("__row"), "__row", "left_anti").filter("ref <> alt").select("ord", F.lit("norm_ref_mismatch").alias("status"))
    full = fits.drop("at", "ref", "alt").join(moved, "__row")
    before, after = ploidy_pair(F.col("chrom"), F.col("pos"), vo.genome_build), ploidy_pair(F.col("chrom"), F.col("at"), vo.genome_build)
    status = (
        F.when(F.col("at") <= 0, "norm_invalid_position")
        .when(F.col("ref") == F.col("alt"), "norm_identical_ref_alt_alleles")
        .when(~is_acgt(F.col("ref")) | ~is_acgt(F.col("alt")), "norm_not_atcg_alleles")
        .when((F.length("ref") > 1) & (F.length("alt") > 1), "norm_unsupported_complex_indel")
        .when((F.col("at") != F.col("pos")) & ~before.eqNullSafe(after), "ploidy_class_changed")
    )
    full = full.withColumn("status", status)
    live = full.filter("status is null").withColumn("__n", F.count("*").over(Window.partitionBy("ord")))
    cols = kept.columns
    good = live.filter("__n = 1").withColumns({"pos": F.col("at"), "a1": F.col("alt"), "a2": F.col("ref")}).select(*cols)
    twice = live.filter("__n > 1").select("ord").distinct().select("ord", F.lit("norm_ambiguous_orientation").alias("status"))
    # One status for each row of which no candidate is left: the first of this order.
    order = F.array(*[F.lit(s) for s in ("norm_not_atcg_alleles", "norm_identical_ref_alt_alleles", "norm_invalid_position", "ploidy_class_changed", "norm_unsupported_complex_indel", "norm_ref_mismatch")])
    failed = full.filter("status is not null").select("ord", "status").union(same).union(lost)
    failed = failed.join(live.select("ord").distinct(), "ord", "left_anti").groupBy("ord").agg(F.min_by("status", F.array_position(order, F.col("status"))).alias("status"))
    rows = vo.df.join(twice.union(failed), "ord")
    return single.select(*cols).unionByName(good), status_qc(vo, rows, F.col("status"))


def block_hits(df: DataFrame, contig: Column, chain: DataFrame) -> DataFrame:
    """Rows with each chain block that they lie in, and its columns.

    ``chain``: (src_contig, s_start, s_end, tgt_contig, t_start, strand,
    chain_id, score); a block covers s_start < pos <= s_end. Blocks are spread
    over bins of 16,384 bases, so the range join is one of equal bins.
    """
    binned = chain.withColumn("__bin", F.explode(F.sequence(F.shiftright("s_start", BIN_BITS), F.shiftright(F.col("s_end") - 1, BIN_BITS))))
    if chain.count() <= BROADCAST_ROWS:
        binned = F.broadcast(binned)
    rows = df.withColumn("__contig", contig).withColumn("__bin2", F.shiftright(F.col("pos") - 1, BIN_BITS))
    on = (F.col("__contig") == F.col("src_contig")) & (F.col("__bin2") == F.col("__bin")) & (F.col("pos") > F.col("s_start")) & (F.col("pos") <= F.col("s_end"))
    return rows.join(binned, on).drop("__bin", "__bin2", "__contig")


def chain_hits(df: DataFrame, contig: Column, chain: DataFrame, key: str = "ord") -> DataFrame:
    """``block_hits`` with the block of the highest-scoring chain for each row."""
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "chain_id", "s_start")
    return block_hits(df, contig, chain).withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")


def lifted_pos() -> Column:
    """Where ``pos`` is in the target, from the columns of its block."""
    minus = F.col("strand") == "-"
    return F.when(minus, F.col("t_start") + F.col("s_end") - F.col("pos") + 1).otherwise(F.col("t_start") + F.col("pos") - F.col("s_start"))


def lift_alleles(hits: DataFrame, contig: Column, chain: DataFrame, target_blocks: DataFrame) -> DataFrame:
    """Lift insertions and deletions: (ord, at, ref, alt, swapped, status) of each row of ``hits``, in the target's plus strand and left-aligned there.

    ``hits`` has a block for each row, whose one-base allele ``ref`` stands at ``pos`` in the source, with the other one in ``alt``.
    Both ends of the site, the base at ``pos`` and the one behind it, are lifted by the same chain, so that a
    gap of the target between them is seen. What the target has from the first up to
    the second must be one of the two alleles, complemented on a minus strand: that one is the target's
    REF, and if it is the longer one the alleles are swapped.
    """
    minus = F.col("strand") == "-"
    first = hits.select("ord", "pos", "ref", "alt", "tgt_contig", "strand", "chain_id", contig.alias("__source"), lifted_pos().alias("__t1"))
    behind = block_hits(first.select("ord", "__source", (F.col("pos") + 1).alias("pos"), F.col("chain_id").alias("__chain")), F.col("__source"), chain)
    second = behind.filter("chain_id = __chain").groupBy("ord").agg(F.min_by(lifted_pos(), F.col("s_start")).alias("__t2"))
    both = first.join(second, "ord", "left")
    low = F.when(minus, F.col("__t2") + 1).otherwise(F.col("__t1"))
    size = F.when(minus, F.col("__t1") - F.col("__t2")).otherwise(F.col("__t2") - F.col("__t1"))
    turn = lambda a: F.when(minus, revcomp(F.col(a))).otherwise(F.col(a))
    both = both.select("ord", "tgt_contig", turn("ref").alias("ref"), turn("alt").alias("alt"), low.alias("at"), size.alias("__size"))
    # The target holds one of the alleles only if it has its length.
    spans = F.coalesce((F.col("__size") == F.length("ref")) | (F.col("__size") == F.length("alt")), F.lit(False))
    both = materialize(both.withColumn("__spans", spans))
    seen = with_window(both.filter("__spans"), F.col("tgt_contig"), F.col("at"), F.col("__size").cast("int"), target_blocks, "ord")
    seen = seen.withColumn("__there", F.expr("left(seq, cast(__size as int))")).drop("seq", "seq_start")
    seen = seen.withColumn("swapped", F.when(F.col("__there") == F.col("ref"), False).when(F.col("__there") == F.col("alt"), True))
    fits = seen.filter("swapped is not null")
    placed = fits.select("ord", "tgt_contig", "at", "swapped", F.when(F.col("swapped"), F.col("alt")).otherwise(F.col("ref")).alias("ref"), F.when(F.col("swapped"), F.col("ref")).otherwise(F.col("alt")).alias("alt"), F.col("ord").alias("__row"))
    placed = materialize(placed)
    moved = normalize_indels(placed, F.col("tgt_contig"), target_blocks).withColumnRenamed("__row", "ord")
    wrong = ~is_acgt(F.col("ref")) | ~is_acgt(F.col("alt")) | (F.col("at") <= 0) | (F.least(F.length("ref"), F.length("alt")) > 1)
    good = placed.select("ord", "swapped").join(moved, "ord").withColumn("status", F.when(wrong, "unsupported_non_snv"))
    lost = seen.filter("swapped is null").select("ord", F.lit("unsupported_swap").alias("status")).union(both.filter("not __spans").select("ord", F.lit("unsupported_non_snv")))
    return good.select("ord", "at", "ref", "alt", "swapped", "status").unionByName(lost, allowMissingColumns=True)


def liftover_build(vo: VariantObject, target_build: str, source_blocks: DataFrame, target_blocks: DataFrame, chain: DataFrame, keep: Callable[[Column, Column], Column] | None = None, sort: bool = True) -> tuple[VariantObject, DataFrame]:
    """(object in the target build, sorted, a2 the reference allele; a QC row for every input row).

    SNVs and alleles of other lengths, one of which is the base that the source has at the position, are lifted (the latter
    as ``lift_alleles`` says, left-aligned in the target). Rows of which neither allele is that base, or whose
    ends the chain parts otherwise than the alleles differ, are ``unsupported_non_snv``. A target that has neither allele is ``unsupported_swap``.
    ``keep`` tells from the source's and the target's contig whether a row stays (else ``outside_groups``). Without ``sort``
    the rows keep their ``ord``.
    """
    if "unknown" in (vo.genome_build, target_build) or vo.genome_build == target_build:
        raise ValueError(f"cannot lift from {vo.genome_build} to {target_build}")
    if vo.contig_naming == "plink_splitx":
        raise ValueError("plink_splitx depends on the build; change the naming first")
    check_naming(vo)
    contig = canonical(F.col("chrom"), vo.contig_naming)
    based = materialize(with_base(vo.df.select(*vo.columns), contig, source_blocks, "src_ref"))
    snv = (F.length("a1") == 1) & (F.length("a2") == 1)
    anchored = F.least(F.length("a1"), F.length("a2")) == 1
    agrees = (F.col("a1") == F.col("src_ref")) | (F.col("a2") == F.col("src_ref"))
    bad = based.filter(~F.col("src_ref").isin("A", "C", "G", "T") | (snv & ~agrees)).limit(3).collect()
    if bad:
        raise ValueError("rows that do not agree with the source build: " + ", ".join(f"{r.chrom}:{r.pos}:{r.a1}:{r.a2}" for r in bad))
    ready = anchored & agrees
    hits = materialize(chain_hits(based.filter(ready), contig, chain))
    minus = F.col("strand") == "-"
    lifted = hits.withColumn("__pos", lifted_pos()).withColumns({"__label": render(F.col("tgt_contig"), vo.contig_naming), "__src": F.col("pos")})
    others = lift_alleles(hits.filter(~snv).withColumns({"ref": F.col("src_ref"), "alt": F.when(F.col("a2") == F.col("src_ref"), F.col("a1")).otherwise(F.col("a2"))}), contig, chain, target_blocks)
    others = materialize(others.select("ord", F.col("at").alias("__at"), F.col("ref").alias("__ref"), F.col("alt").alias("__alt"), "swapped", F.col("status").alias("__status")))
    rest = lifted.filter(~snv).join(others, "ord")
    lifted = with_base(lifted.filter(snv).withColumn("pos", F.col("__pos")), F.col("tgt_contig"), target_blocks)
    for a in ("a1", "a2"):
        lifted = lifted.withColumn(a, F.when(minus, revcomp(F.col(a))).otherwise(F.col(a)))
    local = F.when(F.col("a2") == F.col("ref"), 0).when(F.col("a1") == F.col("ref"), 1)
    # Whether the source's alleles change places: for an indel also where the one-base allele was the first.
    local_of_rest = F.when(F.col("__status").isNull(), F.when(F.col("swapped") != (F.col("a1") == F.col("src_ref")), 1).otherwise(0))
    names = ("ord", "chrom", "pos", "id", "a1", "a2", *(PROVENANCE if vo.is_vmap else ()))
    lifted = lifted.select(*names, "__src", "__label", "tgt_contig", "strand", local.alias("__local"), F.when(local.isNull(), "unsupported_swap").alias("__why"), F.when(local == 1, F.col("a2")).otherwise(F.col("a1")).alias("__x"), F.when(local == 1, F.col("a1")).otherwise(F.col("a2")).alias("__y"))
    rest = rest.withColumn("pos", F.col("__at")).select(*names, "__src", "__label", "tgt_contig", "strand", local_of_rest.alias("__local"), F.col("__status").alias("__why"), F.col("__alt").alias("__x"), F.col("__ref").alias("__y"))
    lifted = lifted.union(rest)
    before, after = ploidy_pair(F.col("chrom"), F.col("__src"), vo.genome_build), ploidy_pair(F.col("tgt_contig"), F.col("pos"), target_build)
    status = (
        F.when(F.col("__why") == "unsupported_non_snv", F.col("__why"))
        .when(F.col("__label").isNull(), "unsupported_target_contig")
        .when(~keep(contig, F.col("tgt_contig")) if keep else F.lit(False), "outside_groups")
        .when(F.col("pos").isNotNull() & ~before.eqNullSafe(after), "ploidy_class_changed")
        .otherwise(F.coalesce("__why", F.lit("lifted")))
    )
    lifted = materialize(lifted.withColumn("status", status))
    good = lifted.filter("status = 'lifted'").withColumns({"chrom": F.col("__label"), "a1": F.col("__x"), "a2": F.col("__y")})
    if vo.is_vmap:
        good = good.withColumn("allele_op", compose_op(F.col("allele_op"), op_name(F.when(minus, 2).otherwise(0) + F.col("__local"))))
    good = materialize(good.select(*vo.columns))
    n = good.withColumn("__n", F.count("*").over(Window.partitionBy("chrom", "pos", "a1", "a2"))) if vo.is_vmap else good.withColumn("__n", F.lit(1))
    collided = n.filter("__n > 1").select("ord", F.lit("duplicate_target").alias("late"))
    said = based.filter(~ready).select("ord", F.lit("unsupported_non_snv").alias("status")).union(lifted.select("ord", "status"))
    qc = vo.df.join(said, "ord", "left").join(collided, "ord", "left")
    qc = status_qc(vo, qc, F.coalesce("late", "status", F.lit("unmapped")))
    out = vo.with_df(n.filter("__n = 1").drop("__n"), genome_build=target_build)
    return (sort_variants(out) if sort else out), qc


def first_rows(vo: VariantObject) -> VariantObject:
    """The first row of each key, in order."""
    return vo.with_df(first_of_key(vo.df, "ord"))
