"""Genotype payloads: sample axes, and projection of packed codes and of allele-pair arrays onto a vmap.

Genotypes are one row for each variant, keyed by (source_shard, source_index).
They are never gathered: a row is as wide as the cohort, so joins carry keys
and each row is rewritten on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import genotypes as G
from varloom.functions.alleles import is_swap, variant_id
from varloom.functions.ploidy import check_ploidy_regions, join_ploidy
from varloom.model import VariantObject
from varloom.scratch import materialize

MODES = ("fid_iid", "iid")
#: One axis for all output, of target samples or of shards that agree; that of all subjects; or that of each output's own shards.
AXES = ("shared", "union", "native")


def subject(mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"sample id mode must be one of {MODES}")
    return F.struct("fid", "iid") if mode == "fid_iid" else F.struct(F.col("iid"))


def norm_sex(c: Column) -> Column:
    n = c.cast("string").try_cast("int")
    return F.when(n.isin(1, 2), n).otherwise(0)


def check_samples(samples: DataFrame, mode: str = "fid_iid") -> DataFrame:
    """(source_shard, local_idx, fid, iid, sex) without a subject twice in a shard, and not empty."""
    if samples.isEmpty():
        raise ValueError("no samples")
    twice = samples.groupBy("source_shard", subject(mode).alias("s")).count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"sample {tuple(twice.s)} is in shard {twice.source_shard} more than once")
    return samples


def referenced(vmap: VariantObject, samples: DataFrame) -> DataFrame:
    """The samples of the shards that mapped rows refer to; a shard without samples is an error."""
    used = materialize(vmap.df.filter("source_index <> -1").select("source_shard").distinct())  # a row for each shard
    lost = used.join(samples.select("source_shard").distinct(), "source_shard", "left_anti").first()
    if lost is not None:
        raise ValueError(f"shard {lost.source_shard} has no samples")
    return samples.join(F.broadcast(used), "source_shard", "left_semi")


def check_fid_presence(samples: DataFrame, mode: str) -> None:
    """Under ``fid_iid`` the headers of sample files name a FID in all shards or in none."""
    if mode == "fid_iid" and "header" in samples.columns:
        has = F.array_contains(F.split(F.regexp_replace("header", "^#", ""), r"\s+"), "FID")
        if samples.agg(F.countDistinct(has)).first()[0] > 1:
            raise ValueError("some sample files have a FID column and others have none")


def signatures(samples: DataFrame) -> DataFrame:
    """(source_shard, signature): a digest of a shard's samples in order, with all the columns that ``samples`` has."""
    line = F.struct("local_idx", *[c for c in samples.columns if c not in ("source_shard", "local_idx")])
    return samples.groupBy("source_shard").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(line)), {"ignoreNullFields": "false"}), 256).alias("signature"))


def same_signature(samples: DataFrame) -> bool:
    """Whether all shards list the same samples, with the same fields, in the same order."""
    return signatures(samples).agg(F.countDistinct("signature")).first()[0] <= 1


def native_axes(vmap: VariantObject, samples: DataFrame, group: Column) -> DataFrame:
    """(group, out_idx, fid, iid, sex and what else lines say): for each output group the samples of the shards that its rows come from.

    These shards must list the same samples; a group none of whose rows has a source is an error.
    """
    used = vmap.df.select(group.alias("group"), F.when(F.col("source_index") != -1, F.col("source_shard")).alias("source_shard"), "ord")
    per = used.groupBy("group", "source_shard").agg(F.min("ord").alias("first"))
    per = materialize(per.join(F.broadcast(signatures(samples)), "source_shard", "left"))
    first = F.min_by("source_shard", F.when(F.col("source_shard").isNotNull(), F.col("first")))
    by_group = per.groupBy("group").agg(F.count("source_shard").alias("shards"), F.count("signature").alias("known"), F.countDistinct("signature").alias("kinds"), first.alias("source_shard"))
    bad = by_group.filter("shards = 0 or kinds > 1 or known < shards").first()
    if bad is not None:
        why = "has no row with a source" if not bad.shards else "has shards without samples" if bad.known < bad.shards else "has shards with different samples"
        raise ValueError(f"a native axis is not possible: output {bad['group']} {why}")
    return _as_axis(samples.join(F.broadcast(by_group.select("group", "source_shard")), "source_shard"), "group")


def union_axis(samples: DataFrame, mode: str = "fid_iid") -> DataFrame:
    """(out_idx, fid, iid, sex) of all subjects, by shard and then place; a known sex beats an unknown one, two known ones are an error.

    What a subject's line says besides is not taken over, as shards may differ in it.
    """
    key = subject(mode).alias("s")
    at = F.struct("source_shard", "local_idx")
    per = samples.groupBy(key).agg(
        F.min(at).alias("at"), F.min_by("fid", at).alias("fid"), F.min_by("iid", at).alias("iid"), F.collect_set(F.when(F.col("sex").isin(1, 2), F.col("sex"))).alias("sexes")
    )
    bad = per.filter(F.size("sexes") > 1).first()
    if bad is not None:
        raise ValueError(f"sample {tuple(bad.s)} has two sexes")
    ordered = per.select("at", "fid", "iid", F.coalesce(F.get("sexes", F.lit(0)), F.lit(0)).alias("sex"))
    # One row for each sample of a cohort.
    listed = ordered.agg(F.array_sort(F.collect_list(F.struct("at", "fid", "iid", "sex"))).alias("all"))
    return listed.select(F.posexplode("all").alias("out_idx", "x")).select("out_idx", "x.fid", "x.iid", "x.sex")


def sample_axis(samples: DataFrame, target: DataFrame | None = None, mode: str = "fid_iid", union: bool = False) -> DataFrame:
    """(out_idx, fid, iid, sex), one axis for all output: the given target axis, the union of all shards, or the one axis that they share.

    Axes that are those of a file keep what its lines say besides (``rest`` and ``header``). The union of one shard is that shard's axis.
    """
    check_fid_presence(samples, mode)
    if target is not None:
        return _as_axis(target)
    first, last = samples.agg(F.min("source_shard"), F.max("source_shard")).first()
    if union and first != last:
        return union_axis(samples, mode)
    if not same_signature(samples):
        raise ValueError("shards have different samples; give a target axis or ask for the union")
    return _as_axis(samples.filter(F.col("source_shard") == first))


def _as_axis(samples: DataFrame, *keep: str) -> DataFrame:
    return samples.select(*keep, F.col("local_idx").alias("out_idx"), "fid", "iid", "sex", *[c for c in ("rest", "header") if c in samples.columns])


def fam_line(samples: DataFrame) -> Column:
    """A FAM line: the whole line of the sample's source where it has one."""
    plain = F.concat_ws("\t", F.lit("0"), F.lit("0"), F.col("sex").cast("string"), F.lit("-9"))
    rest = F.coalesce("rest", plain) if "rest" in samples.columns else plain
    return F.concat_ws("\t", "fid", "iid", rest)


def axis_maps(samples: DataFrame, axis: DataFrame, mode: str = "fid_iid") -> DataFrame:
    """(source_shard, local_of, n_absent): for each output sample its place in the shard, or null. A row for each shard."""
    key = subject(mode).alias("s")
    shards = samples.select("source_shard").distinct()
    want = axis.select(key, "out_idx").crossJoin(F.broadcast(shards))  # samples of the axis, for each shard of the payload
    got = want.join(samples.select(key, "source_shard", "local_idx"), ["source_shard", "s"], "left")
    listed = F.array_sort(F.collect_list(F.struct("out_idx", "local_idx")))
    return got.groupBy("source_shard").agg(F.transform(listed, lambda x: x["local_idx"].cast("int")).alias("local_of"), F.count_if(F.col("local_idx").isNull()).alias("n_absent"))


def reconciliation(vmap: VariantObject, maps: DataFrame) -> DataFrame:
    """(source_shard, mapped_rows, absent_samples, added_missing): what a shard's absent samples add in missing genotypes."""
    per = vmap.df.filter("source_index <> -1").groupBy("source_shard").agg(F.count("*").alias("mapped_rows"))
    return per.join(F.broadcast(maps), "source_shard").select("source_shard", "mapped_rows", F.col("n_absent").alias("absent_samples"), (F.col("mapped_rows") * F.col("n_absent")).alias("added_missing"))


def reconciliation_totals(vmap: VariantObject, maps: DataFrame) -> DataFrame:
    """One row: mapped_variants, output_samples, added_missing, subjects_over_half and variants_over_half.

    The last two count the subjects that are absent from the shards of more
    than half of the mapped variants, and the variants whose shard lacks more than half of the subjects.
    """
    per = vmap.df.filter("source_index <> -1").groupBy("source_shard").agg(F.count("*").alias("n"))
    both = materialize(per.join(F.broadcast(maps), "source_shard").withColumn("size", F.size("local_of")))
    over = F.coalesce(F.sum(F.when(F.col("n_absent") * 2 > F.col("size"), F.col("n"))), F.lit(0))
    sums = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mapped_variants"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("output_samples"), F.coalesce(F.sum(F.col("n") * F.col("n_absent")), F.lit(0)).alias("added_missing"), over.alias("variants_over_half"))
    absent = both.select("n", F.posexplode("local_of").alias("out_idx", "local")).groupBy("out_idx").agg(F.sum(F.when(F.col("local").isNull(), F.col("n")).otherwise(0)).alias("lost"), F.sum("n").alias("n"))
    many = absent.agg(F.count_if(F.col("lost") * 2 > F.col("n")).alias("subjects_over_half"))
    return sums.crossJoin(many)  # one row each


def attach_genotypes(vmap: VariantObject, payload: DataFrame, only_mapped: bool = False, **more: Column) -> DataFrame:
    """Rows of a vmap with their payload columns, as a table; rows without a source stay out of the join. A missing source is an error.

    The payload is read and joined once, and the table's key columns tell what it lacks. ``more``: columns of the payload's, computed where it is written.
    """
    keys = ["source_shard", "source_index"]
    mapped = vmap.df.filter("source_index <> -1")
    joined = materialize(mapped.join(payload.withColumn("__there", F.lit(True)), keys, "left").withColumns(more))
    gone = joined.filter("__there is null").orderBy(*keys).first()
    if gone is not None:
        raise ValueError(f"shard {gone.source_shard} has no variant {gone.source_index}")
    joined = joined.drop("__there")
    return joined if only_mapped else joined.unionByName(vmap.df.filter("source_index = -1"), allowMissingColumns=True)


@dataclass(frozen=True)
class GenotypeResult:
    variants: DataFrame
    genotypes: DataFrame
    samples: DataFrame
    ploidy: DataFrame
    qc: DataFrame
    summary: DataFrame
    #: One row: genotypes that the ploidy check skipped, as their sample has no known sex.
    unvalidated: DataFrame


def require_mapped(vmap: VariantObject, only_mapped: bool) -> None:
    """Some row has a source; else there is no payload to write."""
    got = vmap.df.agg(F.count("*").alias("n"), F.count_if(F.col("source_index") != -1).alias("mapped")).first()
    if not got.n:
        raise ValueError("the vmap has no row")
    if not got.mapped:
        raise ValueError("no row is left" if only_mapped else "no target has a source: all genotypes would be missing")


def checked(vmap: VariantObject, only_mapped: bool) -> VariantObject:
    """The vmap as a table that several jobs read, after the checks of its rows; without unmatched ones for ``only_mapped``."""
    vmap = vmap.with_df(materialize(vmap.df.select(*vmap.columns)))
    require_mapped(vmap, only_mapped)
    if only_mapped:
        vmap = vmap.with_df(vmap.df.filter("source_index <> -1"))
    check_ploidy_regions(vmap.df, vmap.genome_build)
    return vmap


def _axis_rows(vmap: VariantObject, rows: DataFrame, samples: DataFrame, target: DataFrame | None, mode: str, axis: str, group: Column) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows with local_of, __sexes and __n, the samples of the output, the maps of shards or None for a native axis)."""
    if axis not in AXES:
        raise ValueError(f"the sample axis must be one of {AXES}")
    samples = materialize(referenced(vmap, samples))
    if axis != "native":
        out = sample_axis(samples, target, mode, axis == "union")
        maps = axis_maps(samples, out, mode)
        return rows.join(F.broadcast(maps), "source_shard", "left").crossJoin(F.broadcast(_sexes(out))), out, maps  # a row for the cohort
    if target is not None:
        raise ValueError("a native axis takes no target samples")
    out = native_axes(vmap, samples, group)
    listed = F.array_sort(F.collect_list(F.struct("out_idx", "sex")))
    per = out.groupBy("group").agg(F.transform(listed, lambda x: x["out_idx"].cast("int")).alias("local_of"), F.transform(listed, lambda x: x["sex"]).alias("__sexes"), F.count("*").cast("int").alias("__n"))
    return rows.withColumn("group", group).join(F.broadcast(per), "group").drop("group"), out, None


def _sexes(axis: DataFrame) -> DataFrame:
    return axis.agg(F.transform(F.array_sort(F.collect_list(F.struct("out_idx", "sex"))), lambda x: x["sex"]).alias("__sexes"), F.count("*").cast("int").alias("__n"))


def _issues(rows: DataFrame, issues: Column, check: bool) -> DataFrame:
    names = ("source_shard", "source_index", "id", "status", "n_affected")
    differs = (F.col("male") != 2) | (F.col("female") != 2)
    with_issues = rows.filter(differs if check else F.lit(False)).withColumn("__issues", issues)
    fields = with_issues.schema["__issues"].dataType.fieldNames()
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("status"), F.col(f"__issues.{k}").cast("long").alias("n_affected")) for k in fields]))
    return with_issues.select("source_shard", "source_index", "id", each.alias("x")).select("source_shard", "source_index", "id", "x.*").filter("n_affected > 0").select(*names)


def apply_to_bfile(
    vmap: VariantObject,
    geno: DataFrame,
    samples: DataFrame,
    target_samples: DataFrame | None = None,
    axis: str = "shared",
    by_contig: bool = False,
    sample_id_mode: str = "fid_iid",
    only_mapped: bool = False,
    retain_id: bool = False,
    check_ploidy: bool = True,
) -> GenotypeResult:
    """Packed genotypes (``geno``: codes 0 to 3) of a vmap's targets on one sample axis.

    Swapped rows exchange the homozygotes, absent samples and rows without a
    source are missing. Rows that are not diploid in both sexes are checked.
    A native axis is one for each contig with ``by_contig``, else one for all.
    """
    vmap = checked(vmap, only_mapped)
    group = F.col("chrom") if by_contig else F.lit(".")
    rows, samples_out, maps = _axis_rows(vmap, attach_genotypes(vmap, geno, only_mapped), samples, target_samples, sample_id_mode, axis, group)
    out = F.when(F.col("source_index") == -1, G.missing_codes(F.col("__n"))).otherwise(G.remap(F.col("geno"), F.col("local_of"), F.lit(G.MISSING).cast("tinyint")))
    # Ploidies come first, so that their check takes only its own rows to the other axis.
    rows = join_ploidy(rows, vmap.genome_build).withColumn("geno", F.when(is_swap(F.col("allele_op")), G.swap_codes(out)).otherwise(out))
    issues = G.code_ploidy_issues(F.col("geno"), F.col("__sexes"), F.col("male"), F.col("female"))
    return _result(vmap, rows, samples_out, maps, issues, check_ploidy, retain_id, ["geno"])


def apply_to_genotype_arrays(
    vmap: VariantObject,
    arrays: DataFrame,
    samples: DataFrame,
    target_samples: DataFrame | None = None,
    axis: str = "shared",
    by_contig: bool = False,
    sample_id_mode: str = "fid_iid",
    only_mapped: bool = False,
    retain_id: bool = False,
    check_ploidy: bool = True,
) -> GenotypeResult:
    """As ``apply_to_bfile`` for (alleles: two for each sample, phase, dosage); -9 is missing."""
    vmap = checked(vmap, only_mapped)
    group = F.col("chrom") if by_contig else F.lit(".")
    attached = attach_genotypes(vmap, arrays, only_mapped, channel=G.channel(F.col("alleles"), F.col("phase"), F.col("dosage")))
    if "allele_ct" in arrays.columns:
        if (bad := attached.filter("allele_ct <> 2").first()) is not None:
            raise ValueError(f"variant {bad.source_index} of shard {bad.source_shard} has more than two alleles")
        attached = attached.drop("allele_ct")
    if (bad := attached.filter("channel = 'unsupported'").first()) is not None:
        raise ValueError(f"variant {bad.source_index} of shard {bad.source_shard} mixes phases and dosages")
    rows, samples_out, maps = _axis_rows(vmap, attached, samples, target_samples, sample_id_mode, axis, group)
    swap, none = is_swap(F.col("allele_op")), F.col("source_index") == -1
    nth = F.sequence(F.lit(0), F.col("__n") - 1)
    blank = F.transform(nth, lambda _: F.lit(None).cast("int"))
    local = F.when(none, blank).otherwise(F.col("local_of"))
    twice = F.flatten(F.transform(local, lambda i: F.array(i * 2, i * 2 + 1)))
    # Values are turned on the new axis: within ``remap`` the whole row would be turned again for each sample.
    pairs, dose = G.remap(F.col("alleles"), twice, F.lit(G.NONE)), G.remap(F.col("dosage"), local, F.lit(float(G.NONE)).cast("float"))
    rows = join_ploidy(rows, vmap.genome_build).withColumns(
        {
            "alleles": F.when(swap, G.swap_pair(pairs)).otherwise(pairs),
            "phase": G.remap(F.col("phase"), local, F.lit(False)),
            "dosage": F.when(swap, G.swap_dosage(dose)).otherwise(dose),
        }
    )
    issues = G.pair_ploidy_issues(F.col("alleles"), F.col("dosage"), F.col("__sexes"), F.col("male"), F.col("female"))
    return _result(vmap, rows, samples_out, maps, issues, check_ploidy, retain_id, ["alleles", "phase", "dosage", "channel"])


def _result(vmap: VariantObject, rows: DataFrame, axis: DataFrame, maps: DataFrame | None, issues: Column, check: bool, retain_id: bool, payload: list[str]) -> GenotypeResult:
    found = _issues(rows, issues, check)
    unknown = found.filter("status = 'unknown_sex'").agg(F.coalesce(F.sum("n_affected"), F.lit(0)).alias("unknown_sex"))
    qc = found.filter("status <> 'unknown_sex'")
    if maps is None:  # a native axis lacks nobody
        maps = rows.filter("source_index <> -1").select("source_shard", F.lit(0).cast("long").alias("n_absent")).distinct()
    ident = F.col("id") if retain_id else variant_id(F.col("chrom"), F.col("pos"), F.col("a1"), F.col("a2"))
    variants = rows.select("ord", "chrom", ident.alias("id"), "pos", "a1", "a2")
    return GenotypeResult(variants, rows.select("ord", *payload), axis, rows.select("ord", "male", "female"), qc, reconciliation(vmap, maps), unknown)
