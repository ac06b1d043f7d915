"""The user-level pipelines: prepare a variant list, project a payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.contigs import CANONICAL, canonical, normalize_label, rank
from varloom.model import VariantObject, status_qc
from varloom.operators import genotypes as G
from varloom.operators.reference import guess_build, guess_builds, liftover_build, restrict_build_compatible
from varloom.operators.sumstats import apply_to_sumstats
from varloom.operators.variants import drop_strand_ambiguous, first_of_key, match_to_target, normalize_contigs, reorder, restrict_contigs
from varloom.scratch import materialize
from varloom.sources.readers import read_bim, read_pvar, read_vcf


def prepare_variants(
    imported: VariantObject,
    blocks: dict[str, DataFrame],
    chains: dict[tuple[str, str], DataFrame],
    dst_build: str = "GRCh38",
    dst_naming: str = "ncbi",
    flips: bool = True,
    norm_indels: bool = True,
    drop_ambiguous: bool = False,
    contigs: str | None = None,
) -> tuple[VariantObject, dict[str, DataFrame]]:
    """(vmap in the wanted build and naming, QC of each stage).

    Labels, then the build if it is unknown, agreement with the reference,
    liftover where the build differs, and the optional filters. Splitting X
    comes after liftover, as it depends on the build.
    """
    qc: dict[str, DataFrame] = {}
    first_naming = "ncbi" if dst_naming == "plink_splitx" else dst_naming
    vo = imported
    if vo.contig_naming != first_naming:
        vo, qc["normalize_contigs"], _ = normalize_contigs(vo, first_naming)
    vo = vo.with_df(materialize(vo.df))
    if vo.genome_build == "unknown":
        vo, _ = guess_build(vo, {b: blocks[b] for b in ("GRCh37", "GRCh38") if b in blocks})
        if vo.genome_build == "unknown":
            raise ValueError("the genome build cannot be told from the variants")
    there = vo.genome_build == dst_build
    vo, qc["restrict"], _ = restrict_build_compatible(vo, blocks[vo.genome_build], flips, norm_indels, sort=there, drop_duplicates=there)
    vo = vo.with_df(materialize(vo.df))
    if not there:
        edge = (vo.genome_build, dst_build)
        if edge not in chains:
            raise ValueError(f"no chain from {edge[0]} to {edge[1]}")
        vo, qc["liftover"] = liftover_build(vo, dst_build, blocks[edge[0]], blocks[edge[1]], chains[edge])
    if dst_naming != first_naming:
        vo, qc["split_x"], _ = normalize_contigs(vo, dst_naming)
    if drop_ambiguous:
        vo = drop_strand_ambiguous(vo)
    if contigs is not None:
        vo = restrict_contigs(vo, contigs)
    return vo, qc


def prepare_variants_sharded(
    imported: VariantObject,
    groups: list[list[str]] | None,
    blocks: dict[str, DataFrame],
    chains: dict[tuple[str, str], DataFrame],
    dst_build: str = "GRCh38",
    dst_naming: str = "ncbi",
    flips: bool = True,
    norm_indels: bool = True,
    drop_ambiguous: bool = False,
) -> tuple[VariantObject, list[dict[str, DataFrame]]]:
    """(vmap, [QC of each stage, QC of rows outside]): ``prepare_variants`` of each group of contigs, so that every group tells its own build, one behind the other.

    Labels of any spelling count for their contig, X with its pseudoautosomal
    labels. Without ``groups`` every contig is one. Rows whose contig is in no group, or that liftover would
    carry to another group's contig, have the status ``outside_groups``.

    The import is read once. Groups go through together: the builds of all are told in one pass, then
    those of the same build are oriented and lifted in one job.
    """
    if dst_naming == "plink_splitx":
        raise ValueError("plink_splitx is not possible for groups")
    groups = groups if groups is not None else [[c] for c in CANONICAL]
    if len({c for g in groups for c in g}) < sum(map(len, groups)):
        raise ValueError("a contig is in two groups")
    name = {c: str(i) for i, g in enumerate(groups) for c in g}
    of = lambda contig: F.try_element_at(F.create_map(*[F.lit(x) for kv in name.items() for x in kv]), contig)
    imported = imported.with_df(materialize(imported.df.select(*imported.columns)))
    inside = of(normalize_label(F.col("chrom"))).isNotNull()
    qc: dict[str, DataFrame] = {}
    outside = {"outside": status_qc(imported, imported.df.filter(~inside), "outside_groups")}
    vo = imported.with_df(imported.df.filter(inside))
    if vo.contig_naming != dst_naming:
        vo, qc["normalize_contigs"], _ = normalize_contigs(vo, dst_naming)
    vo = vo.with_df(materialize(vo.df.select(*vo.columns)))
    contig = canonical(F.col("chrom"), dst_naming)
    if vo.genome_build == "unknown":
        builds, qc["builds"] = guess_builds(vo, of(contig), {b: blocks[b] for b in ("GRCh37", "GRCh38") if b in blocks})
        if lost := sorted(int(g) for g, b in builds.items() if b == "unknown"):
            raise ValueError(f"the genome build cannot be told from the variants of {', '.join(groups[lost[0]])}")
    else:
        builds = {r[0]: vo.genome_build for r in vo.df.select(of(contig)).distinct().collect()}  # a row for each group
    if not builds:
        raise ValueError("no group has a variant")
    done = None
    for build in sorted(set(builds.values())):
        part = vo.with_df(vo.df.filter(of(contig).isin([g for g, b in builds.items() if b == build])), genome_build=build)
        part, qc[f"restrict {build}"], _ = restrict_build_compatible(part, blocks[build], flips, norm_indels)
        part = part.with_df(materialize(part.df))
        if build == dst_build:
            part = part.with_df(first_of_key(part.df, "ord"))
        else:
            if (build, dst_build) not in chains:
                raise ValueError(f"no chain from {build} to {dst_build}")
            part, qc[f"liftover {build}"] = liftover_build(part, dst_build, blocks[build], blocks[dst_build], chains[build, dst_build], keep=lambda a, b: of(a).eqNullSafe(of(b)), sort=False)
        done = part.df.select(*part.columns) if done is None else done.unionByName(part.df.select(*part.columns))
    out = vo.with_df(materialize(done), genome_build=dst_build)
    if drop_ambiguous:
        out = drop_strand_ambiguous(out)
    # A group stands where its first contig does.
    first = {str(i): min(map(CANONICAL.index, g)) for i, g in enumerate(groups)}
    rank_of = F.try_element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), of(contig))
    ranked = out.df.withColumns({"__group": rank_of, "__rank": rank(contig), "__old": F.col("ord")})
    return out.with_df(reorder(ranked, "__group", "__rank", "pos", "a1", "a2", "__old").drop("__group", "__rank", "__old")), [qc, outside]


def prepare_sharded_files(spark: SparkSession, template: str, fmt: str, blocks: dict[str, DataFrame], chains: dict[tuple[str, str], DataFrame], shards: list[str] | None = None, max_allele_length: int = 150, **options) -> tuple[VariantObject, dict[str, DataFrame]]:
    """``prepare_variants_sharded`` of the files of a path with "@" (``fmt``: bim, pvar or vcf).

    Shards of the same contig, such as X and its pseudoautosomal parts, are one group; a shard gives
    rows of its own contig only, others are ``outside_groups``.
    """
    if "@" not in template:
        raise ValueError("the path needs an @")
    read = {"bim": read_bim, "pvar": read_pvar, "vcf": read_vcf}[fmt]
    vo, qc = read(spark, template, shards=shards, max_allele_length=max_allele_length)
    own = normalize_label(F.col("source_shard")).eqNullSafe(normalize_label(F.col("chrom")))
    df = materialize(vo.df.select(*vo.columns))
    out, (stages, outside) = prepare_variants_sharded(vo.with_df(df.filter(own)), None, blocks, chains, **options)
    return out, {"import": qc, "shard": status_qc(vo, df.filter(~own), "outside_groups"), **stages, **outside}


def project_payload(payload, fmt: str, target: VariantObject, source_vmap: VariantObject | None = None, full_target: bool = False, repeated: bool = False, **options):
    """The payload of a source on a target's rows: mapped rows alone unless ``full_target``; target keys may occur twice with ``repeated``.

    ``fmt``: sumstats (payload: table, metadata), bfile or arrays (payload:
    genotypes, samples). A target without provenance needs the source's vmap.
    """
    if source_vmap is None and not target.is_vmap:
        raise ValueError("a target without provenance needs source_vmap")
    vmap = match_to_target(source_vmap, target, repeated) if source_vmap is not None else target
    if fmt == "sumstats":
        return apply_to_sumstats(vmap, payload[0], payload[1], only_mapped=not full_target, **options)
    apply = {"bfile": G.apply_to_bfile, "arrays": G.apply_to_genotype_arrays}[fmt]
    return apply(vmap, payload[0], payload[1], only_mapped=not full_target, **options)
