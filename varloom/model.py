"""Variant objects: a DataFrame with its build, contig naming and order.

A vtable has (chrom, pos, id, a1, a2), a vmap (source_shard, source_index,
allele_op) besides. Both carry ``ord``, the place of each row: partitions have
no order of their own, so what depends on order reads it from there.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.alleles import KEY, MISSING, OPS, is_acgt
from varloom.functions.contigs import NAMINGS, canonical

BUILDS = ("GRCh37", "GRCh38", "T2T-CHM13v2.0", "unknown")
TABLE = ("chrom", "pos", "id", "a1", "a2")
PROVENANCE = ("source_shard", "source_index", "allele_op")
QC_COLUMNS = {
    "import": ("source_shard", "source_index", "reason"),
    "status": ("source_shard", "source_index", "source_id", "status"),
    "apply": ("source_shard", "source_index", "id", "status", "n_affected"),
}


@dataclass(frozen=True)
class VariantObject:
    df: DataFrame
    genome_build: str = "unknown"
    contig_naming: str | None = None

    def __post_init__(self):
        if self.genome_build not in BUILDS:
            raise ValueError(f"unsupported genome build: {self.genome_build!r}")
        if self.contig_naming is not None and self.contig_naming not in NAMINGS:
            raise ValueError(f"unsupported contig naming: {self.contig_naming!r}")
        lacks = [c for c in (*TABLE, "ord") if c not in self.df.columns]
        if lacks:
            raise ValueError(f"a variant table needs the columns {lacks}")

    @property
    def is_vmap(self) -> bool:
        return all(c in self.df.columns for c in PROVENANCE)

    @property
    def columns(self) -> list[str]:
        return [*TABLE, *(PROVENANCE if self.is_vmap else ()), "ord"]

    def with_df(self, df: DataFrame, **meta) -> VariantObject:
        return replace(self, df=df, **meta)

    def metadata(self) -> dict:
        frame = {"genome_build": self.genome_build} | ({"contig_naming": self.contig_naming} if self.contig_naming else {})
        return {"object_type": "variant_map", "target": frame} if self.is_vmap else {"object_type": "variant_table", **frame}

    def source(self) -> tuple:
        """(shard, index) columns that name a row in a QC table: a vtable's row is its place."""
        return (F.col("source_shard"), F.col("source_index")) if self.is_vmap else (F.lit(".").alias("source_shard"), F.col("ord").alias("source_index"))


def require_same_frame(*objects: VariantObject) -> None:
    """All objects declare one build and one naming. No row is read."""
    frames = [(o.genome_build, o.contig_naming) for o in objects]
    if any(n is None for _, n in frames) or len(set(frames)) > 1:
        said = "; ".join(f"input {i}: build {b}, contig naming {n or 'not declared'}" for i, (b, n) in enumerate(frames, 1))
        raise ValueError(f"the inputs must share one genome build and one declared contig naming ({said})")


def require_naming(vo: VariantObject) -> str:
    if vo.contig_naming is None:
        raise ValueError("the object declares no contig naming")
    return vo.contig_naming


def check_naming(vo: VariantObject) -> VariantObject:
    """Every row's label is one of the declared naming."""
    bad = [r[0] for r in vo.df.filter(canonical(F.col("chrom"), require_naming(vo)).isNull()).select("chrom").limit(3).collect()]
    if bad:
        raise ValueError(f"labels that contig naming {vo.contig_naming} lacks: {', '.join(map(str, bad))}")
    return vo


def duplicate_targets(df: DataFrame) -> DataFrame:
    """(chrom, pos, a1, a2, count) of keys that occur more than once."""
    return df.groupBy(*KEY).count().filter("count > 1")


def validate(vo: VariantObject, check_duplicates: bool = True) -> VariantObject:
    """Raise a ValueError at rows that break the rules of the object; a few are named."""
    c = F.col
    broken = (
        F.when(c("chrom").isNull() | (F.trim("chrom") == ""), "empty chrom")
        .when(c("id").isNull() | (F.trim("id") == ""), "empty id")
        .when(c("pos").isNull() | (c("pos") <= 0), "bad position")
        .when(~F.coalesce(is_acgt(c("a1")) & is_acgt(c("a2")), F.lit(False)), "bad allele")
    )
    if vo.is_vmap:
        none = c("source_index") == -1
        broken = broken.when(
            ~F.coalesce(
                (none & (c("source_shard") == ".") & (c("allele_op") == MISSING)) | ((c("source_index") >= 0) & (c("source_shard") != "") & c("allele_op").isin(*OPS)),
                F.lit(False),
            ),
            "bad provenance",
        )
    bad = vo.df.select(broken.alias("why"), *[c for c in vo.columns]).filter("why is not null").limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r.why} in row {r.ord}" for r in bad))
    if vo.is_vmap and check_duplicates and (twice := duplicate_targets(vo.df).limit(3).collect()):
        raise ValueError("targets that occur more than once: " + ", ".join(f"{r.chrom}:{r.pos}:{r.a1}:{r.a2}" for r in twice))
    return vo


def status_qc(vo: VariantObject, df: DataFrame, status) -> DataFrame:
    """A status QC table of some rows of a vmap or vtable."""
    shard, index = vo.source()
    return df.select(shard, index, F.col("id").alias("source_id"), (F.lit(status) if isinstance(status, str) else status).alias("status"))
