"""Expected ploidy of men and women by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.contigs import normalize_label

# The pseudoautosomal regions of each build, 1-based, both ends included.
PAR = {
    "GRCh37": {"X": ((60001, 2699520), (154931044, 155260560)), "Y": ((10001, 2649520), (59034050, 59363566))},
    "GRCh38": {"X": ((10001, 2781479), (155701383, 156030895)), "Y": ((10001, 2781479), (56887903, 57217415))},
    "T2T-CHM13v2.0": {"X": ((1, 2394410), (153925835, 154259566)), "Y": ((1, 2458320), (62122810, 62460029))},
}
MT_LENGTH = 16569
BUILDS = tuple(PAR)
#: (men, women) outside the pseudoautosomal regions.
SINGLE = {"X": (1, 2), "Y": (1, 0), "MT": (1, 1)}


def _regions(build: str) -> dict:
    if build not in PAR:
        raise ValueError(f"no ploidy model of build {build!r}")
    return PAR[build]


def in_par(contig: Column, pos: Column, build: str) -> Column:
    hit = F.lit(False)
    for name, spans in _regions(build).items():
        for low, high in spans:
            hit = hit | ((contig == name) & pos.between(low, high))
    return F.coalesce(hit, F.lit(False))


def splitx_label(contig: Column, pos: Column, build: str) -> Column:
    """25 for the pseudoautosomal regions of X, 23 for the rest of X, null for other contigs."""
    return F.when(contig == "X", F.when(in_par(contig, pos, build), F.lit("25")).otherwise(F.lit("23")))


def ploidy_pair(chrom: Column, pos: Column, build: str) -> Column:
    """struct(male, female); null where the model has no region (beyond MT, or a position below 1)."""
    contig = normalize_label(chrom)
    pair = lambda m, f: F.struct(F.lit(m).alias("male"), F.lit(f).alias("female"))
    known = (pos >= 1) & ~((contig == "MT") & (pos > MT_LENGTH))
    single = F.when(contig == "X", pair(*SINGLE["X"])).when(contig == "Y", pair(*SINGLE["Y"])).when(contig == "MT", pair(*SINGLE["MT"]))
    haploid = F.coalesce(contig.isin(*SINGLE), F.lit(False))
    return F.when(~haploid | in_par(contig, pos, build), pair(2, 2)).when(known, single)


def check_ploidy_regions(variants: DataFrame, build: str) -> None:
    """Raise a ValueError at a variant on X, Y or MT that lies in no region of the model."""
    contig = normalize_label(F.col("chrom"))
    bad = variants.filter(contig.isin(*SINGLE) & ploidy_pair(F.col("chrom"), F.col("pos"), build).isNull()).select("chrom", "pos").first()
    if bad is not None:
        raise ValueError(f"no ploidy region has {bad.chrom}:{bad.pos}")


def ploidy_regions(spark: SparkSession, build: str) -> DataFrame:
    """(contig, start, end, male, female): a row for each interval; a null end is the contig's end."""
    rows = []
    for contig, spans in _regions(build).items():
        at = 1
        for low, high in spans:
            if low > at:
                rows.append((contig, at, low - 1, *SINGLE[contig]))
            rows.append((contig, low, high, 2, 2))
            at = high + 1
        rows.append((contig, at, None, *SINGLE[contig]))
    rows.append(("MT", 1, MT_LENGTH, *SINGLE["MT"]))
    return spark.createDataFrame(rows, "contig string, start long, end long, male int, female int")


def join_ploidy(variants: DataFrame, build: str) -> DataFrame:
    """Add ``male`` and ``female`` by an interval join with the region table (under 30 rows, broadcast)."""
    regions = ploidy_regions(variants.sparkSession, build)
    contig = normalize_label(F.col("chrom"))
    on = (F.col("__contig") == F.col("contig")) & (F.col("pos") >= F.col("start")) & (F.col("end").isNull() | (F.col("pos") <= F.col("end")))
    joined = variants.withColumn("__contig", contig).join(F.broadcast(regions), on, "left")
    sex = F.coalesce(F.col("__contig").isin(*SINGLE), F.lit(False))
    fill = lambda c: F.when(~sex, F.lit(2)).otherwise(F.col(c)).alias(c)
    return joined.select(*variants.columns, fill("male"), fill("female"))
