"""Writers: variant tables, QC tables, summary statistics, genotypes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.genotypes import encode
from varloom.model import QC_COLUMNS, VariantObject
from varloom.operators.genotypes import fam_line
from varloom.sources.readers import MAGIC, file_system


def _text(df: DataFrame, path: str, **options) -> None:
    df.write.mode("overwrite").options(sep="\t", **options).csv(path)


def write_object(vo: VariantObject, path: str) -> None:
    """Headerless TSV in order, in part files whose names sort in that order, and its metadata beside it."""
    cols = [c for c in vo.columns if c != "ord"]
    _text(vo.df.select(*vo.columns).orderBy("ord").select(*cols), path, quote="")
    spark = vo.df.sparkSession
    spark.createDataFrame([(json.dumps(vo.metadata(), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta.json")


def write_qc(qc: DataFrame, path: str, kind: str, always: bool = False) -> bool:
    """A QC table with its header; nothing where there is no row, unless ``always``."""
    if not always and qc.isEmpty():
        return False
    _text(qc.select(*QC_COLUMNS[kind]), path, header=True)
    return True


def write_sumstats(df: DataFrame, path: str, delimiter: str = "\t", clean: bool = False, gz: bool = False) -> None:
    """In ``ord``. Clean tables have empty cells for what is missing and 15 digits, others ``n/a``."""
    out = df.orderBy("ord").drop("ord")
    if clean:
        out = out.select(*[_short(c) if t == "double" else F.col(c) for c, t in out.dtypes])
    options = {"header": True, "sep": delimiter, "nullValue": "" if clean else "n/a", "emptyValue": ""} | ({"compression": "gzip"} if gz else {})
    out.write.mode("overwrite").options(**options).csv(path)


def save_payload(payload: DataFrame, table: str, buckets: int = 200) -> DataFrame:
    """A payload as a table bucketed and sorted by ``source_index``, so that projections onto many targets don't shuffle it again."""
    payload.repartition(buckets, "source_index").write.mode("overwrite").bucketBy(buckets, "source_index").sortBy("source_index").saveAsTable(table)
    return payload.sparkSession.table(table)


def _short(name: str):
    @F.pandas_udf("string")
    def digits(x):
        return x.map(lambda v: None if v is None or v != v else f"{v:.15g}")

    return digits(F.col(name)).alias(name)


def write_bfile(variants: DataFrame, genotypes: DataFrame, samples: DataFrame, ploidy: DataFrame, path: str) -> None:
    """BIM and FAM as text, BED as ``write_bed`` does, PLOIDY where a row is not (2, 2)."""
    bim = variants.orderBy("ord").select("chrom", "id", F.lit("0").alias("cm"), "pos", "a1", "a2")
    _text(bim, f"{path}.bim")
    write_bed(genotypes, f"{path}.bed")
    samples.orderBy("out_idx").select(fam_line(samples)).write.mode("overwrite").text(f"{path}.fam")
    if not ploidy.filter("male <> 2 or female <> 2").isEmpty():
        _text(ploidy.orderBy("ord").select("male", "female"), f"{path}.ploidy")


def write_genotype_arrays(variants: DataFrame, genotypes: DataFrame, samples: DataFrame, path: str) -> None:
    """Arrays as Parquet; PVAR (REF is a2, ALT is a1) and PSAM as text."""
    genotypes.orderBy("ord").write.mode("overwrite").parquet(f"{path}.arrays.parquet")
    _text(variants.orderBy("ord").select(F.col("chrom").alias("#CHROM"), F.col("pos").alias("POS"), F.col("id").alias("ID"), F.col("a2").alias("REF"), F.col("a1").alias("ALT")), f"{path}.pvar", header=True)
    write_psam(samples, f"{path}.psam")


def write_psam(samples: DataFrame, path: str) -> None:
    """A PSAM file with the whole lines of the samples' source under its header, else with FID, IID and SEX (left out where nobody's is known)."""
    if "header" in samples.columns and (head := samples.agg(F.min("header")).first()[0]) is not None:
        lines = samples.sparkSession.createDataFrame([(-1, head)], "out_idx int, rest string").union(samples.select("out_idx", "rest"))
        lines.coalesce(1).sortWithinPartitions("out_idx").select("rest").write.mode("overwrite").text(path)  # a cohort's lines
        return
    known = samples.filter("sex in (1, 2)").limit(1).count() > 0
    named = [F.col("fid").alias("#FID"), F.col("iid").alias("IID"), *([F.col("sex").alias("SEX")] if known else [])]
    _text(samples.orderBy("out_idx").select(*named), path, header=True)


def write_by_contig(df: DataFrame, path: str) -> None:
    """A folder for each target label; ranges of a label's rows, not the whole label, go to one task."""
    df.repartitionByRange("chrom", "ord").sortWithinPartitions("ord").write.mode("overwrite").partitionBy("chrom").parquet(path)


def write_bed(genotypes: DataFrame, path: str) -> int:
    """A SNP-major PLINK BED file in parts: a folder whose ``part-*`` files, put together in the order of their names, are the file.

    The first part is the magic bytes; then each task writes the records of its
    range of ``ord``, under a name of its attempt first, so that a task that is run
    again leaves the same part. Returns the number of records.
    """
    system, folder = file_system(path)
    system.create_dir(folder)
    system.delete_dir_contents(folder)
    with system.open_output_stream(f"{folder}/part-000000") as f:
        f.write(MAGIC)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = file_system(path)
        name = f"part-{TaskContext.get().partitionId() + 1:06d}"
        attempt, records = f"{folder}/_{name}.{uuid.uuid4().hex}", 0
        with system.open_output_stream(attempt) as f:
            for frame in frames:
                f.write(b"".join(frame["bed"]))
                records += len(frame)
        system.move(attempt, f"{folder}/{name}")
        yield pd.DataFrame({"records": [records]})

    packed = genotypes.select("ord", encode(F.col("geno")).alias("bed")).orderBy("ord").select("bed")
    return packed.mapInPandas(run, "records long").agg(F.sum("records")).first()[0] or 0
