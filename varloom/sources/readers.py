"""Readers: variant lists, summary statistics, samples, genomes, chains, packed genotypes.

Text is read in splits. ``numbered`` gives every line its place in its file:
lines are counted block by block, and the counts of earlier blocks added.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.functions.alleles import allele_reason, norm_allele, parse_pos
from varloom.functions.contigs import shard_tokens
from varloom.model import PROVENANCE, TABLE, VariantObject, validate
from varloom.operators.genotypes import check_samples, norm_sex
from varloom.operators.variants import classified, infer_contig_naming
from varloom.scratch import materialize


def numbered(spark: SparkSession, path: str, keep: Column | None = None, cut: Column | None = None) -> DataFrame:
    """(line, index): the lines of a file for which ``keep`` holds, numbered from 0 in file order; of a folder's files, by name.

    ``cut``: what of a line goes on, so that a wide line is not written again as a whole.
    """
    return numbered_shards(spark, [(".", path, keep, cut)]).select("line", "index")


def numbered_shards(spark: SparkSession, shards: list[tuple[str, str, Column | None, Column | None]]) -> DataFrame:
    """(shard, line, index): ``numbered`` for the file of each shard (token, path, keep, cut), all shards in one pass."""
    every = None
    for token, path, keep, cut in shards:
        lines = spark.read.text(path).select(F.lit(token).alias("shard"), F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        if keep is not None:
            lines = lines.filter(keep)
        if cut is not None:
            lines = lines.withColumn("line", cut)
        every = lines if every is None else every.union(lines)
    # Ids rise within a block whatever else its task reads.
    marked = materialize(every.withColumn("__m", F.monotonically_increasing_id()))
    per = marked.groupBy("shard", "file", "block").agg(F.count("*").alias("n"), F.min("__m").alias("least"))
    # A row for each block.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select("shard", "file", "block", (before - F.col("least")).alias("shift"))
    return marked.join(F.broadcast(starts), ["shard", "file", "block"]).select("shard", "line", (F.col("__m") + F.col("shift")).alias("index"))


def resolve_shards(spark: SparkSession, template: str, shards: list[str] | None = None) -> list[tuple[str, str]]:
    """(token, path) of each shard of a path with "@"; without one the token is ".". None found is an error."""
    if "@" not in template:
        if shards:
            raise ValueError("shards are given but the path has no @")
        return [(".", template)]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda p: hadoop(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(p))
    if shards is not None:
        if not shards or any(not s for s in shards) or len(set(shards)) < len(shards):
            raise ValueError("shards must be given once each and not be empty")
        found = [(s, template.replace("@", s)) for s in shards]
        if lost := [p for _, p in found if not there(p)]:
            raise ValueError(f"no such shard: {lost[0]}")
        return found
    found = sorted(((t, template.replace("@", t)) for t in shard_tokens() if there(template.replace("@", t))), key=lambda x: x[1])
    if not found:
        raise ValueError(f"no shards of {template}")
    return found


def _sharded(spark: SparkSession, path: str, shards: list[str] | None, keep, cut: Column | None = None) -> DataFrame:
    found = resolve_shards(spark, path, shards)
    lines = numbered_shards(spark, [(token, one, keep(one), cut) for token, one in found])
    return _in_order(lines, [token for token, _ in found])


def _in_order(lines: DataFrame, tokens: list[str]) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(t) for t in tokens]), F.col("shard")).cast("int") - 1
    return lines.select("line", F.col("shard").alias("source_shard"), F.col("index").alias("source_index"), F.struct(place.alias("__shard"), F.col("index").alias("source_index")).alias("ord"))


def _imported(rows: DataFrame, reason: Column, contigs: str | None, genome_build: str) -> tuple[VariantObject, DataFrame]:
    """Turn parsed rows (chrom, pos, id, a1, a2) into a vmap and its import QC."""
    ident = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", ".").otherwise(F.trim("id"))
    fields = {"chrom": F.trim("chrom"), "pos": parse_pos(F.col("pos")), "id": ident, "a1": F.col("a1"), "a2": F.col("a2"), "reason": reason}
    good, qc = classified(rows.select(*[v.alias(k) for k, v in fields.items()], "source_shard", "source_index", "ord"), contigs)
    # Shards one after the other: a shard has fewer than 2^40 rows.
    if dict(good.dtypes)["ord"] != "bigint":
        good = good.withColumn("ord", F.shiftleft(F.col("ord.__shard").cast("long"), 40) + F.col("ord.source_index"))
    return VariantObject(good, genome_build, infer_contig_naming(good)), qc


def _bad_place() -> Column:
    return (F.coalesce(F.trim("chrom"), F.lit("")) == "") | parse_pos(F.col("pos")).isNull()


def parse_bim(lines: DataFrame, max_allele_length: int = 150, contigs: str | None = None, genome_build: str = "unknown") -> tuple[VariantObject, DataFrame]:
    """BIM lines: chrom, id, cm, pos, a1, a2, by any white space."""
    f = F.split(F.trim("line"), r"\s+")
    rows = lines.withColumn("f", f).select(
        "source_shard", "source_index", "ord", F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).alias("id"), F.get("f", F.lit(3)).alias("pos"),
        norm_allele(F.get("f", F.lit(4))).alias("a1"), norm_allele(F.get("f", F.lit(5))).alias("a2"), F.size("f").alias("width"),
    )
    reason = F.when((F.col("width") < 6) | _bad_place(), "malformed_row").otherwise(allele_reason(F.col("a1"), F.col("a2"), max_allele_length))
    return _imported(rows, reason, contigs, genome_build)


def parse_vcf(lines: DataFrame, max_allele_length: int = 150, contigs: str | None = None, genome_build: str = "unknown") -> tuple[VariantObject, DataFrame]:
    """VCF lines without the header: CHROM, POS, ID, REF, ALT; a1 is ALT."""
    rows = lines.withColumn("f", F.split("line", "\t")).select(
        "source_shard", "source_index", "ord", F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).alias("pos"), F.get("f", F.lit(2)).alias("id"),
        norm_allele(F.get("f", F.lit(4))).alias("a1"), norm_allele(F.get("f", F.lit(3))).alias("a2"), F.size("f").alias("width"),
    )
    reason = F.when((F.col("width") < 5) | _bad_place(), "malformed_row").when(F.col("a1").contains(","), "multiallelic").otherwise(allele_reason(F.col("a1"), F.col("a2"), max_allele_length))
    return _imported(rows, reason, contigs, genome_build)


def _pvar_names(header: str) -> list[str]:
    names = header.lstrip("#").rstrip("\n").split("\t")
    if lacks := [c for c in ("CHROM", "POS", "ID", "REF", "ALT") if c not in names]:
        raise ValueError(f"the header lacks {lacks}")
    return names


def parse_pvar(lines: DataFrame, header: str, max_allele_length: int = 150, contigs: str | None = None, genome_build: str = "unknown") -> tuple[VariantObject, DataFrame]:
    """PVAR lines under a header ``#CHROM ...`` by whose names columns are found; a1 is ALT."""
    names = _pvar_names(header)
    at = {c: F.get("f", F.lit(names.index(c))) for c in ("CHROM", "POS", "ID", "REF", "ALT")}
    rows = lines.withColumn("f", F.split("line", "\t")).select(
        "source_shard", "source_index", "ord", at["CHROM"].alias("chrom"), at["POS"].alias("pos"), at["ID"].alias("id"),
        norm_allele(at["ALT"]).alias("a1"), norm_allele(at["REF"]).alias("a2"), F.size("f").alias("width"),
    )
    short = F.col("width") <= max(names.index(c) for c in at)
    reason = F.when(short, "malformed_row").when(F.col("a1").contains(","), "multiallelic").when(_bad_place(), "malformed_row").otherwise(allele_reason(F.col("a1"), F.col("a2"), max_allele_length))
    return _imported(rows, reason, contigs, genome_build)


def read_bim(spark: SparkSession, path: str, genome_build: str = "unknown", contigs: str | None = None, shards: list[str] | None = None, max_allele_length: int = 150) -> tuple[VariantObject, DataFrame]:
    return parse_bim(_sharded(spark, path, shards, lambda _: F.trim("line") != ""), max_allele_length, contigs, genome_build)


def read_bim_ids(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """(source_shard, source_index, id) of every line: an import leaves out the later rows of a key, the BED file has their records."""
    lines = _sharded(spark, path, shards, lambda _: F.trim("line") != "")
    return lines.select("source_shard", "source_index", F.get(F.split(F.trim("line"), r"\s+"), F.lit(1)).alias("id"))


def read_vcf(spark: SparkSession, path: str, genome_build: str = "unknown", contigs: str | None = None, shards: list[str] | None = None, max_allele_length: int = 150) -> tuple[VariantObject, DataFrame]:
    # The samples behind ALT are not needed.
    lines = _sharded(spark, path, shards, lambda _: ~F.col("line").startswith("#") & (F.trim("line") != ""), F.substring_index("line", "\t", 6))
    return parse_vcf(lines, max_allele_length, contigs, genome_build)


def first_line(spark: SparkSession, path: str, keep: Column) -> str:
    """The first line for which ``keep`` holds; of a folder's files the first by name that has one."""
    for file in sorted(spark.read.text(path).inputFiles()):
        row = spark.read.text(file).select(F.col("value").alias("line")).filter(keep).first()
        if row is not None:
            return row.line
    raise ValueError(f"{path} has no header")


def read_pvar(spark: SparkSession, path: str, genome_build: str = "unknown", contigs: str | None = None, shards: list[str] | None = None, max_allele_length: int = 150) -> tuple[VariantObject, DataFrame]:
    """Each shard has its own header; the columns that are needed are put in one order."""
    order = ("CHROM", "POS", "ID", "REF", "ALT")
    found, each = resolve_shards(spark, path, shards), []
    for token, one in found:
        names = _pvar_names(first_line(spark, one, F.col("line").startswith("#CHROM")))
        f = F.split("line", "\t")
        # A line that is too short stays so.
        cut = F.when(F.size(f) > max(names.index(c) for c in order), F.concat_ws("\t", *[F.get(f, F.lit(names.index(c))) for c in order])).otherwise("")
        each.append((token, one, ~F.col("line").startswith("#") & (F.trim("line") != ""), cut))
    return parse_pvar(_in_order(numbered_shards(spark, each), [t for t, _ in found]), "#" + "\t".join(order), max_allele_length, contigs, genome_build)


#: A line up to a comment; quoted cells may hold the sign.
_COMMENT = r'^((?:[^"#]|"[^"]*")*+)#.*$'


def read_sumstats(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, and ``source_index``.

    Lines that are blank or begin with ``##`` or ``# `` are left out. The
    header is the first other line (one ``#`` before it goes if it names several columns); it also tells the
    delimiter: tabs, else commas if there are any, else white space. A later ``#`` begins a comment. Cells may
    be quoted, with delimiters and doubled quotes inside, but not over several lines.
    """
    line = F.col("line")
    blank = (F.trim(line) == "") | line.startswith("##") | line.startswith("# ")
    several = F.size(F.split(F.trim(line), r"[\s,]+")) > 1
    header = first_line(spark, path, ~blank & (~line.startswith("#") | several))
    sep = "\t" if "\t" in header else "," if "," in header else None
    first = header.removeprefix("#")
    names = [x.strip() for x in next(csv.reader([first], delimiter=sep))] if sep else [x.strip('"') for x in first.split()]
    body = numbered(spark, path, ~blank & (line != header) & ~line.startswith("#"))
    body = body.withColumn("line", F.regexp_replace("line", _COMMENT, "$1")).withColumn("quoted", F.col("line").contains('"'))
    if sep:
        cells = F.split("line", sep)
        # Only lines with a quote go through the CSV parser.
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        parsed = F.when(F.col("quoted"), F.from_csv(F.col("line"), F.lit(schema), {"sep": sep, "quote": '"', "escape": '"'}))
        cell = lambda i: F.when(F.col("quoted"), F.coalesce(F.col(f"parsed.c{i}"), F.lit(""))).otherwise(F.get("f", F.lit(i)))
        body = body.withColumn("parsed", parsed)
    else:
        cells = F.when(F.col("quoted"), F.transform(F.expr("regexp_extract_all(line, r'(?:\"[^\"]*\"|[^\\s\"])+', 0)"), lambda x: F.regexp_replace(x, '"', ""))).otherwise(F.split(F.trim("line"), r"\s+"))
        cell = lambda i: F.get("f", F.lit(i))
    return body.withColumn("f", cells).select(*[F.trim(cell(i)).alias(n) for i, n in enumerate(names)], F.col("index").alias("source_index"))


def read_vtable(spark: SparkSession, path: str, genome_build: str = "unknown", contig_naming: str | None = None, check: bool = True) -> VariantObject:
    return _read_object(spark, path, TABLE, genome_build, contig_naming, check)


def read_vmap(spark: SparkSession, path: str, genome_build: str = "unknown", contig_naming: str | None = None, check: bool = True, check_duplicates: bool = True) -> VariantObject:
    return _read_object(spark, path, (*TABLE, *PROVENANCE), genome_build, contig_naming, check, check_duplicates)


def _read_object(spark: SparkSession, path: str, names: tuple[str, ...], genome_build: str, contig_naming: str | None, check: bool, check_duplicates: bool = True) -> VariantObject:
    rows = numbered(spark, path, F.trim("line") != "").withColumn("f", F.split("line", "\t"))
    wrong = rows.filter(F.size("f") != len(names)).first()
    if wrong is not None:
        raise ValueError(f"{path}: row {wrong['index']} has {len(wrong.f)} columns, not {len(names)}")
    col = {n: F.get("f", F.lit(i)) for i, n in enumerate(names)}
    col |= {"pos": parse_pos(col["pos"]), "a1": norm_allele(col["a1"]), "a2": norm_allele(col["a2"])}
    if "source_index" in col:
        col["source_index"] = F.when(col["source_index"].rlike(r"^[+-]?[0-9]+$"), col["source_index"].try_cast("bigint"))
    vo = VariantObject(rows.select(*[c.alias(n) for n, c in col.items()], F.col("index").alias("ord")), genome_build, contig_naming)
    return validate(vo, check_duplicates) if check else vo


def read_samples(spark: SparkSession, path: str, shard: str = ".", mode: str = "fid_iid") -> DataFrame:
    """(source_shard, local_idx, fid, iid, sex, rest, header) of a FAM file, or of a PSAM file with a header.

    ``rest`` is what a FAM line says behind the IID, or the whole line of a PSAM file, whose header line is ``header``
    (null for FAM): for comparing shards and for writing the sample again.
    """
    return read_sample_shards(spark, [(shard, path)], mode)


def read_sample_shards(spark: SparkSession, shards: list[tuple[str, str]], mode: str = "fid_iid") -> DataFrame:
    """``read_samples`` for the file of each shard (token, path), all in one pass. A shard without samples is an error."""
    line = F.col("line")
    full = (F.trim(line) != "") & ~line.startswith("##")
    lines = materialize(numbered_shards(spark, [(t, p, full, None) for t, p in shards]))
    heads = {r["shard"]: r.header for r in lines.filter(line.startswith("#")).groupBy("shard").agg(F.min_by("line", "index").alias("header")).collect()}  # a row for each shard
    fam = ["FID", "IID", "father", "mother", "SEX", "pheno"]
    layout = []
    for t, _ in shards:
        names = heads[t].lstrip("#").split() if t in heads else fam
        if "IID" not in names:
            raise ValueError(f"the header of shard {t} has no IID")
        layout.append((t, heads.get(t), len(names), *[names.index(c) if c in names else None for c in ("FID", "IID", "SEX")]))
    layout = spark.createDataFrame(layout, "shard string, header string, width int, fid_at int, iid_at int, sex_at int")
    rows = lines.filter(~line.startswith("#")).withColumn("f", F.split(F.trim("line"), r"\s+")).join(F.broadcast(layout), "shard")
    if (bad := rows.filter(F.size("f") < F.col("width")).first()) is not None:
        raise ValueError(f"a sample of shard {bad['shard']} has fewer than {bad['width']} fields")
    at = lambda c: F.get("f", F.col(c))
    rest = F.when(F.col("header").isNotNull(), F.col("line")).otherwise(F.concat_ws("\t", *[F.get("f", F.lit(i)) for i in (2, 3, 4, 5)]))
    out = rows.select(
        F.col("shard").alias("source_shard"), (F.col("index") - F.when(F.col("header").isNotNull(), 1).otherwise(0)).cast("int").alias("local_idx"), F.coalesce(at("fid_at"), F.lit("0")).alias("fid"), at("iid_at").alias("iid"),
        F.coalesce(norm_sex(at("sex_at")), F.lit(0)).alias("sex"), rest.alias("rest"), "header",
    )
    out = materialize(out)
    have = {r[0] for r in out.select("source_shard").distinct().collect()}
    if lost := [t for t, _ in shards if t not in have]:
        raise ValueError(f"shard {lost[0]} has no samples")
    return check_samples(out, mode)


def under_headers(rows: DataFrame, head: Column, fields: dict[str, Column], block: int = 4096) -> DataFrame:
    """``rows`` (with ``index``) and the ``fields`` of the last row up to each for which ``head`` holds.

    Within blocks of rows by a window of each block; the last header before a
    block comes from a table with a row for each block.
    """
    own = F.when(head, F.struct(F.col("index").alias("start"), *[v.alias(k) for k, v in fields.items()]))
    marked = rows.withColumn("__own", own).withColumn("__block", F.floor(F.col("index") / block))
    last = marked.groupBy("__block").agg(F.max("__own").alias("__last"))
    upto = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("__block", F.last("__last", ignorenulls=True).over(upto).alias("__before"))
    inside = Window.partitionBy("__block").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marked.withColumn("__in", F.last("__own", ignorenulls=True).over(inside)).join(F.broadcast(before), "__block")
    found = found.withColumn("__head", F.coalesce("__in", "__before"))
    return found.select(*rows.columns, *[F.col(f"__head.{k}").alias(k) for k in ("start", *fields)])


#: Bytes of a FASTA file that a task reads at once, and the longest header.
FASTA_RANGE, FASTA_HEADER = 1 << 24, 1 << 16
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_BASE = np.ones(256, dtype=bool)
_BASE[[9, 10, 11, 12, 13, 32]] = False


def _fasta_stretches(path: str, first: int, size: int, end: int) -> list[tuple[int, str | None, np.ndarray]]:
    """(place of the header, its name, bases) of each stretch of a sequence in ``size`` bytes from ``first`` on; place -1 and no name for the one that goes on from before."""
    with open_input(path) as f:
        low = max(0, first - FASTA_HEADER)
        f.seek(low)
        data = np.frombuffer(f.read(min(end, first + size + FASTA_HEADER) - low), np.uint8)
    lines = np.flatnonzero(data == 10) + 1
    begins = np.concatenate(([0], lines)) if low == 0 else lines
    begins = begins[begins < len(data)]
    heads = begins[data[begins] == 62]
    ends = np.append(lines, len(data))[np.searchsorted(lines, heads + 1)] if len(heads) else heads
    at, stop = first - low, min(first - low + size, len(data))
    base = _BASE[data]
    for a, b in zip(heads, ends, strict=True):
        if b == len(data) and low + b < end:
            raise ValueError(f"{path}: a header of over {FASTA_HEADER} bytes")
        base[a:b] = False
    here = [(int(a), int(b)) for a, b in zip(heads, ends, strict=True) if at <= a < stop]
    bounds = [at, *[a for a, _ in here], stop]
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        text = data[here[i - 1][0] + 1 : here[i - 1][1]].tobytes().decode(errors="replace").split() if i else []
        out.append((low + a if i else -1, (text or [""])[0] if i else None, _UPPER[data[a:b][base[a:b]]]))
    return out


def read_fasta(spark: SparkSession, path: str, size: int = 256, step: int = FASTA_RANGE) -> DataFrame:
    """(contig, block, seq): upper-case blocks of a FASTA file, contigs by their canonical name where they have one.

    The file is read by ranges of ``step`` bytes, so it does not matter how long its lines are: the first pass counts the
    bases of each sequence in each range, the second one knows where these stand and cuts
    blocks. Only blocks that reach over two ranges are put together by a shuffle.
    """
    from varloom.functions.contigs import normalize_label

    if path.endswith((".gz", ".bz2")):
        return read_fasta_lines(spark, path, size)
    system, name = file_system(path)
    end = system.get_file_info(name).size or 0
    ranges = spark.range(0, max(end, 1), step).repartition(max(1, min(-(-end // step), 8 * spark.sparkContext.defaultParallelism)), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                found = _fasta_stretches(path, first, step, end)
                cols = [[first] * len(found), range(len(found)), [x[0] for x in found], [x[1] for x in found], [len(x[2]) for x in found]]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["range", "nth", "head", "name", "bases"])

    counted = materialize(ranges.mapInArrow(count, "range long, nth int, head long, name string, bases long"))
    # The sequence that goes on into a range is that of the last header before it: a row for each range.
    last = counted.groupBy("range").agg(F.max(F.when(F.col("head") >= 0, F.struct("head", "name"))).alias("last"))
    before = last.select("range", F.last("last", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    named = counted.join(F.broadcast(before), "range").select("range", "nth", "bases", F.when(F.col("nth") > 0, F.struct("head", "name")).otherwise(F.col("before")).alias("seq")).filter("seq is not null")
    upto = Window.partitionBy("seq.head").orderBy("range", "nth").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a sequence
    placed = named.withColumn("at", F.coalesce(F.sum("bases").over(upto), F.lit(0)))
    work = placed.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("seq.name").alias("name"), "at"))).alias("stretches"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stretches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _fasta_stretches(path, first, step, end)
                for x in stretches:
                    bases, at = found[x["nth"]][2], int(x["at"])
                    edges = np.unique(np.concatenate(([at], np.arange(-(-at // size) * size, at + len(bases), size), [at + len(bases)])))
                    text = bases.tobytes().decode()
                    low, high = edges[:-1], edges[1:]
                    piece = [text[a - at : b - at] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                    cols = [pa.array([x["name"]] * len(low), pa.string()), pa.array(low // size), pa.array(low), pa.array(piece, pa.string()), pa.array(high - low == size)]
                    yield pa.RecordBatch.from_arrays(cols, names=["name", "block", "low", "piece", "whole"])

    pieces = materialize(work.select("range", "stretches").repartition("range").mapInArrow(cut, "name string, block long, low long, piece string, whole boolean"))
    joined = pieces.filter("not whole").groupBy("name", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "piece"))), lambda x: x["piece"]), "").alias("seq"))
    every = pieces.filter("whole").select("name", "block", F.col("piece").alias("seq")).union(joined.select("name", "block", "seq"))
    return every.filter("seq <> ''").select(F.coalesce(normalize_label(F.col("name")), F.col("name")).alias("contig"), "block", "seq")


def read_fasta_lines(spark: SparkSession, path: str, size: int = 256) -> DataFrame:
    """``read_fasta`` by lines, for what only Spark can open, such as compressed files; a line is read whole.

    Each line is placed by the lengths of the lines before it in its
    sequence, cut at block boundaries, and pieces of a block are put together.
    """
    from varloom.functions.contigs import normalize_label

    rows = numbered(spark, path)
    head = F.col("line").startswith(">")
    placed = under_headers(rows, head, {"name": F.regexp_extract("line", r"^>\s*(\S+)", 1)})
    placed = placed.filter(~head & F.col("name").isNotNull()).select("index", "name", F.upper(F.trim("line")).alias("s"))
    # Offsets in two steps, so that no task sees a whole sequence.
    part = F.floor(F.col("index") / 4096)
    sums = placed.groupBy("name", part.alias("part")).agg(F.sum(F.length("s")).alias("n"))
    sums = sums.select("name", "part", F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum(F.length("s")).over(Window.partitionBy("name", "part").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = placed.withColumn("part", part).withColumn("inner", inner).join(sums, ["name", "part"]).withColumn("at", F.col("base") + F.col("inner")).filter("s <> ''")
    blocks = F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.length("s") - 1) / size))
    cut = at.select("name", "at", "s", F.explode(blocks).alias("block"))
    low, high = F.greatest(F.col("at"), F.col("block") * size), F.least(F.col("at") + F.length("s"), (F.col("block") + 1) * size)
    pieces = cut.select("name", "block", low.alias("low"), F.substr("s", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    joined = pieces.groupBy("name", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "piece"))), lambda x: x["piece"]), "").alias("seq"))
    return joined.select(F.coalesce(normalize_label(F.col("name")), F.col("name")).alias("contig"), "block", "seq")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a UCSC chain file, contigs by their canonical name: positions of the target are those of its plus strand."""
    from varloom.functions.contigs import normalize_label

    rows = numbered(spark, path, (F.trim("line") != "") & ~F.col("line").startswith("#")).withColumn("f", F.split(F.trim("line"), r"\s+"))
    g = lambda i: F.get("f", F.lit(i))
    head = g(0) == "chain"
    fields = {
        "score": g(1).try_cast("double"), "src": g(2), "s0": g(5).try_cast("long"), "tgt": g(7),
        "t_size": g(8).try_cast("long"), "strand": g(9), "t0": g(10).try_cast("long"), "chain_id": g(12).try_cast("long"),
    }
    placed = under_headers(rows, head, fields).filter(~head & F.col("start").isNotNull())
    placed = placed.withColumns({"size": g(0).cast("long"), "ds": F.coalesce(g(1).cast("long"), F.lit(0)), "dt": F.coalesce(g(2).cast("long"), F.lit(0))})
    past = Window.partitionBy("start").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda gap: F.coalesce(F.sum(F.col("size") + F.col(gap)).over(past), F.lit(0))
    placed = placed.withColumns({"s_start": F.col("s0") + before("ds"), "t_run": F.col("t0") + before("dt")})
    t_start = F.when(F.col("strand") == "-", F.col("t_size") - F.col("t_run") - F.col("size")).otherwise(F.col("t_run"))
    name = lambda c: F.coalesce(normalize_label(F.col(c)), F.col(c))
    return placed.select(name("src").alias("src_contig"), "s_start", (F.col("s_start") + F.col("size")).alias("s_end"), name("tgt").alias("tgt_contig"), t_start.alias("t_start"), "strand", "chain_id", "score")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, name in it) of a path of any kind that Arrow knows."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def open_input(path: str):
    system, name = file_system(path)
    return system.open_input_file(name)


MAGIC = bytes([0x6C, 0x1B, 0x01])


def read_bed(spark: SparkSession, path: str, n_samples: int, n_variants: int, shard: str = ".", rows_per_piece: int = 4096) -> DataFrame:
    """(source_shard, source_index, geno): codes of a PLINK BED file, SNP-major.

    The size and the magic bytes are checked; then every task seeks its own
    ranges of records and reads these alone, so a file may be of any size.
    """
    width = -(-n_samples // 4)
    info = spark.read.format("binaryFile").load(path).select("length").first()
    if info is None or info.length != 3 + width * n_variants:
        raise ValueError(f"{path}: the size does not fit {n_variants} variants of {n_samples} samples")
    with open_input(path) as f:
        if f.read(3) != MAGIC:
            raise ValueError(f"{path}: not a SNP-major BED file")
    shifts = np.arange(4, dtype=np.uint8) * 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            with open_input(path) as f:
                for first in frame["id"]:
                    f.seek(3 + first * width)
                    part = np.frombuffer(f.read(min(rows_per_piece, n_variants - first) * width), np.uint8).reshape(-1, width)
                    codes = ((part[:, :, None] >> shifts) & 3).reshape(len(part), -1)[:, :n_samples].astype(np.int8)
                    yield pd.DataFrame({"source_index": np.arange(first, first + len(part)), "geno": list(codes)})

    ranges = spark.range(0, n_variants, rows_per_piece)
    pieces = ranges.repartition(max(1, min(-(-n_variants // rows_per_piece), 8 * spark.sparkContext.defaultParallelism)), "id").mapInPandas(run, "source_index long, geno array<tinyint>").hint("merge")  # by its plan the table has the size of the ranges
    return pieces.select(F.lit(shard).alias("source_shard"), "source_index", "geno")


def read_genotype_arrays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("source_shard", "source_index", "allele_ct", "alleles", "phase", "dosage")

