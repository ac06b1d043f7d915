"""PLINK file sets: genotypes read by key, rewritten on packed bytes, and written where their row stands.

A projection moves keys only. The rows of a vmap are ranged by their place in the
output; a task takes its range, reads the records that it needs from the shards' BED
files (neighbouring ones in one read), turns and places their bytes and writes
them. No genotype is shuffled.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import packed
from varloom.functions.alleles import is_swap, variant_id
from varloom.functions.ploidy import join_ploidy
from varloom.model import VariantObject
from varloom.operators import genotypes as G
from varloom.scratch import materialize
from varloom.sources.readers import MAGIC, file_system, read_sample_shards, resolve_shards

#: Records that are no more than so many bytes apart are read in one piece, and so many bytes are worked on at once.
GAP, PIECE = 1 << 16, 1 << 23
SUFFIXES = (".bim", ".bed", ".fam")


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the parts of a folder in the order of their names; [] if there is nothing."""
    system, name = file_system(path)
    info = system.get_file_info(name)
    scheme = path[: len(path) - len(name)] if path.endswith(name) else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type != fs.FileType.Directory:
        return []
    parts = [x for x in system.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.base_name[0] not in "_."]
    return [(scheme + x.path, x.size) for x in sorted(parts, key=lambda x: x.base_name)]


@dataclass(frozen=True)
class Bed:
    """The records of a SNP-major BED file, or of a folder whose parts put together are one."""

    parts: tuple[tuple[str, int], ...]
    n_samples: int
    n_variants: int

    @property
    def width(self) -> int:
        return packed.width(self.n_samples)

    def check(self) -> Bed:
        size = sum(n for _, n in self.parts)
        if size != 3 + self.width * self.n_variants:
            raise ValueError(f"{self.parts[0][0] if self.parts else 'BED'}: the size does not fit {self.n_variants} variants of {self.n_samples} samples")
        if Reader(self).bytes(0, 3) != MAGIC:
            raise ValueError(f"{self.parts[0][0]}: not a SNP-major BED file")
        return self


class Reader:
    """Reads stretches of a ``Bed``; keeps one part open."""

    def __init__(self, bed: Bed):
        self.bed, self.open, self.at = bed, None, -1
        self.begins = np.concatenate(([0], np.cumsum([n for _, n in bed.parts]))).tolist()

    def bytes(self, first: int, n: int) -> bytes:
        out = []
        while n:
            i = bisect_right(self.begins, first) - 1
            if i != self.at:
                self.close()
                system, name = file_system(self.bed.parts[i][0])
                self.open, self.at = system.open_input_file(name), i
            take = min(n, self.begins[i + 1] - first)
            out.append(self.open.read_at(take, first - self.begins[i]))
            first, n = first + take, n - take
        return b"".join(out)

    def records(self, index: np.ndarray) -> np.ndarray:
        """A row for each of these records, which may repeat and be in any order."""
        width = self.bed.width
        need, back = np.unique(index, return_inverse=True)
        block = np.empty((len(need), width), np.uint8)
        cut = np.flatnonzero(np.diff(need) * width > GAP) + 1
        for a, b in zip([0, *cut], [*cut, len(need)], strict=True):
            # A piece has its records and the gaps between them.
            low, high = int(need[a]), int(need[b - 1]) + 1
            step = max(1, PIECE // max(1, width))
            for first in range(low, high, step):
                last = min(high, first + step)
                here = slice(*np.searchsorted(need[a:b], [first, last]) + a)
                if here.start < here.stop:
                    got = np.frombuffer(self.bytes(3 + first * width, (last - first) * width), np.uint8).reshape(-1, width)
                    block[here] = got[need[here] - first]
        return block[back]

    def close(self) -> None:
        if self.open is not None:
            self.open.close()
        self.open, self.at = None, -1


@dataclass(frozen=True)
class Bfiles:
    """Shards of PLINK file sets by token, and the samples of all (see ``read_sample_shards``)."""

    shards: dict[str, Bed]
    samples: DataFrame


def open_bfiles(spark: SparkSession, prefix: str, shards: list[str] | None = None, mode: str = "fid_iid") -> Bfiles:
    """The file set of a prefix, or of each shard of a prefix with "@". Each needs its BIM, BED and FAM, and a BED of the size that these tell."""
    if "@" in prefix:
        found = {s: [t for t, _ in _found(spark, prefix + s, shards)] for s in SUFFIXES}
        tokens = found[".bim"]
        for s, have in found.items():
            if lost := (set(have) ^ set(tokens)):
                raise ValueError(f"shard {min(lost)} is not complete: a {s} or .bim file is missing")
        if not tokens:
            raise ValueError(f"no shards of {prefix}")
    else:
        tokens = ["."]
    at = {t: prefix.replace("@", t) if t != "." else prefix for t in tokens}
    lines = None
    for t, one in at.items():
        part = spark.read.text(f"{one}.bim").filter(F.trim("value") != "").select(F.lit(t).alias("source_shard"))
        lines = part if lines is None else lines.union(part)
    variants = {r.source_shard: r["count"] for r in lines.groupBy("source_shard").count().collect()}
    samples = read_sample_shards(spark, [(t, f"{one}.fam") for t, one in at.items()], mode)
    sizes = {r.source_shard: r["count"] for r in samples.groupBy("source_shard").count().collect()}
    beds = {}
    for t, one in at.items():
        if not variants.get(t):
            raise ValueError(f"{one}.bim has no variant")
        beds[t] = Bed(tuple(listed(f"{one}.bed")), sizes[t], variants[t]).check()
    return Bfiles(beds, samples)


def _found(spark: SparkSession, template: str, shards: list[str] | None) -> list[tuple[str, str]]:
    try:
        return resolve_shards(spark, template, shards)
    except ValueError:
        if shards is not None:
            raise
        return []


def read_records(spark: SparkSession, bfiles: Bfiles) -> DataFrame:
    """(source_shard, source_index, n_samples, bed): all records as packed bytes, each range of them read by one task."""
    beds, step = bfiles.shards, {t: max(1, PIECE // max(1, b.width)) for t, b in bfiles.shards.items()}
    ranges = None
    for t, b in beds.items():
        part = spark.range(0, b.n_variants, step[t]).select(F.lit(t).alias("shard"), F.col("id").alias("first"))
        ranges = part if ranges is None else ranges.union(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bed, reader = beds[shard], Reader(beds[shard])
                index = np.arange(first, min(bed.n_variants, first + step[shard]))
                block = reader.records(index)
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(index)), pa.array(index), pa.array(np.full(len(index), bed.n_samples)), _binary(block)], names=["source_shard", "source_index", "n_samples", "bed"])

    # The plan takes the size of the ranges for that of the records, so a join would broadcast them.
    return ranges.repartition("shard", "first").mapInArrow(run, "source_shard string, source_index long, n_samples long, bed binary").hint("merge")


def _binary(block: np.ndarray) -> pa.Array:
    rows, size = block.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * size
    return pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(block))])


@dataclass
class Axis:
    """The samples of one output group: their sexes, and for each shard the places of their genotypes."""

    sexes: np.ndarray
    gathers: dict[str, packed.Gather] = field(default_factory=dict)

    def __post_init__(self):
        self.n = len(self.sexes)
        self.missing = packed.missing_row(self.n)


class Rewriter:
    """Rows of keys to blocks of output bytes."""

    def __init__(self, beds: dict[str, Bed], axes: dict[str, Axis], check: bool):
        self.beds, self.axes, self.check = beds, axes, check
        self.readers = {t: Reader(b) for t, b in beds.items()}

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, str, np.ndarray, np.ndarray]]:
        """(first row, row behind the last, group, records, issues) of a batch in order; issues: three counts for each row."""
        col = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n in ("group", "source_shard", "source_index", "swap", "male", "female")}
        group = col["group"]
        n_rows, first = batch.num_rows, 0
        while first < n_rows:
            axis = self.axes[group[first]]
            widest = max([axis.n, *(b.n_samples for b in self.beds.values())])
            last = min(n_rows, first + max(1, PIECE // max(1, widest)))
            other = np.flatnonzero(group[first:last] != group[first])
            last = first + int(other[0]) if len(other) else last
            here = {n: c[first:last] for n, c in col.items()}
            out = np.tile(axis.missing, (last - first, 1))
            mapped = here["source_index"] != -1
            for shard in sorted(set(here["source_shard"][mapped])):
                rows = np.flatnonzero(mapped & (here["source_shard"] == shard))
                block = self.readers[shard].records(here["source_index"][rows])
                turned = here["swap"][rows].astype(bool)
                block[turned] = packed.SWAPPED[block[turned]]
                out[rows] = axis.gathers[shard](block)
            issues = np.zeros((last - first, 3), np.int64)
            if self.check:
                for male, female in set(zip(here["male"].tolist(), here["female"].tolist(), strict=True)) - {(2, 2)}:
                    rows = np.flatnonzero((here["male"] == male) & (here["female"] == female))
                    het, there, unknown = packed.ploidy_issues(out[rows], axis.sexes, male, female)
                    issues[rows] = np.stack((het, there, np.full(len(rows), unknown)), axis=1)
            yield first, last, group[first], out, issues
            first = last

    def close(self) -> None:
        for r in self.readers.values():
            r.close()


ISSUES = ("haploid_het_incompatible", "absent_nonmissing", "unknown_sex")


@dataclass(frozen=True)
class BfileProjection:
    """A projection that has not run. ``keys``: (ord, group, chrom, id, pos, a1, a2, source_shard, source_index, swap, male, female), narrow."""

    keys: DataFrame
    beds: dict[str, Bed]
    axes: dict[str, Axis]
    #: (group, out_idx, fid, iid, sex and what else a sample's line says)
    samples: DataFrame
    summary: DataFrame
    check: bool
    groups: tuple[str, ...]

    def _placed(self) -> DataFrame:
        """By group and place, in ranges."""
        return self.keys.repartitionByRange("first", "ord").sortWithinPartitions("first", "ord").drop("first")

    def records(self) -> DataFrame:
        """(ord, group, bed) and three counts of ploidy issues, in ranges of places."""
        beds, axes, check = self.beds, self.axes, self.check

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = Rewriter(beds, axes, check)
            for batch in batches:
                for a, b, _, block, issues in work.blocks(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), _binary(block), *[pa.array(issues[:, i]) for i in range(3)]], names=["ord", "group", "bed", *ISSUES])
            work.close()

        return self._placed().mapInArrow(run, "ord long, group string, bed binary, " + ", ".join(f"{c} long" for c in ISSUES)).hint("merge")

    def write(self, prefix: str) -> BfileFiles:
        """BIM, BED, FAM and, where a row is not (2, 2), PLOIDY: a set for each group if ``prefix`` has "@", all in one pass.

        BIM, BED and PLOIDY are folders of parts whose names give their order; a
        task writes its parts under names of its attempt and renames them, so a task that runs again
        leaves the same. FAM is a file.
        """
        beds, axes, check = self.beds, self.axes, self.check
        at = {g: prefix.replace("@", g) for g in self.groups}
        for g, one in at.items():
            for s in (".bim", ".bed", ".ploidy"):
                system, folder = file_system(one + s)
                if system.get_file_info(folder).type != fs.FileType.NotFound:
                    system.delete_dir_contents(folder)
            system, folder = file_system(f"{one}.bed")
            system.create_dir(folder)
            with system.open_output_stream(f"{folder}/part-000000") as f:
                f.write(MAGIC)
            system.create_dir(file_system(f"{one}.bim")[1])
        uneven = {r[0] for r in self.keys.filter("male <> 2 or female <> 2").select("group").distinct().collect()}
        for g in uneven:
            system, folder = file_system(f"{at[g]}.ploidy")
            system.create_dir(folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work, name = Rewriter(beds, axes, check), f"part-{TaskContext.get().partitionId() + 1:06d}"
            current, files, records = None, {}, 0

            def begin(group: str) -> None:
                for s in (".bim", ".bed", *([".ploidy"] if group in uneven else [])):
                    system, folder = file_system(at[group] + s)
                    attempt = f"{folder}/_{name}.{uuid.uuid4().hex}"
                    files[s] = (system, system.open_output_stream(attempt), attempt, f"{folder}/{name}")

            def end() -> None:
                for system, stream, attempt, to in files.values():
                    stream.close()
                    system.move(attempt, to)
                files.clear()

            for batch in batches:
                text = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("chrom", "id", "pos", "a1", "a2", "male", "female")]
                for a, b, group, block, issues in work.blocks(batch):
                    if group != current:
                        end()
                        begin(group)
                        current = group
                    files[".bed"][1].write(np.ascontiguousarray(block))
                    files[".bim"][1].write("".join(f"{c}\t{i}\t0\t{p}\t{x}\t{y}\n" for c, i, p, x, y in zip(*(t[a:b] for t in text[:5]), strict=True)).encode())
                    if ".ploidy" in files:
                        files[".ploidy"][1].write("".join(f"{m}\t{f}\n" for m, f in zip(text[5][a:b], text[6][a:b], strict=True)).encode())
                    records += b - a
                    some = np.flatnonzero(issues.any(axis=1))
                    take = pa.array(some + a)
                    cols = [batch.column(batch.schema.get_field_index(c)).take(take) for c in ("source_shard", "source_index", "id")]
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.array(issues[some, i]) for i in range(3)], pa.array(np.zeros(len(some), np.int64))], names=["source_shard", "source_index", "id", *ISSUES, "records"])
            end()
            work.close()
            none = [pa.array([None], t) for t in (pa.string(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*none, *[pa.array([0])] * 3, pa.array([records])], names=["source_shard", "source_index", "id", *ISSUES, "records"])

        said = materialize(self._placed().mapInArrow(run, "source_shard string, source_index long, id string, " + ", ".join(f"{c} long" for c in ISSUES) + ", records long"))
        self._write_fams(at)
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("status"), F.col(c).alias("n_affected")) for c in ISSUES[:2]]))
        qc = said.filter("records = 0").select("source_shard", "source_index", "id", each.alias("x")).select("source_shard", "source_index", "id", "x.*").filter("n_affected > 0")
        return BfileFiles(said.agg(F.sum("records")).first()[0] or 0, at, qc, said.agg(F.coalesce(F.sum("unknown_sex"), F.lit(0)).alias("unknown_sex")))

    def _write_fams(self, at: dict[str, str]) -> None:
        line = G.fam_line(self.samples)
        groups = self.samples.sparkSession.createDataFrame([(g,) for g in at], "out string")
        # A group of its own, or the one axis for every group; groups are contigs.
        on = F.col("group").isNull() | (F.col("group") == F.col("out"))
        lines = self.samples.select("group", "out_idx", line.alias("line")).join(F.broadcast(groups), on)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current, stream, move, n = None, None, None, 0
            for frame in frames:
                for out, line in zip(frame["out"], frame["line"], strict=True):
                    if out != current:
                        if stream is not None:
                            stream.close()
                            move()
                        system, name = file_system(f"{at[out]}.fam")
                        attempt = f"{name}._{uuid.uuid4().hex}"
                        stream, move, current = system.open_output_stream(attempt), (lambda s=system, a=attempt, b=name: s.move(a, b)), out
                    stream.write(f"{line}\n".encode())
                    n += 1
            if stream is not None:
                stream.close()
                move()
            yield pd.DataFrame({"n": [n]})

        lines.repartition("out").sortWithinPartitions("out", "out_idx").select("out", "line").mapInPandas(run, "n long").agg(F.sum("n")).first()


@dataclass(frozen=True)
class BfileFiles:
    records: int
    #: The prefix of each group.
    prefixes: dict[str, str]
    qc: DataFrame
    unvalidated: DataFrame


def project_bfiles(
    vmap: VariantObject,
    bfiles: Bfiles,
    target_samples: DataFrame | None = None,
    axis: str = "shared",
    by_contig: bool = False,
    sample_id_mode: str = "fid_iid",
    only_mapped: bool = False,
    retain_id: bool = False,
    check_ploidy: bool = True,
) -> BfileProjection:
    """``apply_to_bfile`` for genotypes in BED files: the rows of a vmap, their records found by key when the projection is read or written.

    Only the shards that rows refer to count for the sample axis. A reference to a
    shard or record that is not there is an error.
    """
    vmap = G.checked(vmap, only_mapped)
    used = vmap.df.filter("source_index <> -1").groupBy("source_shard").agg(F.max("source_index").alias("last")).collect()  # a row for each shard
    for r in used:
        if r.source_shard not in bfiles.shards:
            raise ValueError(f"no shard {r.source_shard}")
        if r["last"] >= bfiles.shards[r.source_shard].n_variants:
            raise ValueError(f"shard {r.source_shard} has no variant {r['last']}")
    shards = {r.source_shard: bfiles.shards[r.source_shard] for r in used}
    samples = G.referenced(vmap, bfiles.samples)
    group = F.col("chrom") if by_contig else F.lit(".")
    groups = [r[0] for r in vmap.df.select(group.alias("g"), "ord").groupBy("g").agg(F.min("ord").alias("first")).orderBy("first").collect()]  # a row for each contig
    if axis not in G.AXES:
        raise ValueError(f"the sample axis must be one of {G.AXES}")
    if axis == "native":
        if target_samples is not None:
            raise ValueError("a native axis takes no target samples")
        out = materialize(G.native_axes(vmap, samples, group))
        axes = {g: Axis(np.array(sexes)) for g, sexes in _by_group(out, "group")}
        for a in axes.values():
            a.gathers = {t: packed.Gather(np.arange(b.n_samples), b.n_samples) for t, b in shards.items() if b.n_samples == a.n}
        maps = None
    else:
        out = materialize(G.sample_axis(samples, target_samples, sample_id_mode, axis == "union"))
        maps = materialize(G.axis_maps(samples, out, sample_id_mode))
        one = Axis(np.array([s for _, s in sorted((r.out_idx, r.sex) for r in out.select("out_idx", "sex").collect())]))  # the cohort's samples
        for r in maps.collect():
            one.gathers[r.source_shard] = packed.Gather(np.array([-1 if i is None else i for i in r.local_of]), shards[r.source_shard].n_samples)
        axes = dict.fromkeys(groups, one)
        out = out.withColumn("group", F.lit(None).cast("string"))
    summary = G.reconciliation(vmap, maps if maps is not None else samples.select("source_shard", F.lit(0).cast("long").alias("n_absent")).distinct())
    ident = F.col("id") if retain_id else variant_id(F.col("chrom"), F.col("pos"), F.col("a1"), F.col("a2"))
    order = F.array_position(F.array(*[F.lit(g) for g in groups]), group)
    keys = join_ploidy(vmap.df, vmap.genome_build).select(F.col("ord").cast("long").alias("ord"), group.alias("group"), "chrom", ident.alias("id"), "pos", "a1", "a2", "source_shard", F.col("source_index").cast("long").alias("source_index"), is_swap(F.col("allele_op")).alias("swap"), "male", "female", order.alias("first"))
    return BfileProjection(materialize(keys), shards, axes, out, summary, check_ploidy, tuple(groups))


def _by_group(axis: DataFrame, name: str) -> list[tuple[str, list[int]]]:
    listed_ = F.transform(F.array_sort(F.collect_list(F.struct("out_idx", "sex"))), lambda x: x["sex"])
    return [(r[0], r[1]) for r in axis.groupBy(name).agg(listed_.alias("sexes")).collect()]  # the cohort of each contig


def write_text(lines: DataFrame, path: str) -> None:
    """The few lines of a table with a single string column as one file, by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, name = file_system(path)
        attempt = f"{name}._{uuid.uuid4().hex}"
        n = 0
        with system.open_output_stream(attempt) as f:
            for frame in frames:
                for line in frame.iloc[:, 0]:
                    f.write(f"{line}\n".encode())
                    n += 1
        system.move(attempt, name)
        yield pd.DataFrame({"n": [n]})

    lines.coalesce(1).mapInPandas(run, "n long").agg(F.sum("n")).first()
