"""PLINK file sets by key, packed genotypes, sample lines, FASTA by ranges, quoted cells, closed-form alignment, liftover of indels."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import genotypes as G
from varloom.functions import packed
from varloom.jobs.workflows import prepare_sharded_files
from varloom.model import VariantObject
from varloom.operators import genotypes as OG
from varloom.operators import reference as R
from varloom.operators import sumstats as S
from varloom.sources import plink, readers, writers

VMAP = "chrom string, pos long, id string, a1 string, a2 string, source_shard string, source_index long, allele_op string, ord long"


def write_set(folder, token, codes, samples, contig="1"):
    """``codes``: a list of rows; ``samples``: FAM lines."""
    (folder / f"in{token}.bim").write_text("".join(f"{contig} v{i} 0 {i + 1} A C\n" for i in range(len(codes))))
    (folder / f"in{token}.fam").write_text("".join(f"{s}\n" for s in samples))
    block = packed.pack(np.array(codes, np.uint8))
    (folder / f"in{token}.bed").write_bytes(readers.MAGIC + block.tobytes())


def read_set(prefix, n):
    data = b"".join(p.read_bytes() for p in sorted(prefix.parent.joinpath(prefix.name + ".bed").glob("part-*")))
    assert data[:3] == readers.MAGIC
    width = packed.width(n)
    block = np.frombuffer(data[3:], np.uint8).reshape(-1, width)
    text = lambda s: "".join(p.read_text() for p in sorted(prefix.parent.joinpath(prefix.name + s).glob("part-*")))
    return packed.unpack(block, n).tolist(), text(".bim").splitlines(), prefix.parent.joinpath(prefix.name + ".fam").read_text().splitlines()


def test_packed_rows_equal_codes(spark):
    rng = random.Random(5)
    cases = [[rng.randrange(4) for _ in range(n)] for n in (1, 2, 3, 4, 5, 7, 31, 64) for _ in range(3)]
    local = [[rng.choice([-1, *range(len(c))]) for _ in range(rng.randrange(1, 9))] for c in cases]
    df = spark.createDataFrame([(i, c, [None if x < 0 else x for x in m]) for i, (c, m) in enumerate(zip(cases, local))], "i int, c array<tinyint>, m array<int>")
    want = df.select("i", G.swap_codes(F.col("c")).alias("s"), G.remap(F.col("c"), F.col("m"), F.lit(G.MISSING).cast("tinyint")).alias("r")).orderBy("i").collect()
    for (c, m), w in zip(zip(cases, local), want):
        block = packed.pack(np.array([c], np.uint8))
        assert packed.unpack(block, len(c))[0].tolist() == c
        assert packed.unpack(packed.swap(block, len(c)), len(c))[0].tolist() == w.s
        moved = packed.Gather(np.array(m), len(c))(block.copy())
        assert packed.unpack(moved, len(m))[0].tolist() == w.r
        # What stands behind the last sample is 0.
        assert packed.unpack(packed.swap(block, len(c)), 4 * packed.width(len(c)))[0, len(c):].tolist() == [0] * (-len(c) % 4)
    assert packed.unpack(packed.missing_row(5)[None], 8)[0].tolist() == [1] * 5 + [0] * 3


def test_ploidy_counts_equal_those_of_arrays(spark):
    rng = random.Random(6)
    sexes = [rng.choice([0, 1, 2]) for _ in range(13)]
    codes = [[rng.randrange(4) for _ in sexes] for _ in range(6)]
    for male, female in ((1, 2), (1, 0), (1, 1), (0, 2)):
        df = spark.createDataFrame([(i, c, sexes, male, female) for i, c in enumerate(codes)], "i int, c array<tinyint>, s array<int>, m int, f int")
        want = df.select("i", G.code_ploidy_issues(F.col("c"), F.col("s"), F.col("m"), F.col("f")).alias("x")).orderBy("i").collect()
        het, there, unknown = packed.ploidy_issues(packed.pack(np.array(codes, np.uint8)), np.array(sexes), male, female)
        assert [(r.x.haploid_het_incompatible, r.x.absent_nonmissing, r.x.unknown_sex) for r in want] == [(a, b, unknown) for a, b in zip(het.tolist(), there.tolist())]


@pytest.fixture()
def files(tmp_path):
    write_set(tmp_path, "1", [[0, 1, 2], [3, 2, 1], [2, 2, 0]], ["F a dad mum 1 7.5", "F b 0 0 2 -9", "F c 0 0 0 1"])
    write_set(tmp_path, "2", [[3, 3, 0], [1, 0, 0]], ["F a dad mum 1 7.5", "F b 0 0 2 -9", "F c 0 0 0 1"], contig="2")
    write_set(tmp_path, "X", [[0, 0]], ["F d 0 0 1 1", "F a 0 0 1 1"], contig="X")
    return tmp_path


def rows_of(spark, *rows):
    return VariantObject(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], VMAP), "GRCh37", "ncbi")


def test_projection_by_key_writes_file_sets(spark, files):
    vmap = rows_of(
        spark,
        ("X", 3_000_000, "x", "A", "C", "1", 0, "identity"), ("1", 5, "a", "A", "C", "2", 0, "swap"), ("1", 6, "b", "A", "C", ".", -1, "missing"),
        ("2", 7, "c", "A", "C", "1", 1, "flip_swap"), ("1", 9, "d", "A", "C", "1", 1, "flip"), ("1", 10, "e", "A", "C", "1", 1, "identity"),
    )
    sets = plink.open_bfiles(spark, str(files / "in@"))
    assert sorted(sets.shards) == ["1", "2", "X"] and sets.shards["2"].n_variants == 2
    made = plink.project_bfiles(vmap, sets, by_contig=True, retain_id=True)
    assert made.groups == ("X", "1", "2")
    for _ in range(2):  # a second run leaves the same
        out = made.write(str(files / "out.@"))
        assert out.records == 6
        codes, bim, fam = read_set(files / "out.1", 3)
        assert codes == [[0, 0, 3], [1, 1, 1], [3, 2, 1], [3, 2, 1]]
        assert bim == ["1\ta\t0\t5\tA\tC", "1\tb\t0\t6\tA\tC", "1\td\t0\t9\tA\tC", "1\te\t0\t10\tA\tC"]
        assert fam == ["F\ta\tdad\tmum\t1\t7.5", "F\tb\t0\t0\t2\t-9", "F\tc\t0\t0\t0\t1"]
        assert read_set(files / "out.2", 3)[0] == [[0, 2, 1]] and read_set(files / "out.X", 3)[0] == [[0, 1, 2]]
    assert (files / "out.X.ploidy").exists() and not (files / "out.1.ploidy").exists()
    assert "".join(p.read_text() for p in sorted((files / "out.X.ploidy").glob("part-*"))) == "1\t2\n"
    # The third sample's sex is not known; the man's genotype is no heterozygote.
    assert out.qc.count() == 0 and out.unvalidated.first().unknown_sex == 1
    again = plink.open_bfiles(spark, str(files / "out.@"))
    assert {t: b.n_variants for t, b in again.shards.items()} == {"1": 4, "2": 1, "X": 1}
    got = {(r.source_shard, r.source_index): packed.unpack(np.frombuffer(r.bed, np.uint8)[None], 3)[0].tolist() for r in plink.read_records(spark, again).collect()}
    assert got[("1", 2)] == [3, 2, 1] and got[("X", 0)] == [0, 1, 2]


def test_no_genotype_is_shuffled(spark, files):
    vmap = rows_of(spark, ("1", 5, "a", "A", "C", "2", 0, "swap"), ("1", 6, "b", "A", "C", "1", 0, "identity"))
    plan = plink.project_bfiles(vmap, plink.open_bfiles(spark, str(files / "in@"))).records()._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.index("MapInArrow") < physical.index("Exchange"), "the records come last"
    assert "bed#" not in physical[physical.index("Exchange") :]


def test_axes_are_those_of_referenced_shards(spark, files):
    sets = plink.open_bfiles(spark, str(files / "in@"))
    two = rows_of(spark, ("1", 5, "a", "A", "C", "1", 0, "identity"), ("1", 6, "b", "A", "C", "X", 0, "swap"))
    with pytest.raises(ValueError, match="different samples"):
        plink.project_bfiles(two, sets)
    made = plink.project_bfiles(two, sets, axis="union")
    got = [packed.unpack(np.frombuffer(r.bed, np.uint8)[None], 4)[0].tolist() for r in made.records().orderBy("ord").collect()]
    assert got == [[0, 1, 2, 1], [3, 1, 1, 3]]
    made.write(str(files / "union"))
    assert read_set(files / "union", 4)[2] == ["F\ta\t0\t0\t1\t-9", "F\tb\t0\t0\t2\t-9", "F\tc\t0\t0\t0\t-9", "F\td\t0\t0\t1\t-9"]
    assert {r.source_shard: (r.absent_samples, r.added_missing) for r in made.summary.collect()} == {"1": (1, 1), "X": (2, 2)}
    # One shard is left: its lines stay as they are.
    one = plink.project_bfiles(rows_of(spark, ("1", 5, "a", "A", "C", "1", 0, "identity")), sets, axis="union")
    one.write(str(files / "one"))
    assert read_set(files / "one", 3)[2][0] == "F\ta\tdad\tmum\t1\t7.5"
    native = plink.project_bfiles(rows_of(spark, ("1", 5, "a", "A", "C", "1", 0, "identity"), ("2", 6, "b", "A", "C", "X", 0, "identity")), sets, axis="native", by_contig=True)
    native.write(str(files / "nat.@"))
    assert read_set(files / "nat.2", 2)[0] == [[0, 0]] and [x.split("\t")[1] for x in read_set(files / "nat.2", 2)[2]] == ["d", "a"]
    for bad, why in (
        (("1", 5, "a", "A", "C", "1", 3, "identity"), "no variant 3"),
        (("1", 5, "a", "A", "C", "9", 0, "identity"), "no shard 9"),
        (("1", 5, "a", "A", "C", ".", -1, "missing"), "no target has a source"),
    ):
        with pytest.raises(ValueError, match=why):
            plink.project_bfiles(rows_of(spark, bad), sets)


def test_file_sets_are_checked(spark, files):
    (files / "in2.fam").rename(files / "moved.fam")
    with pytest.raises(ValueError, match="shard 2 is not complete"):
        plink.open_bfiles(spark, str(files / "in@"))
    (files / "in1.bed").write_bytes(readers.MAGIC + b"1")
    with pytest.raises(ValueError, match="size does not fit"):
        plink.open_bfiles(spark, str(files / "in1"))
    (files / "in1.bed").write_bytes(b"abc123")
    with pytest.raises(ValueError, match="not a SNP-major"):
        plink.open_bfiles(spark, str(files / "in1"))


def test_readers_read_stretches_of_parts(tmp_path):
    rng = np.random.default_rng(1)
    block = rng.integers(0, 256, (50, 3), dtype=np.uint8)
    data = readers.MAGIC + block.tobytes()
    folder = tmp_path / "x.bed"
    folder.mkdir()
    for i, (a, b) in enumerate(((0, 2), (2, 40), (40, 41), (41, len(data)))):
        (folder / f"part-{i:03d}").write_bytes(data[a:b])
    (folder / "_part-9.attempt").write_bytes(b"left over")
    bed = plink.Bed(tuple(plink.listed(str(folder))), 11, 50).check()
    reader = plink.Reader(bed)
    for gap in (0, 6, 1 << 16):
        plink.GAP, kept = gap, plink.GAP
        index = rng.integers(0, 50, 30)
        assert (reader.records(index) == block[index]).all()
        plink.GAP = kept


def test_sample_files(spark, tmp_path):
    (tmp_path / "a.psam").write_text("#FID\tIID\tSEX\tAGE\nF\tx\t1\t30\nF\ty\tNA\t40\n")
    (tmp_path / "b.psam").write_text("#IID\tSEX\nx\t1\n")
    one = readers.read_samples(spark, str(tmp_path / "a.psam"), "1")
    assert [(r.local_idx, r.fid, r.iid, r.sex) for r in one.orderBy("local_idx").collect()] == [(0, "F", "x", 1), (1, "F", "y", 0)]
    both = readers.read_sample_shards(spark, [("1", str(tmp_path / "a.psam")), ("2", str(tmp_path / "b.psam"))])
    with pytest.raises(ValueError, match="FID"):
        OG.sample_axis(both, union=True)
    assert OG.sample_axis(both, mode="iid", union=True).count() == 2
    writers.write_psam(OG.sample_axis(one), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == (tmp_path / "a.psam").read_text()
    with pytest.raises(ValueError, match="fewer than 4"):
        (tmp_path / "c.psam").write_text("#FID\tIID\tSEX\tAGE\nF\tx\t1\n")
        readers.read_samples(spark, str(tmp_path / "c.psam"))
    with pytest.raises(ValueError, match="no samples"):
        (tmp_path / "d.fam").write_text("\n")
        readers.read_samples(spark, str(tmp_path / "d.fam"))


def test_fasta_by_ranges_equals_lines(spark, tmp_path):
    rng = random.Random(2)
    text = "; no sequence yet\n"
    for i, width in enumerate((10_000, 7, 60, 1, 500)):
        seq = "".join(rng.choice("acgtNACGT") for _ in range(1500 if width > 1 else 9))
        text += f">chr{i + 1} some words\r\n" + "".join(seq[a : a + width] + rng.choice(["\n", "\r\n"]) for a in range(0, len(seq), width)) + rng.choice(["", "\n"])
    text += ">scaffold_7\n>empty\n>last\nACG"
    (tmp_path / "g.fa").write_text(text)
    want = {(r.contig, r.block): r.seq for r in readers.read_fasta_lines(spark, str(tmp_path / "g.fa"), 16).collect()}
    assert want[("last", 0)] == "ACG" and len(want) > 300
    for step in (13, 64, 1000, 1 << 20):
        assert {(r.contig, r.block): r.seq for r in readers.read_fasta(spark, str(tmp_path / "g.fa"), 16, step).collect()} == want
    assert len({r.p for r in readers.read_fasta(spark, str(tmp_path / "g.fa"), 16, 500).select(F.spark_partition_id().alias("p")).collect()}) > 1


def test_quoted_cells(spark, tmp_path):
    (tmp_path / "c.csv").write_text('SNP,P,"A 1",N\n"a,b","0,1",G,5 # said\nx,"say ""hi"" # there",C,\ny,1,T\n')
    got = readers.read_sumstats(spark, str(tmp_path / "c.csv"))
    assert got.columns == ["SNP", "P", "A 1", "N", "source_index"]
    assert [tuple(r)[:4] for r in got.orderBy("source_index").collect()] == [("a,b", "0,1", "G", "5"), ("x", 'say "hi" # there', "C", ""), ("y", "1", "T", None)]
    (tmp_path / "s.txt").write_text('SNP P A\n"a b" 1   "G"\nc 2 T\n')
    assert [tuple(r)[:3] for r in readers.read_sumstats(spark, str(tmp_path / "s.txt")).orderBy("source_index").collect()] == [("a b", "1", "G"), ("c", "2", "T")]


def step_by_step(at, ref, alt, seq, start):
    """Left alignment as it is usually told."""
    short = False
    while ref != alt and (not ref or not alt or ref[-1] == alt[-1]):
        if ref and alt:
            ref, alt = ref[:-1], alt[:-1]
        if not ref or not alt:
            if at <= start:
                short = start > 1
                break
            base = seq[at - 1 - start]
            ref, alt, at = base + ref, base + alt, at - 1
    while ref != alt and min(len(ref), len(alt)) > 1 and ref[0] == alt[0]:
        ref, alt, at = ref[1:], alt[1:], at + 1
    return at, ref, alt, short


def test_left_alignment_in_closed_form(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        start, letters = rng.choice([1, 1, 7]), rng.choice(["A", "AC", "ACGT"])
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        seq = word(rng.randint(1, 14))
        rows.append((i, start + rng.randrange(len(seq)), word(rng.randint(1, 4)), word(rng.randint(1, 4)), seq, start))
    df = spark.createDataFrame(rows, "i int, at long, ref string, alt string, seq string, seq_start long")
    for r in R.left_align(df).collect():
        want = step_by_step(*rows[r.i][1:])
        assert r.short == want[3] and (r.short or (r.at, r.ref, r.alt) == want[:3]), rows[r.i]


def test_liftover_of_indels(spark):
    #       123456789012
    src = "ACGTTTACGATC"
    # Bases 1 to 6 lie at 11 to 16 of the target, where one more T follows them, 7 to 12 at 18 to 23.
    tgt = "NNNNNNNNNN" + src[:6] + "T" + src[6:]
    flipped = src[::-1].translate(str.maketrans("ACGT", "TGCA"))
    blocks = lambda **seqs: spark.createDataFrame([(c, 0, s) for c, s in seqs.items()], "contig string, block long, seq string")
    source = blocks(**{"1": src, "2": src})
    target = blocks(**{"1": tgt, "2": flipped})
    chain = spark.createDataFrame(
        [("1", 0, 6, "1", 10, "+", 1, 9.0), ("1", 6, 12, "1", 17, "+", 1, 9.0), ("2", 0, 12, "2", 0, "-", 2, 9.0)],
        "src_contig string, s_start long, s_end long, tgt_contig string, t_start long, strand string, chain_id long, score double",
    )
    vmap = rows_of(
        spark,
        ("1", 2, "plain", "CG", "C", ".", 0, "identity"),  # an insertion that moves nowhere
        ("1", 6, "gap", "TT", "T", ".", 1, "identity"),  # the target has it
        ("1", 6, "other", "TA", "T", ".", 2, "identity"),  # the gap holds something else
        ("2", 3, "minus", "GT", "G", ".", 3, "identity"),  # at the end of a row of T, read backwards
        ("2", 3, "first", "G", "GA", ".", 4, "identity"),  # the reference allele is the first
        ("1", 3, "long", "GTT", "CGT", ".", 5, "identity"),  # neither allele is the base there
        ("1", 12, "edge", "CA", "C", ".", 6, "identity"),  # nothing behind it
    )
    out, qc = R.liftover_build(vmap, "GRCh38", source, target, chain)
    status = {r.source_index: r.status for r in qc.collect()}
    assert status == {0: "lifted", 1: "lifted", 2: "unsupported_swap", 3: "lifted", 4: "lifted", 5: "unsupported_non_snv", 6: "unsupported_non_snv"}
    got = {r.id: (r.chrom, r.pos, r.a1, r.a2, r.allele_op) for r in out.df.collect()}
    assert got["plain"] == ("1", 12, "CG", "C", "identity")
    # REF is TT now; without its last T, and on the left of all T: G and GT.
    assert got["gap"] == ("1", 13, "G", "GT", "swap")
    # Bases 3 to 6 are GTTT; backwards AAAC. An A more stands before them, behind the T of base 7.
    assert got["minus"] == ("2", 6, "TA", "T", "flip")
    assert got["first"] == ("2", 9, "AT", "A", "flip_swap")


def test_shards_of_a_contig_are_one_group(spark, tmp_path):
    lines = {"10": ["10\trs10\t0\t10\tG\tA"], "2": ["2\trs2\t0\t2\tC\tA", "7\tstray\t0\t2\tC\tA"], "NONPAR": ["X\trs_nonpar\t0\t100\tG\tA"], "nonpar": ["XY\trs_lower\t0\t120\tC\tA"]}
    for token, rows in lines.items():
        (tmp_path / f"r.{token}.bim").write_text("\n".join(rows) + "\n")
    genome = lambda base: spark.createDataFrame([(c, 0, base * 200) for c in ("2", "10", "X")], "contig string, block long, seq string")
    both = {"GRCh37": genome("A"), "GRCh38": genome("T")}
    out, qc = prepare_sharded_files(spark, str(tmp_path / "r.@.bim"), "bim", both, {}, shards=list(lines), dst_build="GRCh37", norm_indels=False)
    got = [tuple(r) for r in out.df.orderBy("ord").select("chrom", "pos", "id", "a1", "a2", "source_shard", "source_index").collect()]
    assert got == [("2", 2, "rs2", "C", "A", "2", 0), ("10", 10, "rs10", "G", "A", "10", 0), ("X", 100, "rs_nonpar", "G", "A", "NONPAR", 0), ("X", 120, "rs_lower", "C", "A", "nonpar", 0)]
    assert out.genome_build == "GRCh37" and [r.source_id for r in qc["shard"].collect()] == ["stray"]
    assert {(r.build, r.guess) for r in qc["builds"].collect()} == {("GRCh37", "GRCh37"), ("GRCh38", "GRCh37")}
    with pytest.raises(ValueError, match="@"):
        prepare_sharded_files(spark, str(tmp_path / "r.2.bim"), "bim", both, {})


def test_sample_of_each_group_is_bounded(spark):
    rows = [("1" if i % 10 else "2", i + 1, f"v{i}", "A", "C", i) for i in range(600)]
    vo = VariantObject(spark.createDataFrame(rows, "chrom string, pos long, id string, a1 string, a2 string, ord long"), "unknown", "ncbi")
    blocks = lambda base: spark.createDataFrame([(c, b, base * 256) for c in "12" for b in range(4)], "contig string, block long, seq string")
    builds, evidence = R.guess_builds(vo, F.col("chrom"), {"GRCh37": blocks("C"), "GRCh38": blocks("G")}, sample=50)
    assert builds == {"1": "GRCh37", "2": "GRCh37"}
    assert {(r.group, r.build): (r.considered, r.compatible) for r in evidence.collect()} == {(g, b): (50, 50 * (b == "GRCh37")) for g in "12" for b in ("GRCh37", "GRCh38")}


def test_qc_tables_and_contig_folders(spark, tmp_path):
    qc = spark.createDataFrame([(".", 3, "malformed_row")], "source_shard string, source_index long, reason string")
    assert writers.write_qc(qc, str(tmp_path / "qc"), "import")
    assert [p.read_text() for p in sorted((tmp_path / "qc").glob("part-*"))][-1] == "source_shard\tsource_index\treason\n.\t3\tmalformed_row\n"
    assert not writers.write_qc(qc.limit(0), str(tmp_path / "none"), "import") and not (tmp_path / "none").exists()
    assert writers.write_qc(qc.limit(0), str(tmp_path / "always"), "import", always=True)
    df = spark.createDataFrame([("2", 1, 0), ("1", 5, 1), ("2", 3, 2)], "chrom string, pos long, ord long")
    writers.write_by_contig(df, str(tmp_path / "by"))
    assert sorted(p.name for p in (tmp_path / "by").glob("chrom=*")) == ["chrom=1", "chrom=2"]
    assert [r.pos for r in spark.read.parquet(str(tmp_path / "by" / "chrom=2")).orderBy("ord").collect()] == [1, 3]


def test_a_bucketed_payload_is_not_shuffled(spark):
    payload = spark.createDataFrame([(i, str(i)) for i in range(200)], "source_index long, beta string")
    table = writers.save_payload(payload, "bucketed_payload", 4)
    vmap = rows_of(spark, *[("1", i + 1, f"v{i}", "A", "C", ".", i if i % 3 else -1, "identity" if i % 3 else "missing") for i in range(100)])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.payload_join(vmap, table)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and S.payload_join(vmap, payload)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        out = S.attach_payload(vmap, table)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.sql("DROP TABLE bucketed_payload")
    assert {(r.source_index, r.p__beta) for r in out.filter("source_index <> -1").collect()} == {(i, str(i)) for i in range(100) if i % 3}
    assert out.filter("source_index = -1 and p__beta is null").count() == 34
    with pytest.raises(ValueError, match="out of range"):
        S.attach_payload(vmap, payload.filter("source_index <> 50"))
    with pytest.raises(ValueError, match="no shard"):
        S.attach_payload(rows_of(spark, ("1", 1, "a", "A", "C", "x", 1, "identity")), payload)


def test_records_are_not_broadcast_and_ids_keep_repeated_keys(spark, tmp_path):
    from pyspark.sql import functions as F

    from varloom.functions.genotypes import decode, encode
    from varloom.sources import plink, readers

    folder = str(tmp_path / "a")
    with open(f"{folder}.bim", "w") as f:
        f.write("1\tx\t0\t5\tA\tG\n1\ty\t0\t5\tA\tG\n")
    with open(f"{folder}.fam", "w") as f:
        f.write("".join(f"F I{i} 0 0 0 -9\n" for i in range(5)))
    geno = spark.createDataFrame([(0, [0, 1, 2, 3, 2]), (1, [3, 3, 0, 1, 1]), (2, None), (3, [2])], "source_index long, geno array<tinyint>")
    packed = {r.source_index: r.bed for r in geno.select("source_index", encode(F.col("geno")).alias("bed")).collect()}
    assert packed[2] is None and packed[3] == b"\x02"
    with open(f"{folder}.bed", "wb") as f:
        f.write(bytes([0x6C, 0x1B, 0x01]) + packed[0] + packed[1])
    got = plink.read_records(spark, plink.open_bfiles(spark, folder))
    ids = readers.read_bim_ids(spark, f"{folder}.bim")
    both = got.select("source_shard", "source_index", decode(F.col("bed"), F.col("n_samples")).alias("geno")).join(ids, ["source_shard", "source_index"])
    assert "SortMergeJoin [source_shard" in both._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, list(r.geno)) for r in both.orderBy("source_index").collect()] == [("x", [0, 1, 2, 3, 2]), ("y", [3, 3, 0, 1, 1])]
