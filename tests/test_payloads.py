"""Readers, writers, summary statistics and genotypes."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_variants import vmap, vtable
from varloom.functions import genotypes as G
from varloom.functions import stats
from varloom.jobs import queries as Q
from varloom.operators import genotypes as OG
from varloom.operators import sumstats as S
from varloom.sources import readers as RD
from varloom.sources import writers as WR


def test_vcf_and_bim_files(spark, tmp_path):
    vcf = tmp_path / "x.vcf"
    vcf.write_text("##meta\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\n1\t10\trs1\tA\tg\t.\n1\tbad\trs2\tA\tG\t.\n1\t12\t\tA\tG,T\t.\n1\t13\trs4\tA\tN\t.\n1\t10\trs5\tA\tG\t.\n2\t5\n")
    vo, qc = RD.read_vcf(spark, str(vcf))
    assert [(r.chrom, r.pos, r.id, r.a1, r.a2, r.source_index) for r in vo.df.collect()] == [("1", 10, "rs1", "G", "A", 0)]
    assert {r.source_index: r.reason for r in qc.collect()} == {1: "malformed_row", 2: "multiallelic", 3: "non_actg_allele", 4: "duplicate_target", 5: "malformed_row"}
    for c, lines in {"1": "1 a 0 5 A C\n1 b 0 6 A C\n", "X": "X c 0 7 G T\n"}.items():
        (tmp_path / f"chr{c}.bim").write_text(lines)
    vo, _ = RD.read_bim(spark, str(tmp_path / "chr@.bim"), shards=["X", "1"])
    assert [(r.id, r.source_shard, r.source_index) for r in vo.df.orderBy("ord").collect()] == [("c", "X", 0), ("a", "1", 0), ("b", "1", 1)]
    found, _ = RD.read_bim(spark, str(tmp_path / "chr@.bim"), contigs="X")
    assert [r.source_shard for r in found.df.collect()] == ["X"] and found.contig_naming == "ncbi"
    with pytest.raises(ValueError):
        RD.resolve_shards(spark, str(tmp_path / "no@.bim"))


def test_objects_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("12"), 5 + i, f"r{i}", "A", "C", ".", i, "swap") for i in range(50)]
    vo = vmap(spark, rows)
    WR.write_object(vo, str(tmp_path / "m"))
    parts = sorted((tmp_path / "m").glob("part-*"))
    (tmp_path / "one.vmap").write_text("".join(p.read_text() for p in parts))
    back = RD.read_vmap(spark, str(tmp_path / "one.vmap"), "GRCh37", "ncbi")
    assert [tuple(r) for r in back.df.select(*vo.columns).orderBy("ord").collect()] == [tuple(r) for r in vo.df.select(*vo.columns).orderBy("ord").collect()]
    (tmp_path / "bad.vtable").write_text("1\t5\tx\tA\n")
    with pytest.raises(ValueError):
        RD.read_vtable(spark, str(tmp_path / "bad.vtable"))


def test_sumstats_file(spark, tmp_path):
    (tmp_path / "s.txt").write_text("## note\n\n#CHR POS EA OA BETA\n1 5 a c 0.5 # said\n1 6 G T n/a\n")
    df = RD.read_sumstats(spark, str(tmp_path / "s.txt"))
    assert df.columns == ["CHR", "POS", "EA", "OA", "BETA", "source_index"]
    assert [tuple(r) for r in df.orderBy("source_index").collect()] == [("1", "5", "a", "c", "0.5", 0), ("1", "6", "G", "T", "n/a", 1)]


def test_fasta_and_chain(spark, tmp_path):
    rng = random.Random(2)
    seqs = {"chr1": "".join(rng.choice("acgtN") for _ in range(1337)), "chrUn": "".join(rng.choice("ACGT") for _ in range(300))}
    (tmp_path / "g.fa").write_text("".join(f">{k} text\n" + "\n".join(v[i : i + 70] for i in range(0, len(v), 70)) + "\n" for k, v in seqs.items()))
    got = {}
    for r in RD.read_fasta(spark, str(tmp_path / "g.fa")).orderBy("contig", "block").collect():
        assert len(r.seq) <= 256
        got[r.contig] = got.get(r.contig, "") + r.seq
    assert got == {"1": seqs["chr1"].upper(), "chrUn": seqs["chrUn"]}
    (tmp_path / "c.chain").write_text("chain 100 chr1 1000 + 10 60 chr2 500 - 20 65 7\n20 5 0\n25\n\nchain 50 chr3 100 + 0 5 chr3 100 + 1 6 8\n5\n")
    rows = [tuple(r) for r in RD.read_chain(spark, str(tmp_path / "c.chain")).orderBy("chain_id", "s_start").collect()]
    assert rows == [("1", 10, 30, "2", 460, "-", 7, 100.0), ("1", 35, 60, "2", 435, "-", 7, 100.0), ("3", 0, 5, "3", 1, "+", 8, 50.0)]


def test_normal_approximations(spark):
    ps = [1e-300, 1e-12, 0.001, 0.02425, 0.3, 0.5, 0.77, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in ps], "p double").withColumn("x", stats.qnorm("p"))
    for r in df.withColumn("q", stats.pnorm("x")).collect():
        assert r.q == pytest.approx(r.p, rel=1e-7)
        assert 0.5 * math.erfc(-r.x / math.sqrt(2)) == pytest.approx(r.p, rel=1e-7)


def test_harmonize(spark):
    meta = {"stats_Model": "logistic", "stats_CaseN": 100, "stats_ControlN": "300", "col_OR": "odds.ratio", "col_ORL95": "L", "col_ORU95": "U", "col_OAF": "oaf", "col_P": "pv", "stats_neglog10P": True, "col_Direction": "none"}
    df = spark.createDataFrame([("2", "1.5", "2.7", "0.25", "3", "", 0), ("-1", "x", "2", "7", "inf", "", 1)], "OddsRatio string, L string, U string, oaf string, pv string, none string, source_index long")
    out = {r.source_index: r.asDict() for r in S.harmonize_sumstats(df, meta).collect()}
    assert out[0]["N"] == pytest.approx(4 / (1 / 100 + 1 / 300)) and out[0]["EAF"] == 0.75 and out[0]["P"] == pytest.approx(1e-3)
    assert out[0]["BETA"] == pytest.approx(math.log(2)) and out[0]["SE"] == pytest.approx((math.log(2.7) - math.log(1.5)) / (2 * stats.Z975))
    assert out[0]["Z"] == pytest.approx(3.290526731, rel=1e-8)
    assert "Direction" not in out[0] and out[1]["OR"] is None and out[1]["EAF"] is None and out[1]["Z"] is None
    for bad in ({"stats_Model": "cox"}, {"stats_neglog10P": True}, {"col_P": "pv", "stats_log10P": True, "stats_neglog10P": True}, {"col_P": "nope"}):
        with pytest.raises(ValueError):
            S.harmonize_sumstats(df, bad)


def test_fill_modes(spark):
    df = spark.createDataFrame([("0.1", "0.05", None), ("0.2", "0.1", "5")], "b string, s string, z string")
    meta = {"col_BETA": "b", "col_SE": "s", "col_Z": "z"}
    assert [r.Z for r in S.harmonize_sumstats(df, meta, "row").orderBy("BETA").collect()] == [2.0, 5.0]
    assert [r.Z for r in S.harmonize_sumstats(df, meta, "column").orderBy("BETA").collect()] == [None, 5.0]


def test_swap_effects(spark):
    cols = ("BETA", "Z", "OR", "ORL95", "ORU95", "EAF", "INFO")
    df = spark.createDataFrame([(0.5, 1.0, 2.0, 1.0, 4.0, 0.25, 0.9), (0.5, 1.0, 0.0, 0.0, 4.0, 0.25, 0.9)], ", ".join(f"{c} double" for c in cols))
    turned = S.swap_effects({c: F.col(c) for c in cols}, F.lit(True))
    assert [tuple(r) for r in df.select(*[turned[c].alias(c) for c in cols]).collect()] == [(-0.5, -1.0, 0.5, 0.25, 1.0, 0.75, 0.9), (-0.5, -1.0, None, None, None, 0.75, 0.9)]
    twice = S.swap_effects(turned, F.lit(True))
    assert tuple(df.limit(1).select(*[twice[c].alias(c) for c in cols]).first()) == tuple(df.first())
    assert S.swap_warnings(df, {c: F.col(c) for c in cols}, F.lit(True)).first().asDict() == {"BETA": 0, "Z": 0, "OR": 1, "ORL95": 1, "ORU95": 1, "EAF": 0}


def test_joined_fields(spark):
    df = spark.createDataFrame([("1:100:A:G",), ("1_100_A_G",), ("chr1:5",), ("rs1",)], "v string")
    assert [tuple(r) for r in df.select(*[S.joined_field(F.col("v"), i) for i in range(3)]).collect()][:2] == [("1", "100", "A")] * 2
    out = [r[0] for r in df.select(S.rewrite_joined(F.col("v"), {1: F.lit("7"), 3: F.lit("T")})).collect()]
    assert out == ["1:7:A:T", "1_7_A_T", "chr1:7", "n/a_7:n/a:T"]


def test_missing_source_is_an_error(spark):
    vo = vmap(spark, [("1", 5, "a", "A", "C", ".", 3, "identity")])
    with pytest.raises(ValueError):
        S.attach_payload(vo, spark.createDataFrame([("1", 0)], "b string, source_index long"))
    geno = spark.createDataFrame([(".", 0, [0, 1])], "source_shard string, source_index long, geno array<tinyint>")
    with pytest.raises(ValueError):
        OG.attach_genotypes(vo, geno)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 31, 64])
def test_codec_round_trip(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.integers(0, 4, n).tolist()) for i in range(8)]
    df = spark.createDataFrame(rows, "i long, g array<tinyint>")
    out = df.withColumn("raw", G.encode(F.col("g"))).withColumn("back", G.decode(F.col("raw"), F.lit(n))).withColumn("swapped", G.swap_codes(G.swap_codes(F.col("g")))).collect()
    assert all(list(r.back) == list(r.g) == list(r.swapped) and len(r.raw) == -(-n // 4) for r in out)


def test_ploidy_counts_against_plain_python(spark):
    rng = np.random.default_rng(9)
    rows = [(rng.integers(0, 4, 12).tolist(), rng.integers(0, 3, 12).tolist(), *[(2, 2), (1, 2), (1, 0), (1, 1), (0, 0)][int(rng.integers(0, 5))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "g array<tinyint>, s array<int>, m int, f int")
    for r in df.withColumn("x", G.code_ploidy_issues(F.col("g"), F.col("s"), F.col("m"), F.col("f"))).collect():
        het = there = unknown = 0
        for g, s in zip(r.g, r.s):
            if s not in (1, 2) and r.m != r.f:
                unknown += 1
                continue
            p = r.m if s == 1 else r.f if s == 2 else r.m
            het += p == 1 and g == 2
            there += p == 0 and g != 1
        assert (r.x.haploid_het_incompatible, r.x.absent_nonmissing, r.x.unknown_sex) == (het, there, unknown)


def test_bed_file_and_projection(spark, tmp_path):
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 4, (6, 5))
    packed = np.zeros((6, 8), np.uint8)
    packed[:, :5] = codes
    body = (packed.reshape(6, 2, 4) << (np.arange(4) * 2)).sum(axis=2).astype(np.uint8)
    (tmp_path / "x.bed").write_bytes(RD.MAGIC + body.tobytes())
    geno = RD.read_bed(spark, str(tmp_path / "x.bed"), 5, 6)
    assert [list(r.geno) for r in geno.orderBy("source_index").collect()] == codes.tolist()
    (tmp_path / "x.fam").write_text("".join(f"F{i} I{i} 0 0 {i % 3} -9\n" for i in range(5)))
    samples = RD.read_samples(spark, str(tmp_path / "x.fam"))
    vo = vmap(spark, [("1", 5, "a", "A", "C", ".", 2, "swap"), ("X", 1, "b", "A", "C", ".", -1, "missing"), ("X", 9, "c", "A", "C", ".", 0, "identity")])
    out = OG.apply_to_bfile(vo, geno, samples)
    got = [list(r.geno) for r in out.genotypes.orderBy("ord").collect()]
    assert got == [[{0: 3, 3: 0}.get(g, g) for g in codes[2].tolist()], [1] * 5, codes[0].tolist()]
    assert [(r.male, r.female) for r in out.ploidy.orderBy("ord").collect()] == [(2, 2), (1, 2), (1, 2)]
    WR.write_bfile(out.variants, out.genotypes, out.samples, out.ploidy, str(tmp_path / "out"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out.bed").glob("part-*")))
    assert raw[:3] == RD.MAGIC and len(raw) == 3 + 3 * 2
    (tmp_path / "again.bed").write_bytes(raw)
    again = RD.read_bed(spark, str(tmp_path / "again.bed"), 5, 3, rows_per_piece=2)
    assert [list(r.geno) for r in again.orderBy("source_index").collect()] == got
    assert not [p for p in (tmp_path / "out.bed").iterdir() if not p.name.startswith("part-") and p.suffix != ".crc"]
    with pytest.raises(ValueError):
        RD.read_bed(spark, str(tmp_path / "x.bed"), 5, 7)


def test_sample_axes(spark):
    rows = [("s1", 0, "F", "a", 1), ("s1", 1, "F", "b", 0), ("s2", 0, "F", "b", 2), ("s2", 1, "F", "c", 0)]
    samples = spark.createDataFrame(rows, "source_shard string, local_idx int, fid string, iid string, sex int")
    axis = OG.union_axis(samples)
    assert [(r.iid, r.sex) for r in axis.orderBy("out_idx").collect()] == [("a", 1), ("b", 2), ("c", 0)]
    maps = {r.source_shard: (list(r.local_of), r.n_absent) for r in OG.axis_maps(samples, axis).collect()}
    assert maps == {"s1": ([0, 1, None], 1), "s2": ([None, 0, 1], 1)}
    assert not OG.same_signature(samples)
    with pytest.raises(ValueError):
        OG.union_axis(samples.union(spark.createDataFrame([("s3", 0, "F", "a", 2)], samples.schema)))
    with pytest.raises(ValueError):
        OG.check_samples(samples.union(spark.createDataFrame([("s1", 5, "F", "a", 1)], samples.schema)))


def test_arrays(spark):
    vo = vmap(spark, [("1", 5, "a", "A", "C", ".", 0, "swap"), ("1", 6, "b", "A", "C", ".", -1, "missing")])
    arrays = spark.createDataFrame([(".", 0, 2, [0, 1, -9, -9, 1, 1], [True, False, False], [1.0, -9.0, 2.0])], "source_shard string, source_index long, allele_ct int, alleles array<int>, phase array<boolean>, dosage array<float>")
    samples = spark.createDataFrame([(".", i, "F", f"i{i}", 1) for i in range(3)], "source_shard string, local_idx int, fid string, iid string, sex int")
    got = {r.ord: r for r in OG.apply_to_genotype_arrays(vo, arrays, samples).genotypes.collect()}
    assert list(got[0].alleles) == [1, 0, -9, -9, 0, 0] and list(got[0].dosage) == [1.0, -9.0, 0.0] and got[0].channel == "phase"
    assert list(got[1].alleles) == [-9] * 6 and list(got[1].phase) == [False] * 3 and got[1].channel is None
    with pytest.raises(ValueError):
        OG.apply_to_genotype_arrays(vo, arrays.withColumn("allele_ct", F.lit(3)), samples)


def test_id_lookup(spark):
    lookup = vtable(spark, [("1", 5, "rs1", "A", "C"), ("1", 6, "rs2", "A", "C"), ("2", 6, "rs2", "A", "C"), ("3", 1, ".", "A", "C")])
    rows = [("rs1", "a", "c", 0), ("rs2", "A", "C", 1), ("rs9", "A", "C", 2), (".", "A", "C", 3), ("rs1", "", "C", 4), ("rs1", "N", "C", 5), ("rs1", "A", "C", 6)]
    df = spark.createDataFrame(rows, "snp string, ea string, oa string, source_index long")
    meta = {"col_SNP": "SNP", "col_EffectAllele": "ea", "col_OtherAllele": "oa"}
    vo, qc = S.import_sumstats(df, meta, id_lookup=lookup)
    assert [(r.chrom, r.pos, r.id, r.a1) for r in vo.df.collect()] == [("1", 5, "rs1", "A")] and vo.genome_build == "GRCh37"
    assert {r.source_index: r.reason for r in qc.collect()} == {1: "ambiguous_id_match", 2: "id_not_found", 3: "invalid_id", 4: "malformed_row", 5: "non_actg_allele", 6: "duplicate_target"}


def test_native_axis(spark):
    rows = [("1", 5, "a", "A", "C", "s1", 0, "identity"), ("1", 6, "b", "A", "C", ".", -1, "missing"), ("2", 7, "c", "A", "C", "s2", 0, "swap"), ("2", 8, "d", "A", "C", "s3", 0, "identity")]
    vo = vmap(spark, rows)
    people = [("s1", 0, "F", "a", 1), ("s1", 1, "F", "b", 2), ("s2", 0, "F", "c", 0), ("s3", 0, "F", "c", 0)]
    shape = "source_shard string, local_idx int, fid string, iid string, sex int"
    samples = spark.createDataFrame(people, shape)
    geno = spark.createDataFrame([("s1", 0, [0, 2]), ("s2", 0, [3]), ("s3", 0, [2])], "source_shard string, source_index long, geno array<tinyint>")
    out = OG.apply_to_bfile(vo, geno, samples, axis="native", by_contig=True)
    assert [list(r.geno) for r in out.genotypes.orderBy("ord").collect()] == [[0, 2], [1, 1], [0], [2]]
    assert [tuple(r) for r in out.samples.orderBy("group", "out_idx").select("group", "out_idx", "iid").collect()] == [("1", 0, "a"), ("1", 1, "b"), ("2", 0, "c")]
    with pytest.raises(ValueError, match="different samples"):
        OG.apply_to_bfile(vo, geno, samples, axis="native")
    with pytest.raises(ValueError, match="no row with a source"):
        OG.apply_to_bfile(vmap(spark, [*rows, ("3", 1, "e", "A", "C", ".", -1, "missing")]), geno, samples, axis="native", by_contig=True)
    other = spark.createDataFrame([*people[:3], ("s3", 0, "F", "d", 0)], shape)
    with pytest.raises(ValueError, match="different samples"):
        OG.apply_to_bfile(vo, geno, other, axis="native", by_contig=True)


def test_payloads_without_a_source_are_errors(spark):
    samples = spark.createDataFrame([(".", 0, "F", "a", 1)], "source_shard string, local_idx int, fid string, iid string, sex int")
    geno = spark.createDataFrame([(".", 0, [0])], "source_shard string, source_index long, geno array<tinyint>")
    none = vmap(spark, [("1", 5, "a", "A", "C", ".", -1, "missing")])
    for only in (False, True):
        with pytest.raises(ValueError):
            OG.apply_to_bfile(none, geno, samples, only_mapped=only)
    with pytest.raises(ValueError):
        OG.apply_to_bfile(none.with_df(none.df.limit(0)), geno, samples)
    with pytest.raises(ValueError, match="MT:20000"):
        OG.apply_to_bfile(vmap(spark, [("MT", 20000, "a", "A", "C", ".", 0, "identity")]), geno, samples)


def test_reconciliation_totals(spark):
    people = [("s1", 0, "F", "a", 1), ("s2", 0, "F", "a", 1), ("s2", 1, "F", "b", 0), ("s2", 2, "F", "c", 0)]
    samples = spark.createDataFrame(people, "source_shard string, local_idx int, fid string, iid string, sex int")
    vo = vmap(spark, [("1", i, "a", "A", "C", s, i, "identity") for i, s in enumerate(["s1", "s1", "s1", "s2"], 1)] + [("1", 9, "b", "A", "C", ".", -1, "missing")])
    got = OG.reconciliation_totals(vo, OG.axis_maps(samples, OG.union_axis(samples))).first().asDict()
    assert got == {"mapped_variants": 4, "output_samples": 3, "added_missing": 6, "variants_over_half": 3, "subjects_over_half": 2}


def test_text_columns_that_are_absent(spark):
    vo = vmap(spark, [("1", 5, "rs1", "A", "C", ".", 0, "swap")])
    df = spark.createDataFrame([("9", "x", 0)], "CHROM string, BETA string, source_index long")
    out = S.apply_to_sumstats(vo, df, {"col_CHR": "chrom", "col_POS": "BP", "col_EffectAllele": "A1", "col_BETA": "BETA"})
    assert out.columns == ["ord", "CHROM", "BETA", "BP", "A1"] and tuple(out.first()) == (0, "1", "n/a", "5", "A")
    with pytest.raises(ValueError):
        S.apply_to_sumstats(vo, df, {"col_CHR": "chrom", "col_POS": "MARK", "col_SNP": "MARK"})
    with pytest.raises(ValueError):
        S.apply_to_sumstats(vo, df, {"col_CHR": "nothing"})
    with pytest.raises(ValueError):
        S.apply_to_sumstats(vo, df, {"col_CHR": "chrom", "col_BETA": "BETA"}, clean=True)
    with pytest.warns(UserWarning, match="1 values of BETA"):
        S.apply_to_sumstats(vo, df, {"col_CHR": "chrom", "col_BETA": "BETA"}, warn=True)


def test_delimiters(spark, tmp_path):
    for name, text in {"c": "SNP, CHR, BP\nrs1, 1, 5\n", "t": "SNP\tCHR,x\tBP\nrs1\t1\t5\n", "s": "SNP CHR  BP\nrs1  1 5\n"}.items():
        (tmp_path / name).write_text(text)
        df = RD.read_sumstats(spark, str(tmp_path / name))
        assert df.columns[0] == "SNP" and df.columns[2] == "BP" and tuple(df.first())[:3] == ("rs1", "1", "5")


def test_wide_vcf_and_headers_of_shards(spark, tmp_path):
    (tmp_path / "w.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n" + "".join(f"1\t{i}\tr{i}\tA\tG\t.\t.\t.\tGT" + "\t0/1" * 50 + "\n" for i in range(1, 20)))
    vo, _ = RD.read_vcf(spark, str(tmp_path / "w.vcf"))
    assert [r.id for r in vo.df.orderBy("ord").collect()] == [f"r{i}" for i in range(1, 20)]
    (tmp_path / "p1.pvar").write_text("#CHROM\tPOS\tID\tREF\tALT\n1\t5\ta\tA\tG\n1\t6\n")
    (tmp_path / "p2.pvar").write_text("##x\n#CHROM\tID\tALT\tREF\tPOS\n2\tb\tG\tA\t7\n")
    vo, qc = RD.read_pvar(spark, str(tmp_path / "p@.pvar"))
    assert [(r.chrom, r.pos, r.id, r.a1, r.a2) for r in vo.df.orderBy("ord").collect()] == [("1", 5, "a", "G", "A"), ("2", 7, "b", "G", "A")]
    assert [(r.source_index, r.reason) for r in qc.collect()] == [(1, "malformed_row")]


def test_headers_over_blocks(spark):
    rng = random.Random(3)
    lines = [">x0"] + [f">x{i}" if rng.random() < 0.1 else f"l{i}" for i in range(1, 200)]
    df = spark.createDataFrame(list(enumerate(lines)), "index long, line string").repartition(5)
    got = {r["index"]: r.name for r in RD.under_headers(df, F.col("line").startswith(">"), {"name": F.substring("line", 2, 9)}, block=7).collect()}
    now, want = None, {}
    for i, x in enumerate(lines):
        now = x[1:] if x[0] == ">" else now
        want[i] = now
    assert got == want


def test_shards_with_other_parents_differ(spark, tmp_path):
    (tmp_path / "a.fam").write_text("F a 0 0 1 -9\n")
    (tmp_path / "b.fam").write_text("F a 0 mum 1 -9\n")
    one, two = (RD.read_samples(spark, str(tmp_path / f"{x}.fam"), shard=x) for x in "ab")
    assert OG.same_signature(one.union(one.withColumn("source_shard", F.lit("c")))) and not OG.same_signature(one.union(two))
    (tmp_path / "c.psam").write_text("#FID\tIID\tSEX\tPHENO\nF\ta\t1\t2\n")
    three = RD.read_samples(spark, str(tmp_path / "c.psam"), shard="c").first()
    assert (three.fid, three.iid, three.sex) == ("F", "a", 1) and three.rest.endswith("2")


def test_genotypes_of_high_places(spark, tmp_path):
    """From 37 million orders on, 31 times a place is beyond 64 bits."""
    for t in ("orders", "lineitem"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        df.withColumn(f"{t[0]}_orderkey", F.col(f"{t[0]}_orderkey") + 53_900_000).write.parquet(str(tmp_path / f"{t}.parquet"))
    for t in ("nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    wanted = Q.matched_table(spark, str(tmp_path))
    used = {r[0] for r in wanted.df.filter("source_index <> -1").select("source_index").collect()}
    rows = Q.genotypes(spark, str(tmp_path), wanted)[0].collect()
    assert {r.source_index for r in rows} == used and min(used) * 31 > 2**63
    assert all(list(r.geno) == [(r.source_index * 31 + i * 17) % 4 for i in range(25)] for r in rows)
    codes = {r.ord: r.codes for r in Q.apply_to_bfile(spark, str(tmp_path)).collect()}
    swapped = {"swap", "flip_swap"}
    for r in wanted.df.collect():
        own = [(r.source_index * 31 + i * 17) % 4 for i in range(24, -1, -1)] if r.source_index != -1 else [1] * 25
        assert codes[r.ord] == "".join(str(3 - c if r.allele_op in swapped and c in (0, 3) else c) for c in own) + "11111"


def test_payload_is_read_once(spark):
    """One pass over the payload makes the table, whatever the checks; the errors are those of before."""
    vo = vmap(spark, [("1", 5, "a", "A", "C", ".", 0, "swap")])
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    arrays = spark.createDataFrame([(".", 0, 2, [0, 1, -9, 1], [True, False], [1.0, 1.0])], "source_shard string, source_index long, allele_ct int, alleles array<int>, phase array<boolean>, dosage array<float>")
    samples = spark.createDataFrame([(".", i, "F", f"i{i}", 1) for i in range(2)], "source_shard string, local_idx int, fid string, iid string, sex int")
    got = OG.apply_to_genotype_arrays(vo, arrays.mapInArrow(count, arrays.schema), samples).genotypes.first()
    assert read.value == 1 and list(got.alleles) == [1, 0, -9, 0] and got.channel == "phase"
    with pytest.raises(ValueError, match="mixes"):
        OG.apply_to_genotype_arrays(vo, arrays.withColumn("dosage", F.array(F.lit(0.5), F.lit(1.0)).cast("array<float>")), samples)
