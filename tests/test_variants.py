"""Operators on variant objects, on small tables written out by hand."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from varloom.functions import alleles as A
from varloom.functions import contigs as C
from varloom.functions.ploidy import join_ploidy, ploidy_pair, ploidy_regions
from varloom.jobs import derived as D
from varloom.jobs import queries as Q
from varloom.jobs.workflows import prepare_variants, prepare_variants_sharded, project_payload
from varloom.model import VariantObject, require_same_frame, validate
from varloom.operators import reference as R
from varloom.operators import variants as V

TABLE = "chrom string, pos long, id string, a1 string, a2 string, ord long"
MAP = "chrom string, pos long, id string, a1 string, a2 string, source_shard string, source_index long, allele_op string, ord long"


def vtable(spark, rows, build="GRCh37", naming="ncbi"):
    return VariantObject(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], TABLE), build, naming)


def vmap(spark, rows, build="GRCh37", naming="ncbi"):
    return VariantObject(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], MAP), build, naming)


def got(vo, *cols):
    return [tuple(r) for r in vo.df.orderBy("ord").select(*cols).collect()]


def test_match(spark):
    source = vmap(spark, [("1", 100, "s0", "A", "G", ".", 0, "identity"), ("1", 200, "s1", "C", "T", ".", 1, "flip"), ("1", 200, "s2", "T", "C", ".", 2, "identity"), ("1", 300, "s3", "A", "C", ".", -1, "missing")])
    target = vtable(spark, [("1", 200, "t0", "T", "C"), ("1", 100, "t1", "A", "G"), ("1", 300, "t2", "A", "C"), ("1", 200, "t3", "T", "A")])
    out = V.match_to_target(source, target)
    assert got(out, "id", "source_index", "allele_op") == [("t0", 1, "flip_swap"), ("t1", 0, "identity"), ("t2", -1, "missing"), ("t3", -1, "missing")]
    assert V.match_to_target(source.with_df(source.df.limit(0)), target).df.filter("source_index = -1").count() == 4


def test_a_target_that_is_there_twice_is_an_error(spark):
    source = vmap(spark, [("1", 100, "s0", "A", "G", ".", 0, "identity")])
    with pytest.raises(ValueError, match="1:100:A:G occurs 2 times"):
        V.match_to_target(source, vtable(spark, [("1", 100, "t0", "A", "G"), ("1", 100, "t1", "A", "G")]))


def test_rows_of_a_repeated_target_each_have_the_match(spark):
    source = vmap(spark, [("1", 100, "s0", "G", "A", ".", 7, "identity"), ("1", 100, "s1", "A", "G", ".", 8, "identity")])
    out = V.match_to_target(source, vtable(spark, [("1", 100, "t0", "A", "G"), ("1", 100, "t1", "A", "G"), ("1", 200, "t2", "A", "G")]), repeated=True)
    assert got(out, "id", "source_index", "allele_op") == [("t0", 7, "swap"), ("t1", 7, "swap"), ("t2", -1, "missing")]


def test_an_import_parses_and_shuffles_once(spark):
    from varloom.sources import readers

    lines = ["1 a 0 5 A G", "1 b 0 5 A G", "1 c 0 x A G", "1 d 0 x A G", "1 e 0 7 A", "2 f 0 5 N G", "1 g 0 6 A G"]
    vo, qc = readers.parse_bim(spark.createDataFrame([(x, ".", i, i) for i, x in enumerate(lines)], "line string, source_shard string, source_index long, ord long"), contigs="1")
    assert sorted(tuple(r) for r in qc.collect()) == [(".", 1, "duplicate_target"), (".", 2, "malformed_row"), (".", 3, "malformed_row"), (".", 4, "malformed_row"), (".", 5, "non_actg_allele")]
    assert got(vo, "id") == [("a",), ("g",)]
    plan = qc.unionByName(vo.df.select("source_shard", "source_index", F.lit("kept").alias("reason")))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "split" not in plan


def test_operations_form_a_group(spark):
    ops = [*A.OPS, A.MISSING]
    df = spark.createDataFrame([(x, y, z) for x in ops for y in ops for z in ops], "x string, y string, z string")
    c = lambda a, b: A.compose_op(a, b)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    bad = df.filter((c(c(x, y), z) != c(x, c(y, z))) | (c(x, y) != c(y, x)) | ((x != "missing") & (c(x, x) != "identity")) | ((x == "missing") & (c(x, y) != "missing")))
    assert bad.count() == 0


def test_sets(spark):
    a = vtable(spark, [("2", 5, "a", "A", "C"), ("1", 9, "b", "A", "C"), ("2", 5, "c", "A", "C"), ("10", 1, "d", "G", "T")])
    b = vtable(spark, [("1", 9, "x", "A", "C"), ("2", 5, "y", "A", "C"), ("X", 1, "z", "G", "T")])
    assert got(V.intersect_variants(a, b), "id") == [("a",), ("b",), ("c",)]
    assert got(V.union_variants(a, b), "chrom", "id", "ord") == [("1", "b", 0), ("2", "a", 1), ("10", "d", 2), ("X", "z", 3)]
    assert got(V.intersect_variants(a, b, b.with_df(b.df.limit(0))), "id") == []
    with pytest.raises(ValueError):
        V.union_variants(a, vtable(spark, [("1", 1, "q", "A", "C")], "GRCh38"))
    with pytest.raises(ValueError):
        require_same_frame(a, VariantObject(a.df, "GRCh37"))


@pytest.mark.parametrize("partitions", [1, 4, 7])
def test_sort_does_not_depend_on_partitions(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice(["1", "2", "10", "X", "MT"]), rng.randint(1, 30), f"r{i}", rng.choice("ACGT"), rng.choice("ACGT")) for i in range(200)]
    vo = vtable(spark, rows)
    out = V.sort_variants(vo.with_df(vo.df.repartition(partitions)))
    rank = {c: i for i, c in enumerate(C.CANONICAL)}
    want = sorted(range(200), key=lambda i: (rank[rows[i][0]], rows[i][1], rows[i][3], rows[i][4], i))
    assert got(out, "id", "ord") == [(rows[i][2], n) for n, i in enumerate(want)]


def test_contigs(spark):
    assert C.contig_list("1-3, chrX,MT,2") == ["1", "2", "3", "X", "MT"]
    for bad in ("", "0", "5-2", "chrQ", "1-30"):
        with pytest.raises(ValueError):
            C.contig_list(bad)
    df = spark.createDataFrame([("chr1",), ("26",), ("XY",), ("chrM",), ("HLA",), (None,), ("",), ("par1",)], "c string")
    assert [r[0] for r in df.select(C.normalize_label(F.col("c"))).collect()] == ["1", "MT", "X", "MT", None, None, None, "X"]
    assert [r[0] for r in df.select(C.canonical(F.col("c"), "ucsc")).collect()] == ["1", None, None, "MT", None, None, None, None]


@pytest.mark.parametrize("build", ["GRCh37", "GRCh38", "T2T-CHM13v2.0"])
def test_ploidy(spark, build):
    edges = [(r.contig, p) for r in ploidy_regions(spark, build).collect() for p in (r.start, r.end) if p]
    df = spark.createDataFrame([*edges, ("7", 5), ("chrX", 10**9), ("MT", 16570)], "chrom string, pos long")
    joined = {(r.chrom, r.pos): (r.male, r.female) for r in join_ploidy(df, build).collect()}
    pairs = {(r.chrom, r.pos): r.p and (r.p.male, r.p.female) for r in df.select("*", ploidy_pair(F.col("chrom"), F.col("pos"), build).alias("p")).collect()}
    assert {k: v if v != (None, None) else None for k, v in joined.items()} == pairs
    assert pairs["7", 5] == (2, 2) and pairs["chrX", 10**9] == (1, 2) and pairs["MT", 16570] is None


def test_normalize_contigs(spark):
    vo = vmap(spark, [("chr1", 5, "a", "A", "C", ".", 0, "identity"), ("1", 5, "b", "A", "C", ".", 1, "identity"), ("chrX", 60001, "c", "A", "C", ".", 2, "swap"), ("X", 1, "d", "A", "C", ".", 3, "swap"), ("??", 1, "e", "A", "C", ".", 4, "swap")], naming=None)
    out, qc, counts = V.normalize_contigs(vo, "plink_splitx")
    assert got(out, "chrom", "id") == [("25", "c"), ("23", "d")]
    assert sorted(r.source_index for r in qc.collect()) == [0, 1]
    assert counts.first().asDict() == {"input_rows": 5, "dropped_rows": 1, "changed_rows": 3}


def test_validate(spark):
    ok = ("1", 5, "a", "A", "C", ".", 0, "identity")
    validate(vmap(spark, [ok]))
    for bad in [("1", 0, "a", "A", "C", ".", 0, "identity"), ("1", 5, "", "A", "C", ".", 0, "identity"), ("1", 5, "a", "N", "C", ".", 0, "identity"), ("1", 5, "a", "A", "C", ".", -1, "identity"), ("1", 5, "a", "A", "C", "s", 3, "missing")]:
        with pytest.raises(ValueError):
            validate(vmap(spark, [bad]))
    with pytest.raises(ValueError):
        validate(vmap(spark, [ok, ok]))


# A genome of one contig.
SEQ = "GATTACACACACATTTTGCGCAACGTACGT"


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame([("1", i // 256, SEQ[i : i + 256]) for i in range(0, len(SEQ), 256)], "contig string, block long, seq string")


def test_restrict(spark, blocks):
    rows = [("1", 1, "keep", "T", "G", ".", 0, "identity"), ("1", 2, "swap", "A", "C", ".", 1, "swap"), ("1", 3, "flip", "C", "A", ".", 2, "identity"), ("1", 4, "none", "C", "G", ".", 3, "identity"), ("1", 99, "off", "C", "G", ".", 4, "identity")]
    out, qc, counts = R.restrict_build_compatible(vmap(spark, rows), blocks, allow_strand_flips=True)
    assert got(out, "id", "a1", "a2", "allele_op") == [("keep", "T", "G", "identity"), ("swap", "C", "A", "identity"), ("flip", "G", "T", "flip")]
    assert qc.count() == 0 and counts.first().compatible_rows == 3 and counts.first().input_rows == 5
    assert got(R.restrict_build_compatible(vmap(spark, rows), blocks)[0], "id") == [("keep",), ("swap",)]


def left_align(pos, ref, alt):
    """The plain algorithm, on the whole sequence."""
    while True:
        if ref and alt and ref[-1] == alt[-1] and ref != alt:
            ref, alt = ref[:-1], alt[:-1]
        elif (not ref or not alt) and pos > 1:
            pos -= 1
            ref, alt = SEQ[pos - 1] + ref, SEQ[pos - 1] + alt
        else:
            break
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        ref, alt, pos = ref[1:], alt[1:], pos + 1
    return pos, ref, alt


def test_normalize_indels(spark, blocks):
    rng, rows = random.Random(3), []
    for i in range(60):
        pos = rng.randint(2, 24)
        n = rng.randint(1, 4)
        ref = SEQ[pos - 1]
        rows.append(("1", pos, f"i{i}", ref + "".join(rng.choice("AC") for _ in range(n)), ref, ".", i, "identity"))
    rows.append(("1", 5, "both", "AGGG", SEQ[4:7], ".", 60, "identity"))
    rows.append(("1", 6, "turned", SEQ[5:10], SEQ[5:8] + "X".replace("X", ""), ".", 61, "identity"))
    out, qc, _ = R.restrict_build_compatible(vmap(spark, rows), blocks, norm_indels=True)
    made = {r.source_index: (r.pos, r.a2, r.a1) for r in out.df.collect()}
    said = {r.source_index: r.status for r in qc.collect()}
    for r in rows[:60]:
        want = left_align(r[1], r[4], r[3])
        if r[6] in made:
            assert made[r[6]] == want
        else:
            assert said[r[6]] == "duplicate_target"
    assert said[60] == "norm_unsupported_complex_indel"
    assert said[61] in ("norm_ambiguous_orientation", "duplicate_target") or 61 in made


def test_liftover(spark, blocks):
    chain = spark.createDataFrame([("1", 0, 10, "2", 100, "+", 1, 10.0), ("1", 0, 5, "3", 0, "+", 2, 5.0), ("1", 12, 20, "2", 200, "-", 3, 9.0)], "src_contig string, s_start long, s_end long, tgt_contig string, t_start long, strand string, chain_id long, score double")
    genome = ["C"] * 256
    genome[100], genome[101], genome[102] = "G", "C", "A"
    genome[207] = A_COMPLEMENT[SEQ[12]]
    target = spark.createDataFrame([("2", 0, "".join(genome))], "contig string, block long, seq string")
    rows = [("1", 1, "same", "T", "G"), ("1", 2, "swapped", "C", "A"), ("1", 3, "other", "C", "T"), ("1", 11, "gap", "A", SEQ[10]), ("1", 13, "minus", "C" if SEQ[12] != "C" else "G", SEQ[12])]
    out, qc = R.liftover_build(vtable(spark, rows), "GRCh38", blocks, target, chain)
    assert {r.source_id: r.status for r in qc.collect()} == {"same": "lifted", "swapped": "lifted", "other": "unsupported_swap", "gap": "unmapped", "minus": "lifted"}
    lifted = {r.id: (r.chrom, r.pos, r.a1, r.a2) for r in out.df.collect()}
    assert lifted["same"] == ("2", 101, "T", "G") and lifted["swapped"] == ("2", 102, "A", "C") and lifted["minus"][:2] == ("2", 208)
    with pytest.raises(ValueError):
        R.liftover_build(vtable(spark, [("1", 1, "bad", "T", "C")]), "GRCh38", blocks, target, chain)


A_COMPLEMENT = dict(zip("ACGT", "TGCA"))


def test_guess_and_prepare(spark, blocks):
    rows = [("chr1", p, f"v{p}", "ACGT"[("ACGT".index(SEQ[p - 1]) + 1) % 4], SEQ[p - 1], ".", p, "identity") for p in range(1, 30)]
    vo = vmap(spark, rows, build="unknown", naming="ucsc")
    other = spark.createDataFrame([("1", 0, "N" * 30)], "contig string, block long, seq string")
    guessed, evidence = R.guess_build(vo, {"GRCh37": blocks, "GRCh38": other})
    assert guessed.genome_build == "GRCh37" and {r.build: r.compatible for r in evidence.collect()} == {"GRCh37": 29, "GRCh38": 0}
    out, qc = prepare_variants(vo, {"GRCh37": blocks, "GRCh38": other}, {}, dst_build="GRCh37", drop_ambiguous=True, contigs="1")
    assert out.contig_naming == "ncbi" and all(r.chrom == "1" and A_COMPLEMENT[r.a1] != r.a2 for r in out.df.collect())
    assert set(qc) == {"normalize_contigs", "restrict"}
    again, _ = prepare_variants_sharded(vo, [["1"], ["2"]], {"GRCh37": blocks, "GRCh38": other}, {}, dst_build="GRCh37", drop_ambiguous=True)
    assert got(again, "id") == got(out, "id")
    # Labels of X in any spelling are in its group; what is in no group is named.
    spelled = vmap(spark, [(c, p, f"v{c}{p}", "ACGT"[("ACGT".index(SEQ[p - 1]) + 1) % 4], SEQ[p - 1], ".", 100 + i, "identity") for i, (c, p) in enumerate([("XY", 3), ("par1", 4), ("chrX_PAR1", 5), ("23", 6), ("X", 7), ("GL000", 8), ("5", 9)])], build="GRCh37", naming=None)
    both = {"GRCh37": blocks.union(blocks.withColumn("contig", F.lit("X")))}
    parts, qcs = prepare_variants_sharded(spelled, [["1"], ["X"]], both, {}, dst_build="GRCh37", flips=False, norm_indels=False)
    assert [(r.chrom, r.pos) for r in parts.df.orderBy("ord").collect()] == [("X", p) for p in range(3, 8)]
    assert sorted(r.source_index for r in qcs[-1]["outside"].collect()) == [105, 106]
    with pytest.raises(ValueError):
        prepare_variants_sharded(spelled, [["1"], ["1"]], both, {})
    with pytest.raises(ValueError):
        project_payload(None, "sumstats", vtable(spark, [("1", 1, "a", "A", "C")]))


def test_common_start_is_as_long_as_it_is(spark):
    """Beyond the first 16 characters too; the comparison of all characters stands in the plan twice: of the first 16 and of all."""
    texts = ["", "A", "C", "ACGT" * 4, "ACGT" * 4 + "A", "ACGT" * 5, "ACGT" * 4 + "CA", "T" + "ACGT" * 5]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    got = df.withColumn("n", R.same_from_start(F.col("x"), F.col("y")))
    for r in got.collect():
        assert r.n == len(os.path.commonprefix([r.x, r.y])), r
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") == 2 and "substr(x" in plan


def test_genome_is_joined_once_for_snvs_and_indels(spark, monkeypatch):
    """What the split of SNVs and longer alleles reads is a table, in which no join is left to run twice."""
    seen = []
    was = R._with_indels
    monkeypatch.setattr(R, "_with_indels", lambda vo, kept, *more: seen.append(kept) or was(vo, kept, *more))
    vo = Q.source(spark, SF)
    R.restrict_build_compatible(vo, D.genome(vo.df, around=3), allow_strand_flips=True, norm_indels=True)
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_distinct_before_they_get_neighbours(spark, monkeypatch):
    made = []
    monkeypatch.setattr(D, "materialize", lambda df: made.append(df) or df)
    got = D.genome(Q.target(spark, SF).df, around=1)
    lines = made[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert any("Aggregate" in x for x in lines[explode:])
    assert got.count() == got.select("contig", "block").distinct().count()


def test_generated_methods_are_small_enough_to_be_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    Q.target(spark, SF)
    assert spark.conf.get(key) == "8000"
    spark.conf.set(key, "4000")  # a bound of the session's own stays
    Q.target(spark, SF)
    assert spark.conf.get(key) == "4000"
    spark.conf.unset(key)
