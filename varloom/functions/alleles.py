"""Alleles and the group of allele operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: identity = 0, swap = 1, flip = 2, flip_swap = 3; two operations compose by XOR.
OPS = ("identity", "swap", "flip", "flip_swap")
MISSING = "missing"
KEY = ("chrom", "pos", "a1", "a2")


def norm_allele(c: Column) -> Column:
    return F.upper(F.trim(c))


def is_acgt(c: Column) -> Column:
    return c.rlike("^[ACGT]+$")


def revcomp(c: Column) -> Column:
    return F.translate(F.reverse(c), "ACGT", "TGCA")


def parse_pos(c: Column) -> Column:
    """A position above 0, or null."""
    n = F.trim(c).try_cast("bigint")
    return F.when(F.trim(c).rlike(r"^\+?[0-9]+$") & (n > 0), n)


def op_code(op: Column) -> Column:
    """0 to 3, or null for ``missing``."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(OPS):
        out = F.when(op == name, F.lit(i)).otherwise(out)
    return out


def op_name(code: Column) -> Column:
    out = F.lit(MISSING)
    for i, name in enumerate(OPS):
        out = F.when(code == i, F.lit(name)).otherwise(out)
    return out


def compose_op(first: Column, second: Column) -> Column:
    """The operation that does ``first`` and then ``second``; ``missing`` absorbs."""
    return op_name(op_code(first).bitwiseXOR(op_code(second)))


def classify_op(source_a1: Column, source_a2: Column, target_a1: Column, target_a2: Column, allow_flips: bool = False) -> Column:
    """The operation that turns the source pair into the target pair."""
    out = F.when((source_a1 == target_a1) & (source_a2 == target_a2), F.lit(OPS[0])).when((source_a1 == target_a2) & (source_a2 == target_a1), F.lit(OPS[1]))
    if allow_flips:
        r1, r2 = revcomp(source_a1), revcomp(source_a2)
        out = out.when((r1 == target_a1) & (r2 == target_a2), F.lit(OPS[2])).when((r1 == target_a2) & (r2 == target_a1), F.lit(OPS[3]))
    return out.otherwise(F.lit(MISSING))


def is_swap(op: Column) -> Column:
    return op.isin(OPS[1], OPS[3])


def is_strand_ambiguous(a1: Column, a2: Column) -> Column:
    return revcomp(a1) == a2


def variant_id(chrom: Column, pos: Column, a1: Column, a2: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), a1, a2)


def allele_reason(a1: Column, a2: Column, max_length: int) -> Column:
    """Why an importer turns a pair of normalised alleles down, or null."""
    return (
        F.when(~is_acgt(a1) | ~is_acgt(a2), F.lit("non_actg_allele"))
        .when((F.length(a1) > max_length) | (F.length(a2) > max_length), F.lit("allele_too_long"))
    )
