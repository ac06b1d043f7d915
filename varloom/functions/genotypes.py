"""Genotypes of a variant: codes 0 hom-a1, 1 missing, 2 het, 3 hom-a2; arrays of allele pairs, phases and dosages.

A packed row has four samples to the byte, the first in the lowest bits. The
byte codec is a vectorised helper; everything on arrays is built-in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = -9
HOM_A1, MISSING, HET, HOM_A2 = 0, 1, 2, 3


def decode(packed: Column, n_samples: Column) -> Column:
    @F.pandas_udf("array<tinyint>")
    def unpack(raw: pd.Series, n: pd.Series) -> pd.Series:
        shifts, out = np.arange(4, dtype=np.uint8) * 2, np.empty(len(raw), object)
        # Rows of one cohort at once.
        for (size, k), at in pd.Series(range(len(raw))).groupby([raw.reset_index(drop=True).str.len(), n.reset_index(drop=True)]):
            at = at.to_numpy()
            block = np.frombuffer(b"".join(raw.iloc[at]), np.uint8).reshape(len(at), int(size))
            out[at] = _rows(((block[:, :, None] >> shifts) & 3).reshape(len(at), -1)[:, : int(k)].astype(np.int8))
        return pd.Series(out)

    return unpack(packed, n_samples)


def _rows(block: np.ndarray) -> np.ndarray:
    """The rows of a block as an array of objects."""
    out = np.empty(len(block), object)
    for i, row in enumerate(block):
        out[i] = row
    return out


def encode(codes: Column) -> Column:
    @F.pandas_udf("binary")
    def pack(rows: pd.Series) -> pd.Series:
        shifts, out = np.arange(4, dtype=np.uint8) * 2, np.empty(len(rows), object)
        for size, at in pd.Series(range(len(rows))).groupby(rows.reset_index(drop=True).str.len()):
            at = at.to_numpy()
            full = np.zeros((len(at), -(-int(size) // 4) * 4), np.uint8)
            full[:, : int(size)] = np.stack(rows.iloc[at].to_list())
            block = np.bitwise_or.reduce(full.reshape(len(at), -1, 4) << shifts, axis=2)
            out[at] = [row.tobytes() for row in block]
        return pd.Series(out)

    return pack(codes)


def swap_codes(codes: Column) -> Column:
    """0 and 3 change places; the others stay."""
    return F.transform(codes, lambda g: F.when(g.isin(HOM_A1, HOM_A2), HOM_A2 - g).otherwise(g).cast("tinyint"))


def missing_codes(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(MISSING).cast("tinyint"))


def remap(values: Column, local_of: Column, missing: Column) -> Column:
    """``values`` on another axis: ``local_of`` has the place of each output sample (null: not there). ``values`` is a column, as it is read again for each."""
    return F.transform(local_of, lambda i: F.coalesce(F.get(values, i), missing))


def swap_pair(pairs: Column) -> Column:
    return F.transform(pairs, lambda a: F.when(a == 0, F.lit(1)).when(a == 1, F.lit(0)).otherwise(a))


def swap_dosage(dosages: Column) -> Column:
    return F.transform(dosages, lambda d: F.when(d != NONE, 2 - d).otherwise(d).cast("float"))


def hardcall_dosage(pairs: Column) -> Column:
    """Sum of each sample's two alleles; one missing allele counts as the other."""
    first = F.filter(pairs, lambda a, i: i % 2 == 0)
    second = F.filter(pairs, lambda a, i: i % 2 == 1)
    return F.zip_with(first, second, _hard)


def _hard(a: Column, b: Column) -> Column:
    return F.when((a == NONE) & (b == NONE), NONE).when(a == NONE, b).when(b == NONE, a).otherwise(a + b).cast("float")


def pair_classes(pairs: Column) -> Column:
    """fully_missing, haploid_like, hom_ref, het, hom_alt or malformed_partial of each sample."""
    first = F.filter(pairs, lambda a, i: i % 2 == 0)
    second = F.filter(pairs, lambda a, i: i % 2 == 1)

    def of(a: Column, b: Column) -> Column:
        return (
            F.when((a == NONE) & (b == NONE), "fully_missing")
            .when((a != NONE) & (b == NONE), "haploid_like")
            .when(a == NONE, "malformed_partial")
            .when((a == 0) & (b == 0), "hom_ref")
            .when(a == b, "hom_alt")
            .otherwise("het")
        )

    return F.zip_with(first, second, of)


def channel(pairs: Column, phase: Column, dosage: Column) -> Column:
    """hardcall, phase or dosage: what the row holds beyond hard calls; a mix is ``unsupported``."""
    has_phase = F.coalesce(F.exists(phase, lambda x: x), F.lit(False))
    # Alleles are read by their places: no list of hard calls is made.
    differs = F.transform(dosage, lambda d, i: (d != NONE) & (F.abs(d - _hard(F.get(pairs, i * 2), F.get(pairs, i * 2 + 1))) > 1e-4))
    has_dosage = F.coalesce(F.exists(differs, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    return F.when(has_phase & has_dosage, "unsupported").when(has_dosage, "dosage").when(has_phase, "phase").otherwise("hardcall")


def count_where(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: x))


def code_ploidy_issues(codes: Column, sexes: Column, male: Column, female: Column) -> Column:
    """struct(haploid_het_incompatible, absent_nonmissing, unknown_sex) of a row; sexes: 1 men, 2 women, others unknown.

    Where men and women differ a sample of unknown sex is skipped and counted.
    """
    differs = male != female
    ploidy = lambda s: F.when(s == 1, male).when(s == 2, female).when(~differs, male)
    het = F.zip_with(codes, sexes, lambda g, s: (ploidy(s) == 1) & (g == HET))
    there = F.zip_with(codes, sexes, lambda g, s: (ploidy(s) == 0) & (g != MISSING))
    unknown = F.when(differs, F.size(F.filter(sexes, lambda s: ~s.isin(1, 2)))).otherwise(0)
    return F.struct(count_where(het).alias("haploid_het_incompatible"), count_where(there).alias("absent_nonmissing"), unknown.alias("unknown_sex"))


def pair_ploidy_issues(pairs: Column, dosage: Column, sexes: Column, male: Column, female: Column) -> Column:
    """As ``code_ploidy_issues`` for allele pairs and dosages."""
    differs = male != female
    ploidy = lambda s: F.when(s == 1, male).when(s == 2, female).when(~differs, male)
    classes = pair_classes(pairs)
    het = F.zip_with(classes, sexes, lambda c, s: (ploidy(s) == 1) & (c == "het"))
    malformed = F.transform(classes, lambda c: c == "malformed_partial")
    hard = F.zip_with(classes, sexes, lambda c, s: (ploidy(s) == 0) & (c != "fully_missing"))
    dose = F.zip_with(dosage, sexes, lambda d, s: (ploidy(s) == 0) & (d != NONE))
    unknown = F.when(differs, F.size(F.filter(sexes, lambda s: ~s.isin(1, 2)))).otherwise(0)
    names = ("haploid_het_incompatible", "malformed_partial", "absent_hardcall", "absent_dosage")
    return F.struct(*[count_where(v).alias(k) for k, v in zip(names, (het, malformed, hard, dose), strict=True)], unknown.alias("unknown_sex"))
