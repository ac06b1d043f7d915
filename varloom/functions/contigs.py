"""Contig labels of four naming schemes."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL = (*[str(i) for i in range(1, 23)], "X", "Y", "MT")
NAMINGS = ("ncbi", "ucsc", "plink", "plink_splitx")

# Other spellings of a contig, in lower case and without "chr".
SYNONYMS = {
    "x": "X", "xy": "X", "y": "Y", "m": "MT", "mt": "MT",
    "par": "X", "par1": "X", "par2": "X", "x_par1": "X", "x_par2": "X", "x_nonpar": "X", "nonpar": "X",
    "23": "X", "24": "Y", "25": "X", "26": "MT",
}


def _number(c: str) -> str:
    return {"X": "23", "Y": "24", "MT": "26"}.get(c, c)


def labels(naming: str) -> dict[str, str]:
    """Label to canonical contig of one naming."""
    if naming == "ncbi":
        return {c: c for c in CANONICAL}
    if naming == "ucsc":
        return {"chrM" if c == "MT" else f"chr{c}": c for c in CANONICAL}
    if naming in ("plink", "plink_splitx"):
        out = {_number(c): c for c in CANONICAL}
        return out | {"25": "X"} if naming == "plink_splitx" else out
    raise ValueError(f"unsupported contig naming: {naming}")


def lookup(c: Column, values: dict) -> Column:
    """A literal map; null for what it lacks."""
    if not values:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())]), c)


def _plain(c: Column) -> Column:
    """Without leading zeros of a number: 01 is 1."""
    return F.regexp_replace(c, r"^(chr)?0+(?=[0-9])", "$1")


def canonical(label: Column, naming: str) -> Column:
    return lookup(_plain(F.trim(label)), labels(naming))


def canonical_any(label: Column) -> Column:
    """The contig of a label that is right in some naming, if all namings that know it agree."""
    known: dict[str, set[str]] = {}
    for naming in NAMINGS:
        for k, v in labels(naming).items():
            known.setdefault(k, set()).add(v)
    return lookup(_plain(F.trim(label)), {k: next(iter(v)) for k, v in known.items() if len(v) == 1})


def normalize_label(label: Column) -> Column:
    """The contig of a label in any spelling, or null."""
    low = _plain(F.regexp_replace(F.lower(F.trim(label)), "^chr", ""))
    return lookup(low, {str(i): str(i) for i in range(1, 23)} | SYNONYMS)


def render(contig: Column, naming: str) -> Column:
    return lookup(contig, {v: k for k, v in labels("plink" if naming == "plink_splitx" else naming).items()})


def convert(label: Column, source: str, target: str) -> Column:
    return label if source == target else render(canonical(label, source), target)


def rank(contig: Column) -> Column:
    """1 to 25, in the order of ``CANONICAL``."""
    return lookup(contig, {c: i for i, c in enumerate(CANONICAL, 1)})


def contig_list(spec: str) -> list[str]:
    """The contigs of a text like ``1-5,X,chrM``: each once, in the order given."""
    spelled = {str(i): str(i) for i in range(1, 23)} | SYNONYMS
    out: list[str] = []
    for part in (p.strip() for p in spec.split(",")):
        low, dash, high = (x.strip().lower().removeprefix("chr") for x in part.partition("-"))
        if dash and low.isdigit() and high.isdigit() and int(low) <= int(high):
            found = [spelled.get(str(i)) for i in range(int(low), int(high) + 1)]
        else:
            found = [None if dash else spelled.get(str(int(low)) if low.isdigit() else low)]
        if None in found:
            raise ValueError(f"not a contig or a range of contigs: {part!r}")
        out += [c for c in dict.fromkeys(found) if c not in out]
    if not out:
        raise ValueError("no contigs given")
    return out


def shard_tokens() -> dict[str, str]:
    """What may stand for "@" in a path, and its contig."""
    out = dict(chain.from_iterable(labels(n).items() for n in NAMINGS))
    return out | {"XY": "X", "chrXY": "X"}


def naming_of(valid: Iterable[bool]) -> str | None:
    return next((n for n, ok in zip(NAMINGS, valid, strict=True) if ok), None)
