"""Summary statistics: import, identifiers, harmonisation, and projection onto a vmap."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from varloom.functions import stats
from varloom.functions.alleles import allele_reason, is_swap, norm_allele, parse_pos, variant_id
from varloom.model import VariantObject
from varloom.operators.variants import classified
from varloom.scratch import materialize

VARIANT_COLUMNS = ("CHR", "POS", "SNP", "EffectAllele", "OtherAllele")
#: Payload columns, in the order in which they are written.
PAYLOAD = ("P", "Z", "N", "BETA", "OR", "SE", "ORL95", "ORU95", "CaseN", "ControlN", "StudyN", "INFO", "Direction", "EAF", "CaseEAF", "ControlEAF")
OTHER_FREQUENCIES = {"EAF": "OAF", "CaseEAF": "CaseOAF", "ControlEAF": "ControlOAF"}
SKIPPED_IDS = ("", ".")

# Columns that metadata name


def plain_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "", name).lower()


def resolve(columns: Sequence[str], meta: dict, keys: Sequence[str], loose: bool = False) -> dict[str, str]:
    """Canonical name to column name, for the ``col_*`` entries of metadata.

    Strict: a name must be there as it is, or once in another case. Loose:
    letters and digits alone decide. A name that fits no column or several is an error.
    """
    folded = {k.lower(): k for k in meta}
    if len(folded) < len(meta):
        raise ValueError("metadata keys that differ in case only")
    out = {}
    for key in keys:
        want = meta.get(folded.get(f"col_{key}".lower(), ""))
        if want is None:
            continue
        fits = [c for c in columns if plain_name(c) == plain_name(want)] if loose else [c for c in columns if c == want] or [c for c in columns if c.lower() == want.lower()]
        if len(fits) != 1:
            raise ValueError(f"col_{key}: {want!r} names {len(fits)} columns")
        out[key] = fits[0]
    return out


def joined_field(c: Column, which: int) -> Column:
    """Part ``which`` of a value like ``1:100:A:G`` or ``1_100_A_G``; another value as it is."""
    parts = F.filter(F.split(c, "[:_]"), lambda x: x != "")
    return F.when(c.rlike("[:_]") & (F.size(parts) > which), F.get(parts, F.lit(which))).otherwise(c)


def rewrite_joined(c: Column, new: dict[int, Column]) -> Column:
    """``c`` with parts replaced and its delimiters kept. A value that is not joined becomes CHR_POS:EA:OA, ``n/a`` for what is not given."""
    tokens = F.regexp_extract_all(c, F.lit("([^:_]+)"), 1)
    between = F.regexp_extract_all(c, F.lit("([:_]+|$)"), 1)
    lead = F.regexp_extract(c, "^[:_]*", 0)
    tails = F.when(F.length(lead) > 0, F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(0)))).otherwise(between)
    changed = F.transform(tokens, lambda t, i: _pick(t, i, new))
    kept = F.concat(lead, F.array_join(F.zip_with(changed, tails, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), ""))
    part = lambda k: F.coalesce(new.get(k, F.lit(None)).cast("string"), F.lit("n/a"))
    built = F.concat(part(0), F.lit("_"), part(1), F.lit(":"), part(2), F.lit(":"), part(3))
    return F.when(c.rlike("[:_]"), kept).otherwise(built if len(new) > 1 else next(iter(new.values())).cast("string"))


def _pick(old: Column, i: Column, new: dict[int, Column]) -> Column:
    out = old
    for k, v in new.items():
        out = F.when(i == k, v.cast("string")).otherwise(out)
    return out


# Import


def _with_reason(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.select("chrom", F.col("pos").cast("long").alias("pos"), "id", "a1", "a2", reason.alias("reason"), "source_shard", "source_index", "ord")


def _fields(df: DataFrame, names: dict[str, str]) -> dict[str, Column]:
    """The joined columns of the variant, each with its own part."""
    places = {"CHR": 0, "POS": 1, "EffectAllele": 2, "OtherAllele": 3}
    return {k: joined_field(F.col(f"`{names[k]}`"), i) for k, i in places.items() if k in names}


def import_sumstats(
    sumstats: DataFrame, meta: dict, genome_build: str = "unknown", contig_naming: str | None = None, id_lookup: VariantObject | None = None, contigs: str | None = None, max_allele_length: int = 150
) -> tuple[VariantObject, DataFrame]:
    """(vmap of the variants of a table of strings with ``source_index``, import QC).

    With ``id_lookup`` chromosome and position come from the variant table of
    that object with the same id; it also gives build and naming.
    """
    names = resolve([c for c in sumstats.columns if c != "source_index"], meta, VARIANT_COLUMNS)
    need = ("EffectAllele", "OtherAllele", "SNP") if id_lookup else ("CHR", "POS", "EffectAllele", "OtherAllele")
    lacks = [k for k in need if k not in names]
    if lacks:
        raise ValueError(f"metadata must name the columns {lacks}")
    if id_lookup and ("CHR" in names or "POS" in names):
        raise ValueError("with an id lookup metadata must not name CHR or POS")
    f = _fields(sumstats, names)
    snp = F.trim(F.col(f"`{names['SNP']}`")) if "SNP" in names else F.lit(".")
    base = sumstats.select(
        *[v.alias(f"__{k}") for k, v in f.items()], snp.alias("__snp"), norm_allele(f["EffectAllele"]).alias("a1"), norm_allele(f["OtherAllele"]).alias("a2"),
        F.lit(".").alias("source_shard"), F.col("source_index"), F.col("source_index").alias("ord"),
    )
    absent = F.lit(False)
    for k in f:
        absent = absent | stats.is_missing_token(F.col(f"__{k}"))
    reason = F.when(absent, "malformed_row").otherwise(allele_reason(F.col("a1"), F.col("a2"), max_allele_length))
    if id_lookup is None:
        ident = F.when(F.coalesce(F.col("__snp"), F.lit("")) == "", ".").otherwise(F.col("__snp"))
        rows = base.withColumns({"chrom": F.trim("__CHR"), "pos": parse_pos(F.col("__POS")), "id": ident})
        reason = F.coalesce(reason, F.when(F.col("pos").isNull(), "malformed_row"))
        vo_df, qc = classified(_with_reason(rows, reason), contigs)
        return VariantObject(vo_df, genome_build, contig_naming), qc
    # Ids that many rows share, empty ones above all, stay out of the join.
    usable = ~F.coalesce(F.col("__snp"), F.lit("")).isin(*SKIPPED_IDS)
    known = id_lookup.df.select(F.trim("id").alias("__snp"), "chrom", "pos").filter(~F.col("__snp").isin(*SKIPPED_IDS))
    known = known.groupBy("__snp").agg(F.count("*").alias("__hits"), F.first("chrom").alias("chrom"), F.first("pos").alias("pos"))
    found = base.filter(usable).join(known, "__snp", "left")
    rest = base.filter(~usable).withColumns({"__hits": F.lit(None).cast("long"), "chrom": F.lit(None).cast("string"), "pos": F.lit(None).cast("long")})
    rows = found.unionByName(rest).withColumn("id", F.col("__snp"))
    late = F.when(~usable, "invalid_id").when(F.col("__hits") > 1, "ambiguous_id_match").when(F.col("__hits").isNull(), "id_not_found")
    vo_df, qc = classified(_with_reason(rows, F.coalesce(reason, late)), contigs)
    return VariantObject(vo_df, id_lookup.genome_build, id_lookup.contig_naming), qc


# Harmonisation


def model_of(meta: dict) -> str | None:
    model = meta.get("stats_Model")
    model = {"linear mixed-model": "linear", "logistic mixed-model": "logistic"}.get(model, model)
    if model in ("ordinal", "cox", "other"):
        raise ValueError(f"model {model!r} is not implemented")
    return model


def _number(meta: dict, key: str) -> float | None:
    try:
        return float(meta[key])
    except (KeyError, TypeError, ValueError):
        return None


def rules(model: str | None, meta: dict, use_af_inference: bool) -> list[tuple[str, tuple[str, ...], Callable[..., Column] | float]]:
    """(column, columns that it is derived from, formula or constant), in order."""
    out: list = []
    if model == "linear" and (n := _number(meta, "stats_TotalN")) is not None:
        out.append(("N", (), n))
    if model == "logistic":
        out += [(c, (), n) for c in ("CaseN", "ControlN") if (n := _number(meta, f"stats_{c}")) is not None]
        out += [
            ("N", ("CaseN", "ControlN"), stats.neff),
            ("EAF", ("CaseEAF", "ControlEAF", "CaseN", "ControlN"), stats.af_from_case_control),
            ("BETA", ("OR",), stats.beta_from_or),
            ("SE", ("ORU95", "ORL95"), stats.se_from_or_ci),
        ]
    out += [
        ("Z", ("P", "BETA"), stats.z_from_p_beta),
        ("Z", ("BETA", "SE"), stats.z_from_beta_se),
        ("P", ("Z",), stats.p_from_z),
        ("SE", ("Z", "BETA"), stats.se_from_z_beta),
        ("BETA", ("Z", "SE"), stats.beta_from_z_se),
    ]
    if use_af_inference:
        out += [("N", ("Z", "BETA", "EAF"), stats.n_from_z_beta_af), ("BETA", ("Z", "N", "EAF"), stats.beta_from_z_n_af), ("SE", ("Z", "N", "EAF"), stats.se_from_z_n_af)]
    return out


def present_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that have a value in some row; one aggregate."""
    if not columns:
        return []
    row = df.agg(*[F.count_if(~stats.is_missing_token(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"c{i}"]]


def harmonize_sumstats(df: DataFrame, meta: dict, fill_mode: str = "column", use_af_inference: bool = False) -> DataFrame:
    """Canonical payload columns of a table of strings, derived, checked and in order; all other columns are kept in front.

    ``column``: a rule makes a column that is not there. ``row``: it also fills
    the cells of one that is. Which columns are there is asked once, of the
    whole table, so pass a table that is cheap to read again.
    """
    if fill_mode not in ("column", "row"):
        raise ValueError(f"unsupported fill mode: {fill_mode!r}")
    model = model_of(meta)
    names = resolve(df.columns, meta, (*PAYLOAD, *OTHER_FREQUENCIES.values()), loose=True)
    there = present_columns(df, list(names.values()))
    names = {k: c for k, c in names.items() if c in there}
    neglog, log = bool(meta.get("stats_neglog10P")), bool(meta.get("stats_log10P"))
    if neglog and log:
        raise ValueError("stats_neglog10P and stats_log10P exclude each other")
    if (neglog or log) and "P" not in names:
        raise ValueError("a scale of P is given but there is no P")
    other = [c for c in df.columns if c not in names.values()]
    value = {}
    for k, c in names.items():
        if k == "Direction":
            value[k] = F.col(f"`{c}`")
            continue
        x = stats.numeric(F.col(f"`{c}`"))
        if k == "P" and (neglog or log):
            x = F.pow(F.lit(10.0), -x if neglog else x)
        value[k] = stats.in_range(k, x)
    out = df.select(*[F.col(f"`{c}`") for c in other], *[v.alias(k) for k, v in value.items()])
    for k, o in OTHER_FREQUENCIES.items():
        if o in value:
            out = (out if k in value else out.withColumn(k, 1.0 - F.col(o))).drop(o)
    have = {c for c in out.columns if c not in other}
    for name, inputs, formula in rules(model, meta, use_af_inference):
        if any(i not in have for i in inputs) or (name in have and fill_mode == "column"):
            continue
        made = F.lit(formula) if isinstance(formula, float) else stats.no_nan(formula(*inputs))
        out = out.withColumn(name, F.coalesce(F.col(name), made) if name in have else made)
        have.add(name)
    done = [F.col(k) if k == "Direction" else stats.in_range(k, F.col(k)).alias(k) for k in PAYLOAD if k in have]
    return out.select(*[F.col(f"`{c}`") for c in other], *done)


# Projection


def attach_payload(vmap: VariantObject, payload: DataFrame) -> DataFrame:
    """Every row of a vmap with the payload row it names (null without a source), as a table.

    Rows without a source have keys of their own that no payload row has, so they are spread
    over the join. A source that the payload lacks is an error: the join's one
    pass observes it.
    """
    c = F.col
    mapped = c("source_index") != -1
    seen = Observation()
    joined = payload_join(vmap, payload).observe(
        seen,
        F.min(F.when(mapped & (c("source_shard") != "."), c("source_shard"))).alias("shard"),
        F.min(F.when(mapped & c("__there").isNull(), c("source_index"))).alias("gone"),
    )
    out = materialize(joined.drop("__key", "__there"))
    if (shard := seen.get.get("shard")) is not None:
        raise ValueError(f"summary statistics have no shard {shard!r}")
    if (gone := seen.get.get("gone")) is not None:
        raise ValueError(f"source row {gone} is out of range")
    return out


def payload_join(vmap: VariantObject, payload: DataFrame) -> DataFrame:
    """The join of ``attach_payload``. A payload that ``save_payload`` has bucketed stays where it is; only the vmap is shuffled."""
    c = F.col
    mapped = c("source_index") != -1
    left = vmap.df.withColumn("__key", F.when(mapped, c("source_index")).otherwise(-1 - F.abs(F.xxhash64("ord") % F.lit(1 << 62))))
    right = payload.select(*[c(f"`{x}`").alias(f"p__{x}") if x != "source_index" else c("source_index").alias("__key") for x in payload.columns], F.lit(True).alias("__there"))
    return left.join(right, "__key", "left")


def _inverse(x: Column) -> Column:
    return F.when(x != 0, 1.0 / x)


def swap_effects(value: dict[str, Column], swap: Column) -> dict[str, Column]:
    """Numeric columns as they are after the two alleles change places where ``swap`` holds; Direction and the rest stay."""
    out = dict(value)
    turned = lambda k, v: F.when(swap, v).otherwise(value[k])
    for k in ("BETA", "Z"):
        if k in value:
            out[k] = turned(k, -value[k])
    if "OR" in value:
        out["OR"] = turned("OR", _inverse(value["OR"]))
    for k, o in (("ORL95", "ORU95"), ("ORU95", "ORL95")):
        if k in value:
            # The bounds of an interval turn together or not at all.
            whole = _inverse(value[k]).isNotNull()
            out[k] = turned(k, F.when(whole, _inverse(value.get(o, value[k]))))
    for k in (*OTHER_FREQUENCIES, *OTHER_FREQUENCIES.values()):
        if k in value:
            out[k] = turned(k, 1.0 - value[k])
    return out


TURNED = ("BETA", "Z", "OR", "ORL95", "ORU95", *OTHER_FREQUENCIES, *OTHER_FREQUENCIES.values())


def swap_warnings(df: DataFrame, value: dict[str, Column], swap: Column, raw: dict[str, Column] | None = None) -> DataFrame:
    """One row: for each column that a swap turns, the swapped cells that say something but have no turned value.

    ``raw``: the cells as they were read; without it, ``value`` itself.
    """
    after = swap_effects(value, swap)
    said = lambda k: ~stats.is_missing_token(raw[k].cast("string")) & ~F.lower(F.trim(raw[k].cast("string"))).isin("na", "n/a") if raw else value[k].isNotNull()
    lost = lambda k: after[k].isNull() | F.isnan(after[k]) | (F.abs(after[k]) == float("inf"))
    return df.agg(*[F.count_if(swap & said(k) & lost(k)).alias(k) for k in TURNED if k in value] or [F.lit(0).alias("none")])


def warn_of_swaps(counts: DataFrame) -> None:
    for name, n in counts.first().asDict().items():
        if n:
            warnings.warn(f"{n} values of {name} could not be turned and are missing now", stacklevel=3)


def named_columns(columns: Sequence[str], meta: dict) -> tuple[dict[str, str], dict[str, str]]:
    """(the variant columns that are there, those that metadata names but the table lacks) for output in the input's form.

    The chromosome must be there. A column that is not can stand for one field only.
    """
    folded = {k.lower(): v for k, v in meta.items()}
    there, absent = {}, {}
    for key in VARIANT_COLUMNS:
        want = folded.get(f"col_{key}".lower())
        if want is None:
            continue
        fits = [c for c in columns if c == want] or [c for c in columns if c.lower() == want.lower()][-1:]
        if fits:
            there[key] = fits[0]
        elif want in absent.values():
            raise ValueError(f"{want!r} is not there and is to hold several fields")
        else:
            absent[key] = want
    if "CHR" not in there:
        raise ValueError("metadata must name the column of the chromosome, and the table must have it")
    return there, absent


def apply_to_sumstats(
    vmap: VariantObject, sumstats: DataFrame, meta: dict, clean: bool = False, fill_mode: str = "column", use_af_inference: bool = False, only_mapped: bool = False, retain_id: bool = False, warn: bool = False
) -> DataFrame:
    """The summary statistics of a vmap's targets, in ``ord``.

    Clean: CHR, POS, SNP, alleles and harmonised payload; with ``only_mapped``
    rows without P go, and none left is an error. Otherwise the input columns,
    with the variant overwritten in place and its effects turned; ``n/a`` is
    missing. There, variant columns that metadata names but the table lacks come last.
    ``warn`` counts, in a job of its own, the values that a swap could not turn.
    """
    c = F.col
    ident = c("id") if retain_id else variant_id(c("chrom"), c("pos"), c("a1"), c("a2"))
    vmap = vmap.with_df(vmap.df.select(*vmap.columns))
    if only_mapped:
        vmap = vmap.with_df(vmap.df.filter("source_index <> -1"))
    variant = {"CHR": c("chrom"), "POS": c("pos"), "SNP": ident, "EffectAllele": c("a1"), "OtherAllele": c("a2")}
    if clean:
        names = resolve([x for x in sumstats.columns if x != "source_index"], meta, VARIANT_COLUMNS, loose=True)
        if lacks := [k for k in ("CHR", "POS", "EffectAllele", "OtherAllele") if k not in names]:
            raise ValueError(f"metadata must name the columns {lacks}")
        joined = attach_payload(vmap, sumstats)
        inner = joined.select("ord", *[c(f"`p__{x}`").alias(x) for x in sumstats.columns if x != "source_index"], *[c(x).alias(f"v__{x}") for x in (*variant_source(), "source_index", "allele_op")])
        made = harmonize_sumstats(inner, meta, fill_mode, use_af_inference)
        payload = [k for k in PAYLOAD if k in made.columns]
        # A constant is no value of a row that has no source.
        value = {k: F.when(c("v__source_index") != -1, c(k)) for k in payload}
        turned = swap_effects(value, is_swap(c("v__allele_op")))
        if warn:
            warn_of_swaps(swap_warnings(made, value, is_swap(c("v__allele_op"))))
        out = made.withColumns({x: c(f"v__{x}") for x in variant_source()}).select("ord", *[v.alias(k) for k, v in variant.items()], *[turned[k].alias(k) for k in payload])
        if only_mapped:
            out = out.filter("P is not null") if "P" in payload else out.limit(0)
            if out.isEmpty():
                raise ValueError("no mapped row has a P value")
        return out
    own = [x for x in sumstats.columns if x != "source_index"]
    names, absent = named_columns(own, meta)
    names |= resolve(own, meta, (*PAYLOAD, *OTHER_FREQUENCIES.values()))
    joined = attach_payload(vmap, sumstats)
    swap, mapped = is_swap(c("allele_op")), c("source_index") != -1
    places = {"CHR": 0, "POS": 1, "EffectAllele": 2, "OtherAllele": 3}
    by_column: dict[str, dict[int, Column]] = {}
    for k, i in places.items():
        if k in names:
            by_column.setdefault(names[k], {})[i] = variant[k]
    numbers = {k: stats.numeric(c(f"`p__{names[k]}`")) for k in (*PAYLOAD, *OTHER_FREQUENCIES.values()) if k in names and k != "Direction"}
    turned = swap_effects(numbers, swap)
    changed = {names[k]: v for k, v in turned.items() if v is not numbers[k]}
    if warn:
        warn_of_swaps(swap_warnings(joined, numbers, swap & mapped, {k: c(f"`p__{names[k]}`") for k in numbers}))
    out = []
    for x in sumstats.columns:
        if x == "source_index":
            continue
        raw = c(f"`p__{x}`").cast("string")
        if x in by_column:
            new = by_column[x]
            whole = next(iter(new.values())).cast("string") if len(new) == 1 else rewrite_joined(F.coalesce(raw, F.lit("")), new)
            out.append(F.when(raw.rlike("[:_]"), rewrite_joined(raw, new)).otherwise(whole).alias(x))
        elif x == names.get("SNP"):
            out.append(ident.alias(x))
        elif x in changed:
            # What is not turned stays as it was written.
            text = F.when(swap, changed[x].cast("string")).otherwise(raw)
            out.append(F.when(mapped, F.coalesce(text, F.lit("n/a"))).otherwise("n/a").alias(x))
        else:
            out.append(F.when(mapped, F.coalesce(raw, F.lit("n/a"))).otherwise("n/a").alias(x))
    more = [variant[k].cast("string").alias(name) for k, name in absent.items()]
    return joined.select("ord", *out, *more)


def variant_source() -> tuple[str, ...]:
    return ("chrom", "pos", "id", "a1", "a2")
