"""Variant views of the star-schema tables, as SQL that Spark and DuckDB both read.

A text has table names in braces; views stand in each other as sub-queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.scratch import materialize, small_methods

TABLES = ("orders", "lineitem", "customer")

SITES = """SELECT ord, g % 25 AS ci, CASE WHEN g % 25 = 24 THEN 1 + (g * 7919) % 16569 ELSE 1 + (g * 7919) % 200003 END AS pos
FROM (SELECT o_orderkey AS ord, CAST(floor(o_orderkey / 3) AS BIGINT) AS g FROM {orders}) o1"""

#: Three alleles at each site; a2 is the base of the reference, which has a closed form.
TARGET = f"""SELECT ord, CASE WHEN ci < 22 THEN CAST(ci + 1 AS STRING) WHEN ci = 22 THEN 'X' WHEN ci = 23 THEN 'Y' ELSE 'MT' END AS chrom, pos,
concat('rs', CAST(ord AS STRING)) AS id,
substr('ACGT', CAST(1 + (r + 1 + ord % 3) % 4 AS INT), 1) AS a1, substr('ACGT', CAST(1 + r AS INT), 1) AS a2
FROM (SELECT ord, ci, pos, ((pos * 7919 + ci * 104729) % 97) % 4 AS r FROM ({SITES}) o2) o3"""

#: Rows of a vmap: as the target, swapped, complemented, with a longer allele, and some without a source.
#: Their place is unique by order, line, part and supplier: the line number alone repeats.
PLACE = "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"
SOURCE = f"""SELECT {PLACE} AS ord, chrom, pos, id,
CASE l_partkey % 5 WHEN 2 THEN a2 WHEN 3 THEN translate(a1, 'ACGT', 'TGCA') WHEN 4 THEN concat(a1, 'A') ELSE a1 END AS a1,
CASE l_partkey % 5 WHEN 2 THEN a1 WHEN 3 THEN translate(a2, 'ACGT', 'TGCA') ELSE a2 END AS a2,
'.' AS source_shard, CASE WHEN l_partkey % 11 = 0 THEN -1 ELSE {PLACE} END AS source_index,
CASE WHEN l_partkey % 11 = 0 THEN 'missing' WHEN l_suppkey % 7 = 0 THEN 'swap' WHEN l_suppkey % 7 = 1 THEN 'flip' WHEN l_suppkey % 7 = 2 THEN 'flip_swap' ELSE 'identity' END AS allele_op
FROM {{lineitem}} l1 JOIN ({TARGET}) t1 ON l_orderkey = t1.ord"""

#: A table of strings, with cells that are missing or out of range.
SUMSTATS = f"""SELECT s.ord AS source_index, CAST(s.chrom AS STRING) AS chr, CAST(s.pos AS STRING) AS bp, s.id AS snp, lower(s.a1) AS ea, s.a2 AS oa,
CASE WHEN l_partkey % 13 = 0 THEN '' ELSE CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) % 2001 - 1000 AS STRING) END AS beta_milli,
CASE WHEN l_suppkey % 17 = 0 THEN '-1' WHEN l_suppkey % 19 = 0 THEN 'NA' ELSE CAST(1 + l_partkey % 97 AS STRING) END AS se_milli,
CASE WHEN l_suppkey % 23 = 0 THEN 'inf' ELSE CAST((l_suppkey % 100 + 1) / 101.0e0 AS STRING) END AS p,
CASE WHEN l_partkey % 29 = 0 THEN '1.5' ELSE CAST(CAST(floor(l_tax * 100 + 0.5) AS BIGINT) / 10.0e0 AS STRING) END AS eaf,
CAST(CAST(floor(l_quantity) AS BIGINT) * 1000 AS STRING) AS n, CASE WHEN l_partkey % 2 = 0 THEN '+-' ELSE '?+' END AS dir
FROM {{lineitem}} l2 JOIN ({SOURCE}) s ON s.ord = {PLACE}"""

#: Identifiers: some missing, some on several rows.
IDS = f"""SELECT ord, chrom, pos, CASE WHEN ord % 17 = 0 THEN '.' WHEN ord % 11 = 0 THEN concat('rs', CAST(ord - ord % 22 AS STRING)) ELSE id END AS id, a1, a2 FROM ({TARGET}) t2"""

SAMPLES = """SELECT CASE WHEN c_nationkey % 2 = 0 THEN 's1' ELSE 's2' END AS source_shard, CAST(c_custkey AS INT) AS local_idx,
concat('F', CAST(c_custkey % 50 AS STRING)) AS fid, concat('I', CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING)) AS iid, CAST(c_custkey % 3 AS INT) AS sex FROM {customer} c1"""

#: Blocks of four chains for each contig: one has a gap behind it, one is on the minus strand, one of X leads to an autosome.
CHAIN_ROWS = [
    (contig, start, end, "7" if contig == "X" and k == 2 else contig, 1000 * (k + 1) + start, "-" if k == 1 else "+", 4 * i + k, 1000.0 - 10 * k)
    for i, contig in enumerate([*[str(n) for n in range(1, 23)], "X", "Y", "MT"])
    for k, (start, end) in enumerate(((0, 50_000), (50_000, 100_000), (100_000, 140_000), (150_000, 200_003)))
]


def fill(sql: str, names: dict[str, str] | None = None) -> str:
    """A text with its tables named."""
    return sql.format(**(names or {t: t for t in TABLES}))


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    small_methods(spark)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **tables)


def genome(sites: DataFrame, shift: int = 0, size: int = 256, around: int = 1) -> DataFrame:
    """(contig, block, seq) of the closed-form genome: the blocks of some (chrom, pos) and their neighbours."""
    names = [*[str(n) for n in range(1, 23)], "X", "Y", "MT"]
    number = F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)]), F.col("contig"))
    # Sites become blocks before these get their neighbours: there are far fewer.
    own = sites.select(F.col("chrom").alias("contig"), F.floor((F.col("pos") - 1) / size).alias("own")).distinct()
    near = own.select("contig", F.explode(F.sequence(F.col("own") - around, F.col("own") + around)).alias("block"))
    blocks = near.filter("block >= 0").distinct().withColumn("ci", number)
    base = lambda p: F.substr(F.lit("ACGT"), (1 + ((p * 7919 + F.col("ci") * 104729 + shift) % 97) % 4).cast("int"), F.lit(1))
    return materialize(blocks.select("contig", "block", F.array_join(F.transform(F.sequence(F.col("block") * size + 1, (F.col("block") + 1) * size), base), "").alias("seq")))


def chain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHAIN_ROWS, "src_contig string, s_start long, s_end long, tgt_contig string, t_start long, strand string, chain_id long, score double")
