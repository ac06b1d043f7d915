"""One query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.attribution import attribute_tokens
from varloom.llm.bagminhash import near_duplicates
from varloom.llm.common import table
from varloom.llm.decontam import contaminated_pairs
from varloom.llm.descriptors import draw, image_copies
from varloom.llm.dialogue import damage, repair
from varloom.llm.langid import identify
from varloom.llm.linededup import dedup_lines
from varloom.llm.linedist import extract
from varloom.llm.mixing import mix
from varloom.llm.periodic import collapse_runs
from varloom.llm.suffixtree import score_texts
from varloom.llm.vectorjoin import near_vectors
from varloom.llm.weaklabel import classify_quality


def remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), remainder(5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over pictures of all embeddings: there is no table of images."""
    return image_copies(draw(table(spark, sf_dir, "embeddings")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, remainder(3) != 1)
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op9_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated_pairs(docs, table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("edit"))
    out = collapse_runs(docs, edit_col="edit", digest=True)
    return out.withColumnRenamed("runs", "runs_sha256").withColumnRenamed("collapsed", "collapsed_sha256")


def op12_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair(damage(table(spark, sf_dir, "conversations"))).digests()
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_weak_labels": op2_weak_labels,
    "op3_token_counts": op3_token_counts,
    "op4_bagminhash": op4_bagminhash,
    "op5_image_copies": op5_image_copies,
    "op6_line_dedup": op6_line_dedup,
    "op7_mix": op7_mix,
    "op8_language_id": op8_language_id,
    "op9_line_blocks": op9_line_blocks,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_join": op12_vector_join,
    "op13_dialogue_repair": op13_dialogue_repair,
}

ORACLE_SQL = {
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, u.i, u.line, translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) u
), r AS (
  SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), k AS (
  SELECT l.doc_id, l.i, l.line, r.key IS NOT NULL AND l.doc_id <> r.first AS gone FROM l LEFT JOIN r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
""",
    "op7_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 15)) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source
), v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY source_size::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, max(level) OVER () * w) AS target FROM v
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), n AS (
  SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS extra FROM q
), c AS (
  SELECT source, h, sum(size) AS atom, sum(sum(size)) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto FROM d WHERE size > 0 GROUP BY source, h
), a AS (
  SELECT n.*, c.h AS at, c.atom, n.extra - c.upto + c.atom AS rest
  FROM n LEFT JOIN c ON c.source IS NOT DISTINCT FROM n.source AND c.upto >= n.extra AND c.upto - c.atom < n.extra AND n.extra > 0
)
SELECT d.doc_id, d.size, a.source_size, a.target,
       CAST(a.whole * d.size + CASE WHEN a.at IS NULL THEN 0 WHEN d.h < a.at THEN d.size WHEN d.h = a.at THEN (d.size::HUGEINT * a.rest) // a.atom ELSE 0 END AS BIGINT) AS taken
FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source
""",
}
