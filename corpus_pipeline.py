"""A training corpus from raw documents: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.bagminhash import drop_near_duplicates
from varloom.llm.common import bound_batches, materialize, table
from varloom.llm.decontam import decontaminate
from varloom.llm.langid import identify
from varloom.llm.linededup import dedup_lines
from varloom.llm.mixing import mix
from varloom.llm.queries import remainder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the model rejects; the rest are unchanged."""
    bound_batches(spark)
    return identify(docs, remainder(3) != 1).filter("not rejected").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document has, and documents of which nothing is left; ``n_chars`` follows the text."""
    bound_batches(spark)
    out = dedup_lines(docs)
    left = out.filter((F.length("text") > 0) | (F.col("n_dropped") == 0))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near duplicates."""
    bound_batches(spark)
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that give a benchmark item away."""
    bound_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with the words that it takes of each."""
    taken = mix(docs, carry=("text", "lang")).filter("taken > 0")
    return taken.select("doc_id", "text", "lang", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mixture", mixture),
]

#: SQL cannot express the first, third and fourth stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table: the documents that the mix takes, with the words that it takes of each.

    Between stages the documents are written as Parquet and read again. Rows
    without an id go through; rows without a text end at the first stage.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
