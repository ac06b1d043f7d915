"""Scratch tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Only a session in local mode may go without one and gets a local folder:
    on a cluster other hosts could not read it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def small_methods(spark: SparkSession) -> None:
    """Generated methods of at most 8,000 bytes, unless the session has a bound of its own.

    HotSpot compiles no larger ones, so a stage of many expressions would be interpreted, at a fraction of the speed. Above
    the bound each of its operators is generated by itself, in methods that are small.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, "8000")


#: Whether a query's shuffle files go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a copy that outlives any executor.

    The shuffle files of the write go with its end; they would stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    small_methods(spark)
    path = scratch_dir(spark)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)
