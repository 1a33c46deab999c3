"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, set as the session's checkpoint folder. Without one only a local master is given a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A new folder below it."""
    return f"{checkpoint_folder(spark).rstrip('/')}/loomspan-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint: its plan is short, and lost executors cost nothing before it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table below the checkpoint folder. Its size is known, so Spark broadcasts it if it is small; the shuffle files behind it go once it is written."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)
