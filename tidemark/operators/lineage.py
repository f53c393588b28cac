"""Cuts of lineage into the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset and Spark is one process, as in tests."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        path = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_rdd(rdd: RDD, spark: SparkSession) -> RDD:
    """rdd in memory and in the shared folder, so that what a lost executor held is read again and not computed again."""
    shared_folder(spark)
    rdd = rdd.persist()
    rdd.checkpoint()
    rdd.count()
    return rdd
