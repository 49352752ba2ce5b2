"""Cutting lineage in iterative operators: reliable checkpoints in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on one machine gets a folder of its own, as in tests; on
    a cluster that is an error, since executors do not share a machine's folders."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-tideline-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()
