"""Tables cut from their lineage, in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches of whole texts are kept small: texts may be long, and JVM and Python hold a batch each.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on one machine gets a folder of its own, as in tests; on
    a cluster that is an error, since executors do not share a machine's folders."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tideline-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Written tables of one job: put() writes a DataFrame as Parquet and reads it back, drop() removes a table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def put(self, df: DataFrame, *, by: str | None = None) -> DataFrame:
        """Its shuffle files go as soon as the table is written: nothing reads them again."""
        self.n += 1
        path, writer, conf = f"{self.root}/{self.n}", df.write.option("compression", "zstd"), self.spark.conf
        before = {k: conf.get(k, None) for k in _WHILE_WRITING}
        for k, v in _WHILE_WRITING.items():
            conf.set(k, v)
        try:
            (writer.partitionBy(by) if by else writer).parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tideline_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Only for tables that nothing will read again."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._tideline_path)
            path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession) -> None:
    """Operators that send whole texts to Python keep Arrow batches to 1000 rows, unless the session has its own number:
    JVM and Python hold a batch each, and texts may be long. It stays set, since their plans run when the caller acts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")
