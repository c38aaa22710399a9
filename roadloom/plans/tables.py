"""Tables that cut the lineage of iterative plans: written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="roadloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of a method beyond which the JVM never compiles it; Spark's own limit lets such methods run uncompiled.
LONG = "spark.sql.codegen.hugeMethodLimit", "8000"


def kept(df: DataFrame, tag: str = "step", long: bool = False) -> DataFrame:
    """long: rows of so many expressions that as one method they would run uncompiled; they are split into several."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/network-{tag}-{uuid.uuid4().hex}", spark.conf.get(LONG[0])
    if long:
        spark.conf.set(*LONG)
    try:
        df.write.parquet(path)
    finally:
        if long:
            spark.conf.set(LONG[0], before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table that kept() gave, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def file_bytes(df: DataFrame) -> int:
    """Bytes on disk of a kept table."""
    spark, total = df.sparkSession, 0
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def shares(spark: SparkSession, path: str, each: int = 4 << 20) -> int:
    """Partitions for a shuffle of a table's rows such that one has no more than `each` bytes of its files; at least the session's."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = file.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(file).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-length // each))


def broadcasts(spark: SparkSession, path: str) -> bool:
    """Whether Spark is sure to broadcast what is read from a file, by its bytes."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = file.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(file).getLength()
    return 2 * length <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def sized(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """A kept table with a broadcast hint if its files are that small; a larger one is joined by shuffle."""
    return F.broadcast(df) if file_bytes(df) <= most else df
