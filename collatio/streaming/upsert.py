"""Cells kept up to date as files of cells arrive: a file stream merged batch by batch.

Each micro-batch is merged with the current table by last write per (unit, witness) and written
as a new version beside the old one; readers take the newest complete version. A batch that is
run again after a failure writes its version again, so the outcome is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from collatio.operators.matrix import upsert


def merge(current: DataFrame | None, batch: DataFrame, order: str = "ord") -> DataFrame:
    """The table after ``batch``: one row per (unit, witness), the last written."""
    both = batch if current is None else current.unionByName(batch)
    return upsert(both, order)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions under ``path`` in order, through Spark's file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("v")) for p in done if p.getName().startswith("v"))


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    have = versions(spark, path)
    return spark.read.parquet(f"{path}/v{have[-1]}") if have else None


def follow(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts the stream from Parquet files under ``source``; ``once`` stops when all files are merged."""

    def write(batch: DataFrame, number: int) -> None:
        before = [v for v in versions(spark, path) if v < number]
        current = spark.read.parquet(f"{path}/v{before[-1]}") if before else None
        merge(current, batch).write.mode("overwrite").parquet(f"{path}/v{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = stream.withColumn("ord", F.col("ord").cast("long")).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
