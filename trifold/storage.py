"""Intermediate tables in the folder that the driver and all executors share, and the size of batches that reach Python."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trifold-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def write_shared(df: DataFrame, name: str, **options: str) -> str:
    """Write df as Parquet into the shared folder and return the path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: write df into the shared folder and read it again."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, name))


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete a table written by write_shared once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The intermediate tables of one run: written by cut, deleted when the run is over.

    What the run returns must not read them: `result` writes it as a table that stays.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(write_shared(df, name))
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return cut(df, name)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            drop_shared(self.spark, path)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches by bytes as well as by rows, so that very long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


#: Bytes a core below which a table is dealt anew before Python reads it.
SMALL = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of a file or two dealt to all cores, before work in Python that takes far longer than moving it; larger ones as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
