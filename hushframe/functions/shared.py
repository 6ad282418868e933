"""The folder that all of a cluster's machines share, and tables that are written there once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or else the one set on the context. Where neither is set, as in tests, a
    folder below the warehouse is set, which a cluster shares too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_hushframe_scratch")
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have the files of a scratch table removed when the driver ends; results that are kept lie elsewhere."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: what is drawn or numbered in it stays as it is, however often it is read."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/hushframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
