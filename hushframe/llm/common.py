"""Shared plumbing: the cluster's scratch folder, tables that cut lineage, and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import drop_at_exit, scratch_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/hushframe-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that later plans start from
    files any executor can read; a lost executor costs a task, not the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    drop_at_exit(spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files behind a materialized table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(id_col: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def byte_slices(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Re-slice batches so that each carries at most about `limit` bytes of `column` (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist() if batch.num_rows else []
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, end of each); nulls are empty."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, bounds[1:] - bounds[0]


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def with_release(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow body that gives freed memory back to the system when its task ends: workers live on, and what
    a stage has freed but kept would count beside the next stages' memory."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return body


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str, how: str = "inner", parts: int = 1000) -> DataFrame:
    """rows joined to keyed (one row a key, with the number of rows it meets in `weight`); a key that meets more than a
    `parts`-th of all is dealt to several tasks. Fewer than `parts` keys can, so their table is broadcast."""
    every = keyed.agg(F.sum(weight).alias("_every"))
    hot = keyed.select(key, F.col(weight).alias("_w")).crossJoin(F.broadcast(every)).where(F.col("_w") * parts > F.col("_every"))
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_w") * parts / F.col("_every")).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), salts).cast("int")).drop("_salts")
    right = keyed.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
