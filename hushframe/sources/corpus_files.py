"""Corpus files: quoted multi-line CSV in and out, outside corpora, token rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import corpus


def read_csv(spark: SparkSession, path: str, schema: str = "id long, text string") -> DataFrame:
    """Quoted CSV with a header and line ends inside quotes; an empty text is empty, not null."""
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"')
    return rows.withColumn("text", F.coalesce("text", F.lit("")))


def read_adversarial(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, "id long, category string, text string")
    rows = rows.withColumn("category", F.coalesce("category", F.lit("unknown")))
    return corpus.bio_rows(rows)


def read_annotated(spark: SparkSession, path: str, drop_empty: bool = False, pattern: str = rules.MARKER) -> DataFrame:
    """Marked texts as BIO rows; drop_empty leaves out rows without an entity, as the older versions do."""
    return corpus.bio_rows(read_csv(spark, path), pattern=pattern, drop_empty=drop_empty)


def dropped_labels(rows: DataFrame, pattern: str = rules.MARKER) -> DataFrame:
    """(label, n): labels of markers that no reader keeps, and how often they occur."""
    found = T.unnest(rows, T.markers(F.col("text"), pattern), "m").select("m.label")
    return found.where(~F.col("label").isin(rules.LABELS)).groupBy("label").agg(F.count("*").alias("n"))


def read_negatives(spark: SparkSession, path: str) -> DataFrame:
    return corpus.negative_rows(read_csv(spark, path))


def read_external(spark: SparkSession, path: str, language: str | None = "en") -> DataFrame:
    """Rows (source_text, language, privacy_mask) of an outside corpus that have a target entity."""
    schema = "source_text string, language string, privacy_mask array<struct<label:string,start:int,end:int,value:string>>"
    rows = spark.read.schema(schema).format("parquet" if path.rstrip("/").endswith(".parquet") else "json").load(path)
    if language:
        rows = rows.where(F.col("language") == language)
    rows = rows.where(corpus.has_target(F.col("privacy_mask")))
    return rows.withColumn("bio", corpus.external_bio(F.col("source_text"), F.col("privacy_mask")))


def write_csv(rows: DataFrame, path: str, order: str, columns: tuple[str, ...] = ("text",)) -> None:
    """All values quoted, 1-based dense ids in order."""
    out = corpus.dense_ids(rows, order).select("id", *columns)
    out.write.csv(path, header=True, quoteAll=True, quote='"', escape='"', mode="overwrite")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """The audit report as one JSON file."""
    import json

    spark.createDataFrame([(json.dumps(report, indent=2, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def ensure_corpus(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made first if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        make().write.parquet(path)
    return spark.read.parquet(path)
