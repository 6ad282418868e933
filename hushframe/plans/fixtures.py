"""Marked texts, made from customers by SQL that any engine reads alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# In both dialects: chr(10) is a line end, || joins, STRING is text.
_VALUE = """CASE WHEN k % 100 < 55 THEN CASE k % 7
  WHEN 0 THEN 'AKIA' || upper(substr(md5('a' || s), 1, 16))
  WHEN 1 THEN 'ghp_' || md5('g' || s) || substr(md5('h' || s), 1, 4)
  WHEN 2 THEN 'sk-ant-api03-' || md5('i' || s) || md5('j' || s)
  WHEN 3 THEN 'the ' || substr(md5('k' || s), 1, 10)
  WHEN 4 THEN 'eyJ' || md5('l' || s) || '.eyJ' || md5('m' || s) || '.' || md5('n' || s)
  WHEN 5 THEN 'postgres://app:' || substr(md5('o' || s), 1, 12) || '@db.internal:5432/main'
  ELSE '123-45-' || substr('0000' || s, -4) END
WHEN k % 100 < 68 THEN CASE WHEN k % 3 = 0 THEN 'user at ' || s ELSE 'user' || s || '@example.com' END
WHEN k % 100 < 80 THEN '+1 (' || CAST(200 + k % 800 AS STRING) || ') 555-' || substr('0000' || s, -4)
WHEN k % 100 < 90 THEN CAST(100 + k % 800 AS STRING) || '-' || CAST(10 + k % 90 AS STRING) || '-' || CAST(1000 + k % 9000 AS STRING)
ELSE '4111 1111 1111 1111' END"""
_LABEL = "CASE WHEN k % 100 < 55 THEN 'CREDENTIAL' WHEN k % 100 < 68 THEN 'EMAIL' WHEN k % 100 < 80 THEN 'PHONE' WHEN k % 100 < 90 THEN 'SSN' ELSE 'CREDIT_CARD' END"
_MARK = "'[' || v || '|' || label || ']'"
_TEXT = f"""CASE k % 10
  WHEN 0 THEN 'Customer ' || s || ' wrote: contact ' || {_MARK} || ' about order ' || s
  WHEN 1 THEN CASE k % 4 WHEN 0 THEN 'GITHUB_TOKEN' WHEN 1 THEN 'AWS_ACCESS_KEY_ID' WHEN 2 THEN 'DATABASE_URL' ELSE 'OTHER_KEY' END || '=' || {_MARK} || chr(10) || 'DEBUG=true'
  WHEN 2 THEN {_MARK} || ' ' || {_MARK}
  WHEN 3 THEN 'use ' || {_MARK} || ' and then [kim' || s || '@example.org|EMAIL] at line 42'
  WHEN 4 THEN 'see [x' || s || '|FOO] and [|EMAIL] and ' || {_MARK} || chr(10) || 'bye'
  WHEN 5 THEN 'é 😀 key:' || {_MARK} || '. host 10.0.' || CAST(k % 300 AS STRING) || '.7 aa:bb:cc:dd:ee:ff'
  WHEN 6 THEN 'unclosed [abc' || s || '|CREDENTIAL ] then |SSN] ' || {_MARK}
  WHEN 7 THEN 'template ' || CAST(k % 6 AS STRING) || ' says ' || '[same' || CAST(k % 6 AS STRING) || '|EMAIL]'
  WHEN 8 THEN 'long ' || repeat('word ' || s || ' ', 40 + CAST(k % 400 AS INT)) || {_MARK}
  ELSE 'nothing here, value=' || v || ' for ' || s END"""
_SPLIT = "CASE WHEN k % 20 = 9 OR k % 20 = 19 THEN 'neg' WHEN k % 20 IN (7, 12, 15) THEN 'eval' ELSE 'train' END"
#: {{customer}} is the table.
ANNOTATED = f"""SELECT k AS id, {_SPLIT} AS split, label AS category, {_TEXT} AS text FROM (
  SELECT k, s, {_VALUE} AS v, {_LABEL} AS label FROM (SELECT c_custkey AS k, CAST(c_custkey AS STRING) AS s FROM {{customer}}) a) b"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, split, category, text): marked texts with some of every defect, a tenth of them without markers."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    cores = spark.sparkContext.defaultParallelism
    if customer.rdd.getNumPartitions() < cores:
        # A small file is one task; texts are made from keys, so only keys are dealt out.
        customer = customer.repartition(cores)
    return spark.sql(ANNOTATED, customer=customer)


#: The same, as the beginning of a query.
ANNOTATED_CTE = "annotated AS (" + ANNOTATED.replace("{customer}", "customer") + ")"
