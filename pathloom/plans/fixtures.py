"""Inventories made from the given tables; the texts run in Spark and in DuckDB alike."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.inventory import read_inventory

ORDERS = """SELECT concat('/', r_name, '/', n_name, '/', c_name, '/order', o_orderkey,
  CASE o_orderpriority WHEN '1-URGENT' THEN '.pdf' WHEN '2-HIGH' THEN '.JPG'
    WHEN '3-MEDIUM' THEN '.mp4' WHEN '4-NOT SPECIFIED' THEN '.tar.gz' ELSE '' END) AS path,
  CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS mtime
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
  JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
DOCUMENTS = """SELECT concat('/docs/', lang, '/', source, '/', CASE WHEN doc_id % 10 = 0 THEN '.' ELSE '' END, 'doc', doc_id,
  CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.tmp' WHEN 2 THEN '.html' ELSE '.' END) AS path,
  n_chars AS size, {stamp} '2024-01-01 00:00:00' AS mtime FROM {documents}"""
WORDS = """SELECT concat('/', lang, '/', replace(split_part(text, ' ', 1), '/', ''), CASE doc_id % 3 WHEN 0 THEN '.éX' WHEN 1 THEN '.TXT' ELSE '' END) AS path,
  max(n_chars) AS size, {stamp} '2024-01-01 00:00:00' AS mtime FROM {documents} WHERE replace(split_part(text, ' ', 1), '/', '') <> '' AND NOT contains(split_part(text, ' ', 1), chr(10)) GROUP BY 1"""
PAGES = """SELECT path, max(size) AS size, {stamp} '2024-01-01 00:00:00' AS mtime FROM (
  SELECT concat('/', regexp_extract(url, '^https?://([^/?#]+)', 1),
    regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')) AS path,
    CAST(length(html) AS BIGINT) AS size FROM {pages}) u GROUP BY path"""
CHANGES = """SELECT event_id AS seq, ts, '/home' AS root,
  concat('/home/user', user_id, '/k', regexp_extract(props, '([0-9]+)', 1), '.log') AS path,
  CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'view' THEN 'ATTRIB' WHEN 'click' THEN 'CLOSE_WRITE'
    WHEN 'purchase' THEN 'MOVED_TO' ELSE 'DELETE' END AS kind,
  false AS is_folder, CAST(floor(value * 1000) AS BIGINT) AS size, ts AS mtime FROM {events}"""
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def spark_rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("{stamp}", "TIMESTAMP_NTZ"), **used)


def duck(text: str) -> str:
    return text.format(stamp="TIMESTAMP", **{t: t for t in TABLES})


def files(spark: SparkSession, sf_dir: str, text: str = ORDERS) -> DataFrame:
    return read_inventory(spark_rows(spark, sf_dir, text))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_rows(spark, sf_dir, CHANGES).withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))


#: What documents are written as, by doc_id modulo their number: bytes in hexadecimal before the text
#: (None: the text alone goes too) and the end of the name.
WRITTEN = [("89504E470D0A1A0A", ""), ("1F8B08", ""), ("524946460102030457454250", ""), ("524946460102030457415645", ""), ("255044462D", ""), ("00" * 257 + "7573746172", ".saved"), ("", ""), ("00010203", ""), (None, ""), ("3C21444F43545950452068746D6C3E", ""), ("00000018667479704D344120", ""), ("", ".pdf"), ("E29882", ".Note")]


def written_documents(spark: SparkSession, sf_dir: str, top: str) -> None:
    """Each document as a file below ``top``; written by the tasks, the same again when one is repeated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("lang", F.lit("none")).alias("lang"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def write(batches):
        for pdf in batches:
            for lang, doc, text in zip(pdf["lang"], pdf["doc_id"], pdf["text"], strict=True):
                start, end = WRITTEN[doc % len(WRITTEN)]
                os.makedirs(f"{top}/{lang}", exist_ok=True)
                with open(f"{top}/{lang}/doc{doc}{end}", "wb") as f:
                    f.write(b"" if start is None else bytes.fromhex(start) + text.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    docs.mapInPandas(write, "n long").agg(F.sum("n")).collect()
