"""Snapshots of a catalog: Parquet by root, rules and roots beside it, and a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import to_uri

MAJOR, MINOR = 1, 0


def _content(df: DataFrame) -> DataFrame:
    """Row count and a hash that no order of rows or files changes."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def checksum(df: DataFrame) -> str:
    row = _content(df).first()
    return f"{row['n']}:{row['hash']}"


def save_snapshot(df: DataFrame, path: str, roots: DataFrame, excludes: DataFrame) -> str:
    """A new version beside the old ones; it counts once its manifest is there, which is
    written last.  Returns the version's folder."""
    spark = df.sparkSession
    base = f"{path}/v-{uuid.uuid4().hex}"
    df.write.partitionBy("root").parquet(f"{base}/entries")
    roots.write.parquet(f"{base}/roots")
    excludes.write.parquet(f"{base}/excludes")
    n = df.sparkSession.read.parquet(f"{base}/entries").count()
    row = (MAJOR, MINOR, base, n, checksum(roots) + "/" + checksum(excludes))
    manifest = spark.createDataFrame([row], "major int, minor int, base string, n bigint, config string").withColumn("saved", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return base


def _latest(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("saved")).first()
    if row["major"] != MAJOR or row["minor"] > MINOR:
        raise ValueError(f"snapshot version {row['major']}.{row['minor']} is not {MAJOR}.{MINOR}")
    return row


def load_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Roots and excludes of the newest version, without its entries."""
    base = _latest(spark, path)["base"]
    return spark.read.parquet(f"{base}/roots"), spark.read.parquet(f"{base}/excludes")


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the newest version; refuses another major or newer minor version, and
    roots or rules that are not those it was saved with."""
    row = _latest(spark, path)
    roots, excludes = load_config(spark, path)
    if checksum(roots) + "/" + checksum(excludes) != row["config"]:
        raise ValueError("the snapshot's roots or rules have changed")
    return spark.read.parquet(f"{row['base']}/entries")


def lines(result: DataFrame, what: str = "full_path") -> DataFrame:
    """One column ``value``: full path, parent path, name, or file:// URI."""
    c = {"full_path": F.col("path"), "parent_path": F.col("parent_path"), "name": F.col("name"), "uri": to_uri("path")}[what]
    return result.select(c.alias("value"))


def export_lines(result: DataFrame, path: str, what: str = "full_path") -> None:
    lines(result, what).write.text(path)
