"""Complete a table of files to a tree, and roll sizes and counts up its folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

EPOCH = "timestamp_ntz '1970-01-01 00:00:00'"
CORE = ["root", "path", "is_folder", "size", "mtime"]


def described(df: DataFrame) -> DataFrame:
    """``df`` with the columns that follow from root, path and is_folder."""
    df = df.withColumns({"parent_path": P.parent_of("path", "root"), "name": P.name_of("path"), "depth": P.depth_of("path", "root")})
    return df.withColumn("ext", P.ext_of("name", "is_folder"))


def climbed(entries: DataFrame, *keep: str) -> DataFrame:
    """One row per entry and ancestor (column ``folder``), with the columns to keep."""
    return entries.select("root", *keep, F.explode(P.ancestors("path", "root")).alias("folder"))


def with_folders(files: DataFrame) -> DataFrame:
    """Adds a folder for every proper ancestor that has no row (own size 0, mtime epoch)."""
    core = files.select(*CORE)
    needed = climbed(core.where("not is_folder")).distinct().withColumnRenamed("folder", "path")
    given = core.where("is_folder").select("root", "path")
    missing = needed.join(given, ["root", "path"], "left_anti")
    return core.unionByName(missing.select("root", "path", F.lit(True).alias("is_folder"), F.lit(0).cast("bigint").alias("size"), F.expr(EPOCH).alias("mtime")))


def rollup_counts(entries: DataFrame) -> DataFrame:
    """Direct children per folder: root, path, num_files, num_folders."""
    parents = entries.where("path <> root").select("root", P.parent_of("path", "root").alias("path"), "is_folder")
    return parents.groupBy("root", "path").agg(F.count_if(~F.col("is_folder")).alias("num_files"), F.count_if("is_folder").alias("num_folders"))


def rollup_size(entries: DataFrame) -> DataFrame:
    """Recursive size and counts per folder: root, path, total_size, all_files, all_folders.
    Sums are partial before the shuffle, so ``/``, which every row reaches, is no hot key."""
    up = climbed(entries, "is_folder", "size")
    own = F.when(~F.col("is_folder"), F.col("size")).otherwise(0)
    return up.groupBy("root", F.col("folder").alias("path")).agg(F.sum(own).alias("total_size"), F.count_if(~F.col("is_folder")).alias("all_files"), F.count_if("is_folder").alias("all_folders"))


def folder_table(files: DataFrame) -> DataFrame:
    """All folders, given or implied, with recursive size and direct counts: root, path,
    size, mtime, num_files, num_folders.  One aggregation over files and their ancestors
    gives folders, sizes and files; in another, over the folders, each adds one to the
    folder above it.  ``files`` is read once, and nothing is joined."""
    above = F.when(F.col("is_folder"), F.array("path")).otherwise(P.ancestors("path", "root"))
    up = files.select("root", P.parent_of("path", "root").alias("parent"), "is_folder", "size", "mtime", F.explode(above).alias("folder"))
    own = F.when(~F.col("is_folder"), F.col("size")).otherwise(0)
    direct = ~F.col("is_folder") & (F.col("folder") == F.col("parent"))
    found = up.groupBy("root", F.col("folder").alias("path")).agg(F.sum(own).alias("size"), F.count_if(direct).alias("num_files"), F.max(F.when(F.col("is_folder"), F.col("mtime"))).alias("mtime"))
    itself = F.struct(F.col("path").alias("at"), "size", "mtime", "num_files", F.lit(0).cast("bigint").alias("below"))
    for_parent = F.struct(P.parent_of("path", "root").alias("at"), *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("size", "mtime", "num_files")), F.lit(1).cast("bigint").alias("below"))
    said = found.select("root", F.explode(F.when(F.col("path") != F.col("root"), F.array(itself, for_parent)).otherwise(F.array(itself))).alias("x")).select("root", "x.*")
    out = said.groupBy("root", F.col("at").alias("path")).agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"), F.sum("num_files").alias("num_files"), F.sum("below").alias("num_folders"))
    # a folder that only another one names has no row
    return out.where("num_files is not null").select("root", "path", "size", F.coalesce("mtime", F.expr(EPOCH)).alias("mtime"), "num_files", "num_folders")


def catalog(files: DataFrame) -> DataFrame:
    """The whole entries table: folders added (one given twice counts once), sizes and
    child counts rolled up."""
    none = F.lit(None).cast("bigint")
    own = files.where("not is_folder").select("root", "path", "is_folder", "size", "mtime", none.alias("num_files"), none.alias("num_folders"))
    folders = folder_table(files).select("root", "path", F.lit(True).alias("is_folder"), "size", "mtime", "num_files", "num_folders")
    return described(own.unionByName(folders))


def with_parent(entries: DataFrame) -> DataFrame:
    """Each entry with its parent's size (null for roots and orphans)."""
    up = entries.where("is_folder").select("root", F.col("path").alias("parent_path"), F.col("size").alias("parent_size"))
    return entries.join(up, ["root", "parent_path"], "left")
