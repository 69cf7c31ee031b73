"""Inventories: tables of paths that exist already, and folder trees listed by executors."""

from __future__ import annotations

import os
import stat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import col
from ..operators.tree import EPOCH
from .scratch import settled


def read_inventory(df: DataFrame, path: str = "path", size: str | None = "size", mtime: str | None = "mtime", is_folder: str | None = None, root: str | Column = "/") -> DataFrame:
    """root, path, is_folder, size, mtime.  Absent, null or malformed sizes are 0, times the
    epoch, so later predicates see no nulls and push down; trailing slashes go; rows
    without a path, or with an empty one, go."""
    p = col(path)
    p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    r = F.lit(root) if isinstance(root, str) else root
    s = F.coalesce(col(size).try_cast("bigint"), F.lit(0)) if size else F.lit(0)
    m = F.coalesce(col(mtime).try_cast("timestamp_ntz"), F.expr(EPOCH)) if mtime else F.expr(EPOCH)
    f = F.coalesce(col(is_folder).try_cast("boolean"), F.lit(False)) if is_folder else F.lit(False)
    return df.select(r.alias("root"), p.alias("path"), f.alias("is_folder"), s.cast("bigint").alias("size"), m.alias("mtime")).where("path <> ''")


_LISTED = "root string, path string, is_folder boolean, size bigint, mtime double, device string"
#: Rows that a listing holds before it hands them on.
PART = 10_000


def _names(batches):
    """Paths in folders, in parts of bounded size.  Names of more than 65535 bytes, and those
    that no text can hold (not UTF-8), are left out."""
    for pdf in batches:
        rows = []
        for root, path in zip(pdf["root"], pdf["path"], strict=True):
            try:
                with os.scandir(path) as found:
                    for e in found:
                        if len(os.fsencode(e.name)) > 65535 or not e.name.isascii() and e.name.encode(errors="ignore").decode() != e.name:
                            continue
                        rows.append((root, os.path.join(path, e.name)))
                        if len(rows) == PART:
                            yield pd.DataFrame(rows, columns=["root", "path"])
                            rows = []
            except OSError:
                continue
        if rows:
            yield pd.DataFrame(rows, columns=["root", "path"])


def _stats(batches):
    for pdf in batches:
        rows = []
        for root, path in zip(pdf["root"], pdf["path"], strict=True):
            try:
                st = os.lstat(path)
            except OSError:
                continue
            rows.append((root, path, stat.S_ISDIR(st.st_mode), st.st_size, st.st_mtime, str(st.st_dev)))
        yield pd.DataFrame(rows, columns=["root", "path", "is_folder", "size", "mtime", "device"])


def scan_tree(spark: SparkSession, roots: list[str], tasks: int = 32) -> DataFrame:
    """Files and folders below roots on a file system that executors share: level by level,
    the folders of one level are listed in parallel and give the next.  Hidden entries
    count, links are not followed, what cannot be read is left out.  A folder's names are read
    by one task, part by part; what each name is, is asked by all tasks."""
    level = spark.createDataFrame([(r, r) for r in dict.fromkeys(roots)], "root string, path string")
    start = [(r, r, True, 0, 0.0, str(os.stat(r).st_dev)) for r in dict.fromkeys(roots) if os.path.isdir(r)]
    out = spark.createDataFrame(start, _LISTED)
    while True:
        names = level.repartition(tasks, "path").mapInPandas(_names, "root string, path string")
        found = settled(names.repartition(tasks, "path").mapInPandas(_stats, _LISTED))
        out = out.unionByName(found)
        level = found.where("is_folder").select("root", "path")
        if not level.take(1):
            break
    own = F.when(F.col("is_folder"), F.lit(0)).otherwise(F.col("size")).cast("bigint")
    return out.select("root", "path", "is_folder", own.alias("size"), F.expr(f"timestampadd(second, cast(floor(mtime) as bigint), {EPOCH})").alias("mtime"), "device")
