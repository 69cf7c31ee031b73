"""The first bytes of files on a file system that executors share."""

from __future__ import annotations

import os
import stat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from ..functions.contents import HEAD, bytes_type
from ..functions.types import content_type


def _head(path: str | None) -> bytes | None:
    """The start of a regular file; None for whatever cannot be read (pipes and devices are not opened)."""
    try:
        if path is None or not stat.S_ISREG(os.stat(path).st_mode):
            return None
        with open(path, "rb") as f:
            return f.read(HEAD)
    except (OSError, ValueError):
        return None


def with_heads(files: DataFrame) -> DataFrame:
    """``files`` (path and other columns) with ``__head``, what the first bytes of each are.  Files are read
    where their rows stand, ``HEAD`` bytes each, however long they are."""

    def read(batches):
        for b in batches:
            heads = pa.array([_head(p) for p in b.column("path").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, heads], names=[*b.schema.names, "__head"])

    return files.mapInArrow(read, StructType(list(files.schema.fields)).add("__head", BinaryType()))


def with_content_type(entries: DataFrame) -> DataFrame:
    """``entries`` (path, name, is_folder and other columns) with content_type: what the name says;
    where it says nothing, what the first bytes say; ``unknown`` for files that cannot be read.
    Only the latter files are opened, and only their rows go through Python."""
    named = entries.withColumn("content_type", content_type("name", "is_folder"))
    asked = with_heads(named.where("content_type = 'unknown'"))
    told = asked.withColumn("content_type", F.coalesce(bytes_type("__head"), "content_type")).drop("__head")
    return named.where("content_type <> 'unknown'").unionByName(told)
