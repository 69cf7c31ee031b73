"""Tables that cut lineage, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder


#: Bytes of an Arrow batch while a table is written, unless the session sets its own.
BATCH_BYTES = 8_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Removes the shuffle files of a write once it is done: the table stands for them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor
    costs a read, not a recomputation.  Python stages get batches of bounded bytes, and the
    write's shuffle files go with its end, so that they never add up over many tables."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pathloom-{uuid.uuid4().hex}/{name}"
    own = {key: spark.conf.get(key, None) for key in (_BATCH, _CLEANUP)}
    if own[_BATCH] is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        for key, value in own.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path.rsplit("/", 1)[0]
    return out


def is_stored(df: DataFrame) -> bool:
    return "_stored_at" in vars(df)


def removed(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, in whatever store they are."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a stored table that may be broadcast: its columns are a few numbers each.
BROADCAST_ROWS = 150_000


def sized(df: DataFrame) -> DataFrame:
    """``df`` (a stored table of a few numeric columns) with a broadcast hint if it was
    counted to be small; beyond that Spark shuffles as usual."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
