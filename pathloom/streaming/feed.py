"""The change feed as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.changes import changelog, event_stats, largest, live, normalise, states, watch_log
from ..operators.tree import described
from ..sources import versions
from ..sources.scratch import settled

CHANGES = "seq bigint, ts timestamp, root string, path string, kind string, is_folder boolean, size bigint, mtime timestamp_ntz"


def read_changes(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files that grows, as a stream of changes."""
    reader = spark.readStream.schema(CHANGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def once(changes: DataFrame, late: str = "1 minute") -> DataFrame:
    """Without repeats of an event inside the watermark."""
    return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"])


class PathState(StatefulProcessor):
    """The last state of one path.  The event that decides and the last values are kept
    apart, so the state hangs on seq alone, whatever the order or batch of arrival, and an
    event that comes twice changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("entry", "seq bigint, live boolean, vseq bigint, size bigint, mtime timestamp")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        seq, live, vseq, size, mtime = self.state.get() if self.state.exists() else (-1, False, -1, None, None)
        for e in pd.concat(list(rows)).itertuples():
            if e.action != "update" and e.seq > seq:
                seq, live = e.seq, e.action == "upsert"
            if e.action in ("upsert", "update") and e.seq > vseq:
                vseq, size, mtime = e.seq, e.size, e.mtime
        self.state.update((int(seq), bool(live), int(vseq), None if size is None or pd.isna(size) else int(size), None if mtime is None or pd.isna(mtime) else mtime))
        yield pd.DataFrame({"root": [key[0]], "path": [key[1]], "seq": [max(seq, vseq)], "live": [live], "size": pd.array([size], "Int64"), "mtime": [mtime]})

    def close(self) -> None:
        pass


def fold_paths(changes: DataFrame) -> DataFrame:
    """Per path its newest state (files only: removals of folders and roots go through
    ``write_catalog``).  The session's state store must be RocksDB."""
    events = normalise(changes).where("action in ('upsert', 'update', 'delete')").select("root", "path", "seq", "action", "size", F.col("mtime").cast("timestamp").alias("mtime"))
    return events.groupBy("root", "path").transformWithStateInPandas(statefulProcessor=PathState(), outputStructType="root string, path string, seq bigint, live boolean, size bigint, mtime timestamp", outputMode="Update", timeMode="None")


_STATE = "root string, path string, deciding struct<seq: bigint, action: string>, v struct<seq: bigint, is_folder: boolean, size: bigint, mtime: timestamp_ntz>, gone bigint"


def _states(spark: SparkSession, catalog: str, batch: int | None = None) -> DataFrame:
    """The states up to a batch (all, if none is named), from one version of the catalog."""
    now = versions.latest(spark, catalog)
    if batch is not None and any(p.batch > batch >= p.first for p in now.parts):
        raise ValueError(f"batch {batch} has been merged with later ones")
    parts = [p.name for p in now.parts if batch is None or p.batch <= batch]
    if not parts:
        return spark.createDataFrame([], _STATE)
    return spark.read.schema(_STATE).parquet(*(f"{catalog}/parts/{p}" for p in parts))


def read_catalog(spark: SparkSession, catalog: str, batch: int | None = None) -> DataFrame:
    """The snapshot that ``write_catalog`` has come to, or had after a batch that was not
    merged with later ones yet."""
    return live(largest(_states(spark, catalog, batch)))


def compact(spark: SparkSession, catalog: str) -> None:
    """Merges all batches so far into one part.  ``write_catalog`` merges parts of like size
    by itself, so this is only for a last, large merge."""
    versions.merge(spark, catalog, _STATE, largest, every=True)
    versions.tidy(spark, catalog)


def write_catalog(changes: DataFrame, catalog: str, checkpoint: str, searches: dict[str, Column] | None = None, deltas: str | None = None, describe=None, trigger: dict | None = None) -> StreamingQuery:
    """Appends what each batch says of its paths, and nothing else: states merge in any
    order, so late events, and batches that are tried again, end as one fold of the whole
    feed would.  Parts of like size are merged as they add up; a reader sees one version,
    before a merge or after it.

    With ``searches`` what enters and leaves each of them is appended to ``deltas``; only
    what the batch touches is folded for that, but the states are read (``live.write_live``
    keeps them by key and reads no more than a batch names)."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = settled(states(df))
        if searches and deltas:
            log = changelog(_states(spark, catalog, n - 1), new)
            watch_log(log, searches, describe or described).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{deltas}/batch={n}")
        versions.append(new, catalog, n)
        versions.merge(spark, catalog, _STATE, largest)
        versions.tidy(spark, catalog)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def stream_stats(changes: DataFrame, late: str = "10 seconds", **windows) -> DataFrame:
    return event_stats(changes, late=late, **windows)
