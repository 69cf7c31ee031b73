"""The live catalog as keyed state: a feed in, the changes of the snapshot out.

Entries are dealt to shards by a hash of their path, so that no folder is a hot key.  Each
shard keeps the state of its paths, the removals of folders and roots (which go to all
shards), and, for each folder, the next components of what it holds below: so a removal
reaches the entries below that folder and no others.  Keys are held in cells: each batch reads
and writes the cells of what it touches, each of them once; nothing is folded again.

What comes out is a log: (root, path, was, now) of every entry that appears, goes or changes.
Standing searches, rollups and any copy of the snapshot follow from it.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.changes import ROLLUPS, merged_rollups, normalise, rollup_increments, shown_rollups, watch_log
from ..sources import versions

#: Shards of each root; each is handled by one task at a time.
SHARDS = 64

#: Cells of each shard's tables.  A call to the store costs far more than an entry, so entries
#: come and go in cells: with a million entries in all, some twenty in each.
CELLS = 1024

# an entry: the deciding seq and action; seq, is_folder, size and mtime of its values; shown; time
_OUT = "root string, path string, was_there boolean, was_folder boolean, was_size bigint, was_mtime bigint, now_there boolean, now_folder boolean, now_size bigint, now_mtime bigint"
_NOTHING = (-1, "", -1, None, None, None, False, -1)


def _number(x) -> int | None:
    return None if x is None or x != x else int(x)


def _newer(a: tuple, b: tuple) -> bool:
    """Later, or of the same seq and greater, nulls first: the order of Spark's structs."""
    key = lambda t: [(x is not None, x) for x in t]
    return a[0] > b[0] or a[0] == b[0] and key(a) > key(b)


def folders_above(path: str, root: str) -> list[str]:
    """All folders above a path inside its root, the innermost first, the root the last."""
    out = []
    while path != root and path not in ("", "/"):
        path = path.rsplit("/", 1)[0] or "/"
        out.append(path)
    return out


class Cells:
    """A table by text in keyed state for the length of one call.  All keys of a hash are one
    value of the store, read once when the first of them is asked for and written once."""

    def __init__(self, state):
        self.state = state
        self.held: dict[int, dict] = {}
        self.changed: set[int] = set()
        self.empty = not state.exists()

    def cell(self, n: int) -> dict:
        if n not in self.held:
            row = None if self.empty else self.state.getValue((n,))
            self.held[n] = pickle.loads(row[0]) if row else {}
        return self.held[n]

    def get(self, key: str, default=None):
        return self.cell(zlib.crc32(key.encode("utf-8", "surrogatepass")) % CELLS).get(key, default)

    def put(self, key: str, value) -> None:
        n = zlib.crc32(key.encode("utf-8", "surrogatepass")) % CELLS
        self.cell(n)[key] = value
        self.changed.add(n)

    def drop(self, key: str) -> None:
        n = zlib.crc32(key.encode("utf-8", "surrogatepass")) % CELLS
        if self.cell(n).pop(key, None) is not None:
            self.changed.add(n)

    def items(self) -> list[tuple]:
        if not self.empty:
            for n in [row[0] for row in self.state.keys()]:
                self.cell(n)
        return [x for cell in self.held.values() for x in cell.items()]

    def write(self) -> None:
        for n in self.changed:
            if self.held[n]:
                self.state.updateValue((n,), (pickle.dumps(self.held[n], 4),))
            elif not self.empty and self.state.containsKey((n,)):
                self.state.removeKey((n,))
        self.changed.clear()


class LiveCatalog(StatefulProcessor):
    """One shard.  The state hangs on seq alone, so the order of events inside the watermark,
    and events that come twice, change nothing."""

    def __init__(self, keep: bool):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # entries; names below each folder; seq and time of removals; what no later event needs,
        # once the watermark is past its time
        self.states = [handle.getMapState(x, "cell int", "held binary") for x in ("entries", "below", "gone", "dead")]
        self.timer = handle.getValueState("timer", "at bigint")

    def open(self) -> None:
        """The tables of the key at hand."""
        self.entries, self.below, self.gone, self.dead = map(Cells, self.states)

    def write(self) -> None:
        for table in (self.entries, self.below, self.gone, self.dead):
            table.write()

    # --- the folders' index

    def link(self, path: str, root: str) -> None:
        for folder in folders_above(path, root):
            name = path.rsplit("/", 1)[1]
            names = self.below.get(folder)
            if names is None:
                self.below.put(folder, {name})
            elif name in names:
                return
            else:
                names.add(name)
                self.below.put(folder, names)
                return
            path = folder

    def unlink(self, path: str, root: str) -> None:
        if self.below.get(path):  # a folder with entries below stays on their way
            return
        for folder in folders_above(path, root):
            name = path.rsplit("/", 1)[1]
            names = self.below.get(folder)
            if names is not None:
                names.discard(name)
                if names:
                    self.below.put(folder, names)
                    return
                self.below.drop(folder)
            if self.entries.get(folder) is not None:
                return
            path = folder

    def reached(self, folder: str) -> Iterator[str]:
        """The shard's entries that are the folder or lie below it."""
        todo = [folder]
        while todo:
            at = todo.pop()
            if self.entries.get(at) is not None:
                yield at
            todo += [("" if at == "/" else at) + "/" + n for n in self.below.get(at, ())]

    # --- events

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        root = key[0]
        self.open()
        held: dict[str, list] = {}
        old: dict[str, tuple] = {}
        removals: dict[str, int] = {}

        def entry(path: str) -> list:
            if path not in held:
                known = self.entries.get(path)
                old[path] = known or _NOTHING
                held[path] = list(old[path])
                if not known:
                    self.link(path, root)
            return held[path]

        last = -1
        for frame in rows:
            for e in frame.itertuples(index=False):
                ts = _number(e.ts) or 0
                last = max(last, ts)
                if e.removes and e.seq > removals.get(e.path, -1):
                    if e.seq > self.gone.get(e.path, (-1, -1))[0]:
                        self.gone.put(e.path, (int(e.seq), ts))
                        removals[e.path] = int(e.seq)
                if not e.own:
                    continue
                x = entry(e.path)
                x[7] = max(x[7], ts)
                if e.action != "update" and _newer((e.seq, e.action), (x[0], x[1])):
                    x[0], x[1] = int(e.seq), e.action
                if e.action in ("upsert", "update"):
                    v = (int(e.seq), bool(e.is_folder), _number(e.size), _number(e.mtime))
                    if _newer(v, tuple(x[2:6])):
                        x[2:6] = v
        for folder in removals:
            for path in list(self.reached(folder)):
                entry(path)

        ends: dict[str, tuple] = {}

        def end(folder: str) -> tuple:
            if folder not in ends:
                ends[folder] = self.gone.get(folder, (-2, -1))
            return ends[folder]

        out = []
        earliest = None
        for path, x in held.items():
            over = max(end(folder) for folder in [path, *folders_above(path, root)])
            now = x[1] == "upsert" and x[0] > over[0] and x[2] > over[0]
            before = old[path]
            was, values = before[6], tuple(before[3:6])
            x[6] = now
            if was != now or now and values != tuple(x[3:6]):
                out.append((root, path, was, *(values if was else (None,) * 3), now, *(x[3:6] if now else (None,) * 3)))
            self.entries.put(path, tuple(x))
            if self.keep:
                continue
            if now:
                if before[6] is False:
                    self.dead.drop(path)
            else:
                at = max(x[7], over[1])
                self.dead.put(path, at)
                earliest = at if earliest is None else min(earliest, at)
        for folder in removals:
            at = end(folder)[1]
            earliest = at if earliest is None else min(earliest, at)
        if earliest is not None and not self.keep:
            self.wake(earliest, timerValues)
        self.write()
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
            whole = {c: "Int64" for c in ("was_size", "was_mtime", "now_size", "now_mtime")} | {c: "boolean" for c in ("was_folder", "now_folder")}
            yield frame.astype(whole)

    # --- the end of state

    def wake(self, at: int, timerValues) -> None:
        """One timer a shard, at the earliest time at which anything of it may go."""
        at = max(at, timerValues.getCurrentWatermarkInMs()) + 2
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Events before the watermark come no more: what is not there, and what removed it, is
        forgotten."""
        root, mark = key[0], timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        self.open()
        later = []
        for path, ts in self.dead.items():
            if ts < mark:
                self.dead.drop(path)
                self.entries.drop(path)
                self.unlink(path, root)
            else:
                later.append(ts)
        for folder, (_, ts) in self.gone.items():
            if ts < mark:
                self.gone.drop(folder)
            else:
                later.append(ts)
        self.write()
        if later:
            self.wake(min(later), timerValues)
        return iter([])

    def close(self) -> None:
        pass


_MICROS = "cast(unix_micros(cast({} as timestamp)) as bigint)"


def rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind lives in the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_changes(changes: DataFrame, late: str | None = "1 minute", shards: int = SHARDS) -> DataFrame:
    """The log of a stream of changes: root, path, was, now (struct<is_folder, size, mtime>,
    null where the entry is absent), once for each path and batch.

    Read in order, it turns an empty snapshot into ``fold`` of the feed: removals of folders
    and roots, updates before their creation, repeats and disorder included.  Events more
    than ``late`` behind the newest are left out, and seq must grow with ts that far apart;
    in return what was deleted is forgotten, removals too, and state holds what is there.
    With ``late`` None nothing is left out and nothing forgotten.  Rows without seq, root or
    path say nothing.
    """
    rocksdb(changes.sparkSession)
    events = normalise(changes).where("action <> 'none' and seq is not null and root is not null and path is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        events = events.withWatermark("ts", late)
    removes = F.coalesce((F.col("action") == "clear") | (F.col("action") == "delete") & F.col("is_folder"), F.lit(False))
    own = F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")
    events = events.select("root", "path", F.col("seq").cast("bigint").alias("seq"), "ts", "action", F.coalesce("is_folder", F.lit(False)).alias("is_folder"), "size", F.expr(_MICROS.format("mtime")).alias("mtime"), removes.alias("removes"), own.alias("__own"))
    # a removal is told to every shard, all else to its own
    to = F.when(F.col("removes"), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array("__own"))
    events = events.withColumn("shard", F.explode(to)).withColumn("own", F.col("shard") == F.col("__own"))
    if late:  # the time in ms, beside the column that the watermark is of
        events = events.select("root", "shard", "path", "seq", "action", "is_folder", "size", "mtime", "removes", "own", F.col("ts").alias("__ts"), F.unix_millis("ts").alias("ts"))
    else:
        events = events.select("root", "shard", "path", "seq", "action", "is_folder", "size", "mtime", "removes", "own", F.unix_millis("ts").alias("ts"))
    rows = events.groupBy("root", "shard").transformWithStateInPandas(statefulProcessor=LiveCatalog(late is None), outputStructType=_OUT, outputMode="Update", timeMode="EventTime" if late else "None")
    value = lambda c: F.when(F.col(f"{c}_there"), F.struct(F.col(f"{c}_folder").alias("is_folder"), F.col(f"{c}_size").alias("size"), F.expr(f"cast(timestamp_micros({c}_mtime) as timestamp_ntz)").alias("mtime"))).alias(c)
    return rows.select("root", "path", value("was"), value("now"))


_LOG = "root string, path string, was struct<is_folder: boolean, size: bigint, mtime: timestamp_ntz>, now struct<is_folder: boolean, size: bigint, mtime: timestamp_ntz>"
_ROLLUPS = "root string, path string, " + ", ".join(f"{c} bigint" for c in ROLLUPS)
_DELTAS = "search string, root string, path string, delta string"


def write_live(changes: DataFrame, checkpoint: str, log: str | None = None, rollups: str | None = None, searches: dict[str, Column] | None = None, deltas: str | None = None, late: str | None = "1 minute", shards: int = SHARDS, trigger: dict | None = None) -> StreamingQuery:
    """Runs ``live_changes`` and appends, batch by batch: the log itself to ``log``; what it
    adds to the folders' rollups to ``rollups``, where parts are merged as they add up; which
    entries enter or leave each of ``searches`` to ``deltas``.  Each is a table of versions
    (``sources.versions``): a batch that is tried again counts once."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        df = df.persist()
        try:
            if log:
                versions.append(df.withColumn("batch", F.lit(n).cast("bigint")), log, n)
            if rollups:
                versions.append(rollup_increments(df), rollups, n)
                versions.merge(spark, rollups, _ROLLUPS, merged_rollups)
                versions.tidy(spark, rollups)
            if searches and deltas:
                versions.append(watch_log(df, searches).withColumn("batch", F.lit(n).cast("bigint")), deltas, n)
        finally:
            df.unpersist()

    stream = live_changes(changes, late, shards)
    return stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """root, path, was, now, batch."""
    return versions.read(spark, log, _LOG + ", batch bigint")


def read_rollups(spark: SparkSession, rollups: str) -> DataFrame:
    """The rollups of every folder that anything lies below."""
    return shown_rollups(versions.read(spark, rollups, _ROLLUPS))


def read_deltas(spark: SparkSession, deltas: str) -> DataFrame:
    """search, root, path, delta, batch."""
    return versions.read(spark, deltas, _DELTAS + ", batch bigint")


def snapshot_of(log: DataFrame) -> DataFrame:
    """The snapshot that a log has come to: the last word on each path."""
    last = log.groupBy("root", "path").agg(F.max_by("now", "batch").alias("now"))
    return last.where("now is not null").select("root", "path", "now.is_folder", "now.size", "now.mtime")
