"""A change feed: normalise, fold into a snapshot, keep rollups current, compare snapshots.

``changes``: seq, ts, root, path, kind, is_folder, size, mtime.  A snapshot is a table of
entries with at least root, path, is_folder, size, mtime.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .filters import tag
from ..sources.scratch import settled
from .tree import CORE, described

#: Roots that are sent to every task when a feed names no more.
MANY_ROOTS = 10_000

# Kinds of events and what they do.
ACTIONS = {"CREATE": "upsert", "MOVED_TO": "upsert", "RESCAN": "upsert", "ATTRIB": "update", "CLOSE_WRITE": "update", "DELETE": "delete", "MOVED_FROM": "delete", "DELETE_SELF": "clear", "MOVE_SELF": "clear", "UNMOUNT": "none"}


def normalise(changes: DataFrame) -> DataFrame:
    """Adds ``action``: upsert, update, delete, clear (the whole root) or none; a clear of
    anything but a root does nothing."""
    pairs = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    action = F.coalesce(F.element_at(pairs, F.col("kind")), F.lit("none"))
    return changes.withColumn("action", F.when((action == "clear") & (F.col("path") != F.col("root")), F.lit("none")).otherwise(action))


def _with_last_removal(events: DataFrame, removals: DataFrame) -> DataFrame:
    """``events`` with ``gone``: the last seq at which a folder above, or the whole root,
    went; null if none did."""
    up = events.select("root", "path").distinct().withColumn("folder", F.explode(P.ancestors("path", "root")))
    folders = removals.where("action = 'delete' and is_folder").groupBy("root", F.col("path").alias("folder")).agg(F.max("seq").alias("gone"))
    cleared = removals.where("action = 'clear'").groupBy("root").agg(F.max("seq").alias("cleared"))
    above = up.join(folders, ["root", "folder"]).groupBy("root", "path").agg(F.max("gone").alias("gone"))
    out = events.join(above, ["root", "path"], "left").join(cleared, "root", "left")
    return out.withColumn("gone", F.greatest("gone", "cleared")).drop("cleared")


def drop_obsolete(changes: DataFrame) -> DataFrame:
    """Events before a delete of a folder above them do not count."""
    events = normalise(changes)
    kept = _with_last_removal(events, events.where("action in ('delete', 'clear')")).where("gone is null or seq >= gone")
    return kept.select(*changes.columns)


def states(changes: DataFrame) -> DataFrame:
    """What a part of the feed says of each path: ``deciding`` (the last event that decides
    whether it is there), ``v`` (the last values), ``gone`` (the last delete of it as a
    folder, or clear of it as a root).  States of two parts merge, in any order and with
    repeats, by the largest of each."""
    events = normalise(changes).where("action <> 'none'")
    seq = F.col("seq").cast("bigint").alias("seq")
    return largest(events.select("root", "path", F.when(F.col("action") != "update", F.struct(seq, "action")).alias("deciding"), F.when(F.col("action").isin("upsert", "update"), F.struct(seq, *CORE[2:])).alias("v"), F.when((F.col("action") == "clear") | (F.col("action") == "delete") & F.col("is_folder"), seq).alias("gone")))


def largest(states: DataFrame) -> DataFrame:
    """States that repeat a path as one of each."""
    return states.groupBy("root", "path").agg(*(F.max(c).alias(c) for c in ("deciding", "v", "gone")))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """The states of two parts of a feed taken together."""
    return largest(a.unionByName(b))


def given(snapshot: DataFrame) -> DataFrame:
    """A snapshot as the state before a feed."""
    seq = F.lit(-1).cast("bigint").alias("seq")
    return snapshot.select("root", "path", F.struct(seq, F.lit("upsert").alias("action")).alias("deciding"), F.struct(seq, *CORE[2:]).alias("v"), F.lit(None).cast("bigint").alias("gone"))


def live(states: DataFrame) -> DataFrame:
    """The snapshot that merged states stand for: what is decided after all removals of it,
    of folders above it, and of its root."""
    removals = states.where("gone is not null")
    folders = removals.select("root", F.col("path").alias("folder"), F.col("gone").alias("above"))
    inner = F.filter(F.array_append(P.ancestors("path", "root"), F.col("path")), lambda p: p != F.col("root"))
    up = states.where("deciding.action = 'upsert'").select("root", "path", F.explode(inner).alias("folder"))
    above = up.join(folders, ["root", "folder"]).groupBy("root", "path").agg(F.max("above").alias("above"))
    cleared = removals.where("path = root").select("root", F.col("gone").alias("cleared"))
    rows = states.where("deciding.action = 'upsert'").join(above, ["root", "path"], "left").join(cleared, "root", "left")
    rows = rows.withColumn("end", F.coalesce(F.greatest("above", "cleared"), F.lit(-2)))
    return rows.where("deciding.seq > end and v.seq > end").select("root", "path", "v.is_folder", "v.size", "v.mtime")


def fold(changes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The snapshot after the feed, in order of seq.

    Upserts put an entry; updates change one only if it is there; deletes remove it, a
    folder with all below; clearing a root removes all of it.  Per path one aggregation
    finds the last event that decides whether the entry is there and the last values.
    """
    return live(merged(given(snapshot), states(changes)))


def remove_paths(entries: DataFrame, paths: DataFrame, monitored: DataFrame | None = None) -> DataFrame:
    """Entries without the listed (root, path) and all below them; roots that are
    monitored keep theirs, their feed will tell."""
    from .rules import not_under

    listed = paths if monitored is None else paths.join(monitored.select("root"), "root", "left_anti")
    return not_under(entries, listed)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(root, path, change): added, removed, changed."""
    key = ["root", "path"]
    a = old.select(*key, F.struct("is_folder", "size", "mtime").alias("x"))
    b = new.select(*key, F.struct("is_folder", "size", "mtime").alias("y"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("x").isNull(), F.lit("added")).when(F.col("y").isNull(), F.lit("removed")).when(~F.col("x").eqNullSafe(F.col("y")), F.lit("changed"))
    return both.withColumn("change", change).where("change is not null").select(*key, "change", F.coalesce("y", "x").alias("v")).select(*key, "change", "v.is_folder", "v.size", "v.mtime")


def diff_feed(old: DataFrame, new: DataFrame) -> DataFrame:
    """A feed that turns old into new: folded over ``old`` it gives ``new``."""
    d = diff(old, new)
    kind = F.when(F.col("change") == "removed", "DELETE").otherwise("CREATE")
    # removals of folders come first: what stays below them is created again
    stay = d.where("change <> 'removed'")
    return d.where("change = 'removed'").unionByName(stay).select(F.when(F.col("change") == "removed", 0).otherwise(1).cast("bigint").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), "root", "path", kind.alias("kind"), "is_folder", "size", "mtime")


def replace_root(snapshot: DataFrame, fresh: DataFrame) -> DataFrame:
    """The roots of ``fresh`` give way to it, others stay."""
    return snapshot.join(fresh.select("root").distinct(), "root", "left_anti").unionByName(fresh.select(*snapshot.columns))


def touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """(root, path) of all that the states ``new`` can change in ``old``: their own paths, and
    what lies below folders and roots that they remove."""
    from .rules import under

    removed = new.where("gone is not null").select("root", "path")
    return new.select("root", "path").unionByName(under(old, removed)).distinct()


def changelog(old: DataFrame, new: DataFrame) -> DataFrame:
    """What the states ``new`` change in the snapshot that ``old`` stands for: one row for each
    entry that appears, goes or changes, with ``was`` and ``now`` (struct, null if absent).

    Only roots that the feed names are read (a table by root skips the others), and only
    paths that it touches are folded.
    """
    new = settled(new)
    named = F.broadcast(new.select("root").distinct()) if new.select("root").distinct().count() <= MANY_ROOTS else new.select("root").distinct()
    old = old.join(named, "root", "left_semi")
    at = settled(touched(old, new))
    # removals of folders above what is touched count too
    held = largest(old.join(at, ["root", "path"], "left_semi").unionByName(old.where("gone is not null").join(at, ["root", "path"], "left_anti")))
    entry = lambda states, c: live(states).join(at, ["root", "path"], "left_semi").select("root", "path", F.struct("is_folder", "size", "mtime").alias(c))
    held = settled(held)
    both = entry(held, "was").join(entry(merged(held, new), "now"), ["root", "path"], "full_outer")
    return both.where("not (was <=> now)")


def rollup_increments(log: DataFrame) -> DataFrame:
    """What changed entries add to the rollups of their folders, or take: root, path, and the
    signed total_size, all_files, all_folders (of all below), num_files, num_folders (direct
    children).  ``log`` has root, path, was, now."""
    signed = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("was").alias("v")), F.struct(F.lit(1).alias("sign"), F.col("now").alias("v"))))
    rows = log.where("path <> root").select("root", "path", signed.alias("x")).where("x.v is not null")
    own = rows.select("root", "path", P.parent_of("path", "root").alias("parent"), F.when(~F.col("x.v.is_folder"), F.col("x.sign")).otherwise(0).alias("f"), F.when(F.col("x.v.is_folder"), F.col("x.sign")).otherwise(0).alias("d"), F.when(~F.col("x.v.is_folder"), F.col("x.sign") * F.coalesce(F.col("x.v.size"), F.lit(0))).otherwise(0).alias("s"))
    up = own.withColumn("folder", F.explode(P.ancestors("path", "root")))
    direct = F.col("folder") == F.col("parent")
    sums = {"total_size": F.sum("s"), "all_files": F.sum("f"), "all_folders": F.sum("d"), "num_files": F.sum(F.when(direct, F.col("f")).otherwise(0)), "num_folders": F.sum(F.when(direct, F.col("d")).otherwise(0))}
    out = up.groupBy("root", F.col("folder").alias("path")).agg(*(v.cast("bigint").alias(k) for k, v in sums.items()))
    return out.where(" or ".join(f"{k} <> 0" for k in sums))


ROLLUPS = ["total_size", "all_files", "all_folders", "num_files", "num_folders"]


def rollups(entries: DataFrame) -> DataFrame:
    """The rollups of all folders, as increments over nothing."""
    there = F.struct("is_folder", "size", "mtime")
    return rollup_increments(entries.select("root", "path", F.lit(None).cast("struct<is_folder:boolean,size:bigint,mtime:timestamp_ntz>").alias("was"), there.alias("now")))


def merged_rollups(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Rollups and increments taken together, in any order and number."""
    rows = a if b is None else a.unionByName(b)
    return rows.groupBy("root", "path").agg(*(F.sum(c).cast("bigint").alias(c) for c in ROLLUPS))


def shown_rollups(parts: DataFrame) -> DataFrame:
    """Folders that anything lies below, from rollups and increments; nothing falls below 0."""
    rows = merged_rollups(parts).where("all_files > 0 or all_folders > 0")
    return rows.select("root", "path", *(F.greatest(F.lit(0).cast("bigint"), c).alias(c) for c in ROLLUPS))


def apply_rollup_delta(folders: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``folders`` (root, path, total_size, num_files, num_folders) after a change from
    ``before`` to ``after``: only what changed climbs to its ancestors; never below 0.  Where
    the change is known as a feed, ``changelog`` finds it without comparing snapshots."""
    entry = lambda df, c: df.select("root", "path", F.struct("is_folder", "size", "mtime").alias(c))
    log = entry(before, "was").join(entry(after, "now"), ["root", "path"], "full_outer").where("not (was <=> now)")
    more = rollup_increments(log).select("root", "path", *(F.col(c).alias(f"d_{c}") for c in ROLLUPS))
    out = folders.join(more, ["root", "path"], "left")
    never = lambda c: F.greatest(F.lit(0), F.col(c) + F.coalesce(F.col(f"d_{c}"), F.lit(0))).alias(c)
    return out.select("root", "path", *map(never, ("total_size", "num_files", "num_folders")))


def watch_log(log: DataFrame, searches: dict[str, Column], describe=None) -> DataFrame:
    """``watch`` of what changed alone: ``log`` (root, path, was, now) tells the entry before
    and after, and each search is asked for both.  Searches may use all columns that follow
    from an entry itself (``described``), not those rolled up from others."""
    full = describe or described
    side = lambda c, one: full(log.where(f"{c} is not null").select("root", "path", f"{c}.*", *[x for x in log.columns if x not in ("root", "path", "was", "now")])).withColumn("__side", F.lit(one))
    hits = tag(side("was", -1).unionByName(side("now", 1)), searches)
    moved = hits.groupBy("search", "root", "path").agg(F.sum("__side").alias("n")).where("n <> 0")
    return moved.select("search", "root", "path", F.when(F.col("n") > 0, "enter").otherwise("leave").alias("delta"))


def watch(before: DataFrame, after: DataFrame, searches: dict[str, Column]) -> DataFrame:
    """(search, root, path, delta): which entries enter or leave each saved search."""
    keys = ["search", "root", "path"]
    a = tag(before, searches).select(*keys).withColumn("was", F.lit(1))
    b = tag(after, searches).select(*keys).withColumn("is", F.lit(1))
    both = a.join(b, keys, "full_outer").where("was is null or is is null")
    return both.select(*keys, F.when(F.col("was").isNull(), F.lit("enter")).otherwise(F.lit("leave")).alias("delta"))


def event_stats(changes: DataFrame, width: str = "1 second", slide: str | None = None, session_gap: str | None = None, late: str | None = None) -> DataFrame:
    """Events per window: created, deleted, attribute changes, skipped, and subtrees (folders or
    roots removed with all below).  Windows tumble,
    slide, or are sessions per root; ``late`` sets a watermark for streams."""
    events = normalise(changes).withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        events = events.withWatermark("ts", late)
    window = F.session_window("ts", session_gap) if session_gap else F.window("ts", width, slide or width)
    counts = {"created": "upsert", "deleted": "delete", "updated": "update", "skipped": "none"}
    subtrees = F.count_if((F.col("action") == "clear") | (F.col("action") == "delete") & F.coalesce("is_folder", F.lit(False))).alias("subtrees")
    by = [window.alias("w"), "root"] if session_gap else [window.alias("w")]
    out = events.groupBy(*by).agg(*(F.count_if(F.col("action") == a).alias(n) for n, a in counts.items()), subtrees)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(["root"] if session_gap else []), *counts, "subtrees")


def batch_stats(changes: DataFrame, batch: str) -> DataFrame:
    """Events per value of ``batch``: created, deleted, updated, subtrees (folders removed with
    all below), and skipped: those that do nothing, and those that come before the removal of a
    folder above them, or of their root, in the same batch."""
    events = normalise(changes).withColumn("__id", F.monotonically_increasing_id())
    events = settled(events)
    removed = events.where("action = 'clear' or action = 'delete' and is_folder").groupBy(batch, "root", F.col("path").alias("folder")).agg(F.max("seq").alias("gone"))
    up = events.select("__id", batch, "root", "seq", F.explode(P.ancestors("path", "root")).alias("folder"))
    over = up.join(removed, [batch, "root", "folder"]).where("seq < gone").select("__id").distinct().withColumn("over", F.lit(True))
    rows = events.join(over, "__id", "left")
    skipped = F.coalesce("over", F.lit(False)) | (F.col("action") == "none")
    counts = {"created": F.col("action") == "upsert", "deleted": F.col("action").isin("delete", "clear"), "updated": F.col("action") == "update", "subtrees": (F.col("action") == "clear") | (F.col("action") == "delete") & F.coalesce("is_folder", F.lit(False))}
    return rows.groupBy(batch).agg(*(F.count_if(c & ~skipped).alias(k) for k, c in counts.items()), F.count_if(skipped).alias("skipped"))
