"""The live catalog as keyed state, versions of a table, and increments, against batch folds."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from pathloom.operators import changes as C
from pathloom.operators import predicates as D
from pathloom.operators import rules as B
from pathloom.operators import tree as T
from pathloom.sources import versions as V
from pathloom.streaming import feed, live

SCHEMA = "seq bigint, ts bigint, root string, path string, kind string, is_folder boolean, size bigint"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("seq", F.timestamp_seconds("ts").alias("ts"), "root", "path", "kind", "is_folder", "size", F.expr("timestampadd(second, cast(seq as bigint), timestamp_ntz '2024-01-01 00:00:00')").alias("mtime"))


def random_feed(rnd, n):
    """Two roots, nested folders, removals of folders and of a root, updates before creation."""
    rows = []
    for seq in range(1, n + 1):
        root = rnd.choice(["/r", "/r", "/"])
        parts = [rnd.choice(["a", "ab", "b"]) for _ in range(rnd.randrange(1, 4))]
        path = ("" if root == "/" else root) + "/" + "/".join(parts)
        kind = rnd.choices(["CREATE", "MOVED_TO", "ATTRIB", "CLOSE_WRITE", "DELETE", "MOVED_FROM", "DELETE_SELF", "UNMOUNT"], [6, 2, 3, 2, 3, 1, 0.3, 0.3])[0]
        folder = len(parts) < 3 and rnd.random() < 0.5
        if kind == "DELETE_SELF" and rnd.random() < 0.7:
            path = root
        rows.append((seq, seq, root, path, kind, folder, rnd.choice([None, 0, 5, 60])))
    return rows


def played(spark, folder, batches):
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return feed.read_changes(spark, str(folder), 1)


def known(df):
    return sorted(((r["root"], r["path"], r["is_folder"], r["size"], r["mtime"]) for r in df.select(*T.CORE).collect()), key=repr)


def disordered(rnd, rows, reach):
    """Each event comes up to ``reach`` later than it happened; some come twice."""
    moved = sorted(rows + rnd.sample(rows, len(rows) // 10), key=lambda r: r[0] + rnd.random() * reach)
    cuts = sorted(rnd.sample(range(1, len(moved)), 5))
    return [moved[a:b] for a, b in zip([0, *cuts], [*cuts, len(moved)], strict=True)]


@pytest.mark.parametrize("late", ["40 seconds", None])
def test_live_catalog_is_fold(spark, tmp_path, late):
    rnd = random.Random(11)
    rows = random_feed(rnd, 400)
    batches = disordered(rnd, rows, 30 if late else 400)
    searches = {"big": D.size_is(">", "50"), "ab": D.term("ab"), "folders": D.folders_only()}
    out = {k: str(tmp_path / k) for k in ("log", "rollups", "deltas")}
    q = live.write_live(played(spark, tmp_path / "in", batches), str(tmp_path / "ck"), out["log"], out["rollups"], searches, out["deltas"], late=late, shards=3, trigger={"availableNow": True})
    assert q.awaitTermination(400) and not q.exception()
    feed_rows = frame(spark, rows)
    none = feed_rows.select(*T.CORE).where("false")
    want = C.fold(feed_rows, none)
    assert known(live.snapshot_of(live.read_log(spark, out["log"]))) == known(want) and want.count() > 5
    full = C.shown_rollups(C.rollups(want))
    assert sorted(map(tuple, live.read_rollups(spark, out["rollups"]).collect())) == sorted(map(tuple, full.collect()))
    assert len(V.latest(spark, out["rollups"]).parts) <= 2 * V.ALIKE
    # deltas, batch by batch: those of the batch form on the feed so far
    seen, before = [], T.described(none)
    got = live.read_deltas(spark, out["deltas"])
    for n, part in enumerate(batches):
        seen += part
        after = T.described(C.fold(frame(spark, seen), none))
        mine = sorted(map(tuple, got.where(F.col("batch") == n).drop("batch").collect()))
        assert mine == sorted(map(tuple, C.watch(before, after, searches).collect()))
        before = after


def test_state_ends_behind_the_watermark(spark, tmp_path):
    """What is deleted is forgotten: paths, removals and the folders on their way."""
    rows = [(i, i, "/r", f"/r/d{i % 5}/x{i}", "CREATE", False, 1) for i in range(1, 101)]
    gone = [(100 + i, 101, "/r", f"/r/d{i}", "DELETE", True, 0) for i in range(5)] + [(200, 102, "/r", "/r/keep/y", "CREATE", False, 3)]
    later = [[(300 + k, 1000 + 100 * k, "/r", "/r/keep/z", "CREATE", False, k)] for k in range(4)]
    stream = live.live_changes(played(spark, tmp_path / "in", [rows, gone, *later]), "10 seconds", shards=2)
    q = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(300) and not q.exception()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(sizes) > 200 and sizes[-1] < 15, sizes


def test_batches_count_once_and_readers_see_one_version(spark, tmp_path):
    table, schema = str(tmp_path / "t"), "k bigint, n bigint"
    total = lambda df: df.groupBy("k").agg(F.sum("n").cast("bigint").alias("n"))
    part = lambda n: spark.range(20).select(F.col("id").alias("k"), F.lit(n).cast("bigint").alias("n"))
    assert V.read(spark, table, schema).count() == 0
    bad, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            sums = {r["n"] for r in total(V.read(spark, table, schema)).collect()}
            if len(sums) > 1:  # half a merge, or half a batch
                bad.append(sums)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in range(1, 9):
            V.append(part(n), table, n)
            V.append(part(100), table, n)  # tried again: counts once
            V.merge(spark, table, schema, total)
    finally:
        stop.set()
        reader.join()
    assert not bad
    assert {r["n"] for r in total(V.read(spark, table, schema)).collect()} == {36}
    now = V.latest(spark, table)
    assert now.batch == 8 and len(now.parts) < 8
    V.tidy(spark, table)
    folders = {p.name for p in (tmp_path / "t" / "parts").iterdir()}
    assert {p.name for p in now.parts} <= folders and len(folders) < 16
    assert {r["n"] for r in total(V.read(spark, table, schema)).collect()} == {36}


def test_no_commit_over_another(spark, tmp_path):
    table = str(tmp_path / "t")
    V.append(spark.range(3), table, 0)
    with pytest.raises(RuntimeError, match="another"):
        V._commit(spark, table, V.Version(1, 5, []))
    assert V.latest(spark, table).batch == 0


def test_changelog_and_increments(spark):
    """Increments from change states equal the rollups of whole folds; untouched roots stay unread."""
    rnd = random.Random(3)
    rows = random_feed(rnd, 300)
    none = frame(spark, rows).select(*T.CORE).where("false")
    parts = C.rollups(none)
    for a, b in ((0, 100), (100, 220), (220, 300)):
        old, new = C.states(frame(spark, rows[:a])), C.states(frame(spark, rows[a:b]))
        log = C.changelog(old, new)
        before, after = C.fold(frame(spark, rows[:a]), none), C.fold(frame(spark, rows[:b]), none)
        changed = C.diff(before, after).select("root", "path")
        assert sorted(map(tuple, log.select("root", "path").collect())) == sorted(map(tuple, changed.collect()))
        parts = C.merged_rollups(parts, C.rollup_increments(log))
    want = T.rollup_size(C.fold(frame(spark, rows), none)).na.fill(0).select("root", "path", "total_size", "all_files", "all_folders")
    got = C.shown_rollups(parts).select("root", "path", "total_size", "all_files", "all_folders")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kids = T.rollup_counts(C.fold(frame(spark, rows), none))
    assert sorted(map(tuple, C.shown_rollups(parts).where("num_files > 0 or num_folders > 0").select("root", "path", "num_files", "num_folders").collect())) == sorted(map(tuple, kids.collect()))


def test_under_is_below(spark, monkeypatch):
    rnd = random.Random(7)
    paths = {"/" + "/".join(rnd.choice(["a", "ab", "b", "c.d"]) for _ in range(rnd.randrange(1, 5))) for _ in range(80)} | {"/"}
    entries = spark.createDataFrame([(root, p) for p in sorted(paths) for root in ("/", "/a") if p.startswith(root)], "root string, path string")
    entries = entries.where("root = '/' or path = '/a' or startswith(path, '/a/')")
    for few in (["/a"], ["/a/b", "/a/b/ab", "/c.d"], ["/"], ["/zz"], []):
        folders = spark.createDataFrame([(r, p) for p in few for r in ("/", "/a")], "root string, path string")
        want = sorted(set(map(tuple, B.below(entries, folders).collect())))
        rest = sorted(set(map(tuple, entries.collect())) - set(want))
        for most in (B.MANY_FOLDERS, -1):
            monkeypatch.setattr(B, "MANY_FOLDERS", most)
            assert sorted(set(map(tuple, B.under(entries, folders).collect()))) == want
            assert sorted(map(tuple, B.not_under(entries, folders).select("root", "path").collect())) == rest
        monkeypatch.undo()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(B.not_under(entries, folders))
    assert "Generate" not in text and "Exchange hashpartitioning" not in text
    rules = spark.createDataFrame([("*.tmp", True, "wildcard", "basename", "files"), ("/a/b", True, "fixed", "full_path", "folders")], B.RULE)
    text = plan(B.apply_excludes(T.described(entries.withColumn("is_folder", F.lit(False))), rules, True))
    assert "Join" not in text and "Exchange" not in text


def test_same_device(spark):
    rows = [("/r", "/r", True, "1"), ("/r", "/r/a", True, "1"), ("/r", "/r/m", True, "2"), ("/r", "/r/m/x", False, "2"), ("/r", "/r/m/y", False, "1"), ("/r", "/r/f", False, "2"), ("/r", "/r/n", False, None), ("/q", "/q", True, None), ("/q", "/q/x", False, "1"), ("/q", "/q/y", False, None), ("/s", "/s/x", False, "3")]
    df = spark.createDataFrame(rows, "root string, path string, is_folder boolean, device string")
    assert sorted(r["path"] for r in B.same_device(df).collect()) == ["/q", "/q/y", "/r", "/r/a", "/s/x"]


def test_state_is_read_and_written_in_cells(spark, tmp_path):
    """A batch of many paths makes a bounded number of calls to a shard's store."""
    rows = [(i, i, "/r", f"/r/d{i % 5}/x{i}", "CREATE", False, i) for i in range(1, 4001)]
    gone = [(5000, 5000, "/r", "/r/d3", "DELETE", True, 0), (5001, 5001, "/r", "/r/d4/x4", "DELETE", False, 0)]
    log = str(tmp_path / "log")
    q = live.write_live(played(spark, tmp_path / "in", [rows, gone]), str(tmp_path / "ck"), log, late=None, shards=1, trigger={"availableNow": True})
    assert q.awaitTermination(300) and not q.exception()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert 0 < max(sizes) <= live.CELLS + 10, sizes
    got = {r["path"]: r["size"] for r in live.snapshot_of(live.read_log(spark, log)).collect()}
    assert got == {p: s for _, _, _, p, _, _, s in rows if s % 5 != 3 and s != 4}
