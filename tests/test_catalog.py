"""Round trips and properties of the catalog."""

import datetime
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from pathloom.functions import literals, sql
from pathloom.functions import paths as P
from pathloom.functions.order import natural_key
from pathloom.operators import changes as C
from pathloom.operators import rules as B
from pathloom.operators import tree as T
from pathloom.operators.ranges import range_join, range_totals
from pathloom.plans import queries as plans
from pathloom.sources import inventory, snapshot
from pathloom.sources.scratch import shared_folder
from pathloom.streaming import feed

FEED = [
    (1, "/r/a/x", "CREATE", False, 5), (2, "/r/a/y", "CREATE", False, 7), (3, "/r/ab", "CREATE", False, 1), (4, "/r/a/x", "CLOSE_WRITE", False, 9),
    (5, "/r/z", "ATTRIB", False, 3), (6, "/r/a", "DELETE", True, 0), (7, "/r/a/y", "MOVED_TO", False, 8), (8, "/r/b", "CREATE", False, 2), (9, "/r/b", "DELETE", False, 0),
]


def changes(spark, rows=FEED):
    df = spark.createDataFrame([(s, "/r", p, k, d, n) for s, p, k, d, n in rows], "seq bigint, root string, path string, kind string, is_folder boolean, size bigint")
    return df.select("seq", F.timestamp_seconds("seq").alias("ts"), "root", "path", "kind", "is_folder", "size", F.expr(T.EPOCH).alias("mtime"))


def test_fold(spark):
    df = changes(spark)
    final = C.fold(df, df.select(*T.CORE).where("false"))
    assert sorted((r["path"], r["size"]) for r in final.collect()) == [("/r/a/y", 8), ("/r/ab", 1)]
    assert {r["seq"] for r in C.drop_obsolete(df).collect()} == {3, 5, 6, 7, 8, 9}
    old = C.fold(df.where("seq < 5"), df.select(*T.CORE).where("false"))
    again = C.fold(C.diff_feed(old, final), old)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, final.collect()))


def test_excludes(spark):
    rules = spark.createDataFrame([("*.tmp", True, "wildcard", "basename", "files"), ("/home/user/build", True, "fixed", "full_path", "folders"), (".*[.](swp|bak)$", True, "regex", "basename", "files"), ("(", True, "regex", "basename", "both")], B.RULE)
    paths = [("/home/user/build", True), ("/home/user/build/x", False), ("/home/user/file.tmp", False), ("/home/user/foo.swp", False), ("/home/user/.gitignore", False), ("/home/user/file.txt", False)]
    rows = T.described(spark.createDataFrame([("/home", p, d) for p, d in paths], "root string, path string, is_folder boolean"))
    assert [r["path"] for r in B.apply_excludes(rows, rules, True).collect()] == ["/home/user/file.txt"]


def test_scan_snapshot(spark, tmp_path):
    top = tmp_path / "tree"
    (top / "subdir").mkdir(parents=True)
    for name, size in (("a.txt", 12), ("subdir/b.txt", 2), ("subdir/c.txt", 1), (".h", 1)):
        (top / name).write_bytes(b"x" * size)
    rows = T.catalog(inventory.scan_tree(spark, [str(top)]))
    got = {r["path"].removeprefix(str(top)): (r["size"], r["depth"]) for r in rows.collect()}
    assert got == {"": (16, 0), "/a.txt": (12, 1), "/.h": (1, 1), "/subdir": (3, 1), "/subdir/b.txt": (2, 2), "/subdir/c.txt": (1, 2)}
    rules, roots = B.default_excludes(spark), spark.createDataFrame([(str(top), True)], "path string, active boolean")
    snapshot.save_snapshot(rows, str(tmp_path / "snap"), roots, rules)
    back = snapshot.load_snapshot(spark, str(tmp_path / "snap"))
    assert snapshot.checksum(back.select(*sorted(rows.columns))) == snapshot.checksum(rows)


def test_stream_is_batch(spark, tmp_path):
    df = changes(spark)
    for i, (a, b) in enumerate(((0, 4), (4, 20))):
        df.where(f"seq > {a} and seq <= {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.2)
    stream = feed.read_changes(spark, str(tmp_path / "in"), 1)
    q = feed.write_catalog(stream, str(tmp_path / "cat"), str(tmp_path / "ck"), trigger={"availableNow": True})
    q.awaitTermination(120)
    final = C.fold(df, df.select(*T.CORE).where("false"))
    assert sorted(map(tuple, feed.read_catalog(spark, str(tmp_path / "cat")).collect())) == sorted(map(tuple, final.collect()))


def test_type_order_of_all_entries(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        for name in ("orders", "customer", "nation", "region", "lineitem", "documents", "pages"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        want = db.execute(plans.ORACLES["g4_g6_sort_type_all"]).fetchall()
    got = [tuple(r) for r in plans.QUERIES["g4_g6_sort_type_all"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and sorted(i for _, i in got) == list(range(len(got)))


def test_stream_of_late_events_is_batch(spark, tmp_path):
    """Batches out of order, a batch twice, removals of folders and of the root."""
    rows = [*FEED, (10, "/r/c/d", "CREATE", False, 4), (11, "/r", "DELETE_SELF", True, 0), (12, "/r/c/e", "CREATE", False, 6), (13, "/r/c/e", "ATTRIB", False, 1), (14, "/r/c/f", "CREATE", False, 2), (15, "/r/c", "DELETE", True, 0), (16, "/r/c/g", "CREATE", False, 3)]
    df = changes(spark, rows)
    batches = [(13, 13), (6, 9), (1, 5), (15, 16), (10, 12), (6, 9), (14, 14)]
    for a, b in batches:
        df.where(f"seq between {a} and {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.2)
    out = str(tmp_path / "cat")
    q = feed.write_catalog(feed.read_changes(spark, str(tmp_path / "in"), 1), out, str(tmp_path / "ck"), {"all": F.lit(True)}, str(tmp_path / "out"), trigger={"availableNow": True})
    assert q.awaitTermination(180) and not q.exception()
    want = sorted(map(tuple, C.fold(df, df.select(*T.CORE).where("false")).collect()))
    got = lambda: sorted(map(tuple, feed.read_catalog(spark, out).collect()))
    assert [r[1] for r in want] == ["/r/c/g"] and got() == want
    feed.compact(spark, out)
    assert got() == want
    moved = spark.read.parquet(str(tmp_path / "out")).groupBy("path").agg(F.sum(F.when(F.col("delta") == "enter", 1).otherwise(-1)).alias("n")).where("n <> 0")
    assert [tuple(r) for r in moved.collect()] == [("/r/c/g", 1)]
    # by path, whatever the order of batches: an update that comes before the entry it is of
    two = changes(spark, [(6, "/r/x", "ATTRIB", False, 7), (5, "/r/x", "CREATE", False, 1)])
    for seq in (6, 5):
        two.where(f"seq = {seq}").coalesce(1).write.mode("append").parquet(str(tmp_path / "two"))
        time.sleep(0.2)
    q = feed.fold_paths(feed.read_changes(spark, str(tmp_path / "two"), 1)).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and not q.exception()
    assert [(r["live"], r["size"]) for r in spark.table("folded").collect()][-1] == (True, 7)


def test_snapshot_refusals(spark, tmp_path):
    rows = T.catalog(changes(spark).where("kind = 'CREATE'").select(*T.CORE))
    rules, roots = B.default_excludes(spark), spark.createDataFrame([("/r", True)], "path string, active boolean")
    path = str(tmp_path / "snap")
    base = snapshot.save_snapshot(rows, path, roots, rules)
    assert snapshot.load_snapshot(spark, path).count() == rows.count()
    spark.createDataFrame([("/other", True)], roots.schema).write.mode("append").parquet(f"{base}/roots")
    with pytest.raises(ValueError, match="changed"):
        snapshot.load_snapshot(spark, path)
    newer = spark.read.parquet(f"{path}/manifest").withColumn("major", F.lit(snapshot.MAJOR + 1)).withColumn("saved", F.current_timestamp())
    newer.write.mode("append").parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="version"):
        snapshot.load_snapshot(spark, path)


def test_malformed_inventory_values(spark):
    rows = spark.createDataFrame([("/a", "12x", "no date", "maybe"), ("/b/", "7", "2024-01-02", "true"), ("", "1", None, None), (None, "1", None, None)], "path string, size string, mtime string, d string")
    got = {r["path"]: (r["size"], str(r["mtime"]), r["is_folder"]) for r in inventory.read_inventory(rows, is_folder="d").collect()}
    assert got == {"/a": (0, "1970-01-01 00:00:00", False), "/b": (7, "2024-01-02 00:00:00", True)}


def test_long_rule_tables(spark):
    """Beyond the inline bound the same rules, broken ones too, give the same rows."""
    few = [("(", True, "regex", "basename", "both"), ("x.*", True, "regex", "basename", "both"), ("/r/b", True, "fixed", "full_path", "folders")]
    many = few + [(f"name{i}", True, "fixed", "basename", "both") for i in range(B.INLINE_RULES + 10)]
    rows = T.described(spark.createDataFrame([("/r", p, d) for p, d in (("/r/x1", False), ("/r/b", True), ("/r/b/c", False), ("/r/d", False), ("/r", True))], "root string, path string, is_folder boolean"))
    for rules in (few, many):
        got = B.apply_excludes(rows, spark.createDataFrame(rules, B.RULE))
        assert sorted(r["path"] for r in got.collect()) == ["/r", "/r/d"]


def test_range_join_by_cells(spark):
    rnd = random.Random(6)
    values = [rnd.randint(-300, 300) for _ in range(200)] + [None, 2**62, -(2**62)]
    ranges = [(i, *sorted((rnd.randint(-320, 320), rnd.randint(-320, 320)))) for i in range(60)] + [(98, -(2**62), 2**62), (99, 5, 5)]
    rows, table = spark.createDataFrame([(v,) for v in values], "v bigint"), spark.createDataFrame(ranges, "k int, lo bigint, hi bigint")
    want = sorted((v, k) for v in values if v is not None for k, lo, hi in ranges if lo <= v < hi)
    for few in (0, 1000):
        assert sorted((r["v"], r["k"]) for r in range_join(rows, "v", table, few=few).collect()) == want


def test_range_join_of_any_kind(spark):
    """Both ways give the same rows: fractions, the ends of a long, NaN and infinities, times."""
    nan, inf = float("nan"), float("inf")
    numbers = [5.7, 6.2, -0.0, 0.0, 1e-300, -1e300, 1e300, inf, -inf, nan, None, 3.0, 2.9999999999999996, 1e17, 1e17 + 16]
    ranges = [(0, 5.8, 7.0), (1, 5.7, 5.8), (2, -inf, 0.0), (3, 0.0, inf), (4, 3.0, 3.0), (5, 2.9999999999999996, 3.0), (6, -1e300, 1e300), (7, 0.0, nan), (8, 7.0, 5.0), (9, 1e17, 1e17 + 16), (10, None, 3.0), (11, -1e-300, 1e-299)]
    cases = [([(v,) for v in numbers], "v double", ranges, "k int, lo double, hi double")]
    least, most = -(2**63), 2**63 - 1
    longs = [least, least + 1, -1, 0, 1, most - 1, most, None]
    cases.append(([(v,) for v in longs], "v bigint", [(0, least, most), (1, least, least + 1), (2, most - 1, most), (3, -1, 1), (4, 0, 0), (5, least, 0)], "k int, lo bigint, hi bigint"))
    cases.append(([(v,) for v in longs[2:5]] + [(5,), (6,), (7,)], "v bigint", [r for r in ranges if r[0] in (0, 3, 6, 11)], "k int, lo double, hi double"))
    days = [datetime.datetime(1969, 12, 31, 23), datetime.datetime(2024, 3, 10, 2, 30, 0, 1), datetime.datetime(2024, 3, 10, 2, 30), None]
    cases.append(([(v,) for v in days], "v timestamp_ntz", [(0, days[0], days[1]), (1, days[2], days[1]), (2, days[1], days[1]), (3, datetime.datetime(1, 1, 1), datetime.datetime(9999, 1, 1))], "k int, lo timestamp_ntz, hi timestamp_ntz"))
    for values, kind, table, kinds in cases:
        rows, intervals = spark.createDataFrame(values, kind), spark.createDataFrame(table, kinds)
        few, many = (sorted((str(r["v"]), r["k"]) for r in range_join(rows, "v", intervals, few=n).collect()) for n in (1000, 0))
        assert few == many and few
    with pytest.raises(TypeError):
        range_join(spark.createDataFrame([("a",)], "v string"), "v", spark.createDataFrame([("a", "b")], "lo string, hi string"), few=0)


def test_range_totals_without_pairs(spark):
    """The same as counting the pairs, but no table grows with them."""
    rnd = random.Random(8)
    values = [(rnd.choice([None, -0.0, 0.0, float("nan"), float("inf"), rnd.randint(-30, 30) / 4]), rnd.choice([None, 3, -(2**62)])) for _ in range(300)]
    ends = lambda: rnd.choice([None, -0.0, 0.0, float("nan"), -float("inf"), rnd.randint(-40, 40) / 4])
    ranges = [(i % 50, ends(), ends()) for i in range(120)]
    rows, table = spark.createDataFrame(values, "v double, b bigint"), spark.createDataFrame(ranges, "k int, lo double, hi double")
    by = lambda df, n, b: sorted((r["k"], r["n"], r["b"]) for r in df.groupBy("k").agg(n.alias("n"), F.sum(F.coalesce(b, F.lit(0)).cast("decimal(38,0)")).alias("b")).collect())
    want = by(range_join(rows, "v", table), F.count("*"), F.col("b"))
    assert by(range_totals(rows.limit(300), "v", table).withColumn("b", F.lit(0)), F.sum("n"), F.col("b")) == [(k, n, 0) for k, n, _ in want] and want
    small = rows.withColumn("b", F.col("b") % 1000)
    assert by(range_totals(small, "v", table, ["b"]), F.sum("n"), F.col("b")) == by(range_join(small, "v", table), F.count("*"), F.col("b"))
    days = spark.createDataFrame([(datetime.datetime(2024, 1, d, 12),) for d in range(1, 9)], "v timestamp_ntz")
    got = range_totals(days, "v", spark.createDataFrame([(1, datetime.date(2024, 1, 2), datetime.date(2024, 1, 5)), (2, datetime.date(2025, 1, 1), datetime.date(2025, 1, 2))], "k int, lo date, hi date"))
    assert [(r["k"], r["n"]) for r in got.collect()] == [(1, 3)]
    # 4000 values in each of 4000 intervals: 16 million pairs, which no table of the job holds
    wide = range_totals(spark.range(4000), "id", spark.range(4000).select(F.col("id").alias("k"), (-F.col("id")).alias("lo"), (F.col("id") + 4000).alias("hi")), ["id"])
    assert [tuple(r) for r in wide.groupBy("n", "id").count().collect()] == [(4000, 7998000, 4000)]
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" not in plan and "__level" not in plan
    # exploded cells look small to Spark, and were sent whole through the driver
    many = range_join(days, "v", spark.range(50).select("id", F.expr("timestamp_ntz '2024-01-01'").alias("lo"), F.expr("timestamp_ntz '2024-01-03'").alias("hi")), few=0)
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()


def test_sql_functions(spark):
    sql.register(spark)
    one = lambda q: spark.sql(f"SELECT {q}").first()[0]
    assert one("path_ancestors('/a/b/c', '/')") == ["/", "/a", "/a/b"] and one("path_ancestors('/a', '/a')") == []
    assert one("path_ancestors('/a/b/c', '/a')") == ["/a", "/a/b"] and one("path_depth('/a/b/c', '/a')") == 2
    assert one("path_parent('/a', '/')") == "/" and one("path_join('/', 'x')") == "/x" and one("path_ext('a.tar.gz', false)") == "gz"
    for glob in ("?b.c", "*a[b]", "|{x"):
        assert one(f"glob_to_regex('{glob}')") == spark.range(1).select(P.glob_to_regex(F.lit(glob))).first()[0]
    assert one("path_root('/a/bc/d', array('/a', '/a/b', '/'))") == "/a" and one("path_root('/x', array('/a'))") is None
    assert [tuple(r) for r in spark.sql("SELECT p, folder, place FROM VALUES ('/a/b/c'), ('/a') t(p), LATERAL path_ancestor_rows(p, '/') ORDER BY ALL").collect()] == [("/a", "/", 0), ("/a/b/c", "/", 0), ("/a/b/c", "/a", 1), ("/a/b/c", "/a/b", 2)]
    for name in ("a10b02", "00", "x/1", ""):
        assert spark.sql(f"SELECT natural_key('{name}')").first()[0] == spark.range(1).select(natural_key(F.lit(name))).first()[0]
    for text in ("12mb", "100", "9223372036854775t", "x", "3K"):
        assert one(f"size_interval('{text}')") == spark.range(1).select(literals.size_interval(F.lit(text))).first()[0]


def test_folders_are_plain(spark):
    """The folder table against loops: given folders, repeated ones, one whose own folder
    has no row, nulls, roots without anything else, and no rows at all."""
    rnd = random.Random(11)
    rows = [(r, "/" + "/".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) + f"/f{i}", False, rnd.choice([None, 0, 5, 2**40])) for i in range(120) for r in [rnd.choice(["/", "/a"])]]
    rows = [x for x in rows if x[0] == "/" or x[1].startswith("/a/")]
    rows += [("/", "/lost/empty", True, 3), ("/", "/lost/empty", True, 4), ("/", "/a", True, 1), ("/only", "/only", True, 0)]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "root string, path string, is_folder boolean, size bigint, s long").withColumn("mtime", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    up = lambda p: p.rsplit("/", 1)[0] or "/"
    want = {}
    for root, path, is_folder, size in rows:
        at = path
        while not is_folder and at != root:
            f = want.setdefault((root, up(at)), [None, 0])
            if size is not None:
                f[0] = (f[0] or 0) + size
            f[1] += at == path
            at = up(at)
        if is_folder:
            f = want.setdefault((root, path), [None, 0])
            f[0] = f[0] or 0
    below = {k: sum(r == k[0] and p != r and up(p) == k[1] for r, p in want) for k in want}
    got = {(r["root"], r["path"]): r for r in T.folder_table(df).collect()}
    assert {k: (r["size"], r["num_files"], r["num_folders"]) for k, r in got.items()} == {k: (*v, below[k]) for k, v in want.items()}
    assert ("/", "/lost") not in got and got["/", "/lost/empty"]["mtime"] > got["/", "/b"]["mtime"]
    assert T.folder_table(df.where("false")).count() == 0


def test_scans_and_pushdown(spark):
    """A search over the catalog reads each of its four tables twice at most, folders alone
    once and without a join of their own; a filter on a stored catalog reaches the Parquet scan."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = plans.orders_catalog(spark, "/root/testdata/sf0.001").where("size > 1000")
    assert plan(rows).count("FileScan parquet") == 8 and plan(rows).count("Exchange hash") == 2
    assert plan(rows.where("is_folder")).count("FileScan parquet") == 4 and plan(rows.where("not is_folder")).count("Exchange hash") == 0
    one = T.folder_table(snapshot_of(spark))
    assert plan(one).count("FileScan parquet") == 1 and "Join" not in plan(one)
    stored = snapshot_of(spark).where((F.col("size") > 1000) & F.col("name").startswith("a")).select("path")
    text = plan(stored)
    assert "GreaterThan(size,1000)" in text and "StringStartsWith(name,a)" in text and "mtime" not in text.split("ReadSchema")[1]


def snapshot_of(spark):
    path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    plans.orders_catalog(spark, "/root/testdata/sf0.001").write.parquet(path)
    return spark.read.parquet(path)


def test_remove_paths_reads_the_catalog_once(spark):
    """The list and what it is taken from come from one table that was written."""
    from pathloom.plans.queries import QUERIES

    plan = QUERIES["i9_remove_paths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
