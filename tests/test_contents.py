import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pathloom.functions import contents as K
from pathloom.functions.paths import name_of
from pathloom.operators import results as R
from pathloom.sources import inventory
from pathloom.sources.contents import with_content_type


def told(data: bytes) -> str:
    """The plain reading: every signature is tried, the one that names most bytes wins."""
    best = None
    for offset, pattern, mime in K.TABLE:
        pairs = [(offset + i // 2, pattern[i : i + 2]) for i in range(0, len(pattern), 2) if pattern[i] != "."]
        if all(len(data) > i and data[i] == int(x, 16) for i, x in pairs) and (best is None or len(pairs) > best[0]):
            best = (len(pairs), mime)
    if not data:
        return K.EMPTY
    if best:
        return best[1]
    head = data[: K.HEAD]
    for cut in range(4 if len(data) >= K.HEAD else 1):
        try:
            text = head[: len(head) - cut].decode()
        except UnicodeDecodeError:
            continue
        return K.OTHER if any(ord(c) < 32 and c not in "\b\t\n\f\r\x1b" or c == "\x7f" for c in text) else K.TEXT
    return K.OTHER


def samples() -> list[bytes]:
    out = [b"", b"a", b"\xff", b"plain\n", b"nul\0", b"del\x7f", "é".encode(), "é".encode()[:1], b"\x1b[1m", b"PK\x03\x04 and text"]
    for offset, pattern, _ in K.TABLE:
        whole = b" " * offset + bytes.fromhex(pattern.replace("..", "00"))
        out += [whole, whole[:-1], whole + b"\0\1 text", b"x" + whole, whole + b"t" * 600]
    for letter in ("é", "€", "😀"):
        size = len(letter.encode())
        out += [b"t" * (K.HEAD - n) + letter.encode() * 3 for n in range(size + 1)] + [b"t" * (K.HEAD - 1 - n) + letter.encode()[:-1] for n in range(size)]
    return out


def test_bytes_as_a_plain_reading(spark):
    data = samples()
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)] + [(-1, None)], "i int, head binary")
    got = {r.i: r.t for r in rows.select("i", K.bytes_type("head").alias("t")).collect()}
    assert got.pop(-1) is None
    wrong = [(data[i][:40], t, told(data[i])) for i, t in got.items() if t != told(data[i])]
    assert not wrong
    assert len({m for _, _, m in K.TABLE}) > 80 and {m for _, _, m in K.TABLE} <= set(got.values())


def test_types_of_files(spark, tmp_path):
    (tmp_path / "shot").write_bytes(b"\x89PNG\r\n\x1a\n...")
    (tmp_path / "named.pdf").write_bytes(b"\x89PNG\r\n\x1a\n...")
    (tmp_path / ".hidden").write_bytes(b"text")
    (tmp_path / "large.bin").write_bytes(b"\0" * 3_000_000)
    (tmp_path / "nothing").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "link").symlink_to("shot")
    (tmp_path / "broken").symlink_to("nowhere")
    os.mkfifo(tmp_path / "pipe")
    listed = inventory.scan_tree(spark, [str(tmp_path)]).withColumn("name", name_of("path"))
    gone = listed.limit(1).select("root", F.lit(str(tmp_path) + "/gone").alias("path"), F.lit(False).alias("is_folder"), *listed.columns[3:-1], F.lit("gone").alias("name"))
    got = {r.path[len(str(tmp_path)) :]: r.content_type for r in with_content_type(listed.unionByName(gone)).collect()}
    assert got == {"": "inode/directory", "/sub": "inode/directory", "/shot": "image/png", "/link": "image/png", "/named.pdf": "application/pdf", "/.hidden": K.TEXT, "/large.bin": K.OTHER, "/nothing": K.EMPTY, "/broken": "unknown", "/pipe": "unknown", "/gone": "unknown"}
    assert with_content_type(listed.limit(0)).collect() == []


def test_huge_folders_come_in_parts(spark, tmp_path, monkeypatch):
    import pandas as pd

    for i in range(250):
        (tmp_path / f"f{i}").write_bytes(b"x" * i)
    (tmp_path / os.fsdecode(b"\xff")).write_bytes(b"")
    monkeypatch.setattr(inventory, "PART", 100)
    parts = list(inventory._names([pd.DataFrame({"root": ["r", "r"], "path": [str(tmp_path), "/nowhere"]})]))
    assert [len(p) for p in parts] == [100, 100, 50]
    rows = inventory.scan_tree(spark, [str(tmp_path)]).where("not is_folder").collect()
    assert sorted((os.path.basename(r.path), r.size) for r in rows) == sorted((f"f{i}", i) for i in range(250))


@pytest.mark.parametrize("hot", [0, 3000])
def test_groups_over_many_ranges(spark, hot):
    """One folder of most rows, ties, repeated rows, nulls in every column."""
    rows = [("/", "/hot", f"/hot/{i % 2500}", i % 7 if i % 11 else None) for i in range(hot)]
    rows += [("/", f"/d{i % 9}" if i % 10 else None, f"/x{i % 130}" if i % 13 else None, i % 5 if i % 3 else None) for i in range(400)]
    t = spark.createDataFrame(rows, "root string, parent_path string, path string, size bigint")
    plain = Window.partitionBy("root", "parent_path").orderBy(F.desc("size"), "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = t.select("parent_path", "path", "size", F.sum("size").over(plain).alias("s"), F.count("*").over(plain).alias("n"))
    order = [F.desc("size"), F.asc("path")]
    got = R._running(R._running(t, ["root", "parent_path"], order, F.col("size"), "s"), ["parent_path"], order, F.lit(1), "n")
    key = lambda r: repr((r.parent_path, r.path, r.size, r.s, r.n))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert R.rank_within(t.limit(0), "parent_path").collect() == []
