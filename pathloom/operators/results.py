"""What is done with a search's result: sorts, pages, counts, selections, highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.groups import captured
from ..functions.order import sort_keys
from ..functions.paths import fold, fold_text
from ..sources.scratch import settled
from .predicates import Flags

KEY = ["root", "path"]
#: Rows before a page that a limit may pass over.
NEAR_TOP = 10_000


def sort_by(result: DataFrame, prop: str, desc: bool = False, prev: list[str] | None = None) -> DataFrame:
    return result.orderBy(*sort_keys(prop, desc, prev))


def top(result: DataFrame, k: int, prop: str, desc: bool = False, prev: list[str] | None = None) -> DataFrame:
    """The first k: each task keeps k rows, nothing is sorted whole."""
    return sort_by(result, prop, desc, prev).limit(k)


def page(result: DataFrame, start: int, n: int, prop: str, desc: bool = False) -> DataFrame:
    """Rows ``start`` to ``start + n`` of the order.  A page near the top is a limit; a
    deeper one is cut from the row index, so that nothing before it is gathered."""
    if start <= NEAR_TOP:
        return sort_by(result, prop, desc).offset(start).limit(n)
    return sort_by(with_row_index(result, prop, desc).where(F.col("row_index").between(start, start + n - 1)).drop("row_index"), prop, desc)


def _dealt(result: DataFrame, order: list[Column]) -> DataFrame:
    """Sorted in parallel in ranges of an order and written once, so that counts and rows see the
    same ranges; ``__part`` numbers the ranges, ``__id`` grows with the order."""
    parts = int(result.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = result.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return settled(dealt.withColumn("__part", F.shiftright("__id", 33)))


def _running(result: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of a group, from its first in ``order`` to
    the row itself.  No group is one task: ranges of (by, order) are summed each by itself, and
    a range that starts inside a group adds what the ranges before it hold of that group.
    There is one such group for each range at most, so what is sent to all tasks is bounded
    by the number of ranges."""
    dealt = _dealt(result.withColumn("__value", value), [*(F.asc(b) for b in by), *order])
    own = dealt.groupBy("__part", *by).agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__part")
    before = F.sum("__sum").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    carried = own.select("__part", *by, before.alias("__before"), F.row_number().over(earlier).alias("__nth")).where("__nth > 1 and __before is not null")
    carried = F.broadcast(carried.select(F.col("__part").alias("__at"), "__before", *(F.col(b).alias(f"__by{i}") for i, b in enumerate(by))))
    same = F.col("__part") == F.col("__at")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{i}"))
    inside = F.sum("__value").over(Window.partitionBy("__part", *by).orderBy("__id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = dealt.withColumn("__inside", inside).join(carried, same, "left")
    total = F.coalesce(F.col("__inside") + F.col("__before"), "__inside", "__before")
    return summed.select(*result.columns, total.alias(name))


def with_row_index(result: DataFrame, prop: str, desc: bool = False, prev: list[str] | None = None) -> DataFrame:
    """A row_index from 0 over the whole order, without a single-task window: ranges are
    sorted in parallel, counted, and each range starts where the one before it ends."""
    order = sort_keys(prop, desc, prev)
    dealt = _dealt(result, order)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    starts = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
    inside = F.col("__id") - F.shiftleft("__part", 33)
    return dealt.join(F.broadcast(starts), "__part").withColumn("row_index", F.col("__start") + inside).select(*result.columns, "row_index")


def search_info(result: DataFrame) -> DataFrame:
    """num_files, num_folders, num_entries of a result or of a whole catalog."""
    return result.agg(F.count_if(~F.col("is_folder")).alias("num_files"), F.count_if("is_folder").alias("num_folders"), F.count("*").alias("num_entries"))


catalog_info = search_info


def selection_info(result: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected and total, files and folders."""
    marked = result.join(selection.select(*KEY).distinct().withColumn("__on", F.lit(True)), KEY, "left")
    on, folder = F.col("__on").isNotNull(), F.col("is_folder")
    return marked.agg(F.count_if(on & ~folder).alias("selected_files"), F.count_if(on & folder).alias("selected_folders"), F.count_if(~folder).alias("num_files"), F.count_if(folder).alias("num_folders"))


def root_report(entries: DataFrame, roots: DataFrame, now: int) -> DataFrame:
    """Files, folders and bytes per root, and whether it is due for a scan at ``now``
    (seconds): its period is over, or it is monitored or scanned after launch."""
    own = F.when(~F.col("is_folder"), F.col("size")).otherwise(0)
    found = entries.groupBy("root").agg(F.count_if(~F.col("is_folder")).alias("num_files"), F.count_if("is_folder").alias("num_folders"), F.sum(own).alias("bytes"))
    due = (F.col("rescan_after") > 0) & (F.col("last_scan_time") + F.col("rescan_after") <= now)
    r = roots.where("active").dropDuplicates(["path"]).select(F.col("path").alias("root"), "last_scan_time", due.alias("due"), (F.col("monitor") | F.col("scan_after_launch")).alias("due_at_start"))
    return r.join(found, "root", "left").select("root", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("num_files", "num_folders", "bytes")), "last_scan_time", "due", "due_at_start")


def describe(result: DataFrame, cols: list[str]) -> DataFrame:
    """Only the asked attributes; one that the table lacks reads as 0."""
    return result.select(*(F.col(c) if c in result.columns else F.lit(0).alias(c) for c in cols))


def select_all(result: DataFrame) -> DataFrame:
    return result.select(*KEY).distinct()


def select_none(result: DataFrame) -> DataFrame:
    return result.select(*KEY).where(F.lit(False))


def select_range(indexed: DataFrame, a: int, b: int) -> DataFrame:
    """Keys of rows a to b of a result with row_index, ends in any order."""
    return indexed.where(F.col("row_index").between(min(a, b), max(a, b))).select(*KEY)


def toggle(selection: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys in one of the two but not in both."""
    both = selection.select(*KEY).distinct().unionByName(rows.select(*KEY).distinct())
    return both.groupBy(*KEY).agg(F.count("*").alias("n")).where("n = 1").select(*KEY)


def invert(result: DataFrame, selection: DataFrame) -> DataFrame:
    return result.select(*KEY).distinct().join(selection, KEY, "left_anti")


def drop_removed(selection: DataFrame, removed: DataFrame) -> DataFrame:
    return selection.join(removed, KEY, "left_anti")


def union_results(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(KEY)


def intersect_results(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY).distinct(), KEY, "left_semi")


def except_results(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY).distinct(), KEY, "left_anti")


def _octets(text: Column, chars: Column) -> Column:
    return F.octet_length(F.left(text, chars))


def _hit(text: Column, needle: str, case: bool = False) -> tuple[Column, Column]:
    """First and last (excluded) character, from 1, of the first hit; 0 without any."""
    if case or needle.isascii():
        at = F.instr(text if case else fold(text), needle if case else fold_text(needle))
        return at, at + len(needle)
    like = lambda c: F.collate(c, Flags.collation)
    at = F.instr(like(text), F.lit(needle))
    sizes = F.sequence(F.lit(1), F.lit(3 * len(needle)))
    size = F.filter(sizes, lambda n: like(F.substring(text, at, n)) == like(F.lit(needle)))
    return at, at + F.coalesce(F.get(size, 0), F.lit(len(needle)))


def highlight_term(needle: str, case: bool = False, field: str = "name") -> Column:
    """ARRAY<STRUCT<field, start, end>> in bytes: the first hit of a substring.  A needle
    beyond ASCII is found as ``term`` finds it; its hit may be longer or shorter."""
    at, end = _hit(F.col(field), needle, case)
    return F.when(at > 0, F.array(F.struct(F.lit(field).alias("field"), _octets(F.col(field), at - 1).alias("start"), _octets(F.col(field), end - 1).alias("end")))).otherwise(F.array().cast("array<struct<field:string,start:int,end:int>>"))


def highlight_regex(pattern: str, field: str = "name", groups: int = 0) -> Column:
    """The whole first match of a regex, and those of its groups that hold any text.  The regex
    is asked with all text between groups captured too, so a group's place is a sum of lengths
    (``groups.captured``)."""
    asked, places = captured(pattern)
    rx = "(?d)(?iu)" + asked
    part = lambda g: F.octet_length(F.regexp_extract(F.col(field), rx, g))
    at = F.regexp_instr(F.col(field), F.lit(rx))
    start = _octets(F.col(field), at - 1)
    empty = F.array().cast("array<struct<field:string,start:int,end:int>>")
    span = lambda a, b: F.struct(F.lit(field).alias("field"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    spans = [span(start, start + part(0))]
    for g in range(1, groups + 1):
        own, terms = places[g]
        a = start
        for number, sign in terms:
            a = a + part(number) * sign
        spans.append(F.when(part(own) > 0, span(a, a + part(own))))
    return F.when(at > 0, F.filter(F.array(*spans), lambda x: x.isNotNull())).otherwise(empty)


def highlight_path(needle: str) -> Column:
    """A substring of the path, split over the folder part and the name."""
    at, end = _hit(F.col("path"), needle)
    a, b = _octets(F.col("path"), at - 1), _octets(F.col("path"), end - 1)
    cut = F.octet_length("path") - F.octet_length("name")
    folder = F.when(a < cut, F.struct(F.lit("path").alias("field"), a.alias("start"), F.least(b, cut).alias("end")))
    name = F.when(b > cut, F.struct(F.lit("name").alias("field"), F.greatest(a - cut, F.lit(0)).alias("start"), (b - cut).alias("end")))
    return F.when(at > 0, F.filter(F.array(folder, name), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<field:string,start:int,end:int>>"))


def highlight_ext() -> Column:
    """The extension in name and in ext."""
    n, e = F.octet_length("name"), F.octet_length("ext")
    return F.when(F.length("ext") > 0, F.array(F.struct(F.lit("name").alias("field"), (n - e).alias("start"), n.alias("end")), F.struct(F.lit("ext").alias("field"), F.lit(0).alias("start"), e.alias("end")))).otherwise(F.array().cast("array<struct<field:string,start:int,end:int>>"))


def highlight_size() -> Column:
    """The whole size column."""
    return F.array(F.struct(F.lit("size").alias("field"), F.lit(0).alias("start"), F.octet_length(F.col("size").cast("string")).alias("end")))


def space_report(result: DataFrame, keys: list[str], mode: str = "rollup") -> DataFrame:
    """Files and bytes by keys, with subtotals by rollup or cube."""
    grouped = getattr(result.where("not is_folder"), mode)(*keys)
    return grouped.agg(F.count("*").alias("num_files"), F.sum("size").alias("bytes"))


def rank_within(result: DataFrame, by: str, order: str = "size") -> DataFrame:
    """The place of each entry, from 1, among those alike in ``by``, the largest ``order`` first."""
    return _running(result, [by], [F.desc(order), F.asc("path")], F.lit(1), "rank")


def share_of_parent(result: DataFrame) -> DataFrame:
    """Each entry's part of its parent's size, and the parts' running total among its
    siblings, the largest first."""
    from .tree import with_parent

    result = _running(with_parent(result), ["root", "parent_path"], [F.desc("size"), F.asc("path")], F.col("size"), "running")
    return result.withColumn("share", F.when(F.col("parent_size") > 0, F.col("size") / F.col("parent_size")))
