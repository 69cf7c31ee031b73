"""Search predicates: each builds one two-valued Boolean column, so a whole search is one
filter that Catalyst can push down and generate code for."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import date_interval, int_interval, relative_interval, size_interval
from ..functions.paths import col, fold, fold_text
from ..functions.types import content_type


@dataclass(frozen=True)
class Flags:
    """How terms match; groups hand theirs on to what they hold."""

    case: bool = False
    exact: bool = False
    path: bool = False
    regex: bool = False
    auto_path: bool = False
    auto_case: bool = False
    collation: str = "UNICODE_CI"  # for terms beyond ASCII; tr_CI for Turkish

    def but(self, **changes) -> Flags:
        """The flags of an inner group."""
        return replace(self, **changes)


def two_valued(p: Column) -> Column:
    """Null (a column that the entry's type has not) counts as false, so NOT makes it true."""
    return F.coalesce(p, F.lit(False))


def everything() -> Column:
    return F.lit(True)


def nothing() -> Column:
    return F.lit(False)


def all_of(*p: Column) -> Column:
    return reduce(lambda a, b: a & b, p, F.lit(True))


def any_of(*p: Column) -> Column:
    return reduce(lambda a, b: a | b, p, F.lit(False))


def negate(p: Column) -> Column:
    return ~two_valued(p)


def files_only(p: Column | None = None) -> Column:
    return ~F.col("is_folder") & (F.lit(True) if p is None else p)


def folders_only(p: Column | None = None) -> Column:
    return F.col("is_folder") & (F.lit(True) if p is None else p)


def _glob(pattern: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r".^$+()[]{}|\\" else c) for c in pattern) + "$"


def _text(haystack: Column, needle: str, flags: Flags) -> Column:
    """Contains or equals, by the cheapest comparison that folds what the needle needs."""
    if flags.case:
        h, n = haystack, F.lit(needle)
    elif needle.isascii():
        h, n = fold(haystack), F.lit(fold_text(needle))
    else:
        h, n = F.collate(haystack, flags.collation), F.collate(F.lit(needle), flags.collation)
    return h == n if flags.exact else F.contains(h, n)


def term(needle: str, flags: Flags = Flags(), on: Column | str | None = None) -> Column:
    """A word, a pattern with ``*`` or ``?`` (whole string), or with the regex flag a
    regular expression, on the name, or the path where flags or ``auto_path`` say so."""
    if flags.auto_case and any(c.isupper() for c in needle):
        flags = flags.but(case=True)
    in_path = flags.path or (flags.auto_path and "/" in needle)
    haystack = col(on) if on is not None else F.col("path" if in_path else "name")
    if flags.regex:
        return regex(needle, flags, haystack)
    if "*" in needle or "?" in needle:
        return F.rlike(haystack, F.lit(("(?d)" if flags.case else "(?d)(?iu)") + _glob(needle)))
    return _text(haystack, needle, flags)


def compiles(pattern: str) -> bool:
    """Whether the JVM takes a pattern: asked once, on the driver."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JError, PySparkException):
        return False
    return True


def regex(pattern: str, flags: Flags = Flags(), on: Column | str | None = None) -> Column:
    """Unanchored; a pattern that does not compile matches nothing."""
    haystack = col(on) if on is not None else F.col("path" if flags.path else "name")
    text = ("(?d)" if flags.case else "(?d)(?iu)") + pattern
    if not compiles(text):
        return nothing()
    return F.rlike(haystack, F.lit(text))


def ext(*items: str, flags: Flags = Flags()) -> Column:
    """Files with one of the extensions; none, or an empty item, means files without."""
    wanted = items or ("",)
    have = F.col("ext") if flags.case else fold("ext")
    return two_valued(~F.col("is_folder") & have.isin(*(w if flags.case else fold_text(w) for w in wanted)))


def parent(path: str, flags: Flags = Flags()) -> Column:
    """Direct children of a folder; ``''`` for entries without a parent."""
    return _text(F.col("parent_path"), path, flags.but(exact=True))


def cmp(c: Column | str, op: str, start, end=None) -> Column:
    """=, >, <, >=, <= with start, or range: start <= c < end."""
    c = col(c)
    if op == "range":
        return (c == start) if end is None or start is end else (c >= start) & (c < end)
    return {"=": c == start, ">": c > start, "<": c < start, ">=": c >= start, "<=": c <= start}[op]


def _literal(c: Column, op: str, lo: Column, hi: Column, known: Column) -> Column:
    """A bare literal that spans several units is an interval; other operators take its start."""
    p = F.when(lo == hi, c == lo).otherwise((c >= lo) & (c < hi)) if op == "=" else cmp(c, op, lo)
    return two_valued(F.when(known, p))


def between(c: Column | str, a: str | None, b: str | None, interval) -> Column:
    """``a..b`` = [start of a, start of b); either end may be open."""
    c = col(c)
    lo = interval(F.lit(a))["lo"] if a else None
    hi = interval(F.lit(b))["lo"] if b else None
    p = all_of(*([c >= lo] if a else []), *([c < hi] if b else []))
    return two_valued(F.when(lo == hi, c == lo).otherwise(p) if a and b else p)


def size_is(op: str, text: str | None) -> Column:
    """``size_is('>', '1MB')``; a text that says nothing matches nothing, no text everything."""
    if text is None:
        return everything()
    i = size_interval(F.lit(text))
    return _literal(F.col("size"), op, i["lo"], i["hi"], i.isNotNull())


def size_between(a: str | None, b: str | None) -> Column:
    return between("size", a, b, size_interval)


def mtime_is(op: str, text: str | None, now) -> Column:
    """Dates, and words such as ``lastweek`` that hang on ``now``."""
    if text is None:
        return everything()
    i = F.coalesce(date_interval(F.lit(text)), relative_interval(F.lit(text), now))
    return _literal(F.col("mtime"), op, i["lo"], i["hi"], i.isNotNull())


def _int_is(c: Column, op: str, text: str | int) -> Column:
    i = int_interval(F.lit(str(text)))
    return _literal(c, op, i["lo"], i["hi"], i.isNotNull())


def depth_is(op: str, n: str | int) -> Column:
    return _int_is(F.col("depth"), op, n)


def childcount_is(op: str, n: str | int) -> Column:
    return two_valued(F.col("is_folder") & _int_is(F.col("num_files") + F.col("num_folders"), op, n))


def childfilecount_is(op: str, n: str | int) -> Column:
    return two_valued(F.col("is_folder") & _int_is(F.col("num_files"), op, n))


def childfoldercount_is(op: str, n: str | int) -> Column:
    return two_valued(F.col("is_folder") & _int_is(F.col("num_folders"), op, n))


def childcount_between(a: str | None, b: str | None) -> Column:
    return two_valued(F.col("is_folder") & between(F.col("num_files") + F.col("num_folders"), a, b, int_interval))


def empty() -> Column:
    return childcount_is("=", 0)


def content_type_is(needle: str, flags: Flags = Flags()) -> Column:
    return term(needle, flags, content_type("name", "is_folder"))


class Macros:
    """Named searches that other searches may use; one that uses itself yields nothing."""

    def __init__(self, builders: dict):
        self.builders, self.open = builders, []

    def macro(self, name: str, flags: Flags = Flags()) -> Column:
        if name in self.open:
            return nothing()
        self.open.append(name)
        try:
            return self.builders[name](self, flags)
        finally:
            self.open.pop()


def search(entries: DataFrame, query: Column | None = None, filter: Column | None = None) -> DataFrame:
    """Entries that meet the saved filter and the query; a blank one lets all through."""
    return entries.filter(all_of(*(two_valued(p) for p in (filter, query) if p is not None)))
