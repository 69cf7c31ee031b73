"""Small vectors of the search semantics."""

import datetime as dt

from pyspark.sql import functions as F

from pathloom.functions import literals, order
from pathloom.functions import paths as P
from pathloom.operators import filters, results
from pathloom.operators import predicates as D

CI = D.Flags()


def _matches(spark, rows):
    """rows: (predicate on name, haystack, expected)."""
    for i, (p, h, want) in enumerate(rows):
        got = spark.createDataFrame([(h, h, False)], "name string, path string, is_folder boolean").select(D.two_valued(p).alias("r")).first()["r"]
        assert got == want, (i, h, want)


def test_terms(spark):
    t = D.term
    _matches(spark, [
        (t("i"), "ı", False), (t("é"), "e", False), (t("ı"), "i", False), (t("i"), "İ", False), (t("İ"), "i", False),
        (t("?"), "aa", False), (t("*.txt"), "testtxt", False), (t("a", CI.but(case=True)), "A", False), (t("A", CI.but(auto_case=True)), "a", False),
        (t("é"), "É", True), (t("ﬀ"), "affe", True), (t("?"), "ı", True), (t("*c*f"), "abcdef", True), (t("abc?ef"), "abcdef", True),
(D.regex("^b"), "ba", True), (D.regex("^B"), "ba", True), (D.regex("^a"), "ba", False), (D.regex("("), "test", False),
        (t("ABC", CI.but(exact=True)), "aBc", True), (t("ABC", CI.but(exact=True)), "aBcd", False), (t("ȁ", CI.but(exact=True)), "Ȁ", True), (t("ȁ", CI.but(exact=True, case=True)), "Ȁ", False),
        (D.all_of(t("a"), D.negate(D.any_of(t("b"), D.negate(t("c"))))), "ac", True), (D.negate(D.negate(t("b"))), "b", True),
    ])


def test_natural_order(spark):
    for text in ("000 00 01 010 09 0 1 9 10", "a a/b a.b a001 a01 a1 a1b a9 a10 ab"):
        want = text.split()
        got = [r["x"] for r in spark.createDataFrame([(w,) for w in reversed(want)], "x string").orderBy(order.natural_key("x")).collect()]
        assert got == want


def test_extension_and_glob(spark):
    for name, want in ((".hidden", ""), ("dot.", ""), ("none", ""), ("a.ext", "ext"), ("a.b.txt", "txt"), ("", "")):
        assert spark.range(1).select(P.ext_of(F.lit(name), F.lit(False))).first()[0] == want
    for glob, want in (("", "^$"), ("?bc", "^.bc$"), ("ab.", "^ab\\.$"), ("*abc*", "^.*abc.*$"), ("[abc]", "^\\[abc\\]$"), ("|a{", "^\\|a\\{$")):
        assert spark.range(1).select(P.glob_to_regex(F.lit(glob))).first()[0] == want


def test_size_texts(spark):
    mb = 10**6 // 1000 * 950 - 1
    for text, want in (("abc", None), ("mb", None), ("9223372036854775t", None), ("9223372036854775807", (2**63 - 1, 2**63 - 1)), ("0m", (0, mb)), ("100", (100, 100)), ("100abc", None), ("1kb", (1000, 1949)), ("12mB", (12 * 10**6, 12 * 10**6 + mb))):
        got = spark.range(1).select(literals.size_interval(F.lit(text)).alias("i")).first()["i"]
        assert (None if got is None else tuple(got)) == want, text


def test_date_texts(spark):
    now = F.lit("2024-01-15 10:00:00").cast("timestamp_ntz")
    good = "today yesterday thishour pastyear past3years lastweek last2weeks lasttwoweeks inthelastday 4months 3min 3minutes".split()
    bad = "past2000000000years past2000years last2147483647months 2000abc abc past4year pastyears lastweeks 4month".split()
    for t in good + bad:
        got = spark.range(1).select(literals.relative_interval(F.lit(t), now).alias("i")).first()["i"]
        assert (got is not None) == (t in good), t
    for t, ok in (("2022", 1), ("22-1", 1), ("22-1-1 12:00:00", 1), ("2022-01-01 12", 1), ("2022-01 12:00:00", 0), ("1960", 0)):
        assert (spark.range(1).select(literals.date_interval(F.lit(t)).alias("i")).first()["i"] is not None) == bool(ok), t
    week = spark.range(1).select(literals.relative_interval(F.lit("lastweek"), now).alias("i")).first()["i"]
    assert tuple(week) == (dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 15))


def test_extensions_fold_letters_of_ascii_only(spark):
    rows = spark.createDataFrame([("É",), ("é",), ("mp4v",), ("MP4V",), ("Mp4v",), ("",)], "ext string").withColumn("is_folder", F.lit(False))
    found = lambda p: [r["ext"] for r in rows.where(p).collect()]
    assert found(D.ext("É")) == ["É"] and found(D.ext("MP4v")) == ["mp4v", "MP4V", "Mp4v"]
    tags = filters.default_filters()
    assert found(tags["Videos"]) == ["mp4v", "MP4V"] and found(tags["Pictures"]) == [""]


def test_sizes_shown(spark):
    for n, want in ((0, "0 bytes"), (1, "1 byte"), (1150, "1.1 kB"), (1250, "1.2 kB"), (1350, "1.4 kB"), (311250, "311.2 kB"), (999960, "1000.0 kB"), (10**15, "1.0 PB")):
        assert spark.range(1).select(P.format_size(F.lit(n).cast("bigint"))).first()[0] == want, n


def test_highlights_beyond_ascii(spark):
    row = spark.createDataFrame([("/é/aÉxé", "aÉxé")], "path string, name string")
    first = lambda c: [tuple(x) for x in row.select(c.alias("h")).first()["h"]]
    assert first(results.highlight_term("éX")) == [("name", 1, 4)] and first(results.highlight_path("É/A")) == [("path", 1, 4), ("name", 0, 1)]
    assert first(results.highlight_term("É", case=True)) == [("name", 1, 3)] and first(results.highlight_term("zé")) == []
