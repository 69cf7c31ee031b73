"""Places of a regex's groups, against Python's own."""

import re

import pytest
from pyspark.sql import functions as F

from pathloom.functions.groups import captured
from pathloom.operators.results import highlight_regex

PATTERNS = ["(o)c(o)", "o(c[0-9]*)([0-9])[.]([a-z]+)", "a(b)|c(d(e))", "(ab)+c(d)", "(?:x(a)y)*z([0-9]{2,3})", "a\\(b[()](c)", "(a|ab)(c|bcd)(d*)", "((a)(b))+", "(é+)(x)", "(?:(a)|b)(c)", "x(?=y)(y)", "(a)(b)?(c)", "((?:ab|cd)+)(e)", "(ab|cd)+(e)", "(a)\\1(b)", "[(](a)[)]"]
TEXTS = ["oco", "xocoo", "oc12.txt", "cde ab", "abababcd", "xayxayz123", "a(b(c", "abcd", "abab", "ééx", "ac bc", "xyy", "ac abc", "abcdabe", "cdabe", "aab", "(a)", "", "zzz", "é oco"]


def test_groups_stand_where_python_finds_them(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "name string")
    for pattern in PATTERNS:
        n = re.compile(pattern).groups
        got = {r["name"]: [(h["start"], h["end"]) for h in r["h"]] for r in rows.select("name", highlight_regex(pattern, groups=n).alias("h")).collect()}
        for text in TEXTS:
            m = re.search(pattern, text)
            at = lambda i: len(text[:i].encode())
            want = [] if not m else [(at(m.start()), at(m.end()))] + [(at(m.start(g)), at(m.end(g))) for g in range(1, n + 1) if m[g]]
            assert got[text] == want, (pattern, text)


def test_groups_without_a_place():
    for pattern in ("(?=(a))a", "((a)|b)+", "(a"):
        with pytest.raises((ValueError, IndexError, TypeError)):
            captured(pattern)


def test_plan_of_an_expression(spark):
    """It stays an expression: no Python in the plan."""
    plan = spark.range(1).select(F.lit("oco").alias("name")).select(highlight_regex("(o)c(o)", groups=2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
