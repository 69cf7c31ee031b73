"""Size, number and date texts as intervals: STRUCT<lo, hi>, null where they say nothing.

``now`` is always given, so results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col, fold

_SIZES = {"k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}


def _pair(ok: Column, lo: Column, hi: Column) -> Column:
    return F.when(ok, F.struct(lo.alias("lo"), hi.alias("hi")))


def size_interval(x: Column | str) -> Column:
    """Integer, optional k m g t, optional b: ``1kb`` is 1000 to 1949; null beyond 64 bits."""
    x = fold(F.trim(col(x)))
    number = F.regexp_extract(x, "^([0-9]+)([kmgt]?)b?$", 1).try_cast("bigint")
    suffix = F.regexp_extract(x, "^([0-9]+)([kmgt]?)b?$", 2)
    unit = F.coalesce(*(F.when(suffix == s, F.lit(v)) for s, v in _SIZES.items()), F.lit(1)).cast("bigint")
    lo = F.try_multiply(number, unit)
    hi = F.when(suffix == "", lo).otherwise(F.try_add(lo, (unit / 1000 * 950).cast("bigint") - 1))
    return _pair(hi.isNotNull(), lo, hi)


def int_interval(x: Column | str) -> Column:
    x = col(x)
    v = F.when(F.rlike(x, F.lit("^[+-]?[0-9]+$")), x.try_cast("bigint"))
    return _pair(v.isNotNull(), v, v)


_DATE = r"^([0-9]{4}|[0-9]{2})(?:-([0-9]{1,2})(?:-([0-9]{1,2})(?: ([0-9]{1,2})(?::([0-9]{1,2})(?::([0-9]{1,2}))?)?)?)?)?$"


def date_interval(x: Column | str) -> Column:
    """``Y[-m[-d[ H[:M[:S]]]]]``, interval of the stated precision, end excluded; two-digit
    years from 69 on belong to the last century; nothing before 1970."""
    x = F.trim(col(x))
    part = [F.regexp_extract(x, _DATE, i) for i in range(1, 7)]
    year = F.when(F.length(part[0]) == 2, part[0].try_cast("int") + F.when(part[0].try_cast("int") >= 69, 1900).otherwise(2000)).otherwise(part[0].try_cast("int"))
    number = [F.coalesce(p.try_cast("int"), F.lit(d)) for p, d in zip(part[1:], (1, 1, 0, 0, 0), strict=True)]
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, *number)
    lo = text.try_cast("timestamp_ntz")
    step = F.coalesce(*(F.when(part[i] != "", F.expr(f"interval 1 {u}")) for i, u in ((5, "second"), (4, "minute"), (3, "hour"))), F.lit(None))
    month = F.when(part[1] == "", F.lit(12)).when(part[2] == "", F.lit(1))
    hi = F.when(part[3] != "", lo + step).when(part[2] != "", lo + F.expr("interval 1 day")).otherwise(lo + F.make_ym_interval(F.lit(0), month))
    return _pair((part[0] != "") & lo.isNotNull() & (year >= 1970), lo, hi)


# Names, in the order of the calendar; numbers as words.
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "dozen": 12, "hundred": 100}
UNITS = {"year": "year", "month": "month", "week": "week", "day": "day", "hour": "hour", "minute": "minute", "min": "minute", "second": "second", "sec": "second"}

# Counts that reach back 1900 years, so that no date leaves the calendar.
MOST = {"year": 1_900, "month": 22_800, "week": 99_000, "day": 693_000, "hour": 16_600_000, "minute": 998_000_000, "second": 2_147_483_647}

_RELATIVE = "^(inthelast|last|previous|prev|past|this)?([0-9]+|" + "|".join(NUMBERS) + ")?(year|month|week|day|hour|minute|min|second|sec)(s?)$"


def relative_interval(x: Column | str, now: Column | str) -> Column:
    """today, yesterday, weekday and month names, and counts of units up to ``now``
    (timestamp without zone).  Weeks start on Monday.  More than one needs a plural, one a
    singular; min and sec are both.  Counts of more than 1900 years say nothing."""
    x, now = fold(F.trim(col(x))), col(now)
    start = lambda unit, t=None: F.date_trunc(unit, now if t is None else t).cast("timestamp_ntz")
    day = start("day")
    days = lambda n: F.make_dt_interval(n)
    none = F.lit(None).cast("struct<lo:timestamp_ntz,hi:timestamp_ntz>")
    named = F.when(x == "today", F.struct(day.alias("lo"), (day + F.expr("interval 1 day")).alias("hi"))).when(x == "yesterday", F.struct((day - F.expr("interval 1 day")).alias("lo"), day.alias("hi")))
    for i, w in enumerate(WEEKDAYS):
        at = day - days(F.pmod(F.weekday(now) - i, F.lit(7)))
        named = named.when(x.isin(w, w[:3]), F.struct(at.alias("lo"), (at + F.expr("interval 1 day")).alias("hi")))
    for i, m in enumerate(MONTHS, 1):
        at = start("month") - F.make_ym_interval(F.lit(0), F.pmod(F.month(now) - i, F.lit(12)))
        named = named.when(x.isin(m, m[:3]), F.struct(at.alias("lo"), (at + F.expr("interval 1 month")).alias("hi")))
    prefix, count, unit, plural = (F.regexp_extract(x, _RELATIVE, i) for i in range(1, 5))
    word = F.element_at(F.create_map(*(F.lit(v) for p in NUMBERS.items() for v in p)), count)
    n = F.when(count == "", F.lit(1)).otherwise(F.coalesce(word, count.try_cast("int")))
    both = unit.isin("min", "sec") & (plural == "")
    fits = (unit != "") & (n >= 1) & (both | (plural == F.when(n > 1, F.lit("s")).otherwise(F.lit("")))) & ~(unit.isin("min", "sec") & (plural == "s"))
    fits &= (prefix != "this") | (count == "")
    asked = n
    for u in dict.fromkeys(UNITS.values()):
        n = F.least(asked, F.lit(MOST[u]))
        back = {"year": F.make_ym_interval(n, F.lit(0)), "month": F.make_ym_interval(F.lit(0), n), "week": F.make_dt_interval(n * 7), "day": F.make_dt_interval(n), "hour": F.make_dt_interval(F.lit(0), n), "minute": F.make_dt_interval(F.lit(0), F.lit(0), n), "second": F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))}[u]
        mine = fits & (asked <= MOST[u]) & unit.isin(*(k for k, v in UNITS.items() if v == u))
        named = named.when(mine & (prefix == "this"), F.struct(start(u).alias("lo"), now.alias("hi")))
        named = named.when(mine & prefix.isin("past", ""), F.struct((now - back).alias("lo"), now.alias("hi")))
        named = named.when(mine, F.struct((start(u) - back).alias("lo"), start(u).alias("hi")))
    return named.otherwise(none)
