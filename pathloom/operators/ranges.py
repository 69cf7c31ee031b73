"""Range joins: values against intervals, few or many, and totals by interval without the pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import settled

#: Intervals up to this number are sent to the values.
FEW = 1_000
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _code(name: str, kinds: list[T.DataType]) -> Column:
    """A whole number between -2**62 and 2**62 that never falls where the column rises: half
    of a long; the days or half the microseconds of times; else a logarithm in fine steps.
    Values that are close may share one, so what meets by codes is compared again."""
    x = F.col(name)
    if all(isinstance(k, _WHOLE) for k in kinds):
        return F.shiftright(x.cast("bigint"), 1)
    if all(isinstance(k, T.DateType) for k in kinds):
        return F.unix_date(x).cast("bigint")
    if all(isinstance(k, T.TimestampType) for k in kinds):
        return F.shiftright(F.unix_micros(x), 1)
    if all(isinstance(k, (T.TimestampNTZType, T.DateType)) for k in kinds):
        return F.shiftright(F.expr(f"timestampdiff(microsecond, timestamp_ntz '1970-01-01 00:00:00', cast(`{name}` as timestamp_ntz))"), 1)
    if all(isinstance(k, (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType)) for k in kinds):
        d = x.cast("double")
        size = F.floor(F.least(F.log1p(F.abs(d)), F.lit(800.0)) * F.lit(float(1 << 52))).cast("bigint")
        return F.when(F.isnan(d), F.lit(801 << 52)).when(d < 0, -size).otherwise(size)
    raise TypeError(f"no range join over {kinds}")


def range_join(rows: DataFrame, value: str, intervals: DataFrame, lo: str = "lo", hi: str = "hi", few: int = FEW) -> DataFrame:
    """``rows`` with each of the ``intervals`` [lo, hi) that holds their value: numbers of any
    kind, dates or times; nulls and empty intervals join with nothing.

    Few intervals are broadcast.  Many are cut into the dyadic cells of their codes, at most
    two of each size 1, 2, 4, ...; a value lies in one cell of each size, so large tables meet
    in an ordinary shuffle by size and cell.  Both ways end in the same comparison.
    """
    inside = (F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))
    if intervals.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(intervals), inside)
    kinds = [rows.schema[value].dataType, intervals.schema[lo].dataType, intervals.schema[hi].dataType]
    cut = intervals.where(F.col(lo) < F.col(hi)).withColumns({"__lo": _code(lo, kinds), "__hi": _code(hi, kinds) + 1})
    cut = cut.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(62))))
    cells = cut.withColumns({"__a": F.expr("-shiftright(-__lo, __level)"), "__b": F.expr("shiftright(__hi, __level)")}).where("__a < __b")
    ends = F.array(F.when(F.expr("(__a & 1) = 1"), F.col("__a")), F.when(F.expr("(__b & 1) = 1"), F.col("__b") - 1))
    # the ends of a level may be the same cell
    cells = cells.withColumn("__cell", F.explode(F.array_distinct(F.filter(ends, lambda c: c.isNotNull())))).drop("__a", "__b", "__lo", "__hi")
    levels = [r[0] for r in cells.select("__level").distinct().collect()]  # 63 at most
    at = rows.withColumn("__code", _code(value, kinds)).withColumn("__level", F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>"))).withColumn("__cell", F.expr("shiftright(__code, __level)"))
    # Spark takes exploded tables for as small as what they come from: never broadcast them
    return at.join(cells.hint("merge"), ["__level", "__cell"]).where(inside).drop("__level", "__cell", "__code")


def range_totals(rows: DataFrame, value: str, intervals: DataFrame, sums: Sequence[str] = (), lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Each of the ``intervals`` [lo, hi) that holds any of the values, with ``n``, the number of
    rows whose value it holds, and the ``sums`` over them (whole numbers; nulls add nothing): what
    ``range_join`` gives once it is counted by interval, without a row for each pair.

    Values and ends, compared in their common type, lie in one order, cut into ranges that are
    summed each by itself; what is before an interval's end less what is before its start is the
    interval's.  The work grows with values and intervals, not with the pairs they make.
    """
    kinds = [rows.schema[value].dataType, intervals.schema[lo].dataType, intervals.schema[hi].dataType]
    _code(value, kinds)
    if odd := [c for c in sums if not isinstance(rows.schema[c].dataType, _WHOLE)]:
        raise TypeError(f"no exact differences of {odd}")
    measures = {"__n": F.count("*").cast("decimal(38,0)")} | {f"__sum{i}": F.sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")).cast("decimal(38,0)") for i, c in enumerate(sums)}
    intervals = intervals.where(F.col(lo) < F.col(hi))
    points = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__at")).agg(*(v.alias(k) for k, v in measures.items())).withColumn("__end", F.lit(False))
    ends = intervals.select(F.explode(F.array(lo, hi)).alias("__at")).distinct().select("__at", *(F.lit(0).cast("decimal(38,0)").alias(k) for k in measures), F.lit(True).alias("__end"))
    line = points.unionByName(ends).groupBy("__at").agg(*(F.sum(k).cast("decimal(38,0)").alias(k) for k in measures), F.max("__end").alias("__end"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = settled(line.repartitionByRange(parts, "__at").withColumn("__part", F.spark_partition_id()))
    own = line.groupBy("__part").agg(*(F.sum(k).alias(k) for k in measures))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = F.broadcast(own.select("__part", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_start") for k in measures)))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = line.withColumns({k: F.sum(k).over(inside) - F.col(k) for k in measures}).where("__end").join(starts, "__part")
    before = settled(before.select("__at", *((F.col(k) + F.col(f"{k}_start")).cast("decimal(38,0)").alias(k) for k in measures)))
    side = lambda tag: before.select(F.col("__at").alias(f"__{tag}"), *(F.col(k).alias(f"{k}_{tag}") for k in measures))
    both = intervals.join(side("lo"), F.col(lo) == F.col("__lo")).join(side("hi"), F.col(hi) == F.col("__hi")).where("__n_hi > __n_lo")
    return both.select(*intervals.columns, *((F.col(f"{k}_hi") - F.col(f"{k}_lo")).cast("bigint").alias(c) for k, c in zip(measures, ["n", *sums], strict=True)))
