"""Running values along an order, without one task for each key.

Rows are cut into stretches along the order: a stretch is a value that never falls from row to row. Windows run within
(keys, stretch); what a stretch hands on to the next one (a count, its last time) is one row for each stretch, and these
few rows are stitched in a second pass. So a key with all rows is dealt out to as many tasks as it has stretches.
Keys are not null; rows whose stretch is null come first, as they do in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.operators.settle import settled

#: Days and numbers that one stretch holds.
DAYS, NUMBERS = 64.0, 1 << 16
PART, LOCAL = "scan_part", "scan_local"
BEFORE_ALL = (Window.unboundedPreceding, -1)


def of_days(column: str = "mjd", width: float = DAYS) -> Column:
    return F.coalesce(F.floor(F.col(column) / F.lit(width)).cast("long"), F.lit(-(1 << 62)))


def of_numbers(column: str, width: int = NUMBERS) -> Column:
    return F.coalesce(F.floor(F.col(column) / F.lit(width)).cast("long"), F.lit(-(1 << 62)))


def numbered(rows: DataFrame, keys: list[str], order: list, stretch: Column, name: str, start: int = 1, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``name``: numbers from ``start`` along ``order`` within the keys.

    ``counted`` has the same keys and stretches where a lighter frame can be counted in the place of ``rows``.
    """
    counts = (rows if counted is None else counted).groupBy(*keys, stretch.alias(PART)).agg(F.count(F.lit(1)).alias(LOCAL))
    ahead = F.coalesce(F.sum(LOCAL).over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(*BEFORE_ALL)), F.lit(0))
    offsets = counts.select(*keys, PART, ahead.alias("scan_ahead"))
    own = rows.withColumn(PART, stretch)
    own = own.withColumn(LOCAL, F.row_number().over(Window.partitionBy(*keys, PART).orderBy(*order)))
    return own.join(offsets, [*keys, PART]).select(*[c for c in rows.columns if c != name], (F.col("scan_ahead") + F.col(LOCAL) + F.lit(start - 1)).cast("long").alias(name))


def ahead(rows: DataFrame, keys: list[str], by: str, amount: str, width: int = NUMBERS, name: str = "ahead") -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over the rows before in the order of ``by``, a whole number that no other row of the keys has."""
    own = rows.withColumn(PART, of_numbers(by, width))
    sums = own.groupBy(*keys, PART).agg(F.sum(amount).alias(LOCAL))
    before = lambda c, of, order: F.coalesce(F.sum(c).over(Window.partitionBy(*of).orderBy(order).rowsBetween(*BEFORE_ALL)), F.lit(0))
    handed = sums.select(*keys, PART, before(LOCAL, keys, PART).alias("scan_ahead"))
    own = own.withColumn(LOCAL, before(amount, [*keys, PART], by))
    return own.join(handed, [*keys, PART]).select(*[c for c in rows.columns if c != name], (F.col("scan_ahead") + F.col(LOCAL)).alias(name))


def sessions(times: DataFrame, keys: list[str], gap: float | Column, days: float = DAYS, name: str = "grp") -> DataFrame:
    """``times`` with the number of its session, from 1: a new one where the time before is more than ``gap`` earlier.

    A ``gap`` that is a column is the same for all rows of a key.
    """
    wide = gap if isinstance(gap, Column) else F.lit(float(gap))
    w = Window.partitionBy(*keys, PART).orderBy("mjd")
    own = times.withColumn(PART, of_days(width=days))
    own = own.withColumn(LOCAL, F.when(F.col("mjd") - F.lag("mjd").over(w) > wide, 1).otherwise(0))
    own = own.withColumn(LOCAL, F.sum(LOCAL).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    ends = own.groupBy(*keys, PART).agg(F.min("mjd").alias("scan_first"), F.max("mjd").alias("scan_last"), F.max(LOCAL).alias("scan_breaks"), *([F.max(gap).alias("scan_gap")] if isinstance(gap, Column) else []))
    line = Window.partitionBy(*keys).orderBy(PART)
    apart = F.col("scan_first") - F.lag("scan_last").over(line) > (F.col("scan_gap") if isinstance(gap, Column) else wide)
    opened = ends.withColumn("scan_new", F.when(F.lag(PART).over(line).isNull() | F.coalesce(apart, F.lit(True)), 1).otherwise(0))
    handed = F.sum("scan_new").over(line) + F.coalesce(F.sum("scan_breaks").over(line.rowsBetween(*BEFORE_ALL)), F.lit(0))
    carried = opened.select(*keys, PART, handed.alias("scan_ahead"))
    return own.join(carried, [*keys, PART]).select(*[c for c in times.columns if c != name], (F.col("scan_ahead") + F.col(LOCAL)).alias(name))


def stretched(spans: DataFrame, keys: list[str], gap: float, days: float = DAYS, name: str = "part") -> DataFrame:
    """``spans`` (keys, low, high) numbered by stretches: a new one where a span begins more than ``gap`` behind all before it."""
    w = Window.partitionBy(*keys, PART).orderBy("low", "high")
    line = Window.partitionBy(*keys).orderBy(PART)
    own = spans.withColumn(PART, of_days("low", days))
    own = own.withColumn(LOCAL, F.max("high").over(w.rowsBetween(*BEFORE_ALL)))
    tops = own.groupBy(*keys, PART).agg(F.max("high").alias("scan_top"))
    reach = tops.select(*keys, PART, F.max("scan_top").over(line.rowsBetween(*BEFORE_ALL)).alias("scan_ahead"))
    met = own.join(reach, [*keys, PART]).withColumn(LOCAL, F.when(F.col("low") - F.greatest(LOCAL, "scan_ahead") > gap, 1).otherwise(0)).drop("scan_ahead")
    met = settled(met.withColumn(LOCAL, F.sum(LOCAL).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    breaks = met.groupBy(*keys, PART).agg(F.max(LOCAL).alias("scan_breaks"))
    handed = breaks.select(*keys, PART, F.coalesce(F.sum("scan_breaks").over(line.rowsBetween(*BEFORE_ALL)), F.lit(0)).alias("scan_ahead"))
    return met.join(handed, [*keys, PART]).select(*spans.columns, (F.col("scan_ahead") + F.col(LOCAL)).alias(name))


def beside(points: DataFrame, marks: DataFrame, days: float = DAYS) -> DataFrame:
    """Each point (psr, mjd) with ``before`` and ``behind``: the marks (psr, mjd, mark) last not after it and first not before it.

    A source has one mark for each time at most; marks are structs.
    """
    line = marks.select("psr", "mjd", "mark", F.lit(False).alias("is_point")).unionByName(points.select("psr", "mjd").withColumn("is_point", F.lit(True)), allowMissingColumns=True)
    own = line.withColumn(PART, of_days(width=days))
    inside = lambda *order: F.last("mark", ignorenulls=True).over(Window.partitionBy("psr", PART).orderBy(*order))
    own = own.withColumn("before", inside("mjd", "is_point")).withColumn("behind", inside(F.desc("mjd"), F.col("is_point"))).filter("is_point")
    is_mark = F.col("mark").isNotNull()
    ends = line.groupBy("psr", of_days(width=days).alias(PART)).agg(F.max_by("mark", F.when(is_mark, F.col("mjd"))).alias("last"), F.min_by("mark", F.when(is_mark, F.col("mjd"))).alias("first"))
    handed = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy("psr").orderBy(order).rowsBetween(*BEFORE_ALL))
    carried = ends.select("psr", PART, handed("last", F.col(PART)).alias("scan_before"), handed("first", F.desc(PART)).alias("scan_behind"))
    return own.join(carried, ["psr", PART]).select("psr", "mjd", F.coalesce("before", "scan_before").alias("before"), F.coalesce("behind", "scan_behind").alias("behind"))


#: Stretches that a range of values is counted in, and values of a stretch that are few enough to be ranked.
STRETCHES, FEW = 1024, 4096


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], stretches: int = STRETCHES, few: int = FEW) -> DataFrame:
    """(keys, n, q): the exact quantiles of each key's values at ``shares``, between two values in proportion.

    No group's values are kept in one place. The range of a key is counted in stretches, which tells the one that holds a
    rank; that one is counted again, until it holds one value or few enough to be ranked. Stretches are equal in size of
    magnitude first and in width then, so a handful of rounds reaches single numbers, however they lie. Nulls and NaN
    don't count; keys without values have no row.
    """
    size = lambda c: F.signum(c) * F.coalesce(F.ln(F.abs(F.col(c))) + F.lit(750.0), F.lit(0.0))  # noqa: E731  from the least positive number on
    by = size
    x = settled(rows.select(*keys, F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)"))
    ends = x.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    place = (F.col("n") - 1) * F.col("share")
    wanted = ends.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).select(*keys, "n", "lo", "hi", "share", place.alias("place"))
    ranks = wanted.select(*keys, "lo", "hi", "n", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    open_, found = settled(ranks.select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))), []
    done = lambda df: df.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("x"))
    while True:
        found.append(done(open_))
        ranked = open_.filter((F.col("lo") < F.col("hi")) & (F.col("inside") <= few))
        left = open_.filter((F.col("lo") < F.col("hi")) & (F.col("inside") > few))
        ranges = left.select(*keys, "lo", "hi").distinct()
        met = x.join(ranked.select(*keys, "lo", "hi").distinct(), keys).filter("lo <= x and x <= hi")
        nth = met.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "lo").orderBy("x")) - 1)
        at = ranked.select(*keys, "lo", "rank", (F.col("rank") - F.col("below")).alias("nth"))
        found.append(nth.join(at, [*keys, "lo", "nth"]).select(*keys, "rank", "x"))
        if left.isEmpty():
            break
        width = by("hi") / F.lit(float(stretches)) - by("lo") / F.lit(float(stretches))
        part = F.least(F.floor((by("x") - by("lo")) / F.nullif(width, F.lit(0.0))), F.lit(stretches - 1)).cast("long")
        by = F.col  # from the second round on
        counts = x.join(ranges, keys).filter("lo <= x and x <= hi").groupBy(*keys, "lo", part.alias("part")).agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count(F.lit(1)).alias("m"))
        ahead = F.coalesce(F.sum("m").over(Window.partitionBy(*keys, "lo").orderBy("part").rowsBetween(*BEFORE_ALL)), F.lit(0))
        narrower = counts.withColumn("ahead", ahead).join(left.select(*keys, "lo", "rank", "below"), [*keys, "lo"]).filter("below + ahead <= rank and rank < below + ahead + m")
        open_ = settled(narrower.select(*keys, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("ahead")).alias("below"), F.col("m").alias("inside")))
    values = found[0]
    for more in found[1:]:
        values = values.union(more)
    of = lambda c, name: values.select(*keys, F.col("rank").alias(c), F.col("x").alias(name))
    both = wanted.withColumns({"below": F.floor("place"), "behind": F.ceil("place")}).join(of("below", "a"), [*keys, "below"]).join(of("behind", "b"), [*keys, "behind"])
    between = F.when(F.col("below") == F.col("behind"), F.col("a")).otherwise((F.col("behind") - F.col("place")) * F.col("a") + (F.col("place") - F.col("below")) * F.col("b"))
    by_share = both.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("share", between.alias("x")))).alias("m"))
    return by_share.select(*keys, "n", F.array(*[F.col("m")[F.lit(float(s))] for s in shares]).alias("q"))
