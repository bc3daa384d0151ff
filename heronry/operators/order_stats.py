"""Exact order statistics of groups of any size, by refining histograms.

A round counts the rows between a target's bounds by BINS bins of equal width (partial counts before the shuffle), finds
the bin that holds the target's rank, and takes that bin's own least and largest value as the next bounds. Bins follow
values monotonically whatever rounding does, so no row is misplaced; a target is done when its bounds are one value. What
meets in one task is the counts of one target, BINS rows, never a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronry import scratch

BINS = 1024


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """A bin from -1 on that does not fall as v rises; infinities and NaN, the largest of all, have bins of their own."""
    inf = float("inf")
    # Halves first: the width of a range of doubles may exceed a double.
    place = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS)
    inner = F.when(hi > lo, F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1))).otherwise(F.lit(0))
    return F.when(F.isnan(v), F.lit(BINS + 1)).when(v == inf, F.lit(BINS)).when(v == -inf, F.lit(-1)).otherwise(inner).cast("int")


def at_ranks(values: DataFrame, group: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """group, n (values that are not null), and for each name the value at place ranks[name](n) of the sorted group, from 0
    on; null where there is no such place. Groups without values have no row; null is a group."""
    rows = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    sound = ~F.isnan("v") & (F.abs("v") != float("inf"))
    sizes = scratch.written(rows.groupBy("g").agg(F.count("*").alias("n"), F.min(F.when(sound, F.col("v"))).alias("lo"), F.max(F.when(sound, F.col("v"))).alias("hi")), "sizes")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("rank")) for name, rank in ranks.items())))
    some = F.lit(0.0)
    targets = sizes.select("g", F.coalesce("lo", some).alias("lo"), F.coalesce("hi", some).alias("hi"), each.alias("t"))
    targets = targets.select("g", "lo", "hi", "t.name", "t.rank", F.lit(True).alias("whole")).filter("rank >= 0")
    done, used = None, [sizes]
    while True:
        # A written table has a known size, by which Spark chooses to broadcast the targets or not.
        now = scratch.written(targets, "targets")
        used.append(now)
        both = rows.join(now.withColumnRenamed("g", "tg"), F.col("g").eqNullSafe(F.col("tg")))
        both = both.filter("whole OR (v >= lo AND v <= hi)").select("g", "name", "rank", "v", _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"))
        counts = both.groupBy("g", "name", "rank", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(W.partitionBy("g", "name").orderBy("bin"))
        held = counts.withColumn("upto", upto).filter("upto > rank AND upto - c <= rank")
        found = scratch.written(held.select("g", "lo", "hi", "name", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.lit(False).alias("whole")), "found")
        used.append(found)
        ready = found.filter("lo <=> hi").select("g", "name", F.col("lo").alias("v"))
        done = ready if done is None else done.union(ready)
        targets = found.filter("NOT lo <=> hi")
        if targets.isEmpty():
            break
    picked = done.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks))
    out = sizes.select("g", "n").join(picked.withColumnRenamed("g", "pg"), F.col("g").eqNullSafe(F.col("pg")), "left")
    return scratch.carrying(out.select(F.col("g").alias(group), "n", *ranks), *used)


def index_quantile(q: float) -> Callable[[Column], Column]:
    """The place min(floor(n * q), n - 1)."""
    return lambda n: F.least(F.floor(n * F.lit(q)), n - 1)


def continuous_quantile(values: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """group, n, value: the quantile between the two values around place (n - 1) * q, by their distance from it."""
    place = lambda n: (n - 1) * F.lit(q)
    found = at_ranks(values, group, value, {"low": lambda n: F.floor(place(n)), "high": lambda n: F.ceil(place(n))})
    part = place(F.col("n")) - F.floor(place(F.col("n")))
    between = F.col("low") + (F.col("high") - F.col("low")) * part
    out = found.select(group, "n", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("value"))
    return scratch.carrying(out, found)
