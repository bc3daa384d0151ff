"""Row numbers over a whole table, or over each of its groups, without a task that holds the table or a group.

The rows are dealt out by ranges of (group, order) and sorted inside each range; a row's place in its range comes from
the same stage. What is missing is how many rows of its group stand in earlier ranges: one count a range and group, of
which there are at most ranges + groups, summed up by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronry import scratch

_ROW_BITS = 33  # monotonically_increasing_id: the partition's number above, the row's place in it below


def numbered(df: DataFrame, order: list[Column | str], *, group: tuple[str, ...] = (), name: str = "n", ranges: int | None = None) -> DataFrame:
    """df with the column `name`: from 0 on, by `order`, inside each value of the columns `group` (null is a value).

    Rows that are equal in order keep the input's order (so `order=[]` numbers rows as they are read), and however many
    they are, they spread over ranges. An empty table stays empty. The result reads scratch tables: `scratch.discard` it
    when it has been used.
    """
    taken = {c.lower() for c in df.columns}
    fresh = lambda c: c if c not in taken else fresh(c + "_")
    tie, place, part, row, ahead, first = map(fresh, ("__tie", "__place", "__part", "__row", "__ahead", "__first"))
    keys = [*map(F.col, group), *(F.col(o) if isinstance(o, str) else o for o in order), F.col(tie)]
    dealt = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(ranges, *keys) if ranges else dealt.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys).drop(tie).withColumn(place, F.monotonically_increasing_id())
    held = scratch.written(dealt, "ranges")
    spots = held.withColumn(part, F.shiftright(place, _ROW_BITS)).withColumn(row, F.col(place).bitwiseAND((1 << _ROW_BITS) - 1)).drop(place)
    counts = spots.groupBy(*group, part).agg(F.count("*").alias(ahead), F.min(row).alias(first))
    earlier = W.partitionBy(*(group or [F.lit(0)])).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn(ahead, F.coalesce(F.sum(ahead).over(earlier), F.lit(0)))
    # A written table has a known size, by which Spark chooses to broadcast it or not.
    before = scratch.written(before.select(*(F.col(g).alias(f"{g}__g") for g in group), F.col(part).alias(f"{part}__g"), ahead, first), "counts")
    same = F.col(part) == F.col(f"{part}__g")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__g"))
    out = spots.join(before, same).withColumn(name, F.col(ahead) + F.col(row) - F.col(first))
    return scratch.carrying(out.select(*df.columns, name), held, before)
