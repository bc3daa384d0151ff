"""Global and grouped row numbers, against sorting in plain Python."""

import random

from pyspark.sql import functions as F

from heronry import scratch
from heronry.operators.numbering import numbered


def test_numbers_by_order_and_group(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v int").repartition(7)
    got = {r["id"]: r["n"] for r in numbered(df, ["v", "id"], ranges=13).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    by_group = numbered(df, [F.desc("v"), "id"], group=("g",), ranges=13)
    got = {r["id"]: r["n"] for r in by_group.collect()}
    for g in ("hot", "a", "b", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(len(own)))
    paths = by_group._scratch
    scratch.discard(by_group)
    assert len(paths) == 2 and not any(scratch.hadoop_path(spark, p)[1].exists(scratch.hadoop_path(spark, p)[0]) for p in paths)


def test_equal_rows_spread_and_keep_the_input_order(spark):
    df = spark.range(0, 5000, 1, 4).select(F.lit("x").alias("k"), F.col("id").alias("__place"))
    rows = numbered(df, ["k"], ranges=8)
    assert [r["__place"] for r in rows.orderBy("n").collect()] == list(range(5000))
    assert [r["__place"] for r in numbered(df, []).orderBy("n").collect()] == list(range(5000))
    held = spark.read.parquet(rows._scratch[0])
    sizes = [r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2500  # one key, and still no range holds half of it
    assert numbered(df.limit(0), ["k"], group=("k",)).collect() == []
