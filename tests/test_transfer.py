"""Copies that are stopped, damaged and finished."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from heronry.operators.transfer import Transfer


def test_a_copy_goes_on_and_damage_is_found(spark, tmp_path):
    source = spark.range(500).select(F.col("id").cast("string").alias("point_id"), (F.col("id") * 3).alias("n"), F.when(F.col("id") % 7 > 0, F.lit("x")).alias("t"))
    move = Transfer(source, f"{tmp_path}/c", parts=12, at_once=4)
    seen = []

    def stop(done, parts):
        seen.append(done)
        if len(seen) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        move.copy(stop)
    assert len(move.unfinished()) == 4
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/c/data/part=*/*.parquet")}
    # A part that was half written, without a mark, is replaced.
    late = move.unfinished()[0]
    os.makedirs(f"{tmp_path}/c/data/part={late}", exist_ok=True)
    source.limit(3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/c/data/part={late}")
    move = Transfer(source, f"{tmp_path}/c", parts=12, at_once=4)
    freed = []
    assert move.finish() == {"parts": 12, "differing": [], "complete": True, "deleted": False}
    assert all(os.stat(f).st_mtime_ns == t for f, t in before.items())
    key = lambda r: r[0]
    assert sorted(map(tuple, move.copied().drop("part").collect()), key=key) == sorted(map(tuple, source.collect()), key=key)
    for lost in (glob.glob(f"{tmp_path}/c/data/part=3/*.parquet")[0], glob.glob(f"{tmp_path}/c/data/part=5/*.parquet")[0]):
        os.remove(lost)
    told = move.finish(lambda: freed.append(1))
    assert told["differing"] == [3, 5] and not told["deleted"] and not freed
    assert move.repair() == [3, 5] and move.finish(lambda: freed.append(1))["deleted"] and freed == [1]
    changed = source.withColumn("n", F.when(F.col("point_id") == "77", -1).otherwise(F.col("n")).cast("long"))
    assert len(Transfer(changed, f"{tmp_path}/c", parts=12).differing()) == 1


def test_nothing_and_a_clashing_name(spark, tmp_path):
    none = spark.range(0).select(F.col("id").cast("string").alias("point_id"))
    assert Transfer(none, f"{tmp_path}/n", parts=3).finish()["complete"]
    with pytest.raises(ValueError):
        Transfer(none.withColumn("Part", F.lit(1)), f"{tmp_path}/n")
