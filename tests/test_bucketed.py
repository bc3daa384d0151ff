"""The bucketed table: upserts that write their own buckets, versions, compaction, concurrent writers."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from heronry.operators.bucketed import MOST_COMMITS, BucketTable

SCHEMA = StructType().add("point_id", "string").add("n", "long")


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def held(df):
    return {r["point_id"]: r["n"] for r in df.collect()}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = BucketTable.create(spark, path, SCHEMA, buckets=32)
    assert held(table.read()) == {}
    want = {f"k{i}": i for i in range(1000)}
    table.upsert(rows(spark, list(want.items())))
    before, first = files(path), table.read()
    some = {f"k{i}": -i for i in range(0, 1000, 100)} | {"new": 7}  # 1 %
    version = table.upsert(rows(spark, list(some.items())))
    after = files(path)
    assert all(after[f] == t for f, t in before.items())
    fresh = {f.rsplit("/", 2)[1] for f in after if f not in before}
    own = {f"bucket={r['b']}" for r in rows(spark, list(some.items())).select(table._bucket(F.col("point_id"), 32).alias("b")).collect()}
    assert fresh == own and len(own) <= 11
    assert held(table.read()) == want | some and held(first) == want  # the first reader's version stands
    assert held(table.read(version.number - 1)) == want
    table.upsert(rows(spark, list(some.items())))
    assert held(table.read()) == want | some
    asked = table.lookup(rows(spark, [("k100", 0), ("none", 0)]))
    assert held(asked) == {"k100": -100}
    scanned = {f.split("bucket=")[1].split("/")[0] for f in asked.inputFiles()}
    assert len(scanned) <= 2


def test_compaction_and_vacuum(spark, tmp_path):
    path, want, rng = f"{tmp_path}/t", {}, random.Random(2)
    table = BucketTable.create(spark, path, SCHEMA, buckets=2)
    for turn in range(MOST_COMMITS + 3):
        batch = {f"k{rng.randrange(30)}": turn * 100 + i for i in range(12)}
        want |= batch
        version = table.upsert(rows(spark, list(batch.items())))
        assert max(map(len, version.files.values())) <= MOST_COMMITS
    assert held(table.read()) == want
    version = table.compact()
    assert all(len(c) == 1 for c in version.files.values()) and held(table.read()) == want
    old = table.read(version.number - 1)
    assert table.vacuum(keep=2) == 0  # too young to be deleted
    assert table.vacuum(keep=2, older_than=-60) > 0 and held(old) == want == held(table.read())
    table.vacuum(keep=1, older_than=-60)
    assert len(files(path)) == len(version.files) and held(table.read()) == want


def test_writers_at_one_time_both_count(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = BucketTable.create(spark, path, SCHEMA, buckets=4)
    batches = [{f"w{w}-{i}": w for i in range(50)} | {"shared": w} for w in range(4)]
    threads = [threading.Thread(target=lambda b=b: BucketTable(spark, path).upsert(rows(spark, list(b.items())))) for b in batches]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = held(table.read())
    assert len(got) == 201 and got["shared"] in range(4) and table.version().number == 4


def test_a_compaction_keeps_what_is_written_meanwhile(spark, tmp_path, monkeypatch):
    table = BucketTable.create(spark, f"{tmp_path}/t", SCHEMA, buckets=1)
    table.upsert(rows(spark, [("a", 1), ("b", 1)]))
    table.upsert(rows(spark, [("a", 2)]))
    plain = table._write

    def slow(*args):
        out = plain(*args)
        monkeypatch.setattr(table, "_write", plain)
        table.upsert(rows(spark, [("b", 3)]))
        return out

    monkeypatch.setattr(table, "_write", slow)
    version = table.compact()
    assert len(version.files[0]) == 2 and held(table.read()) == {"a": 2, "b": 3}


def test_refusals(spark, tmp_path):
    schema = StructType().add("point_id", "string").add("vector", ArrayType(FloatType()))
    table = BucketTable.create(spark, f"{tmp_path}/v", schema, vector="vector")
    make = lambda data: spark.createDataFrame(data, schema)
    table.upsert(make([("a", [1.0, 2.0]), ("n", None)]))
    for wrong in ([("b", [1.0])], [("b", [1.0, 2.0]), ("c", [1.0, 2.0, 3.0])]):
        with pytest.raises(ValueError, match="components"):
            table.upsert(make(wrong))
    assert {r["point_id"] for r in table.read().collect()} == {"a", "n"} and table.version().size == 2
    with pytest.raises(ValueError, match="columns"):
        table.upsert(make([("a", None)]).withColumn("x", F.lit(1)))
    with pytest.raises(ValueError, match="another table"):
        BucketTable.create(spark, f"{tmp_path}/v", SCHEMA)
    table.upsert(make([]))
    assert table.read().count() == 2 and BucketTable.exists(spark, f"{tmp_path}/v") and not BucketTable.exists(spark, f"{tmp_path}/w")
