"""Copies of tables that go on after a stop, are checked part by part, and free their source only when all parts agree.

The rows are dealt to parts by a hash of their key. A part is copied whole and then leaves a mark, so a copy that was
stopped begins again with the parts that have none, and a part that was half written is replaced. Counts and sums of row
hashes of each part, one row a part, say which parts differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators import store
from heronry.scratch import hadoop_path


class Transfer:
    """A copy of source, a table whose rows do not change meanwhile, to the folder path.

    parts: how finely a stopped copy goes on and damage is found; at_once: parts of one pass over the source.
    """

    def __init__(self, source: DataFrame, path: str, *, key: str = "point_id", parts: int = 32, at_once: int = 8):
        if "part" in (c.lower() for c in source.columns):
            raise ValueError("a column named part is needed for the copy's folders")
        self.source, self.path, self.parts, self.at_once = source, path.rstrip("/"), parts, at_once
        self.spark, self.number = source.sparkSession, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def _mark(self, part: int):
        return hadoop_path(self.spark, f"{self.path}/done/{part:06d}")

    def unfinished(self) -> list[int]:
        at, fs = hadoop_path(self.spark, f"{self.path}/done")
        done = {int(e.getPath().getName()) for e in fs.listStatus(at)} if fs.exists(at) else set()
        return [p for p in range(self.parts) if p not in done]

    def copy(self, on_progress: Callable[[int, int], None] | None = None) -> None:
        """Copies the parts that are not marked; on_progress(parts done, parts)."""
        left = self.unfinished()
        while left:
            now, left = left[: self.at_once], left[self.at_once :]
            rows = self.source.withColumn("part", self.number).filter(F.col("part").isin(now))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/data")
            for part in now:
                at, fs = self._mark(part)
                fs.create(at, True).close()
            if on_progress:
                on_progress(self.parts - len(left), self.parts)

    def copied(self) -> DataFrame:
        """The rows of the copy."""
        at, fs = hadoop_path(self.spark, f"{self.path}/data")
        if not fs.exists(at):
            return self.source.limit(0)
        held = self.source.limit(0).withColumn("part", F.lit(0)).schema
        return self.spark.read.schema(held).parquet(f"{self.path}/data")

    def _sums(self, df: DataFrame) -> dict[int, tuple]:
        whole = F.xxhash64(*self.source.columns).cast("decimal(20,0)")
        return {r["part"]: (r["n"], r["h"]) for r in df.groupBy("part").agg(F.count("*").alias("n"), F.sum(whole).alias("h")).collect()}  # parts at most

    def differing(self) -> list[int]:
        """The parts whose rows are not the source's."""
        try:
            there = self._sums(self.copied())
        except Exception:  # noqa: BLE001 - a file that cannot be read: find its part by reading each alone
            there = {}
            for part in range(self.parts):
                try:
                    there |= self._sums(self.copied().filter(F.col("part") == part))
                except Exception:  # noqa: BLE001
                    there[part] = None
        here = self._sums(self.source.withColumn("part", self.number))
        return sorted(p for p in here.keys() | there.keys() if here.get(p) != there.get(p))

    def repair(self) -> list[int]:
        """Copies the parts again that differ; returns which."""
        wrong = self.differing()
        for part in wrong:
            at, fs = self._mark(part)
            fs.delete(at, False)
            store.remove(self.spark, f"{self.path}/data/part={part}")
        self.copy()
        return wrong

    def finish(self, delete: Callable[[], None] | None = None) -> dict:
        """Copies what is left and compares; calls delete, which frees the source, only if every part agrees."""
        self.copy()
        wrong = self.differing()
        if not wrong and delete:
            delete()
        return {"parts": self.parts, "differing": wrong, "complete": not wrong, "deleted": bool(delete) and not wrong}
