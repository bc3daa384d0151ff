"""A keyed table that an upsert does not rewrite: hash buckets, delta files, a manifest for each version.

Layout, below one folder:

- `data/commit=<id>/bucket=<b>`: the rows of one write, never changed afterwards. A key's bucket is a hash of it.
- `versions/<number>.json`: a version: for each bucket the commits that make it up, oldest first, and each commit's rank. It
  is written once, by a create that fails where the number exists, so of two writers one goes on after the other.

An upsert writes its own rows, in their buckets, and a manifest that names them behind what was there: its cost follows the
batch, and nothing stored is read. A reader holds one manifest's files for as long as it likes; of rows with one key the
commit of the highest rank counts. Buckets of one commit are read as they are, the others merged within themselves.
Compaction rewrites buckets of many commits; `vacuum` deletes what no kept version names.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronry.operators import store
from heronry.scratch import hadoop_path

#: Commits of a bucket beyond which an upsert compacts it.
MOST_COMMITS = 8
_ATTEMPTS = 20


@dataclass
class Version:
    number: int
    key: str
    buckets: int
    schema: str
    vector: str | None
    size: int | None  # components of every vector
    files: dict[int, list[str]] = field(default_factory=dict)  # bucket: commits, oldest first
    ranks: dict[str, int] = field(default_factory=dict)  # of commits

    def text(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def of(text: str) -> Version:
        told = json.loads(text)
        return Version(**{**told, "files": {int(b): c for b, c in told["files"].items()}})


class BucketTable:
    """The table at path, which `create` made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def create(spark: SparkSession, path: str, schema: StructType, *, key: str = "point_id", buckets: int = 64, vector: str | None = None, size: int | None = None) -> BucketTable:
        """An empty table; with `vector`, every value of that column has `size` components (those of the first rows, if not
        given). An existing table is opened, if its columns are these."""
        table = BucketTable(spark, path)
        held = table.version()
        if held is None:
            table._commit(Version(0, key, buckets, schema.json(), vector, size))
            held = table.version()
        if held.key != key or table.schema(held).simpleString() != schema.simpleString():
            raise ValueError(f"{path} holds another table: {table.schema(held).simpleString()}")
        return table

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return BucketTable(spark, path).version() is not None

    # ---- versions ---------------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        at, fs = hadoop_path(self.spark, f"{self.path}/versions")
        names = [e.getPath().getName() for e in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _told(self, number: int) -> Version | None:
        at, fs = hadoop_path(self.spark, f"{self.path}/versions/{number:09d}.json")
        try:
            stream = fs.open(at)
        except Exception:  # noqa: BLE001 - deleted meanwhile
            return None
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Version.of(text) if text.endswith("\n") else None  # else it is being written

    def version(self, number: int | None = None) -> Version | None:
        """The newest version, or that of a number; None where there is none."""
        if number is not None:
            return self._told(number)
        return next((v for n in reversed(self._numbers()) if (v := self._told(n)) is not None), None)

    def _commit(self, version: Version) -> bool:
        at, fs = hadoop_path(self.spark, f"{self.path}/versions/{version.number:09d}.json")
        try:
            stream = fs.create(at, False)
        except Exception:  # noqa: BLE001 - another writer has this number, or the folder cannot be written
            if not fs.exists(at):
                raise
            return False
        stream.write((version.text() + "\n").encode())
        stream.close()
        return True

    def _committed(self, change) -> Version:
        """change(version) applied to the newest version; again to a newer one, if another writer was first."""
        for attempt in range(_ATTEMPTS):
            version = self.version()
            version.number += 1
            change(version)
            if self._commit(version):
                return version
            time.sleep(0.05 * (attempt + 1))
        raise RuntimeError(f"{self.path}: no version could be written in {_ATTEMPTS} attempts")

    # ---- reading ----------------------------------------------------------------------------------

    @staticmethod
    def schema(version: Version) -> StructType:
        return StructType.fromJson(json.loads(version.schema))

    def _bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _files(self, version: Version, files: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.path}/data/commit={c}/bucket={b}" for b, commits in sorted(files.items()) for c in commits]
        names = self.schema(version).fieldNames()
        if not paths:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(version.schema))).withColumns({"commit": F.lit(""), "bucket": F.lit(0)})
        held = StructType.fromJson(json.loads(version.schema)).add("commit", "string").add("bucket", "integer")
        return self.spark.read.schema(held).option("basePath", f"{self.path}/data").parquet(*paths).select(*names, "commit", "bucket")

    def _merged(self, version: Version, files: dict[int, list[str]]) -> DataFrame:
        """The rows of these buckets: of each key that of its latest commit."""
        names = self.schema(version).fieldNames()
        alone = {b: c for b, c in files.items() if len(c) == 1}
        several = {b: c for b, c in files.items() if len(c) > 1}
        out = self._files(version, alone).select(*names)
        if several:
            rank = F.create_map(*(F.lit(x) for c in sorted({c for own in several.values() for c in own}) for x in (c, version.ranks[c])))
            last = W.partitionBy(version.key).orderBy(F.desc("__rank"))
            rows = self._files(version, several).withColumn("__rank", rank[F.col("commit")])
            rows = rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").select(*names)
            out = rows if not alone else out.unionByName(rows)
        return out

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version; what is written later does not change them."""
        version = self.version(number)
        return self._merged(version, version.files)

    def lookup(self, ids: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
        """The rows of these keys (a column named as the table's key); only their buckets are read."""
        version = self.version()
        ids = ids.select(version.key).distinct()
        asked = {r["b"] for r in ids.select(self._bucket(F.col(version.key), version.buckets).alias("b")).distinct().collect()}  # buckets at most
        rows = self._merged(version, {b: c for b, c in version.files.items() if b in asked})
        rows = rows.select(version.key, *columns) if columns else rows
        return rows.join(ids, version.key, "left_semi")

    # ---- writing ----------------------------------------------------------------------------------

    def upsert(self, rows: DataFrame, *, compact: bool = True) -> Version:
        """Puts rows in, or over those of the same key; of repeated keys one row, the same each time, stays."""
        version = self.version()
        schema = self.schema(version)
        if dict(rows.dtypes) != {f.name: f.dataType.simpleString() for f in schema}:
            raise ValueError(f"columns differ from the table's: {sorted(set(rows.dtypes) ^ {(f.name, f.dataType.simpleString()) for f in schema})}")
        one = store.latest(rows.withColumn("__batch", F.lit(0)), version.key, "__batch").drop("__batch").select(*schema.fieldNames())
        commit, touched = self._write(one, version)
        size = self._checked(version, commit, touched)

        def change(v: Version) -> None:
            v.size = v.size or size
            v.ranks[commit] = max(v.ranks.values(), default=0) + 1
            for b in touched:
                v.files.setdefault(b, []).append(commit)

        version = self._committed(change)
        crowded = [b for b in touched if len(version.files[b]) > MOST_COMMITS]
        return self.compact(crowded) if compact and crowded else version

    def _write(self, rows: DataFrame, version: Version) -> tuple[str, list[int]]:
        commit = uuid.uuid4().hex
        folder = f"{self.path}/data/commit={commit}"
        dealt = rows.withColumn("bucket", self._bucket(F.col(version.key), version.buckets)).repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(folder)
        at, fs = hadoop_path(self.spark, folder)
        return commit, sorted(int(n[7:]) for e in fs.listStatus(at) if (n := e.getPath().getName()).startswith("bucket="))

    def _checked(self, version: Version, commit: str, touched: list[int]) -> int | None:
        """The size of the vectors that were written; an error where it is not one, or not the table's."""
        if version.vector is None or not touched:
            return None
        n = F.size(version.vector)
        told = self._files(version, {b: [commit] for b in touched}).filter(F.col(version.vector).isNotNull()).agg(F.min(n).alias("lo"), F.max(n).alias("hi")).first()
        if told["lo"] is not None and (told["lo"] != told["hi"] or version.size not in (None, told["lo"])):
            store.remove(self.spark, f"{self.path}/data/commit={commit}")
            raise ValueError(f"vectors of {told['lo']} to {told['hi']} components; the table's have {version.size or 'one size'}")
        return told["lo"]

    def compact(self, buckets: list[int] | None = None) -> Version:
        """Rewrites buckets of several commits as one; commits that others add meanwhile stay behind it."""
        version = self.version()
        files = {b: list(c) for b, c in version.files.items() if len(c) > 1 and (buckets is None or b in buckets)}
        if not files:
            return version
        commit, touched = self._write(self._merged(version, files), version)

        def change(v: Version) -> None:
            for b, commits in files.items():
                if v.files.get(b, [])[: len(commits)] != commits:
                    raise RuntimeError(f"bucket {b} was compacted by another writer")
                v.files[b] = ([commit] if b in touched else []) + v.files[b][len(commits) :]
            # No later than the latest of what it replaces, so commits behind it still count.
            v.ranks[commit] = max(version.ranks[c] for own in files.values() for c in own)
            named = {c for own in v.files.values() for c in own}
            v.ranks = {c: r for c, r in v.ranks.items() if c in named}

        return self._committed(change)

    def vacuum(self, keep: int = 2, older_than: float = 3600.0) -> int:
        """Deletes all but the last `keep` versions, and folders of data that none of these names and that are older than
        so many seconds (a writer may not have named its own yet). Returns how many folders went."""
        numbers = self._numbers()
        for n in numbers[:-keep]:
            store.remove(self.spark, f"{self.path}/versions/{n:09d}.json")
        named = {(c, b) for n in numbers[-keep:] if (v := self.version(n)) for b, own in v.files.items() for c in own}
        at, fs = hadoop_path(self.spark, f"{self.path}/data")
        gone, least = 0, (time.time() - older_than) * 1000
        for entry in fs.listStatus(at) if fs.exists(at) else []:
            commit = entry.getPath().getName().removeprefix("commit=")
            if entry.getModificationTime() > least:
                continue
            for part in fs.listStatus(entry.getPath()):
                name = part.getPath().getName()
                if name.startswith("bucket=") and (commit, int(name[7:])) not in named:
                    fs.delete(part.getPath(), True)
                    gone += 1
            if commit not in {c for c, _ in named}:
                fs.delete(entry.getPath(), True)
        return gone
