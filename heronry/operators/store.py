"""Point tables: upsert, skipping unchanged documents, lookup, copy with verification, statistics."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from heronry.functions import text as T

BYTES_PER_POINT = 6000
FREE_POINTS = 1_000_000


def build_points(chunks: DataFrame, embedder=None) -> DataFrame:
    """chunks with point_id and, with an embedder (a function of a text column to a vector column), vector."""
    text = T.embed_text("breadcrumb", "title", "text")
    vector = F.lit(None).cast("array<float>") if embedder is None else embedder(text)
    return chunks.withColumn("point_id", T.uuid5("chunk_id")).withColumn("vector", vector)


def hashing_embedder(size: int = 64):
    """A deterministic stand-in for a model: signed token hashes summed into `size` components (native)."""

    def embed(text):
        h = F.transform(T.tokens(text), lambda t: F.xxhash64(t))
        at = F.sequence(F.lit(0), F.lit(size - 1))
        total = lambda j: F.aggregate(F.filter(h, lambda x: F.pmod(x, F.lit(size)) == j), F.lit(0.0), lambda s, x: s + F.when(x > 0, 1.0).otherwise(-1.0))
        return F.transform(at, lambda j: total(j).cast("float"))

    return embed


def model_embedder(make: Callable[[], Callable], batch_size: int = 64):
    """An embedder from a model: make() runs once in a worker and gives a function from an array of texts to a matrix."""
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size)


def latest(points: DataFrame, key: str = "point_id", order: str = "batch") -> DataFrame:
    """The last row of each key; equal batches by the whole row's hash."""
    rest = [c for c in points.columns if c not in (key, order)]
    w = W.partitionBy(key).orderBy(F.desc(order), F.xxhash64(*rest) if rest else F.lit(0))
    return points.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(stored: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """stored with the rows of new put in or over it by key; the same batch twice changes nothing."""
    both = stored.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    return latest(both, key, "__batch").drop("__batch")


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str = "point_id", keep: int = 2) -> None:
    """Writes the next version of the table at path and moves the pointer last, so readers never see half a table.

    New rows must have the table's columns and types. Of older versions the last `keep` - 1 stay, for readers that
    still hold them; the others are deleted.
    """
    current = current_version(spark, path)
    if current:
        stored = spark.read.parquet(current)
        if dict(stored.dtypes) != dict(new.dtypes):
            raise ValueError(f"columns differ from the table's: {sorted(set(stored.dtypes) ^ set(new.dtypes))}")
        data = upsert(stored, new, key)
    else:
        data = latest(new.withColumn("__batch", F.lit(0)), key, "__batch").drop("__batch")
    number = int(current.rsplit("/v-", 1)[1].split("-")[0]) + 1 if current else 0
    target = f"{path}/v-{number:09d}-{uuid.uuid4().hex}"
    data.write.parquet(target)
    spark.range(1).select(F.lit(target).alias("target")).coalesce(1).write.mode("overwrite").json(f"{path}/_current")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("v-") and int(name.split("-")[1]) <= number - keep:
            fs.delete(entry.getPath(), True)


def current_version(spark: SparkSession, path: str) -> str | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.json(f"{path}/_current").first()["target"]


def changed_documents(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """docs but those whose chunk 0 is stored with the same non-empty content hash. stored: point_id, content_hash."""
    docs = docs.withColumn("__point", T.uuid5(F.concat("page_id", F.lit("-0"))))
    seen = stored.select(F.col("point_id").alias("__seen"), F.col("content_hash").alias("__hash"))
    same = (F.col("__point") == F.col("__seen")) & (F.col("content_hash") == F.col("__hash")) & (F.col("content_hash") != "")
    return docs.join(seen, same, "left_anti").drop("__point")


def orphan_points(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored points of the documents in chunks that the documents no longer have."""
    docs = chunks.select("doc_id").distinct()
    return stored.join(docs, "doc_id", "left_semi").join(chunks.select(T.uuid5("chunk_id").alias("point_id")), "point_id", "left_anti")


def lookup(points: DataFrame, ids: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return points.select("point_id", *columns).join(ids.select("point_id").distinct(), "point_id", "left_semi")


def transfer(source: DataFrame, path: str) -> dict:
    """Copies a table and compares counts and sums of row hashes; never deletes the source."""
    source.write.mode("errorifexists").parquet(path)
    return verify(source, source.sparkSession.read.parquet(path))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def verify(source: DataFrame, target: DataFrame) -> dict:
    both = [d.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*source.columns).cast("decimal(20,0)")).alias("h")).first() for d in (source, target)]
    return {"source": both[0]["n"], "target": both[1]["n"], "complete": both[1]["n"] >= both[0]["n"], "same": both[0] == both[1]}


def capacity(points: int, free_bytes: int, cloud: bool = False, buffer: int = 1 << 30) -> dict:
    need = points * BYTES_PER_POINT
    return {"bytes": need, "fits": need + buffer <= free_bytes, "warning": cloud and points > FREE_POINTS}


def direction(said: str | None, storage: str = "local") -> tuple[str, str]:
    """(source, target) of a transfer; without a word, away from the present storage."""
    # Ways to name a direction.
    names = {
        ("cloud", "local"): ("cloud-to-local", "c2l", "cloud2local", "to-local", "local"),
        ("local", "cloud"): ("local-to-cloud", "l2c", "local2cloud", "to-cloud", "cloud"),
    }
    if not said:
        return (storage, "local" if storage == "cloud" else "cloud")
    for pair, words in names.items():
        if said.strip().lower().replace("_", "-") in words:
            return pair
    raise ValueError(f"unknown direction {said!r}")


def stats(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("points_count"), F.max(F.size("vector")).alias("dimensions"), F.countDistinct("doc_id").alias("documents"))
