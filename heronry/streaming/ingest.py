"""Incremental ingest with Structured Streaming: documents to chunks to a point table."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heronry import schemas
from heronry.operators import chunking, store
from heronry.operators.bucketed import BucketTable
from heronry.scratch import hadoop_path
from heronry.sources import multistream, readers


def dump_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Articles of the XML dumps (also .bz2) that appear in a folder."""
    pages = spark.readStream.format("xml").option("rowTag", "page").option("maxFilesPerTrigger", files_per_trigger).schema(schemas.DUMP_PAGE).load(folder)
    return readers.articles(pages)


@contextmanager
def _whole_plans(spark: SparkSession):
    """Within, a plan keeps its observed parts where a join turns out empty; else what they counted is lost."""
    name, rule = "spark.sql.adaptive.optimizer.excludedRules", "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    was = spark.conf.get(name, None)
    spark.conf.set(name, f"{was},{rule}" if was else rule)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def index_batch(table: BucketTable | str, docs: DataFrame, *, embedder: Callable | None = None, size: int = 1200, overlap: int = 200, skip_unchanged: bool = True, key: str = "point_id") -> dict:
    """Chunks documents and puts their points into the table (created at that path if there is none), in one pass.

    Returns documents, changed, skipped, chunks, seconds and chunks_per_s, which are observed in that pass: nothing is
    counted again, neither the batch nor the table.
    """
    start, spark = time.time(), docs.sparkSession
    seen, fresh, made = Observation("seen"), Observation("fresh"), Observation("made")
    batch = docs.observe(seen, F.count("*").alias("n"))
    opened = table if isinstance(table, BucketTable) else BucketTable(spark, table) if BucketTable.exists(spark, table) else None
    if opened is not None and skip_unchanged:
        batch = store.changed_documents(batch, opened.read())
    batch = batch.observe(fresh, F.count("*").alias("n"))
    points = store.build_points(chunking.chunk_sources(batch, size, overlap), embedder)
    if opened is None:
        opened = BucketTable.create(spark, table, points.schema, key=key, vector="vector")
    with _whole_plans(spark):
        opened.upsert(points.observe(made, F.count("*").alias("n")))
    documents, changed, chunks = (x.get["n"] for x in (seen, fresh, made))
    seconds = time.time() - start
    return {"documents": documents, "changed": changed, "skipped": documents - changed, "chunks": chunks, "seconds": seconds, "chunks_per_s": chunks / seconds}


def index_stream(docs: DataFrame, table: str, checkpoint: str, *, embedder: Callable | None = None, size: int = 1200, overlap: int = 200, skip_unchanged: bool = True, on_progress: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Chunks and upserts every micro-batch, then stops when the input is used up.

    Offsets live in the checkpoint, and ids follow from the documents, so a batch that is run again
    writes the same rows: the table holds each point once. on_progress(batch, what `index_batch` observed) is called on
    the driver. A batch writes its own buckets only; the table is not rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        told = index_batch(table, batch, embedder=embedder, size=size, overlap=overlap, skip_unchanged=skip_unchanged)
        if on_progress:
            on_progress(number, told)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_dump(spark: SparkSession, path: str, table: str, checkpoint: str, *, step_bytes: int = 256_000_000, on_progress: Callable[[int, dict], None] | None = None, **how) -> int:
    """Indexes a multistream dump (`multistream`) range by range of its bytes, each in many tasks; returns how many ranges
    were indexed. A range that is done leaves a mark in the checkpoint folder, so a run that was stopped goes on with the
    first range without one; that range's points are put in once, however often it is begun."""
    file, size = multistream.opened(path)
    file.close()
    done = 0
    for start in range(0, size, step_bytes):
        end = min(start + step_bytes, size)
        mark, fs = hadoop_path(spark, f"{checkpoint}/{start:015d}-{end:015d}")
        if fs.exists(mark):
            continue
        told = index_batch(table, readers.articles(multistream.dump_pages(spark, path, start=start, end=end)), **how)
        fs.create(mark, True).close()
        done += 1
        if on_progress:
            on_progress(start, told)
    return done


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events by type in tumbling windows of event time, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
