"""Training order: a keyed Feistel permutation gives every sequence a global slot; ranges of slots become
shards of fixed-stride binary records.

1. Documents become ids plus an end id, cut into sequences of at most `length` ids, written once as a
   table. A sequence's number is the rows of the files before its own plus its row there, so numbers
   0 to n - 1 cost no sort and no shuffle, and a task that is run again finds the same numbers.
2. slot = Feistel(number): four rounds over the least even number of bits that holds n; results of n
   or more are put through again (cycle-walking), so slots are a permutation of 0 to n - 1.
3. Shard s holds slots s * per_shard onwards. One shuffle brings each range of shards to one task,
   ordered by slot; a shard is one row: its first slot, its documents and its bytes. Record i of a
   shard starts at i * stride: doc_id (int64), piece (int32), ids held (int32), then `length` ids of
   two bytes (four for vocabularies above 65,536), zeros behind the last; all little-endian. A reader that
   has consumed m records goes on in shard m // per_shard at byte (m % per_shard) * stride.

Defined results: null and empty texts are one sequence of the end id; a null doc_id is written as
the least int64; repeated rows are sequences of their own; no rows, no shards; other columns are ignored.
"""

from __future__ import annotations

from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidied, written

#: Stands for a null doc_id, the least int64.
NO_ID = -(2**63)
HEADER = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("held", "<i4")])


def feistel(numbers: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A permutation of 0 to n - 1, by cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % 2**64) for r in range(1, rounds + 1)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0xFF51AFD7ED558CCD)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left << np.uint64(half) | right

    out = once(numbers.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def sequences_of(docs: DataFrame, tokenizer: str, *, length: int, end_id: int, blanks: bool = True) -> DataFrame:
    """doc_id, piece, held, ids (bytes)."""

    def cut(batches):
        import pyarrow as pa

        from heronry.llm.tokens import tokenizer as held

        encode = held(tokenizer, blanks)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, flat, counts in encode(batch.column(1)):
                rows, end = [], 0
                for doc, n in zip(docs[first : first + len(counts)], counts.tolist(), strict=True):
                    ids = np.append(flat[end : end + n], np.array([end_id], flat.dtype))
                    end += n
                    for k, start in enumerate(range(0, len(ids), length)):
                        own = ids[start : start + length]
                        rows.append((NO_ID if doc is None else doc, k, len(own), own.tobytes()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "held", "ids"])

    return docs.mapInArrow(tidied(cut), "doc_id long, piece int, held int, ids binary")


def training_shards(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 1,
    key: int = 20240613, per_shard: int = 1024, id_bytes: int = 2, blanks: bool = True,
) -> DataFrame:
    """One row per shard: shard, first_slot, n_sequences, stride, doc_ids (by slot), crc32, data."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(sequences_of(docs, tokenizer, length=length, end_id=end_id, blanks=blanks), "sequences")
    rows = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = sorted((r["file"], r["n"]) for r in rows.groupBy("file").agg(F.count("*").alias("n")).collect())
    before, n = {}, 0
    for file, held in sizes:
        before[file] = n
        n += held
    stride = HEADER.itemsize + id_bytes * length

    @F.pandas_udf("long")
    def slot(file: pd.Series, row: pd.Series) -> pd.Series:  # the ids themselves stay in the JVM here
        return pd.Series(feistel(file.map(before).to_numpy(np.int64) + row.to_numpy(np.int64), n, key))

    def bound(shard, first, docs, data):
        import zlib

        import pyarrow as pa

        raw = b"".join(data)
        row = (shard, first, len(docs), stride, docs, zlib.crc32(raw), raw)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
        names = ["shard", "first_slot", "n_sequences", "stride", "doc_ids", "crc32", "data"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    def bind(batches):
        shard, first, docs, data = None, 0, [], []
        for part in (batch.slice(at, 1024) for batch in batches for at in range(0, batch.num_rows, 1024)):
            for slot, doc, piece, held, ids in zip(*(part.column(c).to_pylist() for c in ("slot", "doc_id", "piece", "held", "ids")), strict=True):
                if slot // per_shard != shard:
                    if docs:
                        yield bound(shard, first, docs, data)
                    shard, first, docs, data = slot // per_shard, slot, [], []
                docs.append(doc)
                data.append((pack("<qii", doc, piece, held) + ids).ljust(stride, b"\0"))
        if docs:
            yield bound(shard, first, docs, data)

    shards = max(1, -(-n // per_shard))
    parts = min(shards, max(8, -(-shards // 32)))
    slotted = rows.select(slot("file", "row").alias("slot"), "doc_id", "piece", "held", "ids")
    ranges = slotted.repartitionById(parts, F.expr(f"CAST(slot DIV {per_shard} * {parts} DIV {shards} AS INT)")).sortWithinPartitions("slot")
    return ranges.mapInArrow(tidied(bind), "shard long, first_slot long, n_sequences long, stride long, doc_ids array<long>, crc32 long, data binary")


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each row's bytes as `<folder>/shard-<number>.bin` (a folder that all executors share) and
    returns shard, path, bytes. Files appear whole, by renaming, so a task that runs twice does no harm."""

    def write(batches):
        import os
        import uuid

        import pyarrow as pa

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{folder}/shard-{shard:09d}.bin"
                with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                os.replace(part, path)
                out.append((shard, path, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["shard", "path", "bytes"])

    return shards.select("shard", "data").mapInArrow(write, "shard long, path string, bytes long")


def read_records(data: bytes, stride: int, start: int = 0, id_bytes: int = 2):
    """(doc_id, piece, ids) of the records of a shard from number `start` on."""
    for at in range(start * stride, len(data), stride):
        head = np.frombuffer(data, HEADER, 1, at)[0]
        yield int(head["doc_id"]), int(head["piece"]), np.frombuffer(data, f"<u{id_bytes}", int(head["held"]), at + HEADER.itemsize)


def op4_training_order(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return training_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
