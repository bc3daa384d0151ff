"""Best-fit packing by large-item matching.

1. Documents become ids, end with one end id, and are cut at the capacity: one row a piece.
2. Lengths are at most the capacity, so the counts by length are at most `capacity` rows. The plan
   is made from these counts alone: pieces above a third of the capacity, of which no sequence holds
   more than two, are paired greedily, longest first, each with the longest partner that fits;
   smaller ones, longest first, go to the smallest gap that holds them, or open a new sequence. Equal
   sequences are one entry of the plan with a count, so its size follows the capacity, not the corpus.
3. Pieces of a length are numbered and look their number up in the plan: a task counts the pieces of each length as it
   cuts them, so only the counts by task and length are added up. Pieces are written in buckets by task and never
   shuffled.

Defined results: null and empty texts are one piece of the end id; repeated rows are packed each;
no document, no row; other columns are ignored, so their names cannot clash. Nothing is dropped or
truncated.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucketed, table, tidied


def pieces_of(docs: DataFrame, tokenizer: str, *, capacity: int, end_id: int, keep_ids: bool, blanks: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, place (from 0, among the task's pieces of that length) and, on
    request, ids. Place follows the order of rows, so the pieces must be written before they are used twice."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids array<int>" * keep_ids

    def cut(batches):
        import pyarrow as pa

        from heronry.llm.tokens import tokenizer as held

        encode, task, met = held(tokenizer, blanks), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, flat, counts in encode(batch.column(1)):
                rows, end = [], 0
                for doc, n in zip(docs[first : first + len(counts)], counts.tolist(), strict=True):
                    ids = np.append(flat[end : end + n].astype("<u4"), np.uint32(end_id))
                    end += n
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((doc, k, start, len(own), zlib.crc32(own.tobytes()), task, met[len(own)], own.astype(np.int32)))
                        met[len(own)] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", "ids"][: 7 + keep_ids]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types[: len(names)], strict=False)], names)

    return docs.mapInArrow(tidied(cut), schema)


def plan_sequences(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, first number, last number + 1, first sequence, offset), and the number of sequences.

    The numbers of a length's pieces run from 0; those of a segment go to consecutive sequences.
    """
    third = capacity // 3
    left = {n: c for n, c in counts.items() if c > 0}
    groups: list[list] = []  # [count, lengths]
    large = sorted(n for n in left if n > third)
    while large:
        n = large[-1]
        if left[n] == 0:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - n) - 1
        while k >= 0 and left[large[k]] == 0:
            k -= 1
        if k < 0:
            groups.append([left[n], (n,)])
            left[n] = 0
        elif large[k] == n:
            if left[n] > 1:
                groups.append([left[n] // 2, (n, n)])
            if left[n] % 2:
                left[n] = 1
                k -= 1
                while k >= 0 and left[large[k]] == 0:
                    k -= 1
                groups.append([1, (n,) if k < 0 else (n, large[k])])
                if k >= 0:
                    left[large[k]] -= 1
            left[n] = 0
        else:
            both = min(left[n], left[large[k]])
            groups.append([both, (n, large[k])])
            left[n] -= both
            left[large[k]] -= both
    by_gap: dict[int, list] = defaultdict(list)
    for g in groups:
        by_gap[capacity - sum(g[1])].append(g)
    gaps = sorted(g for g in by_gap if g)

    def put(gap: int, group: list) -> None:
        if gap not in by_gap or not by_gap[gap]:
            bisect.insort(gaps, gap) if gap else None
        by_gap[gap].append(group)

    for n in sorted((n for n in left if n <= third), reverse=True):
        need = left[n]
        while need:
            k = bisect.bisect_left(gaps, n)
            if k == len(gaps):
                each = capacity // n
                whole, rest = divmod(need, each)
                if whole:
                    put(capacity - each * n, [whole, (n,) * each])
                if rest:
                    put(capacity - rest * n, [1, (n,) * rest])
                need = 0
                continue
            gap = gaps[k]
            group = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(k)
            used = min(need, group[0])
            if used < group[0]:
                put(gap, [group[0] - used, group[1]])
            put(gap - n, [used, (*group[1], n)])
            need -= used
    segments, numbered, sequence = [], defaultdict(int), 0
    for gap in sorted(by_gap):
        for count, lengths in by_gap[gap]:
            offset = 0
            for n in lengths:
                segments.append((n, numbered[n], numbered[n] + count, sequence, offset))
                numbered[n] += count
                offset += n
            sequence += count
    return segments, sequence


def pack_documents(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, blanks: bool = True
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = pieces_of(docs, tokenizer, capacity=capacity, end_id=end_id, keep_ids=keep_ids, blanks=blanks)
    # A task's pieces are one bucket's, so each task writes one file.
    pieces = bucketed(pieces, "task", "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments, _ = plan_sequences(counts, capacity)
    ahead = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    # The counts go to the pieces' buckets: few rows, held as a hash table, so pieces are not sorted either.
    starts = before.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("starts"))
    pieces = pieces.join(starts.hint("shuffle_hash"), "task").withColumn("number", F.col("place") + F.col("starts")[F.col("length")]).drop("starts")
    plan = np.array(sorted(segments), np.int64).reshape(-1, 5)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = ", ".join(f"{n} {dict(pieces.dtypes)[n]}" for n in names) + ", sequence_id long, offset long"

    def place(batches):
        import pyarrow as pa

        first = {n: (plan[a:b, 1], plan[a:b]) for n, a, b in zip(*_runs(plan[:, 0]), strict=True)}
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for n, a, b in zip(*_runs(length[order]), strict=True):
                at = order[a:b]
                starts, rows = first[n]
                hit = rows[np.searchsorted(starts, number[at], side="right") - 1]
                sequence[at], offset[at] = hit[:, 3] + number[at] - hit[:, 1], hit[:, 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return pieces.select(*names, F.col("number").cast("long")).mapInArrow(tidied(place), schema)


def _runs(values: np.ndarray):
    """Distinct values of a sorted array, and where each starts and ends."""
    if not len(values):
        return [], [], []
    cuts = np.flatnonzero(np.diff(values)) + 1
    starts = np.concatenate([[0], cuts])
    return values[starts].tolist(), starts.tolist(), np.concatenate([cuts, [len(values)]]).tolist()


def op7_best_fit_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
