"""Findings of round three on what moves between tasks and what a worker holds at once."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from heronry.functions.stems import STOP_WORDS
from heronry.operators import code_chunks, search, vector_index


class Table:
    """Stands for a table: what an operator would run on workers runs here, on one batch."""

    def __init__(self, batch, dtypes):
        self.batch, self.dtypes = batch, dtypes

    def select(self, *columns):
        return self

    def mapInPandas(self, work, schema):
        return list(work(iter([self.batch])))

    mapInArrow = mapInPandas


@pytest.mark.parametrize("how", [{}, {"stems": True, "stop_words": STOP_WORDS}])
def test_bm25_moves_texts_and_scores_but_no_tokens(spark, how):
    points = spark.createDataFrame([(i, f"red fox {i % 3} running foxes") for i in range(40)], "point_id long, text string")
    queries = spark.createDataFrame([(1, "fox runs"), (2, "1 red"), (3, "nothing")], "query_id long, query string")
    scored = search.bm25_scores(points, queries, **how)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert any(re.fullmatch(r"point_id#\d+L?", k) for k in keys)
    assert not any("point_id" in k and "token" in k for k in keys)
    got = {(r["query_id"], r["point_id"]): r["score"] for r in scored.collect()}
    p, q = (search.bm25_weights(t, *c, **how).collect() for t, c in ((points, ("point_id", "text")), (queries, ("query_id", "query"))))
    want: dict = {}
    for a in p:
        for b in q:
            if a["token"] == b["token"]:
                at = (b["query_id"], a["point_id"])
                want[at] = want.get(at, 0) + a["weight"] * b["weight"]
    assert got == pytest.approx(want)


def test_probes_go_out_in_bounded_frames():
    index, n, dim = object.__new__(vector_index.Index), 500, 64
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(200, dim))
    index.names, index.centres = np.arange(200, dtype=np.int32), centres / np.linalg.norm(centres, axis=1, keepdims=True)
    index.reach, index.blocks = np.full(200, -1.0), np.ones(200, int)
    pdf = pd.DataFrame({"query_id": range(n), "vector": list(rng.normal(size=(n, dim))), "least": -1.0})
    frames = index.probed(Table(pdf, [("query_id", "bigint"), ("vector", "array<double>")]), 8, "least")
    assert max(8 * dim * len(f) for f in frames) <= 8_000_000
    found = pd.concat(frames)
    assert len(found) == n * 192 == len(found[["query_id", "cell"]].drop_duplicates())


def test_dense_search_holds_bounded_products(spark):
    rng = np.random.default_rng(2)
    n, dim = 10_000, 8
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1024, dim)))], "query_id long, vector array<double>")
    taken = []

    class Points(Table):
        def mapInPandas(self, work, schema):
            tracemalloc.start()
            taken.append((pd.concat(work(iter([self.batch]))), tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()
            return spark.createDataFrame(taken[0][0], schema)

    points = Points(pd.DataFrame({"point_id": range(n), "vector": list(rng.normal(size=(n, dim)))}), [("point_id", "bigint"), ("vector", "array<double>")])
    assert search.dense_topk(points, queries, 5).count() == 5 * 1024
    assert taken[0][1] < 40_000_000


def test_code_chunks_go_out_in_bounded_batches():
    n = 1000
    docs = pa.RecordBatch.from_pydict({"page_id": [str(i) for i in range(n)], "title": ["t"] * n, "url": ["u"] * n, "text": ["import os\n\n\ndef f():\n    return os.getcwd()\n"] * n, "content_hash": ["h"] * n})
    out = code_chunks.chunk_code(Table(docs, []))
    assert sum(b.num_rows for b in out) == n
    assert max(b.num_rows for b in out) <= 64
