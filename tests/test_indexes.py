"""Order statistics, the lexical and the vector index, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.operators import lexical_index, order_stats, search, vector_index

# ---- order statistics -----------------------------------------------------------------------------


def test_order_statistics_of_groups(spark):
    rng = random.Random(1)
    inf = math.inf
    groups = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2000)], "few": [rng.randrange(3) for _ in range(500)], "one": [7.5],
        None: [rng.gauss(0, 1) for _ in range(1001)], "ends": [inf, -inf, 1.0, 2.0, math.nan, inf, -inf, 3.0], "only": [inf] * 3, "huge": [-1.7e308, 1.7e308, 0.0],
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in order_stats.at_ranks(df, "g", "v", {"p50": order_stats.index_quantile(0.5), "p95": order_stats.index_quantile(0.95), "last": lambda n: n - 1}).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs = sorted(vs, key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
        n = len(vs)
        want = [vs[min(int(n * 0.5), n - 1)], vs[min(int(n * 0.95), n - 1)], vs[-1]]
        assert got[g]["n"] == n and list(map(repr, (got[g]["p50"], got[g]["p95"], got[g]["last"]))) == list(map(repr, map(float, want)))
    assert order_stats.at_ranks(df.limit(0), "g", "v", {"p50": order_stats.index_quantile(0.5)}).collect() == []


def test_continuous_quantile(spark):
    values = np.random.default_rng(2).normal(size=777)
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    assert order_stats.continuous_quantile(df, "g", "v", 0.99).first()["value"] == pytest.approx(np.quantile(values, 0.99), rel=1e-12)


# ---- lexical index --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of one hot word, common and rare words, equal texts, and queries for all of these."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    draw = lambda n: " ".join(["hot", *rng.choices(words, [1 / (i + 1) for i in range(400)], k=n)])
    texts = [draw(rng.randrange(1, 60)) for _ in range(900)] + ["hot rare1 w5 w6"] * 5 + ["", "hot"]
    points = spark.createDataFrame(list(enumerate(texts)), "point_id long, text string")
    asked = [(0, "rare1 w5 hot"), (1, "nothing here"), (2, draw(12)), (3, "hot"), (4, "w399 w398 rare1"), (5, ""), (6, texts[17])]
    return points, spark.createDataFrame(asked, "query_id long, query string")


@pytest.mark.parametrize("k,spend", [(1, 0.3), (10, 0.3), (10, 0.99), (2000, 0.3)])
def test_lexical_index_is_exact(spark, corpus, tmp_path, monkeypatch, k, spend):
    points, queries = corpus
    monkeypatch.setattr(lexical_index, "FIRST", 4)
    monkeypatch.setattr(lexical_index, "PIECE", 16)
    monkeypatch.setattr(lexical_index, "SPEND", spend)
    monkeypatch.setattr(lexical_index, "TRIED_POSTINGS", 60)
    lexical_index.build(search.bm25_weights(points, "point_id", "text"), f"{tmp_path}/i")
    index = lexical_index.Index(spark, f"{tmp_path}/i")
    assert index.postings.select(F.max(F.size("ids"))).first()[0] <= 16
    asked = search.bm25_weights(queries, "query_id", "query").withColumnRenamed("weight", "q_weight")
    shown = lambda df: sorted((r["query_id"], r["rank"], r["point_id"], round(r["score"], 9)) for r in df.collect())
    assert shown(index.topk(asked, k)) == shown(search.ranked(search.bm25_scores(points, queries), k))
    plan = index.planned(asked, index.thresholds(asked, k))
    whole = asked.join(index.tiers, "token").agg(F.sum("n")).first()[0]
    if k <= 10:
        assert plan.agg(F.sum("n")).first()[0] < whole
    if spend > 0.9 and k <= 10:
        assert plan.agg(F.sum("n")).first()[0] < whole / 2


# ---- vector index ---------------------------------------------------------------------------------


def clustered(n, dims, centres, seed, noise=0.35):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    x = c[rng.integers(centres, size=n)] + noise * rng.normal(size=(n, dims))
    x[: n // 3] = c[0] + noise * rng.normal(size=(n // 3, dims))  # a third of all points lie in one cluster
    return x


def frame(spark, x):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(x)), "vector": [v.tolist() for v in x]}), "point_id long, vector array<float>")


def plain_topk(x, asked, k, skip_self=False):
    u = x.astype(np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = np.round(u @ u[q], 12)
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if not (skip_self and i == q)]
        out[q] = order[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["point_id"])
    return out


def test_vector_index_recall_and_share_read(spark, tmp_path):
    """50,000 vectors: recall@10 of 0.95 against all pairs, with under a fifth of the points compared for a query."""
    x = clustered(50_000, 32, 60, 4)
    points = frame(spark, x)
    vector_index.build(points, f"{tmp_path}/v", block=4096, cells=256)
    index = vector_index.Index(spark, f"{tmp_path}/v")
    asked = list(range(0, 50_000, 500))
    queries = points.filter("point_id % 500 = 0").withColumnRenamed("point_id", "query_id")
    got, want = found(index.topk(queries, 10, probes=40)), plain_topk(x, asked, 10)
    recall = np.mean([len(set(got[q]) & set(want[q])) / 10 for q in asked])
    print("recall", recall)
    assert recall >= 0.95
    read = index.probed(queries, 40).select("query_id", "cell").distinct().join(index.points.groupBy("cell").count(), "cell")
    share = read.groupBy("query_id").agg((F.sum("count") / 50_000).alias("s")).agg(F.avg("s")).first()[0]
    print("share", share)
    assert share < 0.2
    assert index.points.groupBy("cell", "block").count().agg(F.max("count")).first()[0] <= 2 * 4096
    plan = index.by_code(index.probed(queries.limit(1), 3), 10, False)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [cell" in plan or "cell#" in plan.split("PartitionFilters")[1][:200]


def test_vector_index_exact_mode(spark, tmp_path):
    x = clustered(3000, 8, 20, 5)
    x[100:110] = x[100]  # ties
    points = frame(spark, x)
    odd = spark.createDataFrame([(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [None] * 8)], "point_id long, vector array<float>")
    vector_index.build(points.union(odd), f"{tmp_path}/v", block=200)
    index = vector_index.Index(spark, f"{tmp_path}/v")
    asked = list(range(0, 3000, 50))
    queries = points.union(odd).filter("point_id % 50 = 0 OR point_id > 4999").withColumnRenamed("point_id", "query_id")
    for skip in (False, True):
        assert found(index.topk(queries, 7, first=1, refine=2, skip_self=skip)) == plain_topk(x, asked, 7, skip)
    assert {len(v) for v in found(index.topk(queries.filter("query_id = 50"), 5000)).values()} == {3000}


def test_vector_index_refuses(spark, tmp_path):
    two = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "point_id long, vector array<float>")
    with pytest.raises(ValueError):
        vector_index.build(two, f"{tmp_path}/v")
    with pytest.raises(ValueError):
        vector_index.build(two.limit(0), f"{tmp_path}/w")
