"""The registered queries' columns and what they promise of them, the models against plain versions, pipeline edges."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heronry.llm import queries, quality, secrets, toxicity
from heronry.llm.line_rules import line_rules

SF, SF2, SF3 = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
SCORED = {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
CONTRACTS = {
    "op1_quality_rff": SCORED,
    "op2_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_toxicity": SCORED,
    "op4_training_order": {"shard": "bigint", "first_slot": "bigint", "n_sequences": "bigint", "doc_ids": "array<bigint>", "data": "binary"},
    "op5_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "dropped_lines": "array<int>"},
    "op6_nn_descent": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op9_line_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op10_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    types, ids = dict(df.dtypes), [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {c: types[c] for c in CONTRACTS[name]} == CONTRACTS[name]
    rows = df.collect()
    if "doc_id" in types and name != "op7_best_fit_packing":
        assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    if name in ("op1_quality_rff", "op3_toxicity"):
        fold = {"op1_quality_rff": (5, 0), "op3_toxicity": (4, 2)}[name]
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1]) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1
    if name == "op6_nn_descent":
        assert Counter(r["query_id"] for r in rows) == {i: 5 for i in range(0, 500, 50)}


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF2}/documents.parquet')")
    cur = con.execute(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF2)
    assert sorted(x[0] for x in cur.description) == sorted(df.columns)
    names = [x[0] for x in cur.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(str(r[c]) for c in df.columns) for r in df.collect()) == want


@pytest.mark.parametrize(("name", "label", "least"), [("op1_quality_rff", "quality", 0.9), ("op3_toxicity", "toxic", 0.9)])
def test_held_out_rows(spark, name, label, least):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF3}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES[name](spark, SF3).filter("held_out").collect() if labels.get(r["doc_id"]) is not None]
    assert len(rows) > 500 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) >= least


def test_ridge_by_hand(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF2}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter("label IS NOT NULL")
    model = quality.fit_quality(docs, labels)
    pdf = quality.with_stats(docs.join(labels, "doc_id"), "doc_id", "label").withColumn("fold", F.expr("pmod(xxhash64(29, doc_id), 5)")).toPandas()
    x = pdf[list(quality.STATS)].to_numpy()
    z = np.clip((x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1), -6, 6)
    z = np.column_stack([np.sqrt(2 / 256) * np.cos(z @ model.w + model.b), np.ones(len(z))])
    fit = (pdf["fold"] != 0).to_numpy()
    want = np.linalg.solve(z[fit].T @ z[fit] + np.eye(257), z[fit].T @ pdf["label"].to_numpy()[fit])
    assert np.allclose(model.weights, want, atol=1e-6)


def test_isotonic_by_its_min_max_form():
    rng = np.random.default_rng(6)
    for _ in range(20):
        score, label = rng.permutation(40) / 40, rng.integers(0, 2, 40).astype(float)
        y = label[np.argsort(score)]
        best = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
        cuts = [0, *(i for i in range(1, 40) if abs(best[i] - best[i - 1]) > 1e-12), 40]
        want = np.maximum.accumulate([(y[a:b].sum() + 0.5) / (b - a + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        assert np.allclose(quality.isotonic(score, label)[1], want)


def test_toxicity_by_dense_matrices():
    """The same training with one matrix of documents by buckets."""
    rng = np.random.default_rng(9)
    vocab = ["good", "fine", "badd", "awful", "naïve", "tree", "stone"]
    texts = [" ".join(rng.choice(vocab, 12)) for _ in range(30)]
    labels = np.array([float("badd" in t) for t in texts])
    bits, size, scale, decay, rate, steps = 10, 4, 100.0, 0.1, 0.05, 12
    got = toxicity.train(texts, labels, bits=bits, size=size, epochs=steps, min_docs=1, seed=3)
    m = np.zeros((30, 1 << bits))
    for d, t in enumerate(texts):
        for w in t.split():
            own = toxicity.buckets(w, bits)
            for b in own:
                m[d, b] += 1 / len(own) / (len(t.split()) + toxicity.PADDING)
    used = np.flatnonzero(m.any(axis=0))
    m, draw = m[:, used], np.random.default_rng(3)
    params = [draw.normal(0, 0.01, (len(used), size)), draw.normal(0, 0.3, (size, 2)), np.zeros(2)]
    loss = lambda e, w, b: -np.log((lambda x: np.exp(x) / np.exp(x).sum(axis=1, keepdims=True))(scale * m @ e @ w + b)[np.arange(30), labels.astype(int)]).mean() + decay * (e * e).sum() / 60
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        e, w, b = params
        x = scale * m @ e @ w + b
        p = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
        g = (p - np.eye(2)[labels.astype(int)]) / 30
        grads = [scale * m.T @ g @ w.T + decay * e / 30, (scale * m @ e).T @ g, g.sum(axis=0)]
        if step == 3:  # finite differences
            for part, grad in zip(params, grads, strict=True):
                at = tuple(rng.integers(0, n) for n in part.shape)
                part[at] += 1e-6
                up = loss(*params)
                part[at] -= 2e-6
                down = loss(*params)
                part[at] += 1e-6
                assert grad[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)
        for i, (q, grad) in enumerate(zip(params, grads, strict=True)):
            first[i] += 0.1 * (grad - first[i])
            second[i] += 0.001 * (grad * grad - second[i])
            q -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    want = np.zeros(1 << bits)
    want[used] = params[0] @ (params[1][:, 1] - params[1][:, 0])
    assert np.allclose(got.table, want, atol=2e-3 * np.abs(want).max())


def test_classes_of_secrets(spark):
    """Each class has its own threshold."""
    runs = {"hex": "0123abcd" * 5, "mixed": "aB3dE5gH7jK9mN1pQ2rS", "base64": "aB3d/5gH7jK9+N1pQ2rS", "letters": "aBdEgHjKmNpQrSzYxWvU"}
    df = spark.createDataFrame([(n, t) for n, t in runs.items()], "doc_id string, text string")
    off = {"hex_bits": 9.0, "mixed_bits": 9.0, "base64_bits": 9.0, "letter_bits": 9.0}
    for name in runs:
        key = {"hex": "hex_bits", "mixed": "mixed_bits", "base64": "base64_bits", "letters": "letter_bits"}[name]
        found = {r["doc_id"] for r in secrets.secret_spans(df, **off | {key: 1.0}).collect() if any(x["k"] == 3 for x in r["spans"])}
        assert found <= {name} and (found or name == "hex")  # a run of lower-case hex is a span of the fixed kind already


def test_line_rule_limits_are_parameters(spark):
    text = "One sentence here. And an end without a mark " * 10
    df = spark.createDataFrame([(1, "\n".join([text] * 2 + ["A plain line that ends well."] * 30))], "doc_id long, text string")
    lost = lambda **how: line_rules(df, **how).selectExpr("n_words - clean_words AS lost").first()["lost"]
    assert lost() == 0 and lost(long_line=10_000) > 0


NAMES = ("doc", "row", "kept", "whole", "n_lines", "dropped_lines", "id", "key", "score", "part")


def test_pipeline_stages_on_edge_rows(spark):
    rows = [(None, "a text without an id but with quite enough words in it to stay", "en", None, 5), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (4, "x" * 30_000, "en", "s", 30_000)]
    rows += [(3, f"document three with many words {i} and a tail that differs somewhat from others {i * 7}", "en", "t", 9) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit(c) for c in NAMES})
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            if name != "best_fit_packing":
                assert out.columns == docs.columns and all(r[c] == c for r in out.collect() for c in NAMES)
                docs = out
            if name in ("toxicity", "line_dedup", "ngram_jaccard_join"):
                assert n == (8 if df.columns and docs.count() else 0)
