"""Top-k search for sets of queries: dense, lexical, fused, re-ranked."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronry.functions import scores as S
from heronry.functions import text as T
from heronry.functions.stems import stemmed

#: Bytes of query vectors that one pass over the points compares (they travel to every task), bytes of products of queries
#: with a batch of points that are held at once, and rows that a task sends on at once.
BLOCK_BYTES, PRODUCT_BYTES, ROWS_AT_ONCE = 64_000_000, 8_000_000, 16_384
#: Queries' weights that are sent to every task in place of moving those of the points to them.
SENT_WEIGHTS = 500_000


class _Best:
    """The k best (score, id) of each of n queries, over all batches of a task; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0)] * n, [None] * n

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        # Ids keep their type: numbers are not objects.
        ids = ids if self.ids[i] is None else np.concatenate([self.ids[i], ids])
        scores = np.concatenate([self.scores[i], scores])
        top = np.lexsort((ids, -np.round(scores, 12)))[: self.k]
        self.scores[i], self.ids[i] = scores[top], ids[top]


def dense_topk(points: DataFrame, queries: DataFrame, k: int = 5, *, id_col: str = "point_id", query_col: str = "query_id", vector_col: str = "vector", skip_self: bool = False) -> DataFrame:
    """query_id, rank, point id, score: the k points of largest cosine, ties to the smaller id.

    Queries are compared in blocks with every point; a task sends on one frame with only its k best a query, so what
    is shuffled is k rows a query and task. Zero vectors and nulls take no part.
    """
    rows = queries.filter(F.col(vector_col).isNotNull()).select(query_col, vector_col)
    id_type, query_type = dict(points.dtypes)[id_col], dict(queries.dtypes)[query_col]
    schema = f"{query_col} {query_type}, {id_col} {id_type}, score double"

    def block(part: list) -> DataFrame:
        names = [r[0] for r in part]
        q = np.array([r[1] for r in part], float)
        norms = np.linalg.norm(q, axis=1)
        q = q / np.where(norms > 0, norms, np.nan)[:, None]

        def best(batches: Iterable):
            import pandas as pd

            held = _Best(len(q), k)
            for pdf in batches:
                pdf = pdf[pdf[vector_col].notna()]
                if not len(pdf):
                    continue
                x = np.stack(pdf[vector_col].to_numpy()).astype(float)
                norm = np.linalg.norm(x, axis=1)
                own, x = pdf[id_col].to_numpy()[norm > 0], x[norm > 0] / norm[norm > 0][:, None]
                if not len(own):
                    continue
                at_once = max(1, PRODUCT_BYTES // (8 * len(x)))
                for at in range(0, len(q), at_once):
                    for i, s in enumerate(q[at : at + at_once] @ x.T, at):
                        use = ~np.isnan(s) & ((own != names[i]) | (not skip_self))
                        if len(s) > 4 * k:  # only what reaches the k-th score can be among the best
                            use &= np.round(s, 12) >= np.round(np.partition(np.where(use, s, -2), -k)[-k], 12)
                        held.add(i, s[use], own[use])
            each = max(1, ROWS_AT_ONCE // k)
            for at in range(0, len(q), each):
                some = [i for i in range(at, min(at + each, len(q))) if held.ids[i] is not None and len(held.ids[i])]
                if some:
                    name = np.repeat(np.array([names[i] for i in some], object), [len(held.ids[i]) for i in some])
                    yield pd.DataFrame({query_col: name, id_col: np.concatenate([held.ids[i] for i in some]), "score": np.concatenate([held.scores[i] for i in some])})
                for i in some:
                    held.ids[i] = held.scores[i] = None

        return points.select(id_col, vector_col).mapInPandas(best, schema)

    found, part, size = None, [], 0
    for row in [*rows.toLocalIterator(), None]:
        if row is not None:
            part.append(row)
            size += 8 * len(row[1])
        if part and (row is None or size >= BLOCK_BYTES):
            found = block(part) if found is None else found.union(block(part))
            part, size = [], 0
    if found is None:
        return points.sparkSession.createDataFrame([], f"{query_col} {query_type}, rank int, {id_col} {id_type}, score double")
    ranked = W.partitionBy(query_col).orderBy(F.desc(F.round("score", 12)), id_col)
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(query_col, "rank", id_col, "score")


def title_search(points: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, point_id, title: points whose title holds every token of the query, in order of id.

    Joined on one token of the query (its longest, then first), so there is no comparison of all pairs.
    """
    q = queries.select("query_id", F.array_distinct(T.tokens("query")).alias("q")).filter(F.size("q") > 0)
    key = F.array_sort(F.transform("q", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    q = q.withColumn("token", F.get(key, F.lit(0))["t"])
    p = points.select("point_id", "title", F.array_distinct(T.tokens("title")).alias("t")).withColumn("token", F.explode("t"))
    hit = p.join(q, "token").filter(F.size(F.array_except("q", "t")) == 0)
    first = W.partitionBy("query_id").orderBy("point_id")
    return hit.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit).select("query_id", "point_id", "title")


def bm25_weights(
    texts: DataFrame, id_col: str, text_col: str, *, stems: bool = False, stop_words: tuple[str, ...] = (), only: DataFrame | None = None, dealt: bool = False, **how
) -> DataFrame:
    """Long form id, token, weight of each text's tokens. Words of stop_words count for nothing, not in the length either;
    with stems, words of one stem are one token. A text's own counts are formed first, so a word is stemmed once a text.

    only: a table of tokens, small enough to be sent to every task; other tokens give no rows, but count in the length.
    With dealt, texts move to their ids' places before they become tokens, and nothing moves after that.
    """
    texts = texts.select(id_col, text_col).repartition(id_col) if dealt else texts
    tokens = T.tokens(text_col)
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~t.isin(*stop_words))
    t = texts.select(id_col, tokens.alias("t")).withColumn("length", F.size("t"))
    known = lambda rows: rows if only is None else rows.join(F.broadcast(only), "token", "left_semi")
    each = t.select(id_col, "length", F.explode("t").alias("token"))
    tf = (each if stems else known(each)).groupBy(id_col, "length", "token").agg(F.count("*").alias("tf"))
    if stems:
        tf = known(stemmed(tf, "token")).groupBy(id_col, "length", "token").agg(F.sum("tf").alias("tf"))
    return tf.select(id_col, "token", S.bm25_weight(F.col("tf"), F.col("length"), **how).alias("weight"))


def bm25_scores(points: DataFrame, queries: DataFrame, pool: DataFrame | None = None, **how) -> DataFrame:
    """query_id, point_id, score: sum over shared tokens of the product of both weights.

    pool (query_id, point_id) restricts the pairs: only its points' tokens are joined, by query and token. Without it
    every pair with a shared token counts: up to SENT_WEIGHTS weights of queries (they are counted first) are sent to every
    task, so that a point is scored where its text is and only its scores go on; more are joined by token.
    how: what bm25_weights takes (stems, stop_words), the same for both sides.
    """
    if pool is not None:
        pool = pool.select("query_id", "point_id").distinct()
        points = points.join(pool.select("point_id").distinct(), "point_id", "left_semi")
        queries = queries.join(pool.select("query_id").distinct(), "query_id", "left_semi")
    q = bm25_weights(queries, "query_id", "query", **how).withColumnRenamed("weight", "q_weight")
    if pool is None and q.count() <= SENT_WEIGHTS:
        p = bm25_weights(points, "point_id", "text", only=q.select("token").distinct(), dealt=True, **how)
        return p.join(F.broadcast(q), "token").groupBy("query_id", "point_id").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("score"))
    p = bm25_weights(points, "point_id", "text", **how)
    pairs = p.join(q, "token") if pool is None else pool.join(p, "point_id").join(q, ["query_id", "token"])
    return pairs.groupBy("query_id", "point_id").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("score"))


def lexical_text(points: DataFrame) -> DataFrame:
    """point_id, text as BM25 reads it: title, breadcrumb, and the text below them (columns that are there)."""
    part = lambda c: F.coalesce(c, F.lit("")) if c in points.columns else F.lit("")
    return points.select("point_id", F.concat(part("title"), F.lit(" "), part("breadcrumb"), F.lit("\n"), part("text")).alias("text"))


def ranked(scored: DataFrame, k: int | None = None, digits: int = 9) -> DataFrame:
    """With rank by falling score, ties by point_id."""
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "point_id")
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


def hybrid_search(dense: DataFrame, lexical: DataFrame, points: DataFrame, queries: DataFrame, k: int = 15, w_dense: float = 0.6, w_lexical: float = 0.4, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of dense hits (query_id, point_id, rank) and the pool's BM25 ranks.

    The pool is the union of dense and lexical candidates. A point that dense search did not find counts as 10 places
    behind its query's last dense hit. BM25 reads points' titles and breadcrumbs too, where they have them.
    """
    pool = dense.select("query_id", "point_id", F.col("rank").alias("dense_rank")).join(lexical.select("query_id", "point_id"), ["query_id", "point_id"], "full_outer")
    bm25 = bm25_scores(lexical_text(points), queries, pool).withColumnRenamed("score", "bm25")
    pool = pool.join(bm25, ["query_id", "point_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    by_bm25, own = W.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "point_id"), W.partitionBy("query_id")
    pool = pool.withColumns({"bm25_rank": F.row_number().over(by_bm25), "n": F.count("*").over(own), "n_dense": F.count("dense_rank").over(own)})
    score = S.reciprocal_rank_fusion(F.col("dense_rank"), F.col("bm25_rank"), F.col("n_dense"), F.col("n"), w_dense, w_lexical, rrf_k)
    return ranked(pool.withColumn("score", score).withColumn("score_kind", F.lit("rrf")), k)


def ask(
    points: DataFrame, queries: DataFrame, k: int = 5, *, hybrid: bool = False, score_pairs: Callable[[list[str], list[str]], list[float]] | None = None, titles: int = 10
) -> DataFrame:
    """query_id, rank, point_id, score, score_kind and the columns of points but the vector: the k hits of each query.

    points: point_id, vector, title, text, ...; queries: query_id, query, vector. max(k, 15) candidates come from dense
    search, with hybrid fused with `titles` points whose titles hold the query; score_pairs ranks them again.
    """
    wide = max(k, 15)
    hits = dense_topk(points, queries, wide).withColumn("score_kind", F.lit("cosine"))
    if hybrid:
        hits = hybrid_search(hits, title_search(points, queries, titles), points, queries, wide).select("query_id", "rank", "point_id", "score", "score_kind")
    rest = [c for c in points.columns if c not in ("point_id", "vector")]
    hits = hits.join(points.select("point_id", *rest), "point_id")
    if score_pairs:
        hits = rerank(hits.join(queries.select("query_id", "query"), "query_id"), score_pairs, k).drop("query")
    return hits.filter(F.col("rank") <= k).select("query_id", "rank", "point_id", "score", "score_kind", *rest)


_LOADED: dict = {}


class loaded:  # noqa: N801 - used like a function
    """score_pairs of a model that load() makes: once in a worker, however many tasks it runs."""

    def __init__(self, load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
        self.load, self.key = load, uuid.uuid4().hex

    def __call__(self, queries: list[str], texts: list[str]) -> list[float]:
        if self.key not in _LOADED:
            _LOADED[self.key] = self.load()
        return _LOADED[self.key](queries, texts)


def rerank(hits: DataFrame, score_pairs: Callable[[list[str], list[str]], list[float]], k: int = 5) -> DataFrame:
    """hits (query_id, query, point_id, text, ...) ordered again by the sigmoid of a pair scorer.

    score_pairs(queries, texts) runs on workers over Arrow batches. A query with one hit keeps its score.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in hits.dtypes if n != "pair_score") + ", pair_score double"

    def scored(batches):
        for pdf in batches:
            yield pdf.assign(pair_score=[float(x) for x in score_pairs(pdf["query"].tolist(), pdf["text"].tolist())])

    out = hits.mapInPandas(scored, fields).withColumn("n", F.count("*").over(W.partitionBy("query_id")))
    out = out.withColumn("score", F.when(F.col("n") > 1, S.sigmoid(F.col("pair_score"))).otherwise(F.col("score"))).drop("n", "pair_score", "rank")
    return ranked(out.withColumn("score_kind", F.lit("rerank")), k)
