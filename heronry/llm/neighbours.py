"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, queries walk it greedily.

1. Equal vectors are one node; of a node's ids only the smallest k + 1 can ever be results, so these are kept
   (the limit works before the shuffle). Nodes carry their vector with four bytes a component for the search, and
   similarities are taken in double precision, so near copies keep their order; scores of results come from the
   original vectors.
2. First edges: sorted by random projections, blocks of `block` nodes are compared inside, `tables` times.
3. NN-descent, `rounds` times: every node meets the vectors of its neighbours and of a bounded, seeded
   choice of the nodes that list it (the method's sampling); neighbours of one node are compared with each
   other, pairs that beat a node's worst neighbour are joined back, and each node keeps its best `degree`.
4. A query starts at its own node (or, for foreign vectors, at seeded nodes) and holds the `beam` best nodes
   it has seen; the best `step` that it has not expanded are joined with the graph, until none is left.

Every row is in the index. The walk finds most, not all, of the true neighbours; the tests hold recall
against brute force at 0.9 or more. Memory is bounded: a block, the neighbours of a node, or a beam.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as queries or as
candidates; vectors shorter than the longest count as ending in zeros; ties go to the smaller id; an id that is
repeated with equal vectors counts once; an id on several vectors asks with the least of them and is found once, by
its best score; fewer candidates than k give fewer rows; an empty table none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, table, written

EDGE = "node long, near long, sim double"


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _padded(vectors: list, size: int) -> np.ndarray:
    """A matrix of the vectors, zeros behind the short ones."""
    out = np.zeros((len(vectors), size))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _edges(node, near, sim):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(near, pa.int64()), pa.array(sim, pa.float64())], ["node", "near", "sim"])


def usable(rows: DataFrame) -> DataFrame:
    """id, v of rows whose vector can take part."""
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """node (least id of equal vectors), v, id: up to `keep` ids of each node."""
    w = W.partitionBy("v").orderBy("id")
    rows = rows.distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep)
    return rows.withColumn("node", F.min("id").over(W.partitionBy("v"))).select("node", "v", "id")


def coded(nodes: DataFrame, size: int) -> DataFrame:
    """node, q: components over the largest, four bytes each."""

    def code(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = _padded(b.column("v").to_pylist(), size)
                q = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([r.tobytes() for r in q], pa.binary())], ["node", "q"])

    return nodes.mapInArrow(code, "node long, q binary")


def first_edges(codes: DataFrame, degree: int, tables: int, block: int, n: int, seed: int) -> DataFrame:
    bits = max(1, int(np.log2(max(2, n / block))))

    def keyed(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(b.column("q").to_pylist())
            for t in range(tables):
                draw = np.random.default_rng(seed + t)
                sides = (x @ draw.normal(size=(x.shape[1], bits)) > 0) @ (2.0 ** np.arange(bits))
                key = sides + 1 / (1 + np.exp(-4 * (x @ draw.normal(size=x.shape[1]))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(key), b.column("node"), b.column("q")], ["t", "key", "node", "q"])

    def inside(batches):
        nodes, raw, at = [], [], None

        def compared():
            x = _unit(raw)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            best = np.argsort(-s, axis=1)[:, : min(degree, len(raw) - 1)]
            ids = np.array(nodes)
            return _edges(np.repeat(ids, best.shape[1]), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel())

        for b in batches:
            for t, node, q in zip(*(b.column(c).to_pylist() for c in ("t", "node", "q")), strict=True):
                if t != at or len(nodes) == block:
                    if len(nodes) > 1:
                        yield compared()
                    nodes, raw, at = [], [], t
                nodes.append(node)
                raw.append(q)
        if len(nodes) > 1:
            yield compared()

    keys = codes.mapInArrow(keyed, "t long, key double, node long, q binary")
    parts = max(tables, -(-n * tables // (8 * block)))
    return keys.repartitionByRange(parts, "t", "key", "node").sortWithinPartitions("t", "key", "node").mapInArrow(inside, EDGE)


def best_edges(edges: DataFrame, degree: int) -> DataFrame:
    w = W.partitionBy("node").orderBy(F.desc("sim"), "near")
    edges = edges.groupBy("node", "near").agg(F.max("sim").alias("sim"))
    return edges.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= degree).drop("n")


def meetings(graph: DataFrame, degree: int, seed: int) -> DataFrame:
    """at, node: the neighbours of each node, and a seeded choice of those that list it."""
    back = graph.select(F.col("near").alias("at"), "node")
    w = W.partitionBy("at").orderBy(F.xxhash64(F.lit(seed), "node", "at"))
    back = back.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= degree).drop("n")
    return graph.select(F.col("node").alias("at"), F.col("near").alias("node")).union(back).distinct()


def descend(graph: DataFrame, codes: DataFrame, degree: int, top: int, seed: int) -> DataFrame:
    """One round of NN-descent."""
    worst = graph.groupBy("node").agg(F.when(F.count("*") >= degree, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    known = meetings(graph, degree, seed).join(codes.join(worst, "node", "left"), "node")

    def compare(batches):
        held, at = [], None

        def pairs(rows):
            ids = np.array([r[0] for r in rows])
            x = _unit([r[1] for r in rows])
            s = x @ x.T
            np.fill_diagonal(s, -2)
            limit = np.array([-2 if r[2] is None else r[2] for r in rows])
            best = np.argpartition(-s, min(top, len(rows) - 1), axis=1)[:, :top]
            own = np.take_along_axis(s, best, 1)
            i, j = np.nonzero(own > limit[:, None])
            return ids[i], ids[best[i, j]], own[i, j]

        out, size = [], 0
        for b in batches:
            for a, node, q, worst in zip(*(b.column(c).to_pylist() for c in ("at", "node", "q", "worst")), strict=True):
                if a != at:
                    if len(held) > 1:
                        out.append(pairs(held))
                        size += len(out[-1][0])
                    held, at = [], a
                    if size > 20_000:
                        yield _edges(*map(np.concatenate, zip(*out, strict=True)))
                        out, size = [], 0
                held.append((node, q, worst))
        if len(held) > 1:
            out.append(pairs(held))
        if out:
            yield _edges(*map(np.concatenate, zip(*out, strict=True)))

    new = known.repartition("at").sortWithinPartitions("at", "node").select("at", "node", "q", "worst").mapInArrow(compare, EDGE)
    return best_edges(graph.union(new), degree)


def neighbour_graph(codes: DataFrame, *, degree: int = 24, tables: int = 4, block: int = 256, rounds: int = 4, top: int = 16, seed: int = 41) -> DataFrame:
    """node, near, sim: up to `degree` near nodes of every node."""
    n = codes.count()
    graph = written(best_edges(first_edges(codes, degree, tables, block, n, seed), degree), "graph")
    for r in range(rounds):
        after = written(descend(graph, codes, degree, top, seed + r), "graph")
        discard(graph)
        graph = after
    return graph


def walk(queries: DataFrame, graph: DataFrame, codes: DataFrame, *, degree: int, beam: int, step: int) -> DataFrame:
    """queries: query_id, q, start (node). Rows query_id, node of each query's beam at the end."""
    both = graph.select("node", "near", "sim").union(graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "sim"))
    near = best_edges(both, 2 * degree).join(codes.select(F.col("node").alias("near"), "q"), "near")
    links = near.groupBy("node").agg(F.collect_list(F.struct("near", "q")).alias("out"))  # at most 2 * degree
    links = written(links.select("node", F.col("out.near").alias("near"), F.col("out.q").alias("qs")))
    schema = "query_id long, q binary, nodes array<long>, sims array<double>, done array<boolean>"
    state = written(queries.select("query_id", "q", F.array("start").alias("nodes"), F.array(F.lit(1.0)).alias("sims"), F.array(F.lit(False)).alias("done")))

    def chosen(col="done"):
        open_ = F.filter(F.sequence(F.lit(0), F.size("nodes") - 1), lambda i: ~F.get("done", i))
        return F.slice(open_, 1, step)  # nodes stand in falling order of similarity

    def merged(key, group):
        import pyarrow as pa

        rows = group.to_pylist()
        query = _unit([rows[0]["q"]])[0]
        own = next(r for r in rows if r["nodes"] is not None)
        sims, done = dict(zip(own["nodes"], own["sims"], strict=True)), dict(zip(own["nodes"], own["done"], strict=True))
        found: dict[int, bytes] = {}
        for r in rows:
            if r["expanded"] is not None:
                done[r["expanded"]] = True
                found.update((n, q) for n, q in zip(r["near"] or (), r["qs"] or (), strict=True) if n not in sims)
        if found:
            sims.update(zip(found, (_unit(list(found.values())) @ query).tolist(), strict=True))
        best = sorted(sims, key=lambda n: (-sims[n], n))[:beam]
        row = {"query_id": [rows[0]["query_id"]], "q": [rows[0]["q"]], "nodes": [best], "sims": [[sims[n] for n in best]], "done": [[done.get(n, False) for n in best]]}
        return pa.table(row, schema=pa.schema([("query_id", pa.int64()), ("q", pa.binary()), ("nodes", pa.list_(pa.int64())), ("sims", pa.list_(pa.float64())), ("done", pa.list_(pa.bool_()))]))

    while True:
        todo = written(state.select("query_id", "q", F.explode(F.transform(chosen(), lambda i: F.get("nodes", i))).alias("expanded")), "todo")
        if todo.isEmpty():
            discard(todo, links)
            return state.select("query_id", F.explode("nodes").alias("node"))
        none = lambda t: F.lit(None).cast(t)
        steps = todo.join(links, F.col("expanded") == F.col("node"), "left").select("query_id", "q", none("array<long>").alias("nodes"), none("array<double>").alias("sims"), none("array<boolean>").alias("done"), "expanded", "near", "qs")
        held = state.select("*", none("long").alias("expanded"), none("array<long>").alias("near"), none("array<binary>").alias("qs"))
        asked = todo.select("query_id").distinct()
        moved = held.join(asked, "query_id", "left_semi").select(steps.columns).union(steps).groupBy("query_id").applyInArrow(merged, schema)
        after = written(state.join(asked, "query_id", "left_anti").union(moved), "beams")
        discard(todo, state)
        state = after


def nearest(rows: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, degree: int = 24, beam: int = 300, step: int = 30, **how) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is_query (a column over `id`) marks."""
    rows = usable(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")))
    members = written(nodes_of(rows, k + 1))
    reps = members.filter("id = node").select("node", "v")
    size = members.agg(F.max(F.size("v"))).first()[0] or 0
    codes = written(coded(reps, size))
    graph = neighbour_graph(codes, degree=degree, **how)
    asked = rows.filter(is_query).groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = written(asked.join(reps, "v").select("query_id", "v", "node"))
    found = walk(asked.join(codes, "node").select("query_id", "q", F.col("node").alias("start")), graph, codes, degree=degree, beam=beam, step=step)
    found = found.join(asked.select("query_id", F.col("v").alias("qv")), "query_id").join(reps, "node")

    def exact(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x, y = (_padded(b.column(c).to_pylist(), size) for c in ("qv", "v"))
                score = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
                yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("node"), pa.array(score)], ["query_id", "node", "score"])

    scored = found.select("query_id", "node", "qv", "v").mapInArrow(exact, "query_id long, node long, score double")
    scored = scored.join(members.select("node", F.col("id").alias("vec_id")), "node").filter("vec_id <> query_id")
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_nn_descent(spark, sf_dir) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
