"""An inverted file of cells over vectors: coarse centroids, INT8 codes, probe lists, exact re-scoring.

Layout, below one folder:

- `points`: partitioned by cell: id, block, code (INT8 components of the unit vector, as bytes), vector as it was given.
  A cell of more than BLOCK points is several blocks, dealt by a hash of the id, so no task holds a crowded cell.
- `cells`: cell, centroid, reach (the smallest cosine of a member with the centroid), n, blocks.
- `scale`: what a code of 127 stands for.

Centroids come from spherical k-means on at most SAMPLE vectors; every vector is indexed. A search compares each query with the
centroids, reads the codes of its nearest cells only (the other cells' folders are not listed in the scan), keeps REFINE * k
points a query by code, and scores these again with their vectors in double precision.

`topk(..., probes=None)` is exact: with the angle of a cell's reach, the triangle inequality bounds the cosine of all its
members from above, so after a first search every further cell that could still hold one of the k best is searched too.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronry import scratch
from heronry.operators.order_stats import continuous_quantile

#: Points in a block, vectors that centroids are fitted on, cells at most (centroids travel to every task: MOST_CELLS
#: of 1,024 components are 67 MB), and points a query that are scored again, as a multiple of k.
BLOCK, SAMPLE, MOST_CELLS, REFINE = 16_384, 65_536, 8_192, 8
#: Queries whose products with a block are held at once, and vectors that are compared with all centroids at once.
QUERIES_AT_ONCE, VECTORS_AT_ONCE = 512, 256
#: Bytes of vectors that go out in one frame, where each query's is repeated for every block that it probes.
FRAME_BYTES = 8_000_000
SLACK = 1e-9


def _units(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _slices(frames: Iterable, rows: int) -> Iterable:
    """The frames in parts of so many rows at most."""
    for pdf in frames:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def usable(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Rows whose vector is there, finite and not zero."""
    whole = F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return vectors.filter(whole & F.coalesce(F.exists(vector_col, lambda x: x != 0), F.lit(False)))


def fit_cells(sample: np.ndarray, cells: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means; cells that lose all members are drawn anew from the worst-served vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        best, near = np.zeros(len(sample), int), np.zeros(len(sample))
        for at in range(0, len(sample), 4096):
            product = sample[at : at + 4096] @ centres.T
            best[at : at + 4096], near[at : at + 4096] = product.argmax(1), product.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, sample)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-12
        sums[empty] = sample[np.argsort(near)[: empty.sum()]]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def build(points: DataFrame, path: str, *, id_col: str = "point_id", vector_col: str = "vector", cells: int | None = None, block: int = BLOCK, sample: int = SAMPLE, quantile: float = 0.99) -> None:
    """Writes the index of points. cells: 2 * sqrt(points), MOST_CELLS at most, if not given."""
    spark = points.sparkSession
    own = usable(points.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")))
    held = scratch.written(own, "vectors")
    stats = held.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if not stats["n"]:
        raise ValueError("no vector that can be indexed")
    if stats["least"] != stats["most"]:
        raise ValueError(f"vectors of {stats['least']} and of {stats['most']} components")
    # The sample is the rows of the smallest hashes: bounded, and the same however the table is dealt.
    drawn = held.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toPandas()
    centres = fit_cells(_units(drawn["vector"]), min(cells or int(2 * np.sqrt(stats["n"])) or 1, MOST_CELLS))
    fields = f"id {dict(own.dtypes)['id']}, vector {dict(own.dtypes)['vector']}"

    def assign(batches: Iterable):
        for pdf in _slices(batches, VECTORS_AT_ONCE):
            unit = _units(pdf["vector"])
            product = unit @ centres.T
            yield pdf.assign(cell=product.argmax(1).astype(np.int32), near=product.max(1), unit=list(unit.astype(np.float32)))

    dealt = scratch.written(held.mapInPandas(assign, fields + ", cell int, near double, unit array<float>"), "assigned")
    scale = continuous_quantile(dealt.select(F.lit(1).alias("all"), F.explode("unit").alias("c")).withColumn("c", F.abs("c").cast("double")), "all", "c", quantile).first()["value"]
    members = dealt.groupBy("cell").agg(F.min("near").alias("reach"), F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>").join(members, "cell")
    table.coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([(float(scale),)], "scale double").coalesce(1).write.parquet(f"{path}/scale")
    code = F.transform("unit", lambda x: F.round(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x / F.lit(float(scale)) * 127))).cast("tinyint"))
    rows = dealt.join(members.select("cell", "blocks"), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select("cell", "block", "id", code.alias("code"), "vector").repartition("cell", "block").sortWithinPartitions("cell", "block")
    rows.write.partitionBy("cell").parquet(f"{path}/points")
    scratch.discard(held, dealt)


class Index:
    """An index that `build` wrote. Its centroids are bounded by MOST_CELLS and held here."""

    def __init__(self, spark: SparkSession, path: str):
        self.points = spark.read.parquet(f"{path}/points")
        rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
        self.names = np.array([r["cell"] for r in rows], np.int32)
        self.centres = np.array([r["centroid"] for r in rows])
        self.reach, self.blocks = np.array([r["reach"] for r in rows]), np.array([r["blocks"] for r in rows])
        self.n = np.array([r["n"] for r in rows])

    def probed(self, queries: DataFrame, probes: int | None, beyond: str | None = None) -> DataFrame:
        """query_id, vector, cell, block: the blocks of each query's `probes` nearest cells; with `beyond`, the column of a
        cosine to exceed, those of all further cells that could hold a member above it."""
        names, centres, blocks = self.names, self.centres, self.blocks
        angles = np.arccos(np.clip(self.reach, -1, 1))
        fields = ", ".join(f"`{n}` {t}" for n, t in queries.select("query_id", "vector").dtypes)

        def probe(batches: Iterable):
            import pandas as pd

            rows = max(1, FRAME_BYTES // (8 * centres.shape[1]))
            for pdf in _slices(batches, VECTORS_AT_ONCE):
                near = _units(pdf["vector"]) @ centres.T
                order = np.argsort(-near, axis=1, kind="stable")
                place = np.argsort(order, axis=1, kind="stable")
                if beyond is None:
                    chosen = place < probes
                else:
                    bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - angles, 0))
                    chosen = (place >= probes) & (bound >= pdf[beyond].to_numpy(float)[:, None] - SLACK)
                row, cell = np.nonzero(chosen)
                each = blocks[cell]
                row, cell = np.repeat(row, each), np.repeat(cell, each)
                block = np.arange(len(cell)) - np.repeat(np.cumsum(each) - each, each)
                ids, vectors = pdf["query_id"].to_numpy(), pdf["vector"].to_numpy()
                # A query may probe every block there is: its vector is repeated in frames of bounded size.
                for cut in (slice(at, at + rows) for at in range(0, len(row), rows)):
                    yield pd.DataFrame({"query_id": ids[row[cut]], "vector": vectors[row[cut]], "cell": names[cell[cut]], "block": block[cut].astype(np.int32)})

        columns = ["query_id", "vector"] + ([beyond] if beyond else [])
        return queries.select(*columns).mapInPandas(probe, fields + ", cell int, block int")

    def meeting(self, probes: DataFrame, column: str):
        """The probed blocks with that column, and the queries, both grouped by block and by share of the block's queries:
        one share for every QUERIES_AT_ONCE, so a cell that many queries probe is met in bounded groups."""
        cells = [r["cell"] for r in probes.select("cell").distinct().collect()]  # MOST_CELLS at most
        # Cells are folders: those that no query probes are no part of the scan.
        points = self.points.filter(F.col("cell").isin(cells)).select("cell", "block", "id", column)
        asked = probes.groupBy("cell", "block").agg(F.count("*").alias("asked"))
        share = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("asked") / QUERIES_AT_ONCE))
        queries = probes.join(asked, ["cell", "block"]).withColumn("share", share).drop("asked")
        shares = queries.select(F.col("cell").alias("at_cell"), F.col("block").alias("at_block"), F.col("share").alias("at_share")).distinct()
        dealt = points.join(shares, (F.col("cell") == F.col("at_cell")) & (F.col("block") == F.col("at_block"))).drop("at_cell", "at_block")
        return dealt.groupBy("cell", "block", "at_share"), queries.groupBy("cell", "block", "share")

    def by_code(self, probes: DataFrame, keep: int, skip_self: bool) -> DataFrame:
        """query_id, id, cell: `keep` points of each query by the product of codes and query."""
        points, queries = self.meeting(probes, "code")
        schema = f"query_id {dict(probes.dtypes)['query_id']}, id {dict(self.points.dtypes)['id']}, cell int, rough double"

        def best(low, up):
            import pandas as pd

            if not len(low) or not len(up):
                return pd.DataFrame({"query_id": [], "id": [], "cell": [], "rough": []})
            codes = np.stack(low["code"].to_numpy()).astype(np.float32)
            rough = _units(up["vector"]).astype(np.float32) @ codes.T
            ids, asking = low["id"].to_numpy(), up["query_id"].to_numpy()
            if skip_self:
                rough[asking[:, None] == ids[None, :]] = -np.inf
            top = np.argpartition(-rough, min(keep, rough.shape[1]) - 1, axis=1)[:, :keep]
            score = np.take_along_axis(rough, top, 1).ravel()
            use = score > -np.inf
            return pd.DataFrame({"query_id": np.repeat(asking, top.shape[1])[use], "id": ids[top.ravel()][use], "cell": np.int32(low["cell"].iat[0]), "rough": score[use].astype(float)})

        found = points.cogroup(queries).applyInPandas(best, schema)
        first = W.partitionBy("query_id").orderBy(F.desc("rough"), "id")
        return found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= keep).select("query_id", "id", "cell")

    def rescored(self, hits: DataFrame, queries: DataFrame) -> DataFrame:
        """hits (query_id, id, cell) with score: the cosine of the vectors as they were given."""
        from heronry.functions import scores as S

        cells = [r["cell"] for r in hits.select("cell").distinct().collect()]
        points = self.points.filter(F.col("cell").isin(cells)).select("cell", "id", F.col("vector").alias("own"))
        both = hits.join(points, ["cell", "id"]).join(queries.select("query_id", "vector"), "query_id")
        return both.select("query_id", "id", S.cosine(F.col("vector"), F.col("own")).alias("score"))

    def topk(self, queries: DataFrame, k: int = 10, *, probes: int | None = None, first: int = 8, refine: int = REFINE, skip_self: bool = False, id_col: str = "point_id") -> DataFrame:
        """query_id, rank, id, score: k points of each query (query_id, vector), ties to the smaller id.

        probes: cells a query; None gives the exact k best, by a first search of `first` cells and a second one, without
        codes, of every cell that can hold a better point. A query without a usable vector has no rows.
        """
        queries = scratch.written(usable(queries.select("query_id", "vector")), "queries")
        ranked = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
        near = scratch.written(self.probed(queries, probes or first), "probes")
        hits = scratch.written(self.by_code(near, refine * k, skip_self), "hits")
        scored = self.rescored(hits, queries)
        used = [queries, near, hits]
        if probes is None:
            kth = scored.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") == k).select("query_id", F.col("score").alias("least"))
            asked = scratch.written(queries.join(kth, "query_id", "left").fillna(-1.0, ["least"]), "asked")
            # The cells of the first search again, whole this time: codes may have misplaced a point.
            again = near.join(asked.select("query_id", "least"), "query_id").select("query_id", "vector", "cell", "block")
            further = self.probed(asked, first, "least").unionByName(again)
            scored = self.compared(scratch.carrying(further, asked), k, skip_self)
            used.append(asked)
        out = scored.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        return scratch.carrying(out.select("query_id", "rank", F.col("id").alias(id_col), "score"), *used)

    def compared(self, probes: DataFrame, k: int, skip_self: bool) -> DataFrame:
        """query_id, id, score: the k best of each block that a query probes, by the vectors as they were given."""
        probes = scratch.written(probes, "further")
        points, queries = self.meeting(probes, "vector")
        schema = f"query_id {dict(probes.dtypes)['query_id']}, id {dict(self.points.dtypes)['id']}, score double"

        def best(low, up):
            import pandas as pd

            if not len(low) or not len(up):
                return pd.DataFrame({"query_id": [], "id": [], "score": []})
            ids, asking = low["id"].to_numpy(), up["query_id"].to_numpy()
            score = _units(up["vector"]) @ _units(low["vector"]).T
            if skip_self:
                score[asking[:, None] == ids[None, :]] = -np.inf
            rows, scores, names = [], [], []
            for q, own in zip(asking, score, strict=True):
                use = np.flatnonzero(own > -np.inf)
                if len(use) > k:  # all that tie with the k-th stay until ids decide
                    use = use[np.round(own[use], 12) >= np.round(np.partition(own[use], -k)[-k], 12)]
                top = use[np.lexsort((ids[use], -np.round(own[use], 12)))][:k]
                rows.append(np.repeat(q, len(top)))
                names.append(ids[top])
                scores.append(own[top])
            return pd.DataFrame({"query_id": np.concatenate(rows), "id": np.concatenate(names), "score": np.concatenate(scores)})

        found = points.cogroup(queries).applyInPandas(best, schema)
        return scratch.carrying(found, probes)
