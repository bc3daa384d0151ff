"""A persistent inverted index with impact-ordered blocks, and exact top-k search that reads only some of them.

Layout, below one folder:

- `postings`: a row a block: token, tier, piece, top (the block's largest weight), ids and weights. A token's postings are
  numbered by falling weight; tier j holds the FIRST * 2**j after those of earlier tiers, in pieces of at most PIECE.
- `tiers`: token, tier, top, n: what a search plans with; about log2(n) rows a token.
- `weights`: id, token, weight, by which single documents are scored whole.

Search is exact, for a score that is the sum over shared tokens of the product of both weights:

1. The lists of a query's rarest tokens give candidates; the k-th best of their whole scores is a threshold that the
   k-th best of all documents can only exceed.
2. Let c be a cut for each token with sum(query weight * c) below the threshold. A document whose weight is at most c in
   each of its tokens cannot enter the top k, so only tiers above their token's cut are read. Cuts are chosen so that
   they spare the most postings: tiers are given up from the lowest on, those that cost least for what they hold first.
3. Read postings are summed by document: a bound from below, of which the k-th best may raise the threshold. With every
   token that was not read at its cut it is a bound from above; documents below the threshold by it are dropped, the
   others are scored whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronry import scratch
from heronry.operators import search
from heronry.operators.numbering import numbered

#: Postings in a token's first tier; the most in one row.
FIRST, PIECE = 64, 4096
#: For a query's threshold: postings that are read (the first tier of its rarest token always), and candidates that are
#: scored whole, as a multiple of k.
TRIED_POSTINGS, TRIED = 8192, 4
#: The part of the threshold that cuts may use up. What they leave is what tells read documents apart.
SPEND = 0.3
#: Bounds keep documents that rounding could put below the threshold.
SLACK = 1e-6


def build(weights: DataFrame, path: str, id_col: str = "point_id") -> None:
    """Writes the index of weights (id, token, weight; an id has a token once)."""
    spark, how = weights.sparkSession, {"compression": "zstd"}
    with scratch.freed_shuffles(spark):
        weights.select(F.col(id_col).alias("id"), "token", "weight").write.options(**how).parquet(f"{path}/weights")
        n = numbered(spark.read.parquet(f"{path}/weights"), [F.desc("weight"), "id"], group=("token",))
        rows = n.withColumn("tier", F.floor(F.log2(F.col("n") / FIRST + 1)).cast("int")).withColumn("piece", F.floor(F.col("n") / PIECE))
        own = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "id")))
        blocks = rows.groupBy("token", "tier", "piece").agg(F.max("weight").alias("top"), own.alias("own"))
        blocks = blocks.select("token", "tier", "piece", "top", F.col("own.id").alias("ids"), F.transform("own.w", lambda w: -w).alias("weights"))
        blocks.sortWithinPartitions("token", "tier").write.options(**how).parquet(f"{path}/postings")
        scratch.discard(n)
        held = spark.read.parquet(f"{path}/postings")
        held.groupBy("token", "tier").agg(F.max("top").alias("top"), F.sum(F.size("ids")).alias("n")).write.parquet(f"{path}/tiers")


class Index:
    """An index that `build` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings, self.tiers, self.weights = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "tiers", "weights"))

    def read(self, wanted: DataFrame) -> DataFrame:
        """query_id, id, token, part (the product of both weights) of the tiers wanted: query_id, token, tier, q_weight."""
        blocks = self.postings.join(wanted, ["token", "tier"])
        rows = blocks.select("query_id", "token", "q_weight", F.explode(F.arrays_zip("ids", "weights")).alias("p"))
        return rows.select("query_id", F.col("p.ids").alias("id"), "token", (F.col("p.weights") * F.col("q_weight")).alias("part"))

    def scored(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """pairs (query_id, id) with their whole score. queries: query_id, token, q_weight."""
        own = pairs.join(queries, "query_id").join(self.weights, ["id", "token"])
        return own.groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("score"))

    def thresholds(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, least: the k-th best whole score among candidates of the rarest tokens; none where fewer were found."""
        rows = queries.join(self.tiers, "token").withColumn("held", F.sum("n").over(W.partitionBy("query_id", "token")))
        rarest = W.partitionBy("query_id").orderBy("held", "token", "tier").rowsBetween(W.unboundedPreceding, W.currentRow)
        wanted = rows.withColumn("upto", F.sum("n").over(rarest)).filter((F.col("upto") <= TRIED_POSTINGS) | (F.col("upto") == F.col("n")))
        first = self.read(wanted.select("query_id", "token", "tier", "q_weight")).groupBy("query_id", "id").agg(F.sum("part").alias("part"))
        by_part = W.partitionBy("query_id").orderBy(F.desc("part"), "id")
        some = first.withColumn("r", F.row_number().over(by_part)).filter(F.col("r") <= TRIED * k).select("query_id", "id")
        by_score = W.partitionBy("query_id").orderBy(F.desc("score"))
        kth = self.scored(some, queries).withColumn("r", F.row_number().over(by_score)).filter(F.col("r") == k)
        return kth.select("query_id", F.col("score").alias("least"))

    def planned(self, queries: DataFrame, least: DataFrame) -> DataFrame:
        """query_id, token, tier, q_weight, cut, n, used: the tiers to read, each token's cut times its query weight, and
        the sum of all cuts of the query."""
        rows = queries.join(self.tiers, "token").join(least, "query_id", "left").fillna(0.0, ["least"])
        rows = rows.withColumn("worth", F.col("q_weight") * F.col("top"))
        upward = W.partitionBy("query_id", "token").orderBy(F.desc("tier"))
        so_far = upward.rowsBetween(W.unboundedPreceding, W.currentRow)
        # What giving up this tier and all below costs, for each posting; never less than for those below it.
        rows = rows.withColumn("price", F.col("worth") / F.sum("n").over(so_far)).withColumn("price", F.max("price").over(so_far))
        rows = rows.withColumn("more", F.col("worth") - F.coalesce(F.lag("worth").over(upward), F.lit(0.0)))
        cheap = W.partitionBy("query_id").orderBy("price", "token", F.desc("tier")).rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = rows.withColumn("spent", F.sum("more").over(cheap))
        rows = rows.withColumn("spared", F.col("spent") < SPEND * F.col("least") - SLACK)
        token, query = W.partitionBy("query_id", "token"), W.partitionBy("query_id")
        rows = rows.withColumn("cut", F.coalesce(F.max(F.when(F.col("spared"), F.col("worth"))).over(token), F.lit(0.0)))
        rows = rows.withColumn("used", F.coalesce(F.sum(F.when(F.col("spared"), F.col("more"))).over(query), F.lit(0.0)))
        return rows.filter("NOT spared").select("query_id", "token", "tier", "q_weight", "cut", "n", "used", "least")

    def candidates(self, plan: DataFrame, k: int) -> DataFrame:
        """query_id, id of the documents that can reach their query's threshold."""
        cuts = plan.groupBy("query_id", "token").agg(F.first("cut").alias("cut"))
        limits = plan.groupBy("query_id").agg(F.max("used").alias("used"), F.max("least").alias("least"))
        rows = self.read(plan.select("query_id", "token", "tier", "q_weight")).join(cuts, ["query_id", "token"])
        found = rows.groupBy("query_id", "id").agg(F.sum("part").alias("part"), F.sum(F.col("part") - F.col("cut")).alias("above"))
        found = scratch.written(found, "found")
        by_part = W.partitionBy("query_id").orderBy(F.desc("part"))
        kth = found.withColumn("r", F.row_number().over(by_part)).filter(F.col("r") <= k).groupBy("query_id").agg(F.min(F.when(F.col("r") == k, F.col("part"))).alias("raised"))
        limits = limits.join(kth, "query_id").select("query_id", (F.greatest("least", F.coalesce("raised", F.lit(0.0))) - F.col("used") - SLACK).alias("limit"))
        return scratch.carrying(found.join(limits, "query_id").filter(F.col("above") >= F.col("limit")).select("query_id", "id"), found)

    def topk(self, queries: DataFrame, k: int = 10, id_col: str = "point_id") -> DataFrame:
        """query_id, rank, id, score: the k best of each query, ties to the smaller id. queries: query_id, token, q_weight.

        Of what is written between the steps the scratch tables can go (`scratch.discard`) when the result has been used.
        """
        queries = scratch.written(queries.select("query_id", "token", "q_weight"), "queries")
        plan = scratch.written(self.planned(queries, self.thresholds(queries, k)), "plan")
        found = self.candidates(plan, k)
        chosen = scratch.written(found, "candidates")
        scratch.discard(found)
        best = search.ranked(self.scored(chosen, queries).withColumnRenamed("id", "point_id"), k)
        return scratch.carrying(best.select("query_id", "rank", F.col("point_id").alias(id_col), "score"), queries, plan, chosen)
