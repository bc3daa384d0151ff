"""Retrieval scorecards: ranks of the first acceptable hit, hit rates, reciprocal ranks, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.functions import scores as S
from heronry.operators import order_stats

TARGETS = {"hit_1": 0.75, "hit_3": 0.85, "hit_5": 0.90, "mrr": 0.80, "avg_top_score": 0.70}


def evaluate_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """cases (query_id, category, acceptable, latency_ms), hits (query_id, rank, title, score): a row a case."""
    both = cases.join(hits.select("query_id", "rank", "title", "score"), "query_id", "left")
    match = F.when(S.title_matches(F.col("title"), F.col("acceptable")), F.col("rank"))
    out = both.groupBy("query_id", "category", "latency_ms").agg(F.min(match).alias("rank"), F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))), F.lit(0.0)).alias("top_score"))
    return with_hits(out)


def with_hits(results: DataFrame) -> DataFrame:
    hits = {f"hit_{k}": F.coalesce(F.col("rank") <= k, F.lit(False)) for k in (1, 3, 5)}
    return results.withColumns(hits | {"reciprocal_rank": F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))})


def _measures() -> list:
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_rate")
    return [F.count("*").alias("n"), rate("hit_1"), rate("hit_3"), rate("hit_5"), F.avg("reciprocal_rank").alias("mrr"), F.avg("top_score").alias("avg_top_score")]


def scorecard(results: DataFrame) -> DataFrame:
    """One row; percentiles by refined histograms, so no task holds all latencies."""
    card = results.agg(*_measures(), F.avg("latency_ms").alias("avg_latency"), F.min("latency_ms").alias("min_latency"), F.max("latency_ms").alias("max_latency"))
    tiles = latency_percentiles(results.select(F.lit(1).alias("all"), "latency_ms"), "all", "latency_ms").select("p50", "p95")
    return card.join(tiles, F.lit(True), "left")


def scorecard_by_category(results: DataFrame) -> DataFrame:
    """A row a category and, as category null, one over all: one pass with rollup."""
    return results.rollup("category").agg(*_measures())


def latency_percentiles(values: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, p50 and p95 by the index rule; groups of any size, none of which is gathered."""
    return order_stats.at_ranks(values, group, value, {"p50": order_stats.index_quantile(0.5), "p95": order_stats.index_quantile(0.95)})


def markdown_report(card: DataFrame, categories: DataFrame, results: DataFrame) -> str:
    """The three tables as Markdown; for the bounded result of one evaluation."""

    def shown(df: DataFrame) -> str:
        cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
        rows = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in df.collect()]]
        return "\n".join("| " + " | ".join(r) + " |" for r in rows)

    parts = (("Scorecard", card), ("By category", categories.orderBy("category")), ("Queries", results.orderBy("query_id")))
    return "# Retrieval report\n\n" + "\n\n".join(f"## {name}\n\n{shown(df)}" for name, df in parts) + "\n"
