"""What is made of hits: context blocks, citations, prompts, result texts, and the guard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions import scores as S
from heronry.functions.text import strip

GUARD = 0.40
REFUSAL = "The retrieved sources are not similar enough to the question to answer it."
INSTRUCTION = "Answer from the numbered sources below alone, cite them like [1], and say so if they do not hold the answer."


def label() -> Column:
    return F.when(F.coalesce("breadcrumb", F.lit("")) != "", F.col("breadcrumb")).otherwise(F.coalesce("title", F.lit("Unknown")))


def _joined(part: Column, between: str, name: str) -> Column:
    """Parts of a group in order of rank."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), part.alias("part"))))
    return F.array_join(F.transform(ordered, lambda x: x["part"]), between).alias(name)


def context_blocks(hits: DataFrame) -> DataFrame:
    """query_id, context, sources: array of struct(index, title, url, score)."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), label(), F.lit(" ("), F.coalesce("url", F.lit("")), F.lit(")\n"), strip(F.coalesce("text", F.lit(""))))
    sources = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("index"), label().alias("title"), "url", "score")))
    return hits.groupBy("query_id").agg(_joined(part, "\n\n", "context"), sources.alias("sources"))


def result_texts(hits: DataFrame) -> DataFrame:
    """query_id, result: the hits as numbered text with scores of four digits."""
    part = F.concat(F.format_string("[%d] %s (Score: %.4f)\nURL: %s\n", "rank", label(), F.coalesce("score", F.lit(0.0)), F.coalesce("url", F.lit(""))), F.coalesce("text", F.lit("")), F.lit("\n"))
    return hits.groupBy("query_id").agg(_joined(part, "\n---\n", "result"))


def guarded(hits: DataFrame, threshold: float = GUARD) -> DataFrame:
    """query_id, top_score, answerable, message. Scores must be similarities; fused ranks never reach 0.4."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("top_score"))
    answerable = F.coalesce(F.col("top_score") >= threshold, F.lit(False))
    return best.select("query_id", "top_score", answerable.alias("answerable"), F.when(~answerable, F.lit(REFUSAL)).alias("message"), S.band(F.col("top_score")).alias("band"))


def prompts(contexts: DataFrame, queries: DataFrame) -> DataFrame:
    prompt = F.concat(F.lit(INSTRUCTION + "\n\nContext:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query"))
    return contexts.join(queries, "query_id").select("query_id", prompt.alias("prompt"))


def stream_answer(prompt: str, generate: Callable[[str], Iterator[str]]) -> Iterator[str]:
    """Tokens of an answer from any generator; runs on the driver, one question at a time."""
    yield from generate(prompt)


def choose_model(installed: list[str], preferred: tuple[str, ...]) -> str | None:
    """The first preferred model of which an installed name starts with it, or else the first installed."""
    return next((m for p in preferred for m in installed if m.startswith(p)), installed[0] if installed else None)
