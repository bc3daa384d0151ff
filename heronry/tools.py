"""One object for a folder of points: index documents, search, ask. What a console or a tool server calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry import schemas, scratch
from heronry.operators import answer, evaluate, search, store
from heronry.operators.bucketed import BucketTable
from heronry.sources import fetch, readers
from heronry.streaming import ingest

NOTHING = "Nothing that fits was found."


def search_flags(words: list[str]) -> tuple[str, bool, bool]:
    """(query, hybrid, rerank) of the words of a command."""
    # Spellings of the two flags.
    hybrid, rerank = {"--hybrid", "-h", "-H", "--hyb"}, {"--rerank", "-r", "--re-rank"}
    return " ".join(w for w in words if w not in hybrid | rerank), any(w in hybrid for w in words), any(w in rerank for w in words)


class Library:
    """The points below path. embedder makes a vector column of a text column; score_pairs re-ranks; generate makes an
    answer's pieces from a prompt; article fetches (title, text) of a title. Those that are missing are left out."""

    def __init__(
        self, spark: SparkSession, path: str, *, embedder: Callable | None = None, score_pairs: Callable | None = None,
        generate: Callable[[str], Iterator[str]] | None = None, article: Callable[[str], tuple[str, str] | None] | None = None,
        get: Callable[[str], str] | None = None, extractors: dict[str, Callable] | None = None,
    ):
        self.spark, self.path, self.embedder = spark, path, embedder or store.hashing_embedder()
        self.score_pairs, self.generate, self.article, self.get, self.extractors = score_pairs, generate, article, get, extractors

    def points(self) -> DataFrame:
        """The stored points; an empty table before anything is stored."""
        table = BucketTable(self.spark, self.path)
        return table.read() if table.version() else self.spark.createDataFrame([], schemas.POINT)

    def index(self, docs: DataFrame, *, skip_unchanged: bool = True) -> int:
        """Chunks and stores documents (schemas.DOCUMENT); returns how many chunks. Unchanged ones are passed over."""
        return ingest.index_batch(self.path, docs, embedder=self.embedder, skip_unchanged=skip_unchanged)["chunks"]

    def add(self, target: str) -> tuple[str, int | list[str]]:
        """Indexes a URL, a folder, a file or an article by its title: (kind, chunks), or titles that are near it."""
        titles = self.points().select("title")
        kind, docs = readers.resolve(self.spark, target, self.get, self.article, extractors=self.extractors, titles=titles)
        if kind == "suggestions":
            return kind, [r["title"] for r in docs.collect()]
        return kind, 0 if docs is None else self.index(docs)

    def remote(self, lines: DataFrame, *, articles: bool = False, **how) -> DataFrame:
        """Documents of the addresses, or of the articles by their titles, in the first column of lines; fetched by tasks
        at a rate a host (`fetch.fetched`). What was not found has no document."""
        name, get = F.trim(F.col(lines.columns[0])), self.get or fetch.http_get
        if articles:
            return readers.article_documents(fetch.fetched(fetch.article_targets(lines.select(name.alias("title"))), fetch.article_body(get), **how))
        targets = lines.select(name.alias("target"), F.array(name).alias("urls"))
        return readers.web_documents(fetch.pages(fetch.fetched(targets, get, **how)))

    def hits(self, query: str, k: int = 5, *, hybrid: bool = False, rerank: bool = False) -> DataFrame:
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string").withColumn("vector", self.embedder(F.col("query")))
        return search.ask(self.points(), asked, k, hybrid=hybrid, score_pairs=self.score_pairs if rerank else None)

    def search(self, query: str, k: int = 3, **how) -> str:
        """The hits as numbered text."""
        found = answer.result_texts(self.hits(query, k, **how)).first()
        return found["result"] if found else NOTHING

    def ask(self, question: str, k: int = 4, **how) -> str:
        """A cited answer, or a refusal where no hit is near enough. Fused ranks are not similarities: there the guard
        asks the nearest hit's cosine."""
        hits = self.hits(question, k, **how).cache()
        near = hits if not how.get("hybrid") or how.get("rerank") else self.hits(question, 1)
        best = answer.guarded(near).first()
        if best is None or not best["answerable"] or self.generate is None:
            return answer.REFUSAL if best is None or not best["answerable"] else answer.result_texts(hits).first()["result"]
        context = answer.context_blocks(hits)
        asked = self.spark.createDataFrame([(0, question)], "query_id long, query string")
        prompt = answer.prompts(context.select("query_id", "context"), asked).first()["prompt"]
        sources = context.first()["sources"]
        cited = "\n".join(f"[{s['index']}] {s['title']} - {s['url']}" for s in sources)
        return "".join(answer.stream_answer(prompt, self.generate)) + "\n\nSources:\n" + cited

    def evaluate(self, cases: DataFrame, k: int = 5, *, hybrid: bool = False, rerank: bool = False) -> str:
        """Runs cases (query_id, query, category, acceptable: titles) as one search and returns the report as Markdown.

        A case's latency is its share of the search's time, as all cases are searched together.
        """
        held = scratch.written(cases.select("query_id", "query", "category", "acceptable"), "cases")
        n, start = held.count(), time.time()
        asked = held.select("query_id", "query").withColumn("vector", self.embedder(F.col("query")))
        found = search.ask(self.points(), asked, k, hybrid=hybrid, score_pairs=self.score_pairs if rerank else None)
        hits = scratch.written(found.select("query_id", "rank", "title", "score"), "hits")
        latency = (time.time() - start) * 1000 / max(n, 1)
        results = scratch.written(evaluate.evaluate_cases(held.withColumn("latency_ms", F.lit(latency)), hits), "results")
        card = evaluate.scorecard(results)
        report = evaluate.markdown_report(card, evaluate.scorecard_by_category(results), results)
        scratch.discard(held, hits, results)
        return report

    def stats(self) -> dict:
        return store.stats(self.points()).first().asDict()
