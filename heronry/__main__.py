"""Command line: python -m heronry TABLE stats | add TARGET | ingest-dump FILE [MAX] | search WORDS | ask WORDS |
copy FOLDER | transfer FOLDER (goes on after a stop) | eval CASES (JSON lines of query_id, query, category, acceptable) | ingest-multistream FILE CHECKPOINT | fetch FILE | wiki FILE (lines of addresses or titles). Words after the table that are no command are searched. --hybrid and --rerank go with search, ask and eval."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from heronry.operators import store
from heronry.operators.transfer import Transfer
from heronry.sources import readers
from heronry.streaming import ingest
from heronry.tools import Library, search_flags


def main(words: list[str], library: Library | None = None) -> str:
    if len(words) < 2:
        return __doc__
    table, command, *rest = words
    library = library or Library(SparkSession.builder.appName("heronry").getOrCreate(), table)
    if command == "stats":
        return "\n".join(f"{k}: {v}" for k, v in library.stats().items())
    if command == "add" and rest:
        kind, found = library.add(" ".join(rest))
        return f"not found; near it: {', '.join(found)}" if isinstance(found, list) else f"{kind}: {found} chunks"
    if command == "ingest-dump" and rest:
        most = int(rest[1]) if len(rest) > 1 and rest[1].isdigit() else None
        return f"{library.index(readers.read_dump(library.spark, rest[0], most))} chunks"
    if command == "ingest-multistream" and len(rest) > 1:
        return f"{ingest.index_dump(library.spark, rest[0], table, rest[1], embedder=library.embedder)} ranges"
    if command in ("fetch", "wiki") and rest:
        return f"{library.index(library.remote(library.spark.read.text(rest[0]).filter('trim(value) <> \'\''), articles=command == 'wiki'))} chunks"
    if command == "copy" and rest:
        return str(store.transfer(library.points(), rest[0]))
    if command == "transfer" and rest:
        return str(Transfer(library.points(), rest[0]).finish())
    if command == "eval" and rest:
        file, hybrid, rerank = search_flags(rest)
        return library.evaluate(library.spark.read.json(file), hybrid=hybrid, rerank=rerank)
    query, hybrid, rerank = search_flags(rest if command in ("search", "ask") else [command, *rest])
    return (library.ask if command == "ask" else library.search)(query, hybrid=hybrid, rerank=rerank)


if __name__ == "__main__":
    print(main(sys.argv[1:]))
