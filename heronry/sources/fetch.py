"""Fetching as a Spark job: targets are dealt to tasks by host, so each host is asked at its own pace and hosts run side by side.

A target has one or more addresses (origins), tried in order: each round asks one address of all targets that have no body
yet, dealt by that address's host, and is written before the next, so a later failure repeats no earlier round. In a
round all rows of a host and lane are in one partition. A host of very many targets is split into lanes, each at its share
of the host's rate, so the rate holds while the rows of one host need no common task.

The getter is the caller's function from an address to a body. It returns None where the origin does not have the target (the
next origin is asked at once), and raises where the attempt failed (the same origin is asked again after a pause that doubles,
up to `tries` times). A failure is a row, never a failed job. A body is whole; tasks hand over rows by `batch_bytes`.

Defined results: a null or empty list of addresses, or null addresses only, gives a row with status no_origin; repeated targets
are fetched once if their addresses are equal too; an address without a host is a host of its own name ''; an empty table gives
an empty table. A task that is lost asks its addresses again.
"""

from __future__ import annotations

import heapq
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry import scratch

FETCHED = "target string, urls array<string>, turn int, url string, status string, body string, error string, attempts int"
_OUT = pa.schema([
    ("target", pa.string()), ("urls", pa.list_(pa.string())), ("turn", pa.int32()), ("url", pa.string()), ("status", pa.string()), ("body", pa.string()),
    ("error", pa.string()), ("attempts", pa.int32()),
])
#: Addresses that a task holds at a time: while one host rests, others are asked.
WINDOW = 512


def http_get(url: str, timeout: float = 15.0) -> str | None:
    """A getter over the network; None where the host says that the address does not exist."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "heronry/1"}), timeout=timeout) as answer:  # noqa: S310
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as error:
        if error.code in (404, 410):
            return None
        raise


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1))


def _attempts(rows: Iterator[dict], get: Callable, *, gap: float, tries: int, pause: float, clock=time.monotonic, sleep=time.sleep) -> Iterator[dict]:
    """The rows with status, body, error and attempts; at least gap seconds between two calls of one host."""
    free, waiting, order = {}, [], 0  # when a host may be asked next; (due, order, row, attempts so far)
    rows, more = iter(rows), True
    while True:
        while more and len(waiting) < WINDOW:
            row = next(rows, None)
            if row is None:
                more = False
            else:
                heapq.heappush(waiting, (0.0, order, row, 0))
                order += 1
        if not waiting:
            return
        due, n, row, done = heapq.heappop(waiting)
        now, ready = clock(), max(due, free.get(row["host"], 0.0))
        if ready > now:
            if waiting and waiting[0][0] < ready:  # another may be due sooner
                heapq.heappush(waiting, (ready, n, row, done))
                continue
            sleep(ready - now)
        free[row["host"]] = clock() + gap
        found = {"target": row["target"], "urls": row["urls"], "turn": row["turn"], "url": row["url"], "body": None, "error": None, "attempts": done + 1}
        try:
            body = get(row["url"])
        except Exception as error:  # noqa: BLE001 - any failure of one address is that address's
            if done + 1 < tries:
                heapq.heappush(waiting, (clock() + pause * 2**done, n, row, done + 1))
                continue
            yield found | {"status": "failed", "error": f"{type(error).__name__}: {error}"}
            continue
        yield found | ({"status": "absent"} if body is None else {"status": "ok", "body": body})


def _round(pending: DataFrame, get: Callable, *, rate: float | None, lanes: int, tries: int, pause: float, batch_bytes: int, tasks: int | None) -> DataFrame:
    gap = lanes / rate if rate else 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        held, size = [], 0
        for found in _attempts(rows, get, gap=gap, tries=tries, pause=pause):
            held.append(found)
            size += len(found["body"] or "") + 200
            if size >= batch_bytes:
                yield pa.RecordBatch.from_pylist(held, _OUT)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _OUT)

    # A number of tasks that is named stays as it is; small partitions would otherwise be joined to a few.
    spark = pending.sparkSession
    tasks = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lane = F.pmod(F.xxhash64("target", "urls"), F.lit(lanes))
    # Within a task hosts take turns, as rows stand by a hash.
    dealt = pending.withColumn("host", host_of(F.col("url"))).withColumn("lane", lane).repartition(tasks, "host", "lane").sortWithinPartitions(F.xxhash64("url"))
    return dealt.select("target", "urls", "turn", "url", "host").mapInArrow(work, FETCHED)


def fetched(
    targets: DataFrame, get: Callable[[str], str | None], *, rate: float | None = 1.0, lanes: int = 1, tries: int = 3, pause: float = 1.0, batch_bytes: int = 16_000_000,
    tasks: int | None = None,
) -> DataFrame:
    """targets: target, urls (addresses in order). A written table of FETCHED, one row a target: the first body found, or the
    last address's outcome. rate: calls of one host a second (None: no limit), shared by its lanes."""
    left = targets.select("target", F.array_compact(F.coalesce("urls", F.array().cast("array<string>"))).alias("urls")).distinct()
    left = scratch.written(left, "targets")
    most = left.agg(F.max(F.size("urls"))).first()[0] or 0
    none = left.filter(F.size("urls") == 0).select("target", "urls", F.lit(None).cast("int").alias("turn"), F.lit(None).cast("string").alias("url"), F.lit("no_origin").alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in (("body", "string"), ("error", "string"), ("attempts", "int"))))
    pending, rounds = left.filter(F.size("urls") > 0).withColumn("turn", F.lit(1)), []
    for turn in range(1, most + 1):
        asked = pending.select("target", "urls", F.lit(turn).alias("turn"), F.get("urls", F.lit(turn - 1)).alias("url"))
        rounds.append(scratch.written(_round(asked, get, rate=rate, lanes=lanes, tries=tries, pause=pause, batch_bytes=batch_bytes, tasks=tasks), "fetched"))
        pending = rounds[-1].filter((F.col("status") != "ok") & (F.size("urls") > turn)).select("target", "urls")
    done = [r.filter((F.col("status") == "ok") | (F.size("urls") == F.col("turn"))) for r in rounds]
    out = scratch.written(reduce(DataFrame.union, [none, *done]), "fetched")
    scratch.discard(left, *rounds)
    return out


def pages(found: DataFrame) -> DataFrame:
    """url, html of the pages that were found, as readers.web_documents takes them."""
    return found.filter("status = 'ok'").select("url", F.col("body").alias("html"))


#: The two encyclopedias in the order in which an article is looked for, and the query of a plain extract.
ORIGINS = ("https://simple.wikipedia.org", "https://en.wikipedia.org")
EXTRACT = "/w/api.php?action=query&prop=extracts&explaintext=1&format=json&redirects=1&titles="


def article_urls(title: str) -> list[str]:
    return [origin + EXTRACT + quote(title, safe="") for origin in ORIGINS]


def article_targets(titles: DataFrame) -> DataFrame:
    """target, urls of titles (a column title)."""
    address = F.url_encode("title")
    return titles.select(F.col("title").alias("target"), F.array(*(F.concat(F.lit(o + EXTRACT), F.replace(address, F.lit("+"), F.lit("%20"))) for o in ORIGINS)).alias("urls"))


def article_body(get: Callable[[str], str]) -> Callable[[str], str | None]:
    """A getter of articles: get's answer where it holds one with text, None where this origin has none."""
    def of(url: str) -> str | None:
        answer = get(url)
        held = (json.loads(answer).get("query") or {}).get("pages") or {}
        return answer if any(page != "-1" and (p.get("extract") or "").strip() for page, p in held.items()) else None

    return of
