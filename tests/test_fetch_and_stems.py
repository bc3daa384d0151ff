"""Fetching by host and the two origins; stems against a plain version and goldens."""

import json
import re
import zlib

import pytest
from pyspark.sql import functions as F

from heronry.functions import stems
from heronry.operators import search
from heronry.plans import catalogue
from heronry.sources import fetch, readers
from heronry.tools import Library

GOLDEN = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "formaliti": "formal", "sensitiviti": "sensit", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "homologous": "homolog", "effective": "effect",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "yes": "ye", "at": "at", "a1s": "a1s", "generalizations": "gener",
    "oscillators": "oscil",
}


def test_stems_of_goldens(spark):
    words = spark.createDataFrame([(w, w) for w in GOLDEN], "word string, stem string")
    assert {r["word"]: r["stem"] for r in stems.stemmed(words, "stem").collect()} == GOLDEN


def test_bm25_with_stems_and_stop_words(spark):
    docs = spark.createDataFrame([(1, "The cats were running."), (2, "A cat runs"), (3, "the and of"), (4, None)], "point_id long, text string")
    asked = spark.createDataFrame([(9, "running cat"), (8, "the")], "query_id long, query string")
    ids = lambda **how: {(r["query_id"], r["point_id"]) for r in search.bm25_scores(docs, asked, **how).collect()}
    assert ids() == {(9, 1), (9, 2), (8, 1), (8, 3)}
    assert ids(stop_words=stems.STOP_WORDS) == {(9, 1), (9, 2)}
    w = search.bm25_weights(docs, "point_id", "text", stems=True, stop_words=stems.STOP_WORDS).collect()
    assert {(r["point_id"], r["token"]) for r in w} == {(1, "cat"), (1, "run"), (2, "cat"), (2, "run")}
    assert len({round(r["weight"], 12) for r in w}) == 1  # two words each: stop words are not in the length


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def asked(urls):
    return [{"target": u, "urls": [u], "turn": 1, "url": u, "host": re.sub("/.*", "", u)} for u in urls]


def test_pace_of_hosts_and_pauses():
    clock, calls = Clock(), []

    def get(url):
        calls.append((clock.now, url))
        if url == "a/2" and sum(u == url for _, u in calls) < 3:
            raise OSError("busy")
        if url == "b/1":
            raise ValueError("no")
        return None if url == "a/3" else url

    found = {r["target"]: r for r in fetch._attempts(asked(["a/1", "a/2", "a/3", "b/1", "b/2"]), get, gap=2.0, tries=3, pause=1.0, clock=clock, sleep=clock.sleep)}
    assert {u: (r["status"], r["attempts"], r["body"]) for u, r in found.items()} == {
        "a/1": ("ok", 1, "a/1"), "a/2": ("ok", 3, "a/2"), "a/3": ("absent", 1, None), "b/1": ("failed", 3, None), "b/2": ("ok", 1, "b/2"),
    }
    assert found["b/1"]["error"] == "ValueError: no"
    for host in "ab":
        times = [t for t, u in calls if u[0] == host]
        assert all(b - a >= 2.0 for a, b in zip(times, times[1:], strict=False))
    assert sorted(calls)[0][0] == sorted(calls)[1][0] == 0.0  # two hosts at once, neither waits for the other


def test_origins_in_order_and_rows_without(spark):
    rows = [("x", ["http://one/x", "http://two/x"]), ("y", ["http://one/y", "http://two/y"]), ("z", ["http://one/z", "http://two/z"]), ("n", None), ("e", [None]), ("x", ["http://one/x", "http://two/x"])]

    def get(url):
        if url in ("http://one/y", "http://two/z"):
            return None
        if url == "http://one/z":
            raise OSError("down")
        return url

    targets = spark.createDataFrame(rows, "target string, urls array<string>")
    found = fetch.fetched(targets, get, rate=None, lanes=3, pause=0.0)
    got = {r["target"]: (r["status"], r["turn"], r["body"], r["attempts"]) for r in found.collect()}
    assert found.count() == 5
    assert got == {
        "x": ("ok", 1, "http://one/x", 1), "y": ("ok", 2, "http://two/y", 1), "z": ("absent", 2, None, 1), "n": ("no_origin", None, None, None),
        "e": ("no_origin", None, None, None),
    }
    assert fetch.fetched(targets.limit(0), get).count() == 0


def test_hosts_spread_over_tasks(spark):
    def get(url):
        from pyspark import TaskContext

        return str(TaskContext.get().partitionId())

    rows = [(f"{h}/{i}", [f"http://h{h}/{i}"]) for h in range(12) for i in range(5)]
    found = fetch.fetched(spark.createDataFrame(rows, "target string, urls array<string>"), get, rate=None, tasks=6).collect()
    tasks = {}
    for r in found:
        tasks.setdefault(r["target"].split("/")[0], set()).add(r["body"])
    assert all(len(t) == 1 for t in tasks.values()) and len({t for s in tasks.values() for t in s}) > 1


def answer(page, title, text):
    return json.dumps({"query": {"pages": {page: {"title": title, "extract": text}}}})


def encyclopedia(url):
    simple = url.startswith("https://simple.")
    if url.endswith("titles=The%20Moon%20%26%20co"):
        return answer("7", "The Moon & co", " It goes round. ") if simple else answer("8", "wrong", "wrong")
    if url.endswith("titles=Rare"):
        return answer("-1", "Rare", "") if simple else answer("9", "Rare thing", "Seldom seen, but long enough to be kept.")
    return answer("-1", "none", "")


def test_articles_of_two_encyclopedias(spark, tmp_path):
    titles = spark.createDataFrame([("The Moon & co",), ("Rare",), ("Nowhere",)], "title string")
    assert [u for t in ("The Moon & co",) for u in fetch.article_urls(t)] == fetch.article_targets(titles.limit(1)).first()["urls"]
    docs = readers.article_documents(fetch.fetched(fetch.article_targets(titles), fetch.article_body(encyclopedia), rate=None))
    assert sorted((r["page_id"], r["title"], r["url"], r["text"]) for r in docs.collect()) == [
        ("7", "The Moon & co", "https://simple.wikipedia.org/wiki/The_Moon_&_co", "It goes round."),
        ("9", "Rare thing", "https://en.wikipedia.org/wiki/Rare_thing", "Seldom seen, but long enough to be kept."),
    ]
    lib = Library(spark, f"{tmp_path}/t", get=encyclopedia)
    assert lib.add("Rare")[0] == "wiki" and lib.add("Nowhere")[0] in ("not_found", "suggestions")
    assert lib.remote(titles, articles=True, rate=None).count() == 2


def test_remote_pages_and_failures(spark, tmp_path):
    def get(url):
        if url.endswith("bad"):
            raise OSError("gone")
        return f"<html><title>T</title><p>{url}</p></html>"

    lib = Library(spark, f"{tmp_path}/t", get=get)
    docs = lib.remote(spark.createDataFrame([("http://a/1 ",), ("http://a/bad",)], "value string"), rate=None, pause=0.0).collect()
    assert [(r["url"], r["title"]) for r in docs] == [("http://a/1", "T")] and "http://a/1" in docs[0]["text"]
    pages = {r["url"]: r["html"] for r in readers.fetch_pages(["http://a/1", "http://a/bad"], get, spark, rate=None, pause=0.0).collect()}
    assert pages["http://a/bad"] is None and "<title>" in pages["http://a/1"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_registered_fetch(spark, sf):
    rows = catalogue.fetch_two_origins(spark, sf).collect()
    ids = [str(r[0]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").distinct().collect()]
    assert sorted(r["target"] for r in rows) == sorted(ids)
    for r in rows:
        second = zlib.crc32(f"https://first.example/{r['target']}".encode()) % 4 < 2
        assert (r["turn"], r["status"], r["attempts"]) == (2 if second else 1, "ok", 1)
        assert r["n_body"] == len(f"body of {r['url']}")
