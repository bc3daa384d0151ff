import bz2
import os
import uuid

import pytest
from pyspark.sql import functions as F

from heronry import schemas
from heronry.operators import answer, chunking, evaluate, search, store
from heronry.operators.bucketed import BucketTable
from heronry.sources import readers
from heronry.streaming import ingest

PAGE = "<page><title>{t}</title><ns>{ns}</ns><id>{i}</id>{r}<revision><text>{x}</text></revision></page>"
ARTICLE = "'''Alpha''' is a long article. " * 10


def dump(path, pages):
    body = "<mediawiki>" + "\n".join(PAGE.format(**p) for p in pages) + "</mediawiki>"
    with bz2.open(path, "wt") as f:
        f.write(body)


def page(i, t="A b", ns=0, r="", x=ARTICLE):
    return {"i": i, "t": t, "ns": ns, "r": r, "x": x}


def test_dump(spark, tmp_path):
    dump(f"{tmp_path}/d.xml.bz2", [page(1), page(2, ns=1), page(3, r='<redirect title="x"/>'), page(4, x="stub")])
    rows = readers.read_dump(spark, f"{tmp_path}/d.xml.bz2").collect()
    assert [(r["page_id"], r["url"]) for r in rows] == [("1", "https://simple.wikipedia.org/wiki/A_b")]
    assert rows[0]["text"].startswith("Alpha is")


def test_stream_is_idempotent_and_skips_unchanged(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    dump(f"{tmp_path}/in/a.xml.bz2", [page(1), page(2)])
    told = []
    run = lambda: ingest.index_stream(ingest.dump_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c", embedder=store.hashing_embedder(4), on_progress=lambda n, x: told.append((n, x["documents"], x["skipped"], x["chunks"]))).awaitTermination()
    run()
    run()
    dump(f"{tmp_path}/in/b.xml.bz2", [page(2, x=ARTICLE + " more"), page(3)])
    run()
    points = BucketTable(spark, f"{tmp_path}/t").read()
    assert sorted(r["doc_id"] for r in points.collect()) == ["1", "2", "3"]
    assert points.filter("doc_id = '2' AND text LIKE '%more'").count() == 1
    assert told == [(0, 2, 0, 2), (1, 2, 0, 2)]
    docs = points.limit(1).select(F.lit("77").alias("page_id"), "title", "url", F.lit("word " * 50).alias("text"), F.lit("text").alias("source_type"), F.lit("h").alias("content_hash"))
    first, again = (ingest.index_batch(f"{tmp_path}/t", docs, embedder=store.hashing_embedder(4)) for _ in range(2))
    assert (first["documents"], first["skipped"], first["chunks"]) == (1, 0, 1) and (again["documents"], again["skipped"], again["chunks"]) == (1, 1, 0)


def test_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/x/node_modules")
    for name, text in (("my_notes.txt", "hello"), ("r.md", "intro\n# Real Title\nbody"), ("s.py", "x = 1"), ("q.SQL", "select 1"), ("z.bin", "?"), ("node_modules/a.txt", "no")):
        with open(f"{tmp_path}/x/{name}", "w") as f:
            f.write(text)
    with open(f"{tmp_path}/x/latin.txt", "wb") as f:
        f.write(b"caf\xe9")
    docs = {r["url"].rsplit("/", 1)[1]: r for r in readers.text_documents(readers.walk(spark, f"{tmp_path}/x")).collect()}
    assert set(docs) == {"my_notes.txt", "r.md", "s.py", "q.SQL", "latin.txt"}
    assert (docs["my_notes.txt"]["title"], docs["my_notes.txt"]["text"]) == ("My Notes", "# Document: my_notes.txt\n\nhello")
    assert (docs["r.md"]["title"], docs["s.py"]["title"], docs["s.py"]["text"]) == ("Real Title", "s.py", "x = 1")
    assert docs["q.SQL"]["text"].startswith("# File: q.SQL") and docs["latin.txt"]["text"].endswith("café")
    assert docs["s.py"]["page_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"file://{tmp_path}/x/s.py"))
    assert readers.resolve(spark, f"{tmp_path}/x")[0] == "directory"
    with pytest.raises(ValueError):
        readers.resolve(spark, f"{tmp_path}/x/z.bin")


def test_tables(spark, tmp_path):
    with open(f"{tmp_path}/my_data.csv", "w") as f:
        f.write("a , b\n" + "".join(f"{i},x\n" for i in range(31)) + ",\n99\n")
    text = readers.read_table(spark, f"{tmp_path}/my_data.csv").first()["text"]
    assert text.startswith("# Dataset: My Data\n\nSchema: a, b\n\n\n## Rows 1–30\n\n| a | b |\n| --- | --- |\n| 0 | x |")
    assert "## Rows 31–32" in text and text.rstrip().endswith("| 99 |  |")
    open(f"{tmp_path}/none.csv", "w").close()
    assert readers.read_table(spark, f"{tmp_path}/none.csv").first()["text"] == "# Empty Table: None\n"


def test_upsert_and_orphans(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "point_id string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "point_id string, n int")
    once = store.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 4)] == sorted(map(tuple, store.upsert(once, new).collect()))
    assert store.direction(None, "cloud") == ("cloud", "local") and store.direction("l2c") == ("local", "cloud")
    assert store.direction(" To_Local ") == store.direction("local") == ("cloud", "local") and store.direction("cloud") == ("local", "cloud")
    assert store.capacity(10, 1 << 20)["fits"] is False
    with pytest.raises(ValueError):
        store.direction("sideways")


def test_hybrid_rank_defaults(spark):
    """15 dense hits and 10 others by title: these count as dense rank 25, not 35; BM25 reads titles and breadcrumbs."""
    rows = [(f"d{i:02d}", "x", "", "y") for i in range(15)] + [(f"l{i:02d}", "solar wind" if i else "", "" if i else "solar wind", "") for i in range(10)]
    points = spark.createDataFrame(rows, "point_id string, title string, breadcrumb string, text string")
    queries = spark.createDataFrame([("q", "solar wind")], "query_id string, query string")
    dense = spark.createDataFrame([("q", f"d{i:02d}", i + 1) for i in range(15)], "query_id string, point_id string, rank int")
    lexical = spark.createDataFrame([("q", f"l{i:02d}") for i in range(10)], "query_id string, point_id string")
    got = {r["point_id"]: r["score"] for r in search.hybrid_search(dense, lexical, points, queries, k=25).collect()}
    assert len(got) == 25
    assert got["d00"] == pytest.approx(0.6 / 61 + 0.4 / 71) and got["l00"] == pytest.approx(0.6 / 85 + 0.4 / 61) and got["l09"] == pytest.approx(0.6 / 85 + 0.4 / 70)


def test_ask(spark):
    rows = [(i, [float(i == j) + 0.1 for j in range(20)], f"title {i}", f"text {i}") for i in range(20)]
    points = spark.createDataFrame(rows, "point_id long, vector array<double>, title string, text string")
    queries = spark.createDataFrame([(7, "title 3", rows[3][1])], "query_id long, query string, vector array<double>")
    plain = search.ask(points, queries, 2).orderBy("rank").collect()
    assert [(r["rank"], r["point_id"]) for r in plain] == [(1, 3), (2, 0)] and plain[0]["text"] == "text 3" and plain[0]["score_kind"] == "cosine"
    assert search.ask(points, queries, 3, hybrid=True).filter("rank = 1").first()["point_id"] == 3
    again = search.ask(points, queries, 2, score_pairs=lambda qs, ts: [float(t.split()[1]) for t in ts]).orderBy("rank").collect()
    assert [r["point_id"] for r in again] == [14, 13] and again[0]["score_kind"] == "rerank"


def test_dense_topk_over_many_batches(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(500, 8)).round(1)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 500, 50)], "query_id long, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        rows = search.dense_topk(points, queries, 4, skip_self=False).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 500, 50):
        want = np.lexsort((np.arange(500), -np.round(u @ u[q], 12)))[:4].tolist()
        assert [r["point_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_store_copies_checks_and_drops_old_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "point_id string, n int")
    for _ in range(4):
        store.upsert_table(spark, f"{tmp_path}/t", rows)
    assert len([d for d in os.listdir(f"{tmp_path}/t") if d.startswith("v-")]) == 2
    with pytest.raises(ValueError):
        store.upsert_table(spark, f"{tmp_path}/t", rows.withColumn("n", F.col("n").cast("string")))
    assert store.transfer(rows, f"{tmp_path}/copy") == {"source": 2, "target": 2, "complete": True, "same": True}
    assert store.verify(rows, rows.limit(1))["complete"] is False


def test_folder_of_all_kinds(spark, tmp_path):
    os.makedirs(f"{tmp_path}/f")
    code = "# a comment that is no heading\nimport os\n\n\ndef f(a):\n    return os.path.join(a, 'b')\n"
    for name, text in (("t.csv", "a,b\n0,1\n5,6\n,\n7\n8,9,10\n"), ("x.txt", "hello " * 10), ("p.py", code), ("i.png", "bytes"), ("d.pdf", "bytes")):
        with open(f"{tmp_path}/f/{name}", "w") as f:
            f.write(text)
    kind, docs = readers.resolve(spark, f"{tmp_path}/f", extractors={"pdf": lambda content, path: "# Read\n\n" + "word " * 20})
    found = {r["url"].rsplit("/", 1)[1]: r for r in docs.collect()}
    assert kind == "directory" and set(found) == {"t.csv", "x.txt", "p.py", "i.png", "d.pdf"}
    table = "| a | b |\n| --- | --- |\n| 0 | 1 |\n| 5 | 6 |\n| 7 |  |\n| 8 | 9 |\n"
    assert found["t.csv"]["text"] == "# Dataset: T\n\nSchema: a, b\n\n\n## Rows 1–4\n\n" + table
    assert readers.table_text("", "Empty", ",") == "# Empty Table: Empty\n"
    assert readers.read_table(spark, f"{tmp_path}/f/t.csv").first()["text"] == found["t.csv"]["text"]
    chunks = chunking.chunk_sources(docs).collect()
    assert {r["breadcrumb"] for r in chunks if r["doc_id"] == found["p.py"]["page_id"]} == {"p.py > Module Preamble", "p.py > def f()"}
    assert any(r["text"].startswith("| a | b |") or "| 0 | 1 |" in r["text"] for r in chunks)


def test_suggestions_and_scanned_pages(spark):
    titles = spark.createDataFrame([("Solar wind",), ("Solar cell",), ("Moon",), ("Lunar",)], "title string")
    kind, rows = readers.resolve(spark, "solar wnd", article=lambda t: None, titles=titles)
    assert kind == "suggestions" and rows.first()["title"] == "Solar wind" and rows.count() == 3
    assert readers.resolve(spark, "nothing", article=lambda t: None) == ("not_found", None)
    pages = spark.createDataFrame([("p", "scan", 2, " two "), ("p", "scan", 1, "one"), ("p", "scan", 3, None)], "path string, title string, page int, text string")
    assert readers.scanned_pages(pages).first()["text"] == "# Scanned Document: scan\n\n## Page 1\n\none\n\n## Page 2\n\ntwo\n"


def test_guard_and_cards(spark):
    hits = spark.createDataFrame([("q", 1, 0.40), ("r", 1, 0.39)], "query_id string, rank int, score double")
    assert {r["query_id"]: r["answerable"] for r in answer.guarded(hits).collect()} == {"q": True, "r": False}
    results = evaluate.with_hits(spark.createDataFrame([("a", "x", 1, 0.9, 5.0), ("b", "x", None, 0.1, 1.0)], "query_id string, category string, rank int, top_score double, latency_ms double"))
    card = evaluate.scorecard(results).first()
    assert (card["mrr"], card["hit_1_rate"], card["p50"], card["p95"]) == (0.5, 0.5, 5.0, 5.0)
    assert evaluate.scorecard_by_category(results).count() == 2
    report = evaluate.markdown_report(evaluate.scorecard(results), evaluate.scorecard_by_category(results), results)
    assert report.startswith("# Retrieval report\n\n## Scorecard\n\n| n | hit_1_rate | hit_3_rate | hit_5_rate | mrr |")
    assert "| 2 | 0.5000 | 0.5000 | 0.5000 | 0.5000 | 0.5000 | 3.0000 | 1.0000 | 5.0000 | 5.0000 | 5.0000 |" in report


def test_dense_topk_edges(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0])], "point_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["rank"], r["point_id"]) for r in search.dense_topk(points, queries, 5).orderBy("rank").collect()] == [(1, 1), (2, 4)]
    assert search.dense_topk(points, queries.limit(0), 5).count() == 0
    assert len(schemas.CHUNK.split(", ")) == 9
    assert points.select(F.lit(1)).count() == 4
