import json

import pytest

from heronry.__main__ import main
from heronry.operators import search, store
from heronry.sources.download import download
from heronry.tools import NOTHING, Library, search_flags


def documents(spark, texts):
    rows = [(t, t.title(), f"u/{t}", x, "wiki", x[:9]) for t, x in texts.items()]
    return spark.createDataFrame(rows, "page_id string, title string, url string, text string, source_type string, content_hash string")


def test_library(spark, tmp_path):
    lib = Library(spark, f"{tmp_path}/t", generate=lambda prompt: iter(["Yes ", "[1]"]), article=lambda t: ("Comet", "comet tail ice dust orbit sun far") if t == "comet" else None)
    assert lib.search("anything") == NOTHING and lib.stats()["points_count"] == 0
    docs = documents(spark, {"wind": "solar wind streams from the sun", "bread": "bread is baked from flour and water"})
    assert lib.index(docs) == 2 and lib.index(docs) == 0
    assert lib.search("solar wind streams from the sun", 1).startswith("[1] Wind (Score:") and "u/wind" in lib.search("solar wind sun", 1)
    assert lib.ask("solar wind streams from the sun").startswith("Yes [1]\n\nSources:\n[1] Wind - u/wind")
    assert lib.ask("zebra") == "The retrieved sources are not similar enough to the question to answer it."
    assert lib.add("comet") == ("wiki", 1) and lib.add("Win") == ("suggestions", ["Wind", "Bread", "Comet"])
    assert main(["t", "stats"], lib).startswith("points_count: 3")
    assert main(["t", "search", "bread", "flour", "--hybrid"], lib).startswith("[1] Bread") and main(["t", "bread", "flour"], lib).startswith("[1] Bread")
    assert main(["t", "copy", f"{tmp_path}/c"], lib) == "{'source': 3, 'target': 3, 'complete': True, 'same': True}" and "python -m" in main([])


def test_evaluation_and_transfer_commands(spark, tmp_path):
    lib = Library(spark, f"{tmp_path}/t")
    lib.index(documents(spark, {"wind": "solar wind streams from the sun", "bread": "bread is baked from flour and water", "moon": "the moon pulls the tides"}))
    with open(f"{tmp_path}/cases.json", "w") as f:
        for i, (query, category, title) in enumerate((("solar wind streams from the sun", "space", "Wind"), ("bread is baked from flour and water", "food", "Bread"), ("moon tides pulls the", "space", "Nothing such"))):
            f.write(json.dumps({"query_id": i, "query": query, "category": category, "acceptable": [title]}) + "\n")
    report = main(["t", "eval", f"{tmp_path}/cases.json"], lib)
    lines = report.split("\n")
    assert lines[0] == "# Retrieval report" and any(row.startswith("| 3 | 0.6667 | 0.6667 | 0.6667 | 0.6667 |") for row in lines)
    assert any(row.startswith("| food | 1 | 1.0000 |") for row in lines) and any(row.startswith("| space | 2 | 0.5000 |") for row in lines)
    assert "'complete': True" in main(["t", "transfer", f"{tmp_path}/c"], lib)


def test_flags():
    assert search_flags(["what", "-r", "is", "--hyb", "it"]) == ("what is it", True, True) and search_flags(["x"]) == ("x", False, False)


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    def load():
        with open(f"{tmp_path}/loads", "a") as f:
            f.write("x")
        return lambda qs, ts: [float(len(t)) for t in ts]

    hits = spark.createDataFrame([(q, "q", i, "t" * i, 0.5, i) for q in range(8) for i in range(1, 4)], "query_id long, query string, point_id long, text string, score double, rank int").repartition(6)
    assert {r["point_id"] for r in search.rerank(hits, search.loaded(load), 1).collect()} == {3}
    assert len(open(f"{tmp_path}/loads").read()) <= spark.sparkContext.defaultParallelism

    def make():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts], np.float32)

    embed = store.model_embedder(make, 4)
    df = spark.createDataFrame([("abc",), ("z",)], "t string")
    assert [r["v"] for r in df.select(embed("t").alias("v")).collect()] == [[3.0, 1.0], [1.0, 1.0]]


def test_download_goes_on(tmp_path):
    data, asked = b"0123456789" * 10, []

    def read(start, fail=None):
        asked.append(start)
        return True, iter([data[start : start + 30]] if fail else [data[start:]])

    with pytest.raises(OSError):
        download(f"{tmp_path}/d/x.xml.bz2", lambda: 100, lambda start: read(start, True))
    assert download(f"{tmp_path}/d/x.xml.bz2", lambda: 100, read).read_bytes() == data
    assert download(f"{tmp_path}/d/x.xml.bz2", lambda: 100, read).read_bytes() == data and asked == [0, 30]
    (tmp_path / "d/y.part").write_bytes(b"old")
    assert download(f"{tmp_path}/d/y.xml", lambda: 0, lambda start: (False, iter([data]))).read_bytes() == data
