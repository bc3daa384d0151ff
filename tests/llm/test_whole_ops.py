"""Cases that the training-data operators used to leave out."""

import random

import pytest

from heronry.llm import line_dedup, secrets

KEY = "kR8vQ2mZp0LxT7wY4nB6sD1fG3hJ5"


@pytest.mark.parametrize(
    "text",
    [f"db_sample={KEY}", f"/srv/samples/run7/{KEY}", f"AAAAAAAAA{KEY}", "kRvQmZpLxTwYnBsDfGhJcEgU"],
)
def test_secrets_beside_allowed_words_and_without_digits(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secrets.secret_spans(df).first()["spans"]
    assert spans and spans[-1]["e"] == len(text)
    assert all(not ("sample" in text[x["s"] : x["e"]] or "A" * 8 in text[x["s"] : x["e"]]) for x in spans)


def test_pipeline_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(None, text(1), 1), (None, text(2), 2), (None, text(2), 3), (5, text(3), 4), (5, text(3), 5), (5, text(4), 6), (7, text(5), 7), (None, text(5), 8), (None, "", 9), (None, "", 10)]
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "0L AS n")
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").union(more)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.filter("n > 0").collect()) == sorted([(0, text(1)), (0, text(2)), (5, text(3)), (5, text(4)), (7, text(5)), (0, ""), (0, "")])


def test_small_families_under_one_hot_passage(spark):
    """60 pairs of lines; the pairs share a passage, but only partners are similar enough."""
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, rows = "q" + word(268) + "q", []
    for i in range(60):
        own = word(40)
        rows += [(2 * i, passage + own + word(36) + "z"), (2 * i + 1, passage + own + word(36) + "z")]
    sets = {i: {t[j : j + 10] for j in range(len(t) - 9)} for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert min(like(2 * i, 2 * i + 1) for i in range(60)) >= 0.75 > 0.7 > max(like(0, j) for j in range(2, 120))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lost = {r["doc_id"] for r in line_dedup.dedup_lines(df).collect() if r["dropped_lines"]}
    # A pair shares no band with probability 0.0003 to 0.001.
    assert lost <= set(range(1, 120, 2)) and len(lost) >= 59
