"""Findings of round three in the training-data operators."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heronry.llm import byte_pairs, components, jaccard_join, line_dedup, packing, toxicity
from heronry.llm.common import written
from tests.llm.brute import jaccard_components


@pytest.mark.parametrize("passes", [1, 2])
def test_carried_columns_may_be_named_n(spark, passes):
    rows = [(1, 10, 5), (2, 10, 6), (3, 10, 9), (3, 11, 9), (4, 11, 9), (5, 12, 5)]
    rows = spark.createDataFrame(rows, "key long, band long, n long")

    def verified(pairs, left):
        n = left.select("key", "n").distinct()
        sides = [n.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab"]
        return written(pairs.join(sides[0], "a").join(sides[1], "b").filter("abs(n_a - n_b) <= 1").select("a", "b"), "links")

    got = components.grouped_components(rows, verified, near=F.abs(F.col("n") - F.col("p_n")) <= 1, carried=("n",), passes=passes)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_the_fit_gives_the_drivers_memory_back(spark, monkeypatch):
    called = []
    monkeypatch.setattr(toxicity, "rest", lambda: called.append(1), raising=False)
    docs = spark.createDataFrame([(i, f"a text of {'bad' if i % 2 else 'good'} words") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int")
    toxicity.fit_toxicity(docs, labels)
    assert called


def test_near_copies_that_are_not_linked_do_not_all_meet(spark, monkeypatch):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(150)]

    def copy(of, edits, i):
        words = list(of)
        for j, at in enumerate(draw.sample(range(len(words)), edits)):
            words[at] = f"x{i}_{j}"
        return words

    copies = [copy(base, draw.choice([0, 1, 2, 3, 4, 5, 6, 7]), i) for i in range(400)]
    copies += [copy(copies[i], draw.choice([1, 2, 3]), 1000 + i) for i in range(0, 400, 8)]  # some are linked beside the rest
    rows = [(i, " ".join(words)) for i, words in enumerate(copies)]
    met, was = [], jaccard_join.linked_pairs
    monkeypatch.setattr(jaccard_join, "linked_pairs", lambda pairs, *a: (met.append(pairs.count()), was(pairs, *a))[1])
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = jaccard_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) > 50
    assert sum(met) < 5 * len(rows), met


def test_the_fit_is_not_made_on_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a text of {'bad' if i % 2 else 'good'} words") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")

    def on_driver(texts, labels, **_):
        raise AssertionError(f"{len(texts)} texts on the driver")

    monkeypatch.setattr(toxicity, "train", on_driver)
    model = toxicity.fit_toxicity(docs, labels)
    bad, good = model.scores(pa.array(["bad words", "good words"]))
    assert bad > 0.5 > good
    monkeypatch.undo()
    none = toxicity.fit_toxicity(docs.filter("doc_id < 0"), labels)
    assert none.scores(pa.array(["bad words"])).tolist() == toxicity.train([], np.zeros(0)).scores(pa.array(["bad words"])).tolist()


def mutated_copies(n, seed=4, words=60):
    """Lines: an original, and copies with some words replaced, dropped or added, or with another second half."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 8)))
    base = [word() for _ in range(words)]
    lines = [" ".join(base)]
    for i in range(n - 1):
        of = base if i % 4 else lines[draw.randrange(len(lines))].split(" ")
        copy = of[: words // 2] + [word() for _ in range(words // 2)] if i % 10 == 9 else list(of)
        for _ in range(draw.randint(0, 9)):
            at = draw.randrange(len(copy))
            copy[at : at + 1] = draw.choice([[word()], [word()], [], [copy[at], word()]])
        lines.append(" ".join(copy))
    return list(dict.fromkeys(lines))


def test_copies_of_one_line_meet_by_how_they_differ_from_it(spark):
    """All linked pairs are met, but few of those that are not linked."""
    lines = mutated_copies(240)
    sets = [{x[j : j + 10] for j in range(len(x) - 9)} for x in lines]
    like = lambda a, b: 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])
    part = [0 if like(0, i) else i for i in range(len(lines))]
    texts = spark.createDataFrame(list(enumerate(lines)), "key long, line string")
    left = spark.createDataFrame([(i, 7, 0, part[i], len(lines)) for i in range(len(lines))], "key long, band long, pivot long, part long, n_keys long")
    lists = written(line_dedup.prefixes(left, texts, 10, 75))
    got = {(r["a"], r["b"]) for r in line_dedup.crowded_pairs(left, lists, 75).collect()}
    apart = [(a, b) for a in range(1, len(lines)) for b in range(a + 1, len(lines)) if part[a] != part[b]]
    linked = {x for x in apart if like(*x)}
    assert linked and linked <= got
    assert len(got - linked) < 0.1 * len(apart)


def test_frequent_pieces_are_encoded_once(monkeypatch):
    """A full table of pieces is not forgotten at once."""
    met = []
    monkeypatch.setattr(byte_pairs, "HELD", 4)
    kept = byte_pairs._Kept(lambda piece: met.append(piece) or piece.encode())
    for i in range(40):
        assert kept[f"rare {i}"] == f"rare {i}".encode() and kept[" the"] == b" the"
    assert met.count(" the") == 1 and len(kept) <= 4 and len(kept.before) <= 4


def test_ids_of_pieces_are_not_shuffled(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(i % 50, "some words of a text " * (i % 7)) for i in range(120)], "doc_id long, text string").repartition(5)
    out = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=16, keep_ids=True)
    lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    shuffled = [x for i, x in enumerate(lines) if "ids#" in x and any("Exchange" in y and depth(y) < depth(x) and all(depth(z) > depth(y) for z in lines[j + 1 : i]) for j, y in enumerate(lines[:i]))]
    assert not shuffled, shuffled
    by_sequence = defaultdict(list)
    for r in out.collect():
        assert len(r["ids"]) == r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 16


def test_a_poor_pivot_brings_no_pairs_together(spark):
    """What all copies have in place of their pivot's own words makes no candidates, and a better pivot is found."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9)))
    base, lines = [word() for _ in range(60)], []
    for i in range(160):
        copy = list(base)
        for at in draw.sample(range(60), 2 if i == 77 else 8 if i else 12):
            copy[at] = word()
        lines.append(" ".join(copy))
    sets = [{x[j : j + 10] for j in range(len(x) - 9)} for x in lines]
    linked = {(a, b) for b in range(160) for a in range(b) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    texts = spark.createDataFrame(list(enumerate(lines)), "key long, line string")
    left = spark.createDataFrame([(i, 7, 0, i, 160) for i in range(160)], "key long, band long, pivot long, part long, n_keys long")
    lists = written(line_dedup.prefixes(left, texts, 10, 75))
    got = {(r["a"], r["b"]) for r in line_dedup.crowded_pairs(left, lists, 75).collect()}
    assert {x for x in linked if 0 not in x} <= got and len(got - linked) < 600
    # All keys of the band are among those that choose, and the copy with the fewest words of its own is the most usual one.
    found = [tuple(r) for r in line_dedup.centres(left.filter("key < 40 OR key = 77"), texts, 10).collect()]
    assert found == [(0, 77)]
