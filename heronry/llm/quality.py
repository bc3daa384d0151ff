"""Quality classifier: random Fourier features of document statistics, ridge by normal equations summed
over partitions, isotonic calibration.

Statistics come from built-in functions in one scan. The fit takes at most `sample` labelled rows,
smallest seeded hash first (the scan that finds them runs at full width): that bound is a parameter, so what reaches the driver (means, sums of
size features x features from at most `parts` partitions, one score a calibration row) is bounded
too. Four fifths of the sample fit the ridge, one fifth the isotonic step function.

Defined results: a null text counts as empty and is scored; null labels are no labels; a doc_id that
is labelled twice counts once (the smaller label); without both labels in the sample every score is the
share of label 1 (0.5 without rows); repeated documents are scored each; an empty table gives an
empty result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from math import pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, table, text_of, written

STATS = (
    "log_words", "word_chars", "distinct_words", "stutter", "symbols", "capitals", "marks", "shouts", "digits",
    "log_line_chars", "distinct_lines", "distinct_pairs", "bars", "non_ascii",
)


def document_stats(text: Column) -> list[Column]:
    """Columns for a select over `text` and `words` (array of its words) and `lines`."""
    n, chars = F.greatest(F.size("words"), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    inner = F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1)))
    stutter = F.size(F.filter(inner, lambda i: F.get("words", i) == F.get("words", i - 1)))
    pairs = F.size(F.array_distinct(F.transform(inner, lambda i: F.hash(F.get("words", i - 1), F.get("words", i)))))
    lines = F.size("lines")
    columns = (
        F.log1p(F.size("words")), F.length(F.array_join("words", "")) / n / 10, F.size(F.array_distinct("words")) / n, stutter / n,
        share(r"[#*$%&|<>]") * 10, share(r"\p{Lu}"), share(r"[.,;:]") * 10, share(r"[!?]") * 10, share("[0-9]") * 10,
        F.log1p(chars / lines), F.size(F.array_distinct("lines")) / lines, pairs / n, share(r"\|") * 10,
        (F.octet_length(text) - F.length(text)) / chars,
    )
    return [c.cast("double").alias(name) for name, c in zip(STATS, columns, strict=True)]


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    text = F.col("text")
    docs = docs.select("*", F.array_remove(F.split(text, BLANK, -1), "").alias("words"), F.split(text, "\n", -1).alias("lines"))
    return docs.select(*keep, *document_stats(text))


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising knots and their values, for linear interpolation."""
    order = np.lexsort((label, score))
    blocks: list[list[float]] = []
    for x, y in zip(score[order], label[order], strict=True):
        blocks.append([x, x, y, 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    # A block's value is its mean with half a row of either label, so no score is certain.
    knots = np.array([[(b[0] + b[1]) / 2, (b[2] + 0.5) / (b[3] + 1)] for b in blocks])
    return knots[:, 0], np.maximum.accumulate(knots[:, 1])


class QualityModel:
    """Weights of the features and the calibration; scores arrays of statistics."""

    def __init__(self, features: int = 256, width: float = 3.0, ridge: float = 1.0, seed: int = 29):
        draw = np.random.default_rng(seed)
        self.w = draw.normal(0, 1 / width, (len(STATS), features))
        self.b = draw.uniform(0, 2 * pi, features)
        self.ridge, self.mean, self.scale = ridge, np.zeros(len(STATS)), np.ones(len(STATS))
        self.weights, self.knots, self.values = None, np.array([0.0]), np.array([0.5])

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.column_stack([sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights if self.weights is not None else np.zeros(len(stats))

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, parts: int = 8, model: QualityModel | None = None) -> QualityModel:
    """docs: doc_id, text. labels: doc_id, label (0 or 1), already without what may not be learnt from."""
    model = model or QualityModel()
    labels = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").cast("double").alias("label"))
    labels = labels.withColumn("key", F.xxhash64(F.lit(29), "doc_id")).orderBy("key", "doc_id").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(labels), "doc_id")
    rows = written(with_stats(rows, "label", "key").repartition(parts), "sample")
    moments = rows.agg(*(f(c).alias(f"{c}_{f.__name__}") for c in STATS for f in (F.avg, F.stddev_pop)), F.avg("label").alias("share"), F.count("*").alias("n")).first()
    if not moments["n"] or moments["share"] in (0, 1):
        model.values = np.array([0.5 if not moments["n"] else moments["share"]])
        return model
    model.mean = np.array([moments[f"{c}_avg"] for c in STATS])
    model.scale = np.array([moments[f"{c}_stddev_pop"] or 1.0 for c in STATS])
    fold = F.pmod("key", F.lit(5))

    def summed(batches):
        size = len(model.b) + 1
        gram, right = np.zeros((size, size)), np.zeros(size)
        for pdf in batches:
            z = model.lift(pdf[list(STATS)].to_numpy())
            gram += z.T @ z
            right += z.T @ pdf["label"].to_numpy()
        import pandas as pd

        yield pd.DataFrame({"gram": [gram.tobytes()], "rhs": [right.tobytes()]})

    sums = rows.filter(fold != 0).drop("key").mapInPandas(summed, "gram binary, rhs binary").collect()
    size = len(model.b) + 1
    gram = sum(np.frombuffer(r["gram"]).reshape(size, size) for r in sums)
    model.weights = np.linalg.solve(gram + model.ridge * np.eye(size), sum(np.frombuffer(r["rhs"]) for r in sums))
    held = rows.filter(fold == 0).drop("key").toPandas()
    if held["label"].nunique() == 2:
        model.knots, model.values = isotonic(model.raw(held[list(STATS)].to_numpy()), held["label"].to_numpy())
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score."""

    def scored(batches):
        import pyarrow as pa

        for b in batches:  # as Arrow, in which ids stay whole beside a null
            stats = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in STATS])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(stats), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return with_stats(rows, "doc_id").mapInArrow(scored, "doc_id long, score double")


def op1_quality_rff(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = table(spark, sf_dir, "labels").filter(fold != 0).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
