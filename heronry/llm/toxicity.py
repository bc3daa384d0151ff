"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is itself and its character n-grams (3 to 5, with its edges marked), each hashed to one of
2**`bits` vectors; a document is the mean of its words' means (with PADDING empty words); a linear softmax follows. Vectors and
softmax are fitted together by Adam on at most `sample` labelled documents, so misspelt words share
most of their vectors with the words they come from.

The fitted model is linear in the vectors, so a bucket needs one number at scoring time: its vector
times the difference of the two classes' weights. Workers score the distinct words of a batch at once.

Defined results: null and empty texts have no words and are scored by the intercept; null labels are
no labels; a doc_id that is labelled twice counts once (the larger label); without both labels every
score is the share of label 1 (0 without rows); repeated documents are scored each; other columns
are ignored, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import rest, table, text_of, tidied
from .shingles import mix

EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…*#$%&|"
#: Words without a vector that every mean counts besides its own, so a few words decide little.
PADDING = 10
#: Bytes of text, and distinct words of it, that are scored at once.
BYTES_AT_ONCE, WORDS_AT_ONCE = 4_000_000, 8192
_Q = 0x9E3779B97F4A7C15


def hashed_grams(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of each word and its character n-grams, one word after the other, and how many each word has.

    A gram's hash is a polynomial of its code points, mixed; all words' grams are taken at once.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # to the end of the word
    powers = [np.uint64(pow(_Q, j, 2**64)) for j in range(5)]
    whole = np.zeros(len(points) + 1, np.uint64)
    rising = np.full(len(points), _Q, np.uint64)
    rising[:1] = 1
    rising = np.cumprod(rising, dtype=np.uint64)
    np.cumsum(points * rising, out=whole[1:])
    falling = np.full(len(points), pow(_Q, -1, 2**64), np.uint64)
    falling[:1] = 1
    starts = ends - lengths
    found = [(whole[ends] - whole[starts]) * np.cumprod(falling, dtype=np.uint64)[starts]]
    owners = [np.arange(len(words))]
    for k in (3, 4, 5):
        at = np.flatnonzero(left >= k)
        found.append(sum((points[at + j] * powers[j] for j in range(k)), np.full(len(at), k * _Q % 2**64, np.uint64)))
        owners.append(owner[at])
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (mix(found[order]) >> np.uint64(64 - bits)).astype(np.int64), np.bincount(owners, minlength=len(words))


def buckets(word: str, bits: int) -> list[int]:
    """Hashed places of a word and its character n-grams."""
    return hashed_grams([word], bits)[0].tolist()


def _normal(words: list[str]) -> list[str]:
    return [w.lower().strip(EDGES) for w in words]


class ToxicityModel:
    """One number a bucket, a scale and an intercept; scores texts."""

    def __init__(self, table: np.ndarray, bits: int, scale: float, intercept: float):
        self.table, self.bits, self.scale, self.intercept = table, bits, scale, intercept

    def scores(self, texts) -> np.ndarray:
        """Scores of an Arrow array of strings. Each distinct word of a part is scored once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // BYTES_AT_ONCE)) + 1).tolist(), len(texts)]
        out = [np.zeros(0)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            cut = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()).take(pa.array(np.arange(a, b))), ""))
            offsets = cut.offsets.to_numpy() - (cut.offsets[0].as_py() if len(cut.offsets) else 0)
            runs = cut.flatten().dictionary_encode()
            raw = runs.dictionary.to_pylist()
            of_word = np.zeros(len(raw) + 1)
            for k in range(0, len(raw), WORDS_AT_ONCE):
                places, counts = hashed_grams(_normal(raw[k : k + WORDS_AT_ONCE]), self.bits)
                of_word[k : k + len(counts)] = _segments(self.table[places].astype(float), counts) / counts
            # A text that ends or begins with white space has empty runs there; these are no words.
            is_word = np.append(np.fromiter((r != "" for r in raw), float, len(raw)), 0)
            codes = runs.indices.to_numpy()
            sums, words = (np.diff(np.append(0, np.cumsum(x[codes]))[offsets]) for x in (np.where(is_word > 0, of_word, 0), is_word))
            x = np.clip(self.scale * sums / (words + PADDING) + self.intercept, -40, 40)
            out.append(1 / (1 + np.exp(-x)))
        return np.concatenate(out)


def _segments(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, counts[i] of them for row i (all counts > 0)."""
    return np.add.reduceat(values, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)


def train(texts: list[str], labels: np.ndarray, *, bits: int = 17, size: int = 8, epochs: int = 80, rate: float = 0.05, scale: float = 100.0, decay: float = 0.1, min_docs: int = 6, seed: int = 31) -> ToxicityModel:
    """Words of fewer than min_docs documents teach nothing that would carry over; they only count in the mean."""
    from collections import Counter

    import pyarrow as pa
    import pyarrow.compute as pc

    held = {}  # a word is one object, however many documents have it; only one document's runs of it stand beside it
    bags = []
    for t in texts:
        runs = pc.utf8_split_whitespace(pa.scalar(t or "", pa.large_string())).as_py()
        bags.append(Counter(held.setdefault(w, w) for w in _normal([r for r in runs if r])))
    spread = Counter(w for bag in bags for w in bag)
    vocab = {w: i for i, w in enumerate(sorted(w for w, n in spread.items() if n >= min_docs))}
    kept = [[(vocab[w], n) for w, n in bag.items() if w in vocab] or [(0, 0)] for bag in bags]
    totals = np.array([sum(bag.values()) + PADDING for bag in bags], np.float32)
    if not vocab or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return ToxicityModel(np.zeros(1 << bits, np.float32), bits, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    flat, n_buckets = hashed_grams(list(vocab), bits)
    owner = np.repeat(np.arange(len(vocab)), n_buckets)
    n_words = np.array([len(k) for k in kept])
    doc_word = np.array([w for k in kept for w, _ in k])
    doc_of = np.repeat(np.arange(len(kept)), n_words)
    share = np.array([n for k in kept for _, n in k], np.float32) / totals[doc_of]
    used, place = np.unique(flat, return_inverse=True)
    by_bucket = np.argsort(place, kind="stable")
    bucket_counts = np.bincount(place, minlength=len(used))
    by_word = np.argsort(doc_word, kind="stable")
    words_met, word_counts = np.unique(doc_word, return_counts=True)
    per_word = (1 / n_buckets).astype(np.float32)[:, None]
    draw = np.random.default_rng(seed)
    e = draw.normal(0, 0.01, (len(used), size)).astype(np.float32)
    w, b = draw.normal(0, 0.3, (size, 2)).astype(np.float32), np.zeros(2, np.float32)
    params, first, second = [e, w, b], [], []
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    hot = np.eye(2, dtype=np.float32)[labels.astype(int)]
    for step in range(1, epochs + 1):
        word_vec = _segments(e[place], n_buckets) * per_word
        doc = scale * _segments(word_vec[doc_word] * share[:, None], n_words)
        logits = doc @ w + b
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - hot) / len(kept)
        back = scale * (g @ w.T)
        word_grad = np.zeros_like(word_vec)
        word_grad[words_met] = _segments((back[doc_of] * share[:, None])[by_word], word_counts)
        e_grad = _segments((word_grad * per_word)[owner][by_bucket], bucket_counts)
        for i, (q, grad) in enumerate(zip(params, (e_grad + decay * e / len(kept), doc.T @ g, g.sum(axis=0)), strict=True)):
            first[i] += 0.1 * (grad - first[i])
            second[i] += 0.001 * (grad * grad - second[i])
            q -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    numbers = np.zeros(1 << bits, np.float32)
    numbers[used] = e @ (w[:, 1] - w[:, 0])
    return ToxicityModel(numbers, bits, scale, float(b[1] - b[0]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = 4_000, max_bytes: int = 40_000_000) -> ToxicityModel:
    """docs: doc_id, text. labels: doc_id, label. At most `sample` documents, half of them of label 1 if
    there are as many, smallest seeded hash first; one task takes whole texts, none above max_bytes / 40 (1 MB), until
    max_bytes of UTF-8, and fits. These bounds hold for the fit alone; every text is scored."""
    labels = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    labels = labels.withColumn("key", F.xxhash64(F.lit(31), "doc_id"))
    halves = [labels.filter(F.col("label") == y).orderBy("key", "doc_id").limit(sample // 2) for y in (0, 1)]
    share = labels.agg(F.avg("label")).first()[0]
    if share is None:
        return train([], np.zeros(0))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(halves[0].union(halves[1])), "doc_id").filter(F.octet_length("text") <= max_bytes // 40)

    def fitted(batches):
        import pyarrow as pa

        from heronry.llm.toxicity import train

        texts, marks, held = [], [], 0
        for batch in batches:
            for t, y in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
                held += t.as_buffer().size
                if held <= max_bytes:
                    texts.append(t.as_py())
                    marks.append(y)
        marks = np.array(marks, float)
        model = train(texts, marks)
        ours = float(marks.mean()) if len(marks) else 0.5
        yield pa.RecordBatch.from_pylist([{"numbers": model.table.tobytes(), "bits": model.bits, "scale": float(model.scale), "intercept": float(model.intercept), "ours": ours}])

    # The sample has a bound, and is fitted in a task: the driver gets 4 bytes a bucket.
    one = rows.select("key", "doc_id", "text", "label").repartition(1).sortWithinPartitions("key", "doc_id", "text").select("text", "label")
    found = one.mapInArrow(tidied(fitted), "numbers binary, bits long, scale double, intercept double, ours double").first()
    if found is None:
        model, ours = train([], np.zeros(0)), 0.5
    else:
        model = ToxicityModel(np.frombuffer(found["numbers"], np.float32), found["bits"], found["scale"], found["intercept"])
        ours = found["ours"]
    if 0 < ours < 1:  # the sample is balanced, the corpus is not
        model.intercept += float(np.log(share / (1 - share)) - np.log(ours / (1 - ours)))
    rest()  # the driver goes on to other stages
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns of keep, whatever their names, and the score as the last column, named score_col."""
    numbers = docs.sparkSession.sparkContext.broadcast(model.table)
    bits, scale, intercept = model.bits, model.scale, model.intercept
    # Columns go by their places, so no name can clash; the text travels once.
    sent = [*keep, *([] if text_col in keep else [text_col])]
    inner = docs.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(sent)))
    at, n = sent.index(text_col), len(keep)
    schema = StructType([*inner.schema.fields[:n], StructField("score", DoubleType())])

    def scored(batches):
        import pyarrow as pa

        from heronry.llm.toxicity import ToxicityModel

        own = ToxicityModel(numbers.value, bits, scale, intercept)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(own.scores(batch.column(at)))], [*batch.schema.names[:n], "score"])

    return inner.mapInArrow(tidied(scored), schema).toDF(*keep, score_col)


def op3_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labels = table(spark, sf_dir, "labels").filter(fold != 2).select("doc_id", F.col("toxic").alias("label"))
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
