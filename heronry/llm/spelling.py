"""Spelling variants: words at one edit, by a positional q-gram inverted index with a count filter.

1. Counts: maximal runs of letters of all texts, a seeded slip removes one letter of a few of them, and words that are
   long and frequent enough stay. Native, with partial counts before the shuffle.
2. Blocks: cut at half the length of the shorter word, two words at one edit share the part before or the part behind
   the cut. A word goes to the blocks of both its parts, once as the shorter (or equal) and once as the longer word. A
   block of more than MOST words is split again, by halves of what its words do not share, until it is small or its
   words share all but one letter of the shorter; then the alphabet bounds it. So no group is gathered whole, and no pair is lost.
3. In a block, an inverted index holds for each gram of Q characters and each position the words that have it
   there, in order. A word's lists, at its own positions and one to either side, are merged by a heap; words of
   the next length or the same that come up often enough stay: one edit destroys at most Q grams of the longer word. Grams
   that all words of the block share are left out on both sides of this bound. What stays is verified.
4. A word's form is its most frequent near word, if that is RATIO times as frequent; roots follow forms by doubling.

Defined results: null and empty texts have no words; a null id counts as an empty one in the slip; repeated rows count
again; no words, no rows; other columns are ignored; ties go to the smaller word in the order of code points.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from heapq import merge

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, table, tidied, written

LETTERS = r"A-Za-zÀ-ÿ"
Q, MOST, RATIO = 2, 1024, 5
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counted_words(docs: DataFrame, *, id_col: str, text_col: str, least_chars: int, least_count: int, slip: int) -> DataFrame:
    """word, n."""
    # Runs below the least length cannot become words, as letters are only removed.
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{least_chars},}})"), 1)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.select("id", F.translate("run", _CAPITALS, _CAPITALS.lower()).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    words = words.filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keyed(rows: DataFrame, before: Column, behind: Column) -> DataFrame:
    """rows (word, n, size: length of the shorter word), with what the block's words share: `before` letters at the front,
    `behind` at the back; and the block's key."""
    rows = rows.withColumns({"a": before.cast("int"), "b": behind.cast("int")})
    front, back = F.substring(F.col("word"), F.lit(1), F.col("a")), F.when(F.col("b") > 0, F.expr("right(word, b)")).otherwise(F.lit(""))
    return rows.withColumn("key", F.xxhash64("size", "a", "b", front, back))


def blocks(words: DataFrame, least_chars: int, most: int = MOST) -> DataFrame:
    """words: word, n. Rows key, size, a, b, word, n: every two words at one edit share a key."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.filter(F.array(length, length - 1), lambda s: s >= least_chars)).alias("size"))
    half = F.floor(F.col("size") / 2)
    rows = _keyed(rows, half, F.lit(0)).union(_keyed(rows, F.lit(0), F.col("size") - half))
    out, held = None, []
    while True:
        rows = written(rows, "blocks")
        held.append(rows)
        large = written(rows.filter("size - a - b >= 2").groupBy("key").count().filter(F.col("count") > most).select("key"), "large")
        held.append(large)
        small = rows.join(large, "key", "left_anti")
        out = small if out is None else out.union(small)
        if large.isEmpty():
            break
        rows = rows.join(large, "key", "left_semi").select("word", "n", "size", F.col("a").alias("a0"), F.col("b").alias("b0"))
        half = F.floor((F.col("size") - F.col("a0") - F.col("b0")) / 2)
        deeper = _keyed(rows, F.col("a0") + half, F.col("b0")).unionByName(_keyed(rows, F.col("a0"), F.col("size") - F.col("a0") - half))
        rows = deeper.select("word", "n", "size", "a", "b", "key")
    out._tables = held
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def near_in_block(words: list[str], size: int, a: int, b: int):
    """Pairs of places of a block's words at one edit, the first of the shorter length `size`. a, b: letters they share."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    shorts = sum(len(w) == size for w in words)
    # What is not shared, with a neighbour on either side.
    free = ["^" * (not a) + words[i][max(a - 1, 0) : len(words[i]) - max(b - 1, 0)] + "$" * (not b) for i in order]
    index = defaultdict(list)
    for at, x in enumerate(free):
        for p in range(len(x) - Q + 1):
            index[x[p : p + Q], p].append(at)
    for at in range(shorts):
        x = free[at]
        lists = (index.get((x[p : p + Q], p + d)) for p in range(len(x) - Q + 1) for d in (-1, 0, 1))
        lists = [own[bisect_right(own, at) :] for own in lists if own and own[-1] > at]
        if len(x) - Q + 1 <= Q:  # one free letter: words of one length need not share a gram
            lists.append(range(at + 1, shorts))
        last, shared = -1, 0
        for other in merge(*lists, [len(free)]):
            if other == last:
                shared += 1
                continue
            if last >= 0 and shared >= len(free[last]) - Q + 1 - Q and one_edit(words[order[at]], words[order[last]]):
                yield order[at], order[last]
            last, shared = other, 1


def near_pairs(words: DataFrame, least_chars: int, most: int = MOST) -> DataFrame:
    """a, an, b, bn: every pair of words (word, n) at one edit, once. A written table."""
    rows = blocks(words, least_chars, most)

    def work(batches):
        import pyarrow as pa

        names, types = ["a", "an", "b", "bn"], [pa.string(), pa.int64(), pa.string(), pa.int64()]

        def pairs(block: list[tuple]) -> list[tuple]:
            _, size, a, b, _, _ = block[0]
            return [(block[i][4], block[i][5], block[j][4], block[j][5]) for i, j in near_in_block([r[4] for r in block], size, a, b)]

        block, found = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block and row[0] != block[0][0]:
                    found += pairs(block) if len(block) > 1 else ()
                    block = []
                block.append(row)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
                found = []
        found += pairs(block) if len(block) > 1 else ()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    dealt = rows.select("key", "size", "a", "b", "word", "n").repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(tidied(work), "a string, an long, b string, bn long")
    sides = found.select(F.least("a", "b").alias("x"), F.when(F.col("a") < F.col("b"), F.col("an")).otherwise(F.col("bn")).alias("xn"), F.greatest("a", "b").alias("y"), F.when(F.col("a") < F.col("b"), F.col("bn")).otherwise(F.col("an")).alias("yn"))
    out = written(sides.distinct().toDF("a", "an", "b", "bn"), "near")
    discard(*rows._tables)
    return out


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: forms followed to the last, by doubling. A written table."""
    now = written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after
        if now.filter("moved").isEmpty():
            return now


def spelling_variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_count: int = 5, slip: int = 199, ratio: int = RATIO, most: int = MOST
) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of at least least_chars characters and least_count occurrences."""
    words = written(counted_words(docs, id_col=id_col, text_col=text_col, least_chars=least_chars, least_count=least_count, slip=slip), "words")
    pairs = near_pairs(words, least_chars, most)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("other_n"))
    sides = sides.union(pairs.select(F.col("b"), F.col("a"), F.col("an")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    large = -F.col("best.n") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.other")).alias("form"), F.when(large, -F.col("best.n")).alias("form_n"))
    forms = written(found, "forms")
    roots = roots_of(forms)
    out = written(forms.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "variants")
    discard(words, pairs, forms, roots)
    return out


def op13_spelling_variants(spark, sf_dir) -> DataFrame:
    found = spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "n", "n_near", "form", "form_n", "root")
