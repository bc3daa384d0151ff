"""Mixing sources to target weights (native): Sainte-Laguë quotas of equal-token blocks per shard.

1. Words per document, written once; sums per source. Targets are shares by weight, stopped at max_repeats times
   the source's own words, the excess shared again by weight (water level over the sources).
2. The mix is cut into `shards` shards of equally many blocks of `block` words. Sainte-Laguë's
   highest quotients give every source its blocks for the first 1, 2, ... shards together; the
   method is house monotone, so the differences are each shard's quotas.
3. A source is a stream of its documents in seeded order, cut into n blocks. In pass p block j stands at a
   place of a seeded order of all blocks (a swap-or-not shuffle of ROUNDS rounds, whose keys are drawn by seed, source
   and pass), and is the source's draw number p * n + place. A shard's quota is filled with the source's next draws, so
   every shard has exactly its quota of seeded blocks, and a block comes again only when all others have come.
   A source's last block may be shorter; max_repeats passes bound the draws.

Places in a source's stream come from sums over hashed buckets of documents and then inside a bucket, so no task holds
a source; rows that repeat id and size are counted first, salted, and numbered inside their salt. What stands in one
window is one row a source (and shard).

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, ordered
last; null ids and repeated rows are separate documents of the stream, and rows of one id and size may change places;
sources without words have target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANK, table, text_of, written

DOCS_PER_BUCKET = 4096
#: Rounds of the seeded order of a source's blocks.
ROUNDS = 24
#: A row of the plan holds about 1 KB (keys, sums by shard), so this many are about 10 MB.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """source, source_size, n_docs, weight, target, place (order of the sources by code point, null last)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    sums = sums.withColumn("place", F.row_number().over(ordered) - 1)
    weight = F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights))
    sums = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    # By rising cap/weight, a source is capped if the level that the others would reach stands above its cap.
    rising = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before, all_rows = rising.rowsBetween(W.unboundedPreceding, -1), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    sums = sums.withColumn("level", left / share).withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(all_rows)["level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free * F.col("weight"))
    return sums.select("source", "source_size", "n_docs", "weight", "place", target.cast("double").alias("target"))


def shard_quotas(targets: DataFrame, *, block: int, shards: int) -> DataFrame:
    """source, shard, blocks: Sainte-Laguë over all sources, for the first h shards, less the first h - 1.

    With S sources, a source's number differs from its exact share p*N by at most p*S/2 + 1, so only
    the quotients in that range are ranked: about 5 rows a source and shard.
    """
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total, n = F.sum("target").over(all_rows), F.count("*").over(all_rows)
    houses = targets.withColumn("share", F.when(total > 0, F.col("target") / total).otherwise(0.0)).withColumn("slack", F.ceil(F.col("share") * n / 2) + 1)
    houses = houses.withColumn("house", F.round(total / block)).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    houses = houses.withColumn("seats", F.round(F.col("house") * F.col("h") / shards))
    exact = F.col("share") * F.col("seats")
    houses = houses.withColumn("sure", F.greatest(F.floor(exact) - F.col("slack"), F.lit(0)))
    seats = houses.withColumn("m", F.explode(F.sequence(F.col("sure") + 1, F.col("sure") + 2 * F.col("slack") + 2)))
    seats = seats.withColumn("quotient", F.col("target") / (2 * F.col("m") - 1))
    open_seats = F.max("seats").over(W.partitionBy("h")) - F.sum(F.when(F.col("m") == F.col("sure") + 1, F.col("sure")).otherwise(0)).over(W.partitionBy("h"))
    seats = seats.withColumn("open", open_seats).withColumn("rank", F.row_number().over(W.partitionBy("h").orderBy(F.desc("quotient"), "place", "m")))
    first = seats.groupBy("source", "place", "h").agg((F.max("sure") + F.count(F.when((F.col("rank") <= F.col("open")) & (F.col("target") > 0), 1))).cast("long").alias("first"))
    by_shard = W.partitionBy("place").orderBy("h")
    return first.select("source", "place", (F.col("h") - 1).alias("shard"), (F.col("first") - F.coalesce(F.lag("first").over(by_shard), F.lit(0))).alias("blocks"))


def _numbered(sized: DataFrame, seed: int) -> DataFrame:
    """sized with lo, the words of its source's stream before it. sized: place, n_buckets, doc_id, size, row."""
    rows = sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.col("n_buckets")))
    # Rows of one key and size follow each other; a key that most rows have is one row here.
    same = rows.groupBy("place", "bucket", "key", "size").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("place").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = same.groupBy("place", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    buckets = buckets.select("place", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("bucket_start"))
    inside = W.partitionBy("place", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    same = same.withColumn("inside", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0))).join(buckets, ["place", "bucket"])
    same = same.select("place", "key", "size", (F.col("bucket_start") + F.col("inside")).alias("start"), F.ceil(F.col("n") / DOCS_PER_BUCKET).alias("salts"))
    rows = rows.join(same, ["place", "key", "size"]).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")))
    own = ["place", "key", "size", "salt"]
    salted = W.partitionBy("place", "key", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    salts = rows.filter("salts > 1").groupBy(*own).agg(F.count("*").alias("n"))
    salts = salts.select(*own, F.coalesce(F.sum("n").over(salted), F.lit(0)).alias("before"))
    rows = rows.join(salts, own, "left").withColumn("number", F.row_number().over(W.partitionBy(*own).orderBy("row")) - 1 + F.coalesce("before", F.lit(0)))
    return rows.withColumn("lo", F.col("start") + F.col("number") * F.col("size")).drop("key", "bucket", "start", "salts", "salt", "before", "number")


def round_keys(n: Column, place: Column, seed: int, passes: int) -> Column:
    """array<array<bigint>>: a key below n for each pass and round."""
    key = lambda p, r: F.pmod(F.xxhash64(F.lit(seed), place, F.lit(p), F.lit(r)), F.greatest(n, F.lit(1)))
    return F.array(*(F.array(*(key(p, r) for r in range(ROUNDS))) for p in range(passes)))


def seeded_place(p: int, seed: int) -> str:
    """SQL of the place of block j in pass p, over columns place, n_blocks and keys: a swap-or-not shuffle. Each
    round pairs x with key - x (mod n_blocks), and a hash of the pair's larger member says whether they change places;
    that is its own inverse, so the whole is a permutation for every n_blocks."""
    other = f"pmod(keys[{p}][r] - x, n_blocks)"
    swap = f"(xxhash64({seed}, place, {p}, r, greatest(x, {other})) & 1) = 1"
    return f"aggregate(sequence(0, {ROUNDS - 1}), j, (x, r) -> IF({swap}, {other}, x))"


def _draws(block: int, passes: int, seed: int) -> Column:
    """array<struct<block, draw, words>>: the document's blocks in every pass, as numbers of draws, those that the
    source's quota reaches."""
    at = lambda p: f"CAST({p} AS BIGINT) * n_blocks + {seeded_place(p, seed)}"
    words = f"CAST(least(hi, (j + 1) * {block}) - greatest(lo, j * {block}) AS BIGINT)"
    of = f"transform(sequence(lo DIV {block}, (hi - 1) DIV {block}), j -> array({', '.join(f'struct(j AS block, {at(p)} AS draw, {words} AS words)' for p in range(passes))}))"
    return F.expr(f"IF(size > 0, filter(flatten({of}), d -> d.draw < quota), CAST(array() AS array<struct<block: bigint, draw: bigint, words: bigint>>))")


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, block: int = 64, shards: int = 16, seed: int = 17, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, its words [lo, hi) of its source's stream,
    draws (block, draw, words of the document in it), quotas (the source's, by shard), by_shard (words that each shard
    takes of the document) and taken, their sum. The columns named in keep come along as the struct `kept`."""
    carried = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept") if keep else F.lit(0).alias("kept")
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"), carried)
    size = F.size(F.array_remove(F.split(text_of("text"), BLANK, -1), "")).cast("long")
    sized = written(docs.select("doc_id", "source", size.alias("size"), "kept", F.monotonically_increasing_id().alias("row")), "sizes")
    kept, sized = sized.select("row", "kept"), sized.drop("kept")
    targets = source_targets(sized, weights=weights, max_repeats=max_repeats)
    quotas = shard_quotas(targets, block=block, shards=shards).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("shard", "blocks"))).alias("q"))
    plan = targets.join(quotas.select("place", F.transform("q", lambda x: x["blocks"]).alias("quotas")), "place")
    plan = plan.withColumn("n_buckets", F.ceil(F.col("n_docs") / DOCS_PER_BUCKET)).withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda h: F.aggregate(F.slice("quotas", 1, h), F.lit(0).cast("long"), lambda a, x: a + x))
    plan = plan.withColumn("upto", upto).withColumn("quota", F.least(F.get("upto", F.lit(shards - 1)), F.col("n_blocks") * max_repeats))
    plan = plan.withColumn("keys", round_keys(F.col("n_blocks"), F.col("place"), seed + 2, max_repeats))
    # One row a source: while these are few, they go to the documents, and no source's documents to one task.
    few = plan.count() <= BROADCAST_SOURCES
    rows = sized.join(F.broadcast(plan) if few else plan, sized["source"].eqNullSafe(plan["source"]), "inner").drop(plan["source"])
    rows = _numbered(rows, seed).withColumn("hi", F.col("lo") + F.col("size"))
    # Bound in an array of one element, so that the draws are made once.
    total = lambda d: F.aggregate(d, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    shard = lambda x: F.size(F.filter("upto", lambda u: u <= x["draw"]))
    placed = lambda d: F.transform(d, lambda x: F.struct(shard(x).alias("shard"), x["words"].alias("words")))
    of = lambda d: F.filter(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda h: F.struct(h.alias("shard"), total(F.filter(d, lambda x: x["shard"] == h)).alias("words"))), lambda x: x["words"] > 0)
    rows = rows.withColumn("draws", _draws(block, max_repeats, seed + 3))
    rows = rows.withColumn("by_shard", F.get(F.transform(F.array(placed(F.col("draws"))), of), F.lit(0))).withColumn("taken", total(F.col("draws")))
    names = ("doc_id", "source", "size", "source_size", "target", "lo", "hi", "n_blocks", "quota", "quotas", "draws", "by_shard", "taken")
    # The kept columns are not dealt with the rows; they come back at the end, by row.
    return rows.select(*names, "row").join(kept, "row").drop("row") if keep else rows.select(*names)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself, with the columns of docs: a document once for each time that all its blocks come, and
    once more with the words of its blocks that come once more (white space before a word goes with it)."""
    placed = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, keep=tuple(docs.columns), **how)
    block = int(how.get("block", 64))
    # How often each of the document's blocks comes, in order of the blocks.
    first, last = F.expr(f"lo DIV {block}"), F.expr(f"greatest(hi - 1, lo) DIV {block}")
    times = F.transform(F.sequence(first, last), lambda j: F.size(F.filter("draws", lambda d: d["block"] == j)))
    placed = placed.filter("taken > 0").withColumn("times", times).withColumn("whole", F.array_min("times"))
    words = F.regexp_extract_all(text_of(f"kept.`{text_col}`"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    block_of = lambda i: (F.floor((F.col("lo") + i) / block) - first).cast("int")

    def part(n: Column) -> Column:
        """The words of blocks that come more than n times."""
        some = F.filter(words, lambda _, i: F.get("times", block_of(i)) > n)
        return F.regexp_replace(F.array_join(some, ""), r"^[\x20\x09-\x0D]+", "")

    own = F.col(f"kept.`{text_col}`")
    more = F.array_max("times") - F.col("whole")
    texts = F.concat(F.array_repeat(own, F.col("whole")), F.when(more > 0, F.transform(F.sequence(F.lit(0), more - 1), lambda i: part(F.col("whole") + i))).otherwise(F.array().cast("array<string>")))
    rows = placed.select("kept", F.explode(texts).alias("mixed"))
    return rows.select(*(F.col("mixed").alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns))


def op10_source_mix(spark, sf_dir) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "by_shard")
