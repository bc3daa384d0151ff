"""N-gram Jaccard join with several global token orders, down to components of linked documents.

Tokens are the hashed 5-word shingles of a document. Documents of the same set are one class.

1. Workers turn texts into shingle sets and send them, packed in arrays, to buckets of tokens. There
   each token's document frequency (over classes) is counted; tokens of one class go no further.
2. Buckets of classes put each class's remaining tokens into three global orders: by frequency, then
   hash; and twice by the power of two of the frequency, then a differently salted hash. Linked classes
   of n tokens share a token among the first n - ceil(0.75 n) + 1 in each order (tokens of
   frequency 1 come first in all three and match nothing). A class whose prefix holds none is done.
3. Candidates share a token of the first order's prefix behind which both have enough tokens left, have
   sizes that allow the similarity and must
   meet in the prefixes of the other two orders as well; then the sets are compared.

The pairs under one token are not all formed (`grouped_components`). At first every class is compared with the
least of the classes that are first in its tokens' lists, then with all of these. Pairs inside a component are left
out, and components are updated after each round. Of the lists that are not one component then, those of up to SMALL
classes have all their pairs formed. In a longer one every class is seen by how it differs from the list's centre, the
class whose tokens are the most frequent ones (`crowded_pairs`): two linked classes differ from it in the same tokens, or are
both linked with it. So near copies that are not linked with each other do not meet for what all of them share, and
no link between components is lost.

Defined results: null and empty texts and texts without words have no shingles and are linked with
nothing; repeated rows of an id each give a row; other columns are ignored, so their names cannot
clash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, rest, table, tidied, written
from .components import grouped_components

BYTES_PER_BUCKET = 16_000_000
#: A token travels as its low 40 bits; its bucket comes from the others and is put in front again.
LOW_BITS = 40
MOST_BUCKETS = 1 << 22
BYTES_AT_ONCE = 4_000_000
#: Up to so many classes, all pairs of a list are formed.
SMALL = 8


def _spans(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _runs(edges: np.ndarray, end: int):
    """Start and end of each run that begins at an edge; none if there are no edges."""
    return zip(edges, [*edges[1:], end][: len(edges)], strict=True)


def _packed(batches, k: int, buckets: int):
    """Arrow batches of doc_id and text to rows of arrays: documents (bucket -1), and tokens by bucket."""
    import pyarrow as pa

    from heronry.llm.shingles import mix, shingle_sets

    names = ["bucket", "ids", "classes", "sizes", "counts", "low", "high"]
    raw = lambda x: x.tobytes()
    for batch in batches:
        docs = np.array(batch.column(0).to_pylist(), object)
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        cuts, held = [0], 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= BYTES_AT_ONCE:
                cuts.append(i + 1)
                held = 0
        parts = [shingle_sets(texts[a:b], k) for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True) if b > a]
        if not parts:
            continue
        tokens, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        some = sizes > 0
        sums = np.zeros(len(sizes), np.uint64)
        if len(tokens):
            sums[some] = np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), _spans(sizes[some])[:-1])
        classes = mix(sums + sizes.astype(np.uint64)).view(np.int64)
        null = np.array([d is None for d in docs], bool)
        ids = np.where(null, 0, docs).astype(np.int64)
        rows = [(-1, raw(ids), raw(classes), raw(sizes.astype(np.int32)), raw(null.astype(np.int8)), b"", b"")]
        # Each class of the batch once.
        _, at = np.unique(classes, return_index=True)
        once = np.zeros(len(sizes), bool)
        once[at] = True
        once &= some
        owner = np.repeat(np.arange(len(sizes)), sizes)
        mine = once[owner]
        tokens, owner = tokens[mine], owner[mine]
        bucket = (tokens >> np.uint64(LOW_BITS)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        tokens, owner, bucket = tokens[order], owner[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets + 1)))
        for a, b in _runs(edges, len(bucket)):
            own = owner[a:b]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            who = own[first]
            counts = np.diff(np.append(first, b - a)).astype(np.int32)
            low, high = tokens[a:b].astype(np.uint32), (tokens[a:b] >> np.uint64(32)).astype(np.uint8)
            rows.append((int(bucket[a]), b"", raw(classes[who]), raw(sizes[who].astype(np.int32)), raw(counts), raw(low), raw(high)))
        types = [pa.int32(), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _shared_tokens(group, buckets: int):
    """One bucket of tokens to rows by bucket of classes: the tokens that two or more classes have."""
    import pyarrow as pa

    classes, counts = _joined(group.column("classes"), np.int64), _joined(group.column("counts"), np.int32)
    sizes, classes = np.repeat(_joined(group.column("sizes"), np.int32), counts), np.repeat(classes, counts)
    tokens = _joined(group.column("high"), np.uint8).astype(np.uint64) << np.uint64(32) | _joined(group.column("low"), np.uint32)
    if len(tokens):
        tokens |= np.uint64(group.column("bucket")[0].as_py() << LOW_BITS)
    order = np.lexsort((classes, tokens))
    tokens, classes, sizes = tokens[order], classes[order], sizes[order]
    new_token = np.ones(len(tokens), bool)
    new_token[1:] = tokens[1:] != tokens[:-1]
    new = new_token.copy()
    new[1:] |= classes[1:] != classes[:-1]
    tokens, classes, sizes, new_token = tokens[new], classes[new], sizes[new], new_token[new]
    df = np.diff(np.append(np.flatnonzero(new_token), len(tokens)))
    df = np.repeat(df, df).astype(np.int32)
    many = df > 1
    tokens, classes, sizes, df = tokens[many], classes[many], sizes[many], df[many]
    place = (classes.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((classes, place))
    tokens, classes, sizes, df, place = tokens[order], classes[order], sizes[order], df[order], place[order]
    rows = []
    edges = np.flatnonzero(np.diff(place, prepend=np.uint64(buckets + 1)))
    for a, b in _runs(edges, len(place)):
        first = np.flatnonzero(np.diff(classes[a:b], prepend=~classes[a]))
        counts = np.diff(np.append(first, b - a)).astype(np.int32)
        rows.append((int(place[a]), classes[a:b][first].tobytes(), sizes[a:b][first].tobytes(), counts.tobytes(), tokens[a:b].tobytes(), df[a:b].tobytes()))
    names = ["bucket", "classes", "sizes", "counts", "tokens", "df"]
    types = [pa.int32(), *[pa.binary()] * 5]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _prefixes(group, percent: int):
    """One bucket of classes to a row per class with shared tokens in its prefix; usual: how frequent its tokens are on
    average (thousandths of a power of two)."""
    import pyarrow as pa

    from heronry.llm.shingles import mix

    counts = _joined(group.column("counts"), np.int32)
    classes, sizes = np.repeat(_joined(group.column("classes"), np.int64), counts), np.repeat(_joined(group.column("sizes"), np.int32), counts)
    tokens, df = _joined(group.column("tokens"), np.uint64), _joined(group.column("df"), np.int32)
    level = np.floor(np.log2(df)).astype(np.int8)
    orders = []
    for keys in ((tokens, df), (mix(tokens ^ np.uint64(0xA0761D6478BD642F)), level), (mix(tokens ^ np.uint64(0xE7037ED1A0B428DB)), level)):
        orders.append(np.lexsort((*keys, classes)))
    same = classes[orders[0]]
    first = np.flatnonzero(np.diff(same, prepend=~same[0])) if len(same) else np.zeros(0, int)
    held = np.diff(np.append(first, len(same)))
    n = sizes[orders[0]][first].astype(np.int64)
    prefix = n - (percent * n + 99) // 100 + 1 - (n - held)
    live = prefix > 0
    take = np.where(live, prefix, 0)
    rank = np.arange(len(same)) - np.repeat(first, held)
    cut = rank < np.repeat(take, held)
    lists = []
    for order in orders:
        lists.append(pa.ListArray.from_arrays(pa.array(_spans(take[live]).astype(np.int32)), pa.array(tokens[order][cut].view(np.int64))))
    usual = (1000 * np.add.reduceat(np.log2(df[orders[0]]), first) / n).astype(np.int32) if len(first) else np.zeros(0, np.int32)
    whole = np.repeat(live, held)
    lists.append(pa.ListArray.from_arrays(pa.array(_spans(held[live]).astype(np.int32)), pa.array(tokens[orders[0]][whole].view(np.int64))))
    return pa.Table.from_arrays([pa.array(same[first][live]), pa.array(n[live]), pa.array(usual[live]), *lists], ["class", "n", "usual", "first", "second", "third", "tokens"])


def linked_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the other two orders' filters and are similar, a written table."""
    side = lambda s: classes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "second", "third", "tokens")))
    both = pairs.join(side("a"), F.col("a") == F.col("class_a")).join(side("b"), F.col("b") == F.col("class_b"))
    both = both.filter(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
    # 100 * shared >= percent * (n_a + n_b - shared), with shared named once: a filter makes it each time it is named.
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return written(both.filter((100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "links")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(8, -(-total // BYTES_PER_BUCKET)))
    parts = "bucket int, ids binary, classes binary, sizes binary, counts binary, low binary, high binary"
    packed = docs.mapInArrow(tidied(lambda it: _packed(it, k, buckets)), parts)

    def reduced(key, group):
        if key[0].as_py() >= 0:
            shared = _shared_tokens(group, buckets)
            rest()
            return shared.append_column("ids", _nothing(len(shared)))
        kept = group.select(["bucket", "classes", "sizes", "counts"])
        return kept.append_column("tokens", _nothing(len(kept))).append_column("df", _nothing(len(kept))).append_column("ids", group.column("ids"))

    # Rows of documents are spread over keys of their own: they only pass.
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("classes"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    schema = "bucket int, classes binary, sizes binary, counts binary, tokens binary, df binary, ids binary"
    held = written(packed.withColumn("bucket", spread).groupBy("bucket").applyInArrow(reduced, schema), "tokens")

    def unpacked(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [_joined(batch.column(c), t) for c, t in (("ids", np.int64), ("classes", np.int64), ("sizes", np.int32), ("counts", np.int8))]
            ids = pa.array(columns[0], mask=columns[3].astype(bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1]), pa.array(columns[2].astype(np.int64))], ["doc_id", "class", "n_shingles"])

    rows = written(held.filter("bucket < 0").mapInArrow(unpacked, "doc_id long, class long, n_shingles long"), "documents")
    classes = held.filter("bucket >= 0").drop("ids").groupBy("bucket")
    schema = "class long, n long, usual int, first array<long>, second array<long>, third array<long>, tokens array<long>"
    classes = written(classes.applyInArrow(lambda group: _prefixes(group, percent), schema), "classes")
    discard(held)
    roots = _components(classes, percent)
    discard(classes)
    return _with_components(rows, roots)


def _nothing(n: int):
    import pyarrow as pa

    return pa.nulls(n, pa.binary())


def differences(left: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """A row for each class of a long list beside the list's centre, a written table: g (a number), pivot (the centre), key,
    out (not linked with the centre), part (that of the centre, if linked with it), n, d (how many tokens only one of key
    and centre has), and places, the differing tokens that others have too: at and pos, rarest first.

    left: key, band, part, usual, n_keys. A token counts as another one where a class lacks it. The centre's own
    tokens are lacked by all classes and stand last."""
    many = left.filter(F.col("n_keys") > SMALL)
    centre = many.groupBy("band").agg(F.max(F.struct("usual", "key", "part")).alias("c")).select("band", F.col("c.key").alias("pivot"), F.col("c.part").alias("p_part"))
    rows = many.join(centre, "band").filter("key <> pivot").select("pivot", "p_part", "key", "part").distinct()
    side = lambda key, p: classes.select(F.col("class").alias(key), F.col("n").alias(f"{p}n"), "tokens").withColumnRenamed("tokens", f"{p}tokens")
    rows = rows.join(side("key", ""), "key").join(side("pivot", "p_"), "pivot")
    marked = lambda tokens, lacked: F.transform(tokens, lambda t: F.xxhash64("pivot", t, F.lit(lacked)))
    differing = F.concat(marked(F.array_except("tokens", "p_tokens"), 0), marked(F.array_except("p_tokens", "tokens"), 1))
    own, p_own = F.col("n") - F.size("tokens"), F.col("p_n") - F.size("p_tokens")
    rows = rows.select("pivot", "p_part", "key", "part", "n", "p_n", own.alias("own"), p_own.alias("p_own"), differing.alias("differing"))
    rows = rows.withColumn("d", F.col("own") + F.col("p_own") + F.size("differing"))
    out = (F.col("part") != F.col("p_part")) & (F.col("d") * (100 + percent) > (F.col("n") + F.col("p_n")) * (100 - percent))
    fresh = ~out & (F.col("part") != F.col("p_part"))
    rows = rows.select("pivot", "key", out.alias("out"), fresh.alias("fresh"), F.when(out, F.col("part")).otherwise(F.col("p_part")).alias("part"), "n", "own", "p_own", "d", "differing")
    rows = written(rows.withColumn("g", F.monotonically_increasing_id()), "differences")
    # Rarest first; what one class alone differs in meets nothing, but counts in the places.
    each = rows.select("g", F.explode("differing").alias("at"))
    often = each.groupBy("at").agg(F.count("*").alias("often")).filter("often > 1")
    shared = each.join(often, "at").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("often", "at"))).alias("shared"))
    lists = rows.join(shared, "g", "left").withColumn("shared", F.coalesce(F.col("shared.at"), F.array().cast("array<long>")))
    alone = F.col("own") + F.size("differing") - F.size("shared")
    places = F.transform("shared", lambda t, i: F.struct(t.alias("at"), (i + F.col("alone")).alias("pos")))
    last = F.when(F.col("p_own") > 0, F.array(F.struct(F.xxhash64("pivot").alias("at"), (F.col("alone") + F.size("shared")).alias("pos")))).otherwise(F.array())
    # Of two linked classes, the one that differs more has a shared token among its first ones.
    most = F.floor(F.col("n") * (100 - percent) / percent) + 1
    lists = lists.withColumn("alone", alone.cast("long")).withColumn("places", F.filter(F.concat(places, last), lambda x: x["pos"] < most))
    out = written(lists.select("g", "pivot", "key", "out", "fresh", "part", "n", "d", "places"), "lists")
    discard(rows)
    return out


def crowded_pairs(left: DataFrame, classes: DataFrame, near: Column, percent: int) -> DataFrame:
    """a, b (a < b), a written table: all pairs of classes of a list that can be linked, but for those of one part.

    Let D be what a class differs from the centre in. |A ^ B| = |D_A ^ D_B|, and A and B are linked if that is at most
    c (n_A + n_B), c = (100 - percent) / (100 + percent). If |D_A| + |D_B| is no more, both are linked with the centre: n_B is at
    most n_P + |D_B|, so |D_A| <= c (n_A + n_P) + c |D_B| - |D_B|. Else D_A and D_B share at least
    (|D_A| + |D_B| - c (n_A + n_B)) / 2 tokens, and the first of them in the common order leaves as many behind it."""
    few = left.filter((F.col("key") != F.col("least")) & (F.col("n_keys") <= SMALL)).select("band", "key", "part", "n", "pos")
    few = few.join(few.select("band", *(F.col(c).alias(f"p_{c}") for c in ("key", "part", "n", "pos"))), "band").filter("key < p_key AND part <> p_part").filter(near)
    lists = differences(left, classes, percent)
    first = lists.select("g", "key", "out", "part", "n", "d", F.inline("places"))
    # Of two classes one is not linked with the centre, or both would be of its part.
    met = first.filter("out").drop("out").join(first.select("at", *(F.col(c).alias(f"p_{c}") for c in ("g", "key", "out", "part", "n", "d", "pos"))), "at")
    met = met.filter("part <> p_part AND (NOT p_out OR g < p_g)").filter(F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent)
    behind = F.least(F.col("d") - F.col("pos"), F.col("p_d") - F.col("p_pos"))
    met = met.filter((F.col("d") + F.col("p_d") - 2 * behind) * (100 + percent) <= (F.col("n") + F.col("p_n")) * (100 - percent))
    with_centre = lists.filter("fresh").select("key", F.col("pivot").alias("p_key"))
    pairs = few.select("key", "p_key").union(met.select("key", "p_key")).union(with_centre)
    pairs = written(pairs.select(F.least("key", "p_key").alias("a"), F.greatest("key", "p_key").alias("b")).distinct(), "pairs")
    discard(lists)
    return pairs


def _components(classes: DataFrame, percent: int) -> DataFrame | None:
    """node, component of the classes that have links."""
    # pos: the token's place in the class's whole first order; tokens of frequency 1 stand before all of these.
    lists = classes.select(F.col("class").alias("key"), "n", F.posexplode("first").alias("pos", "band"), (F.col("n") - F.size("tokens")).alias("own"), "usual")
    lists = lists.select("key", "band", "n", (F.col("pos") + F.col("own")).alias("pos"), "usual")
    # The first token that two linked classes share leaves enough tokens behind it in both.
    near = F.least(F.col("n") - F.col("pos"), F.col("p_n") - F.col("p_pos")) * (100 + percent) >= (F.col("n") + F.col("p_n")) * percent
    near = near & (F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent)
    return grouped_components(
        lists, lambda pairs, _: linked_pairs(pairs, classes, percent), near=near, carried=("n", "pos", "usual"), one_first=True,
        crowded=lambda left: crowded_pairs(left, classes, near, percent),
    )


def _with_components(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    least = rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    if roots is not None:
        least = least.join(roots, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("component", "class").alias("root"))
        by_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
        least = least.join(by_root, "root").select("class", "component_id")
    else:
        least = least.select("class", F.col("least").alias("component_id"))
    joined = rows.join(least, "class", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_jaccard_join(spark, sf_dir) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
