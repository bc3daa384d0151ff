"""Distributed union-find (native): connected components by alternating large-star and small-star steps, and
components of keys that meet in groups of any size.

Every step is a minimum per node (pre-aggregated before the shuffle) joined back to the edges, so a
node with very many edges is split like any skewed join. What stands between steps is written to the shared
folder and deleted as soon as the next step has read it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Pivots of a band grow by this factor from round to round.
BASE = 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of u is tied to the least of u's neighbourhood; small: every smaller one and u."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tied = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return tied.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: two columns of long ids; one row per id in an edge: node, component (its least id). A written table.

    Loops, repeated and reversed edges are allowed and change nothing; edges with a null are ignored;
    no edges, no rows.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops, state = now.filter("a = b"), None
    first, now = now, now.filter("a <> b")
    held = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == state:
            break
        state = mark
        after = written(_star(_star(now, large=True), large=False), "edges")
        discard(held)
        held = now = after
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    lone = loops.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = written(found.union(roots).union(lone).groupBy("node").agg(F.min("component").alias("component")), "components")
    discard(first, held)
    return out


def _shared_bands(rows: DataFrame) -> DataFrame:
    """The rows of bands of two or more keys, with part (the key itself), least, level and n_keys, as long as no keys are linked."""
    whole = rows.groupBy("band").agg(F.count("*").alias("n_keys"), F.min("key").alias("least"), F.max("key").alias("most")).filter("least <> most")
    level = F.ceil(F.log("n_keys") / F.log(F.lit(float(BASE))) - 1e-9).cast("int").alias("level")
    return rows.join(whole.select("band", "least", level, "n_keys"), "band").select("band", *(c for c in rows.columns if c != "band"), F.col("key").alias("part"), "least", "level", "n_keys")


def grouped_components(
    rows: DataFrame, verified: Callable[[DataFrame, DataFrame], DataFrame], *, near: Column | None = None, carried: tuple[str, ...] = (), one_first: bool = False,
    crowded: Callable[[DataFrame], DataFrame] | None = None, passes: int = 1,
) -> DataFrame | None:
    """node, component of the keys that have links, a written table; None without links.

    rows: key, band (longs) and the columns carried, none of which is named part, least, level or n_keys. verified takes pairs (a < b) and the
    round's rows, which hold those of all later rounds but the first, and returns the pairs that are linked, as a written
    table (a, b). near may rule a pair out by the carried columns (those of the
    pivot begin with p_). Every pair of keys that share a band is verified, unless its keys are in one component by then.

    The pairs of a band are not all formed. In round 1 every key meets the band's least key (with one_first, in a
    round before it, only the least of its bands' least keys). In round r about BASE**(r - 1) keys, drawn by hash and
    new in each round, meet the others. A band ends when one component holds it or all its pairs have been met.
    Between rounds one pair of star steps draws components together, so some keys of one component may still go by two
    names and meet needlessly; at the end the steps go on until nothing changes.

    With crowded, round 2 is the last: it takes the rows of the bands that are left (key, band, least, part, n_keys: keys of the band) and
    returns pairs (a < b) as a written table, which must hold all pairs of a band's keys that can be linked.

    Most bands hold one key and go at once. Their rows are shuffled in as many passes as passes says, each over its
    part of the bands, so that only one part's shuffles are on disk at a time.
    """
    edges, before, r = None, None, 0 if one_first else 1
    while True:
        named = rows.withColumn("part", F.col("key"))
        if edges is not None:
            part = edges.groupBy("a").agg(F.min("b").alias("b"))
            named = rows.join(part, F.col("key") == F.col("a"), "left").select(*rows.columns, F.coalesce("b", "key").alias("part"))
        whole = named.groupBy("band").agg(F.count("*").alias("n_keys"), F.min("key").alias("least"), F.min("part").alias("lo"), F.max("part").alias("hi"))
        whole = whole.filter("lo <> hi").withColumn("level", F.ceil(F.log("n_keys") / F.log(F.lit(float(BASE))) - 1e-9).cast("int"))
        if r > 1:  # bands whose pairs have all been met are done
            whole = whole.filter((F.col("n_keys") > 2) & (F.col("level") >= r - 1))
        left = named.join(whole.select("band", "least", "level", "n_keys"), "band")
        if edges is None and passes > 1:
            of_pass = [written(_shared_bands(rows.filter(F.pmod("band", F.lit(passes)) == p)), "bands") for p in range(passes)]
            left = written(reduce(DataFrame.union, of_pass), "bands")
            discard(*of_pass)
        else:
            left = written(left, "bands")
        discard(before)
        if left.isEmpty():
            discard(left)
            break
        if crowded is not None and r == 2:
            pairs = crowded(left)
            links = verified(pairs, left)
            discard(pairs, left)
            after = written(links if edges is None else links.union(edges), "edges")
            discard(edges, links)
            edges = None if after.isEmpty() else after
            break
        every = lambda k: F.pow(F.lit(float(BASE)), F.greatest(F.col("level") - k, F.lit(0))).cast("long")
        due = lambda k: F.pmod(F.xxhash64("key"), every(k)) == 0
        first = F.col("key") == F.col("least")
        was = F.lit(False) if r < 2 else first if r == 2 else first | due(r - 2)
        fresh = first if r < 2 else due(r - 1) & ~was
        pivots = left.filter(fresh).select("band", F.col("key").alias("pivot"), F.col("part").alias("p_part"), *(F.col(c).alias(f"p_{c}") for c in carried))
        # Pairs with earlier pivots have been met; of two pivots of one round, one side is enough.
        pairs = left.filter(~was).withColumn("fresh", fresh).join(pivots, "band")
        pairs = pairs.filter((F.col("part") != F.col("p_part")) & ((F.col("key") < F.col("pivot")) | ~F.col("fresh")))
        pairs = pairs.filter(near) if near is not None else pairs
        if r == 0:
            pairs = pairs.groupBy("key").agg(F.min("pivot").alias("pivot"))
        pairs = written(pairs.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct(), "pairs")
        links = verified(pairs, left)
        discard(pairs)
        if not links.isEmpty():
            after = written(_star(_star(links if edges is None else links.union(edges), large=True), large=False), "edges")
            discard(edges)
            edges = after
        discard(links)
        rows, before, r = left.select("key", "band", *carried), left, r + 1
    if edges is None:
        return None
    found = connected_components(edges)
    discard(edges)
    return found


def _centred(left: DataFrame) -> DataFrame:
    """left (key, band, least, n_keys) with pivot in place of least: of three or more keys, the one that meets the most
    keys in all its bands.

    In a family of copies that differ from one original here and there, that is the copy nearest to the original: it
    is in most of the family's bands, and so the pivot of most of them.
    """
    weight = left.groupBy("key").agg(F.sum("n_keys").alias("weight"))
    most = left.filter("n_keys > 2").join(weight, "key").groupBy("band").agg(F.max(F.struct("weight", "key")).alias("most"))
    return left.join(most, "band", "left").select("key", "band", F.coalesce("most.key", "least").alias("pivot"), "n_keys")


def _unlike(left: DataFrame, part: DataFrame) -> DataFrame:
    """The rows of bands that one component does not hold, with part: the key's component, a written table."""
    named = left.select("key", "band", "pivot", "n_keys").join(part.select(F.col("node").alias("key"), "component"), "key", "left")
    named = named.select("key", "band", "pivot", F.coalesce("component", "key").alias("part"), "n_keys")
    whole = named.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select("band")
    return written(named.join(whole, "band", "left_semi"), "bands")


def _with_links(part: DataFrame, pairs: DataFrame, verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """part (node, component), a written table, with the links that verified finds among pairs; takes both tables' place."""
    links = verified(pairs)
    discard(pairs)
    before = part
    if not links.isEmpty():
        part = connected_components(links.union(before.select("node", "component")))
        discard(before)
    discard(links)
    return part


def centred_components(
    rows: DataFrame, verified: Callable[[DataFrame], DataFrame], crowded: Callable[[DataFrame], DataFrame], passes: int = 1,
    central: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame | None:
    """node, component of the keys that have links, a written table; None without links.

    rows: key, band (longs). verified takes pairs (a < b) and returns those that are linked, as a written table (a, b).
    At first every key meets the pivot of each of its bands (`_centred`). The bands that one component does not hold then
    go to crowded (key, band, pivot, part: the key's component, n_keys: keys of the band), which returns pairs (a < b)
    as a written table; it must hold all pairs of a band's keys, but for the pivot and keys of one part, that can be linked.
    With central, which takes such rows and returns (pivot, centre), a written table, the keys beside a pivot first meet its
    centre, if it has one, and that becomes their pivot.

    Most bands hold one key and go at once. Their rows are shuffled once, in as many passes as passes says, each over its
    part of the bands, so that only one part's shuffles are on disk at a time.
    """

    def shared(of: DataFrame) -> DataFrame:
        of = of.repartition("band")
        whole = of.groupBy("band").agg(F.count("*").alias("n_keys"), F.min("key").alias("least")).filter("n_keys > 1")
        return of.join(whole.hint("shuffle_hash"), "band").select("key", "band", "least", "n_keys")

    of_pass = [written(shared(rows.filter(F.pmod("band", F.lit(passes)) == p)), "bands") for p in range(passes)]
    left = written(_centred(reduce(DataFrame.union, of_pass)), "bands")
    discard(*of_pass)
    pairs = written(left.filter("key <> pivot").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct(), "pairs")
    links = verified(pairs)
    discard(pairs)
    part = connected_components(links)
    discard(links)
    left, before = left.filter("n_keys > 2"), left
    still = _unlike(left, part)
    discard(before)
    if central is not None and not still.isEmpty():
        centres = central(still)
        moved = still.join(F.broadcast(centres), "pivot", "left").select("key", "band", F.coalesce("centre", "pivot").alias("pivot"), "n_keys", F.col("centre").isNotNull().alias("moved"))
        moved = written(moved, "bands")
        discard(centres, still)
        pairs = moved.filter("moved AND key <> pivot").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
        pairs = written(pairs, "pairs")
        part = _with_links(part, pairs, verified)
        still = _unlike(moved, part)
        discard(moved)
    if not still.isEmpty():
        part = _with_links(part, crowded(still), verified)
    discard(still)
    if part.isEmpty():
        discard(part)
        return None
    return part
