"""Merkle manifest of a dataset by superblock reduction.

1. A row's leaf is the SHA-256 of its columns, each written with its length, so no two rows of different values
   give one byte string. Leaves are numbered inside their group (range partition, counts, prefix sums).
2. A superblock is the fanout**levels consecutive nodes of a group that one node `levels` levels above covers.
   applyInPandas collapses it to that node, so a pass over the leaves leaves one row a superblock, and the next pass
   treats these rows as its nodes, until each group has one node: its subroot. The subroots, numbered by group,
   are reduced in the same way to the root.
3. Proofs come back down the same passes: a superblock meets the proof of its own node (cogroup), forms its nodes'
   lower proofs again from their hashes, and puts the upper proof behind them. Lower proofs are never shuffled or stored.

What a task holds is one superblock, 256 nodes by default. A group may hold any share of the rows.

Defined results: a null value is "-", which no value gives; a null id comes first in its group, a null group first of all;
rows that repeat an id are ordered by leaf, and rows alike in all columns are leaves of their own, with their own proofs;
an empty table gives no rows; columns that are not named are no part of a leaf, and their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry import scratch
from heronry.operators.numbering import numbered

from .common import table

#: Columns of a document's leaf, in this order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
_NODE = "g long, i long, size long, hash string"


def leaf_of(values: Sequence[Column]) -> Column:
    """The hash of a row: of each value "-" if null, else its bytes in UTF-8, ":" and itself."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*(part(v.cast("string")) for v in values)), 256)


def folded(leaf: Column, positions: Column, siblings: Column) -> Column:
    """The root that a leaf and its proof give: its place among its run's nodes, and the others' hashes, level by level."""
    steps = F.arrays_zip(positions.alias("p"), siblings.alias("s"))
    own = lambda x: F.substring(x["s"], F.lit(1), x["p"] * HEX)
    rest = lambda x: F.substring(x["s"], x["p"] * HEX + 1, F.length(x["s"]))
    return F.aggregate(steps, leaf, lambda h, x: F.sha2(F.concat(own(x), h, rest(x)), 256))


def _levels(size: int, fanout: int, most: int) -> int:
    """Levels that a superblock of a group of this size climbs."""
    n = 0
    while n < most and size > fanout**n:
        n += 1
    return n


def _climb(hashes: list[str], fanout: int, levels: int):
    """The runs of each level, as one string a run, and the hashes that are left."""
    runs = []
    for _ in range(levels):
        runs.append(["".join(hashes[at : at + fanout]) for at in range(0, len(hashes), fanout)])
        hashes = [sha256(r.encode()).hexdigest() for r in runs[-1]]
    return runs, hashes


def collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """nodes: g, i (place in g), size (of g), hash. One row a superblock, in the same columns: the nodes of the next pass."""
    span = fanout**levels

    def collapse(key, pdf):
        import pandas as pd

        pdf, size = pdf.sort_values("i"), int(pdf["size"].iat[0])
        _, top = _climb(pdf["hash"].tolist(), fanout, _levels(size, fanout, levels))
        return pd.DataFrame({"g": [key[0]], "i": [key[1]], "size": [-(-size // span)], "hash": top})

    return nodes.groupBy("g", F.expr(f"i DIV {span}").alias("block")).applyInPandas(collapse, _NODE)


def proved(nodes: DataFrame, fanout: int, levels: int, above=None) -> DataFrame:
    """nodes with root, positions (array<int>) and siblings (array<string>, the hashes of a level as one string).

    above(tops) gives the proofs of the groups' last nodes (g, i, size, hash), and may add columns to them, which their
    nodes then get; without it these nodes are the roots. A pass writes one row for each superblock.
    """
    most = nodes.agg(F.max("size").alias("n")).first()["n"]
    if most is None or most <= 1:
        none = nodes.withColumns({"root": F.col("hash"), "positions": F.array().cast("array<int>"), "siblings": F.array().cast("array<string>")})
        return none if above is None else above(nodes)
    blocks = scratch.written(collapsed(nodes.select("g", "i", "size", "hash"), fanout, levels), "superblocks")
    upper = proved(blocks, fanout, levels, above)
    more = [(n, t) for n, t in upper.dtypes if n not in ("g", "i", "size", "hash", "positions", "siblings")]
    own = [n for n, _ in more]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*nodes.dtypes, *more, ("positions", "array<int>"), ("siblings", "array<string>")])
    span = fanout**levels

    def join(low, up):  # in Arrow, where an id beside a null stays whole
        import pyarrow as pa

        low = low.sort_by("i").drop_columns(["block"])
        runs, _ = _climb(low["hash"].to_pylist(), fanout, _levels(low["size"][0].as_py(), fanout, levels))
        top = {n: up[n][0].as_py() for n in (*own, "positions", "siblings")}
        positions, siblings = [], []
        for i in low["i"].to_pylist():
            at, places, others = i % span, [], []
            for level in runs:
                at, p = divmod(at, fanout)
                places.append(p)
                others.append(level[at][: p * HEX] + level[at][(p + 1) * HEX :])
            positions.append(places + top["positions"])
            siblings.append(others + top["siblings"])
        for n in own:
            low = low.append_column(n, pa.array([top[n]] * len(low), up.schema.field(n).type))
        return low.append_column("positions", pa.array(positions, pa.list_(pa.int32()))).append_column("siblings", pa.array(siblings, pa.list_(pa.string())))

    low = nodes.withColumn("block", F.expr(f"i DIV {span}"))
    up = upper.select(F.col("g").alias("g"), F.col("i").alias("block"), *own, "positions", "siblings")
    out = low.groupBy("g", "block").cogroup(up.groupBy("g", "block")).applyInArrow(join, schema)
    return scratch.carrying(out, blocks, upper)


def merkle_manifest(
    docs: DataFrame, columns: Sequence[str] = LEAF, *, id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None, fanout: int = 16, levels: int = 2
) -> DataFrame:
    """One row per row of docs: id, group, place, leaf, subroot, root, positions, siblings, and the columns of `carry`.

    carry: further small columns, computed from docs (such as the leaf of a changed row), that stay with their row.
    """
    key = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf_of([F.col(c) for c in columns]).alias("hash"), *(c.alias(f"carry_{n}") for n, c in (carry or {}).items()))
    groups = numbered(docs.groupBy(F.col(group_col).alias("own")).agg(F.count("*").alias("size")), [F.col("own").asc_nulls_first()], name="g")
    groups = scratch.carrying(scratch.written(groups, "groups"), groups)
    rows = numbered(key, ["id", "hash"], group=("grp",), name="i")
    nodes = rows.join(groups, F.col("grp").eqNullSafe(F.col("own"))).drop("own")

    def above(tops: DataFrame) -> DataFrame:
        heads = groups.agg(F.count("*").alias("n"))
        subroots = tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.col("hash")).crossJoin(F.broadcast(heads))
        subroots = proved(subroots.select("g", "i", F.col("n").alias("size"), "hash"), fanout, levels)
        out = tops.join(subroots.select(F.col("i").alias("g"), F.col("hash").alias("subroot"), "root", "positions", "siblings"), "g")
        return scratch.carrying(out, subroots)

    nodes = scratch.carrying(nodes, rows, groups)
    out = proved(nodes, fanout, levels, above)
    carried = (F.col(f"carry_{n}").alias(n) for n in (carry or {}))
    named = out.select(F.col("id").alias(id_col), F.col("grp").alias(group_col), F.col("i").alias("place"), F.col("hash").alias("leaf"), "subroot", "root", "positions", "siblings", *carried)
    return scratch.carrying(named, nodes, out)


def op11_merkle_manifest(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.translate("text", capitals, capitals.lower())
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    # Null where the text stays as it is, so most rows carry nothing.
    tampered = F.when(changed & (lower != F.col("text")), leaf_of([*map(F.col, LEAF[:-1]), lower]))
    found = merkle_manifest(docs, carry={"tampered": tampered})
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("positions"), F.col("siblings")))
    proof = F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
