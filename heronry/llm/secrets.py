"""Secret scan (native): three fixed patterns, and windows of high Shannon entropy in candidate strings.

A candidate is a whole run of 20 or more characters of ``[A-Za-z0-9+/_=-]``.
A window of `width` characters slides over it; the counts of its characters, and from them the sum
of n*log2(n), are kept up to date by taking one character out and one in. Where the entropy
log2(width) - sum/width reaches the threshold of the candidate's character class (hex, letters and
digits, base64; a stricter one for runs without a digit), the windows merge into spans of kind ``entropy``. Windows
that a match of the allow-list (placeholders, runs of one character, alphabets) overlaps are passed over, and so
are candidates that a rule for whole runs (^...$: UUIDs, numbers, words with a number) matches, and spans inside a
span of the fixed patterns.

All positions are code points of the original text, ends exclusive. All work happens inside the row.

Defined results: a null or empty text has no spans; repeated rows each give a row; other columns
of the input are ignored, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from math import log2
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are greedy, so a run that is long enough is the same match with the length in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A whole run; the loop is possessive, so long runs stay linear.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

# Strings that look random and are not secret.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy",
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    r"(.)\1{7,}",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"^[0-9_=+/-]+$",
    r"^[A-Za-z]+([-_/][A-Za-z]+)*[-_/][0-9]{1,8}$",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<s:int,k:int,e:int>>"


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s,e,v>> of the leftmost non-overlapping matches: what stands between them gives their places."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def step(done: Column, pair: Column) -> Column:
        start = F.coalesce(_last(done)["e"], F.lit(0)) + F.length(pair["gap"])
        return F.concat(done, F.array(F.struct(start.alias("s"), (start + F.length(pair["v"])).alias("e"), pair["v"].alias("v"))))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("v")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step)).otherwise(zero)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), m["e"].alias("e")))


def hot_windows(value: Column, blocked: Column, width: int, hex_bits: float, mixed_bits: float, base64_bits: float, letter_bits: float) -> Column:
    """array<struct<s,e>>: merged windows of the string whose entropy reaches its class's threshold and that no
    span of blocked, array<struct<s,e,v>>, overlaps."""
    gain = F.array(*[F.lit((n + 1) * log2(n + 1) - (n * log2(n) if n else 0.0)) for n in range(width)])
    code = lambda ch: F.instr(F.lit(ALPHABET), ch) - 1
    threshold = F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(hex_bits)).when(~value.rlike("[0-9]"), F.lit(letter_bits))
    threshold = threshold.when(value.rlike("[+/_=-]"), F.lit(base64_bits)).otherwise(F.lit(mixed_bits))
    codes = F.transform(F.split(value, ""), code)
    spans = "array<struct<s:int,e:int>>"
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"), F.lit(-1).alias("from"),
        F.lit(-1).alias("to"), F.array().cast(spans).alias("out"),
    )

    def scan(both: Column) -> Column:
        codes, threshold, blocked = both["codes"], both["threshold"], both["blocked"]

        def step(st: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.when(i >= width, F.get(codes, i - width)).otherwise(F.lit(-1))
            without = F.when(old >= 0, st["sum"] - F.get(gain, F.get(st["n"], old) - 1)).otherwise(st["sum"])
            held = F.get(st["n"], new) - F.when(old == new, 1).otherwise(0)
            total = without + F.get(gain, held)
            counts = F.transform(st["n"], lambda c, j: c + F.when(j == new, 1).otherwise(0) - F.when(j == old, 1).otherwise(0))
            hot = (i >= width - 1) & (F.lit(log2(width)) - total / width >= threshold)
            first = i - width + 1
            hot = hot & ~F.exists(blocked, lambda b: (b["s"] <= i) & (b["e"] > first))
            apart = hot & (st["from"] >= 0) & (first > st["to"])
            return F.struct(
                counts.alias("n"), total.alias("sum"),
                F.when(hot & ((st["from"] < 0) | apart), first).otherwise(st["from"]).alias("from"),
                F.when(hot, i + 1).otherwise(st["to"]).alias("to"),
                F.when(apart, F.concat(st["out"], F.array(F.struct(st["from"].alias("s"), st["to"].alias("e"))))).otherwise(st["out"]).alias("out"),
            )

        def end(st: Column) -> Column:
            return F.when(st["from"] >= 0, F.concat(st["out"], F.array(F.struct(st["from"].alias("s"), st["to"].alias("e"))))).otherwise(st["out"])

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, end)

    return F.get(F.transform(F.array(F.struct(codes.alias("codes"), threshold.alias("threshold"), blocked.alias("blocked"))), scan), F.lit(0))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def secret_spans(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 20, hex_bits: float = 2.9, mixed_bits: float = 3.6, base64_bits: float = 3.6, letter_bits: float = 4.0, allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """id, text, base and spans: arrays of struct(s start, k place in KINDS, e end), ordered by start, then kind."""
    text = F.col("text")
    docs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    docs = docs.select(
        "doc_id", "text",
        F.when(text.rlike(r"(?i)(word|passwd|secret|token|key)[\"']?\x20*[:=]"), matches(text, ASSIGN)).alias("assign"),
        matches(text, ACCESS).alias("access"), matches(text, HEX).alias("hex"), matches(text, CANDIDATE).alias("runs"),
    )
    value = lambda m: F.regexp_extract(m["v"], ASSIGN, 2)
    assign = F.filter(F.coalesce("assign", F.array().cast("array<struct<s:int,e:int,v:string>>")), lambda m: F.length(value(m)) >= 6)
    base = F.array_sort(F.concat(_spans(assign, "assign"), _spans(F.col("access"), "access"), _spans(F.col("hex"), "hex")))
    docs = docs.withColumn("base", base)
    # One pattern at a time, as their groups have numbers.
    whole = [x for x in allowed if x.removeprefix("(?i)").startswith("^") and x.endswith("$")]
    inside = [x for x in allowed if x not in whole]
    suspect = F.filter("runs", lambda m: ~reduce(or_, [m["v"].rlike(x) for x in whole], F.lit(False)))
    blocked = lambda v: F.concat(F.array().cast("array<struct<s:int,e:int,v:string>>"), *(matches(v, x) for x in inside))
    hot = F.flatten(F.transform(
        suspect,
        lambda m: F.transform(
            hot_windows(m["v"], blocked(m["v"]), width, hex_bits, mixed_bits, base64_bits, letter_bits),
            lambda w: F.struct((m["s"] + w["s"]).alias("s"), F.lit(KINDS.index("entropy")).alias("k"), (m["s"] + w["e"]).alias("e")),
        ),
    ))
    covered = lambda x: F.exists("base", lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"]))
    more = F.when(F.size("runs") > 0, F.filter(hot, lambda x: ~covered(x))).otherwise(F.array().cast(SPAN))
    return docs.select("doc_id", "text", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def op2_secret_scan(spark, sf_dir) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
