"""Quality rules, line first (native): lines are judged alone, failing lines go, and a document
that loses too much of its text goes with them.

Everything happens inside the row with built-in functions: no shuffle, one scan, any text length.

Defined results: a null text counts as empty; a text without words has n_words 0 and fails;
repeated rows each give a row; other columns of the input are ignored, so their names cannot clash;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD, text_of

TERMINAL = r"[.!?:;…。！？][\"'”’»)\]]*$"

# Phrases that mark boilerplate lines.
BOILERPLATE = (
    "all rights reserved",
    "terms of (use|service)",
    "privacy policy",
    "cookie (policy|settings|notice)",
    "(we|this site) uses? cookies",
    "licensed under",
    "is licensed",
    "copyright (\\(c\\)|©|[0-9]{4})",
    "subscribe to our newsletter",
    "sign up for our",
    "click here to",
    "enable javascript",
    "powered by",
    "lorem ipsum",
)
NAVIGATION = r"[|»›>·•](?=\s|$)"


def repeated_words(hashes: Column, order: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more.

    order holds the windows' hashes sorted, the window's place in the low 17 bits. Neighbours that
    agree above those bits are compared by the full hash.
    """
    place = lambda x: x.bitwiseAND(F.lit(0x1FFFF)).cast("int")
    full = lambda x: F.get(hashes, place(x))
    near = F.filter(
        F.sequence(F.lit(0), F.size(order) - 2),
        lambda i: F.shiftright(F.get(order, i).bitwiseXOR(F.get(order, i + 1)), 17) == 0,
    )
    same = F.filter(near, lambda i: full(F.get(order, i)) == full(F.get(order, i + 1)))
    starts = F.flatten(F.transform(same, lambda i: F.array(place(F.get(order, i)), place(F.get(order, i + 1)))))
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def repeated_words_any_length(hashes: Column) -> Column:
    """The same for texts of more windows than 17 bits can number: sorts pairs of hash and place."""
    sorted_pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(pairs: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.size(pairs) - 1),
            lambda j: F.coalesce(F.get(pairs, j)["h"] == F.get(pairs, j - 1)["h"], F.lit(False)) | F.coalesce(F.get(pairs, j)["h"] == F.get(pairs, j + 1)["h"], F.lit(False)),
        )
        starts = F.transform(places, lambda j: F.get(pairs, j)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    # As an element of an array the sorted pairs are made once, not once an element.
    return F.get(F.transform(F.array(sorted_pairs), covered), F.lit(0))


def line_fails(line: Column, long_line: int = 300, boilerplate_chars: int = 240) -> Column:
    """True if a line with words breaks the punctuation, navigation or boilerplate rule.

    Lines of long_line characters or more are paragraphs: a sentence's end inside them is enough. Boilerplate phrases
    mark lines of up to boilerplate_chars characters; in longer ones they may stand in prose.

    Cheap tests stand first; the word counts run only on lines that a cheap test marks.
    """
    words = F.regexp_count(line, F.lit(WORD))
    start = F.substring(line, 1, 40)
    ended = F.right(F.rtrim(line), F.lit(4)).rlike(TERMINAL) | ((F.length(line) >= long_line) & line.rlike(r"\p{L}[.!?] "))
    symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>]")) * 10 > F.length(line)
    shouts = (line.contains("!!") | line.contains("??")) & (words >= 3) & (F.regexp_count(line, F.lit("[!?]")) * 2 > words)
    capitals = (F.upper(start) == start) & (F.upper(line) == line) & (F.lower(line) != line) & (words >= 5)
    bars = F.regexp_count(line, F.lit(NAVIGATION))
    navigation = line.rlike(NAVIGATION) & (bars >= 2) & (bars * 4 >= words)
    boilerplate = (F.length(line) <= boilerplate_chars) & line.rlike("(?i)" + "|".join(BOILERPLATE))
    return ~ended | symbols | shouts | capitals | navigation | boilerplate


def line_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_loss: float = 0.3, long_line: int = 300, boilerplate_chars: int = 240) -> DataFrame:
    """One row per document: id, the cleaned text, the counts, base_failed and kept.

    n_repeat_words counts words in 3-word windows found twice or more in the text. Kept documents
    lose at most max_loss of their words with the failing lines.
    """
    has_word = lambda line: line.rlike(WORD)
    text = F.col("text")
    docs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    docs = docs.withColumn("words", F.array_remove(F.split(text, BLANK, -1), ""))
    n = F.size("words")
    window = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    lines = F.split(text, "\n", -1)
    docs = docs.select(
        "doc_id", n.cast("long").alias("n_words"), window.alias("h"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(lines, has_word).alias("word_lines"),
        F.filter(lines, lambda line: ~has_word(line) | ~line_fails(line, long_line, boilerplate_chars)).alias("good_lines"),
    )
    low = F.lit(~0x1FFFF)
    docs = docs.withColumn("order", F.sort_array(F.transform("h", lambda h, i: h.bitwiseAND(low).bitwiseOR(i.cast("long").bitwiseAND(F.lit(0x1FFFF))))))
    repeated = F.when(F.size("h") < 2, F.lit(0)).when(F.size("h") <= 0x20000, repeated_words(F.col("h"), F.col("order"))).otherwise(repeated_words_any_length(F.col("h")))
    docs = docs.select(
        "doc_id", "n_words",
        "word_chars", "n_symbols",
        (F.size("word_lines") - F.size(F.array_distinct("word_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.array_join("good_lines", "\n").alias("clean_text"),
    )
    docs = docs.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    docs = docs.withColumn("clean_words", F.regexp_count("clean_text", F.lit(WORD)).cast("long"))
    lost = F.col("n_words") - F.col("clean_words")
    return docs.withColumn("kept", ~F.col("base_failed") & (lost <= F.lit(float(max_loss)) * F.col("n_words")))


def op9_line_rules(spark, sf_dir) -> DataFrame:
    from .common import table

    return line_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_words"
    )
