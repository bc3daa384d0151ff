"""Byte-pair encoding and decoding by the merge table of a tokenizer file (byte-level, as its JSON describes it).

1. A text is cut at the file's added tokens, then into pieces by the byte-level pattern; a piece is its bytes.
2. A piece is a doubly linked list of symbols. A queue holds the rank of each neighbouring pair that can merge, ordered by
   rank, then place. The least entry merges its pair, if that pair still stands there (an entry whose symbol is gone, or
   whose pair has another rank by now, is stale and is passed over), and the new symbol's two pairs are queued.
3. Decoding concatenates the vocabulary's strings: bytes, read as UTF-8 with the replacement character for what is none.

The work is one pass over the texts without a shuffle. A worker keeps the ids of pieces it has met in two tables of at most
HELD pieces each, a new one and the one before it; what is met again moves to the new one. Long texts are cut before a space between two other characters, where a piece always begins, so what a
task holds follows the longest run without one, not the text; ids and decoded texts leave by row. A text with code points
above U+FFFF, or without a category in Python's Unicode tables, is cut into pieces by the library's own byte-level cutter.

Defined results: null and empty texts give no ids and an empty text; every row gives a row, repeated ids and rows too; a null
id stays null; an empty table gives no rows; other columns are ignored. Files whose parts are of other kinds (a normalizer,
another model, flags on added tokens) are refused with ValueError, not approximated.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidied

#: Pieces whose ids one of a worker's two tables keeps, the longest piece that is kept, and the characters that are cut into pieces at once.
HELD, HELD_CHARS, CHARS_AT_ONCE = 200_000, 64, 1_000_000
#: Bytes of text whose results leave a task at once.
BYTES_AT_ONCE = 4_000_000
#: Code points below this one have two bytes in UTF-16.
BASIC = 0x10000
_PLACE_BITS = 40
_PLACE = (1 << _PLACE_BITS) - 1
_MODELS: dict[str, BytePairs] = {}


def _of(test) -> str:
    """The code points of two bytes that pass a test, as the inside of a pattern's set."""
    ranges, start = [], None
    for c in range(BASIC + 1):
        held = c < BASIC and test(chr(c))
        if held and start is None:
            start = c
        elif not held and start is not None:
            ranges.append(rf"\u{start:04x}-\u{c - 1:04x}")
            start = None
    return "".join(ranges)


def pieces_pattern() -> re.Pattern:
    """The byte-level pattern: a clitic, a run of letters, of numbers or of other marks, each with one space before it if
    there is one, and runs of white space, without the last one where something follows."""
    letter, number = (_of(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    space = _of(lambda c: c.isspace() and not "\x1c" <= c <= "\x1f")  # Unicode's White_Space lacks the separators
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?(?:[{letter}]+|[{number}]+|[^{space}{letter}{number}]+)|[{space}]+(?![^{space}])|[{space}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one above 255."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return [chr(b if b in prints else 256 + rest.index(b)) for b in range(256)]


class _Kept(dict):
    """The ids of pieces, as bytes; a missing piece is encoded and kept. A full table becomes the one before, whose pieces
    come back when they are met, so frequent pieces are not encoded again."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= HELD_CHARS:
            if len(self) >= HELD:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    """Encodes and decodes by a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before, after = told["model"], told["pre_tokenizer"], told["decoder"]
        plain = {k: model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
        byte_level = before and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if model["type"] != "BPE" or any(plain.values()) or told["normalizer"] or not byte_level or not after or after["type"] != "ByteLevel":
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        if any(t[f] for t in told["added_tokens"] for f in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens with flags")
        vocabulary, letters = model["vocab"], byte_letters()
        byte_of = {c: bytes([b]) for b, c in enumerate(letters)}
        self.byte_ids = [vocabulary[c] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        strings = vocabulary | {t["content"]: t["id"] for t in told["added_tokens"]}
        self.strings = [b""] * (max(strings.values()) + 1)
        for s, i in strings.items():
            self.strings[i] = b"".join(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in told["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.pieces, self.border, self.known = pieces_pattern(), re.compile(r"\S(?= \S)"), set()
        self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.kept = _Kept(self._piece)

    def merged(self, symbols: list[int]) -> list[int]:
        """The ids that a list of symbols merges to."""
        n, pair_of, pop, push = len(symbols), self.merges.get, heappop, heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [m[0] << _PLACE_BITS | i for i, m in enumerate(map(pair_of, zip(symbols, symbols[1:], strict=False))) if m]
        heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & _PLACE
            j, left = after[i], symbols[i]
            if left < 0 or j >= n:
                continue  # stale: the symbol went into another, or is the last by now
            found = pair_of((left, symbols[j]))
            if found is None or found[0] != entry >> _PLACE_BITS:
                continue  # stale: another pair stands here
            new = symbols[i] = found[1]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := pair_of((new, symbols[k])):
                    push(queue, m[0] << _PLACE_BITS | i)
            if (h := before[i]) >= 0 and (m := pair_of((symbols[h], new))):
                push(queue, m[0] << _PLACE_BITS | h)
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> bytes:
        ids = self.merged(list(map(self.byte_ids.__getitem__, piece.encode())))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _parts(self, text: str):
        """A text in parts of about CHARS_AT_ONCE characters, each of which begins where a piece begins."""
        at = 0
        while len(text) - at > CHARS_AT_ONCE:
            end = self.border.search(text, at + CHARS_AT_ONCE - 1)
            if end is None:
                break
            yield text[at : end.end()]
            at = end.end()
        yield text[at:] if at else text

    def _cut(self, text: str) -> list[str]:
        fresh = set(text) - self.known
        if fresh:
            self.known |= (plain := {c for c in fresh if ord(c) < BASIC and unicodedata.category(c) != "Cn"})
            if len(plain) < len(fresh):
                return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]
        return self.pieces.findall(text)

    def encode(self, text: str) -> bytes:
        """The ids of a text, each as four bytes, little-endian."""
        if self.cut is None or not self.cut.search(text):
            return b"".join(b"".join(map(self.kept.__getitem__, self._cut(p))) for p in self._parts(text))
        found = (([self.added[s]] if i % 2 else [self.encode(s)]) for i, s in enumerate(self.cut.split(text)) if s)
        return b"".join(chain.from_iterable(found))

    def decode(self, ids: bytes) -> str:
        import numpy as np

        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def model(path: str) -> BytePairs:
    """This worker's model of that file."""
    if path not in _MODELS:
        _MODELS[path] = BytePairs(path)
    return _MODELS[path]


def _mapped(df: DataFrame, path: str, work, id_type: str, fields: str) -> DataFrame:
    """df: id and a column to work on. work(model, value) gives the values of `fields`, by row."""

    def run(batches):
        import pyarrow as pa

        held = model(path)
        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            at = 0
            while at < len(values):
                rows, size, start = [], 0, at
                while at < len(values) and size < BYTES_AT_ONCE:
                    value = values[at].as_py()
                    size += len(value or "")
                    rows.append(work(held, value))
                    at += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(start, at - start), *columns], names)

    import pyarrow as pa

    of = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names, types = ["id"], []
    for field in fields.split(", "):
        names.append(field.split(" ")[0])
        types.append(of[field.split(" ")[1]])
    return df.mapInArrow(tidied(run), f"id {id_type}, {fields}")


def encode_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and ids (binary: each id as four bytes, little-endian) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def work(held: BytePairs, text: str | None):
        ids = held.encode(text or "")
        return len(ids) // 4, ids

    return _mapped(rows, tokenizer, work, dict(rows.dtypes)["id"], "n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, tokenizer: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and text of rows of ids as `encode_documents` gives them."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    work = lambda held, ids: (ids or b"", held.decode(ids or b""))
    return _mapped(rows, tokenizer, work, dict(rows.dtypes)["id"], "ids binary, text string").withColumnRenamed("id", id_col)


def op12_byte_pairs(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encode_documents(table(spark, sf_dir, "documents"), path).select("doc_id", "ids")
    back = decode_documents(ids, path)
    n = (F.octet_length("ids") / 4).cast("long")
    return back.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
