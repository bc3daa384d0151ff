"""The Merkle manifest, byte pairs and spelling variants against plain versions and libraries, and their edges."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import byte_pairs, merkle, spelling, sql
from heronry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return con


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name,text", [("op11_merkle_manifest", sql.MERKLE_MANIFEST), ("op13_spelling_variants", sql.SPELLING_VARIANTS)])
def test_queries_equal_their_sql(spark, duck, name, text):
    found = QUERIES[name](spark, SF)
    want = duck.execute(text)
    names = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in found.collect()))) == sorted(map(str, want.fetchall()))
    assert set(names) == set(found.columns)


# ---- Merkle manifest ------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(hashes, fanout):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_manifest(rows, fanout):
    """rows: (id, group, text). id, group, leaf, subroot, root, positions, siblings, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], plain_leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain_tree([h for _, h in groups[g]], fanout)
    top = plain_tree([trees[g][-1][0] for g in order], fanout)

    def path(levels, i):
        for level in levels[:-1]:
            run = level[i // fanout * fanout : (i // fanout + 1) * fanout]
            yield i % fanout, "".join(run[: i % fanout] + run[i % fanout + 1 :])
            i //= fanout

    for k, g in enumerate(order):
        for i, (d, leaf) in enumerate(groups[g]):
            proof = [*path(trees[g], i), *path(top, k)]
            yield d, g, leaf, trees[g][-1][0], top[-1][0], [p for p, _ in proof], [s for _, s in proof]


@pytest.mark.parametrize("fanout,levels", [(2, 2), (3, 1), (16, 2)])
def test_manifest_equals_a_plain_tree(spark, fanout, levels):
    rng = random.Random(7)
    ids = [None, None, 2**53 + 1, *range(300)]
    rows = [(i, rng.choice(["hot"] * 8 + ["é", "a", None]), rng.choice([None, "", "Text", "x" * 5000])) for i in ids]
    rows += [(1000, "lone", "one"), (5, "hot", "again"), *[(7, "hot", "same")] * 3]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("hash", F.lit(1)).withColumn("g", F.lit("x"))
    found = merkle.merkle_manifest(df, ("doc_id", "source", "text"), fanout=fanout, levels=levels, carry={"hash_": F.lit("kept")})
    got = [(r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], r["positions"], r["siblings"]) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_manifest(rows, fanout)))
    folded = merkle.folded(F.col("leaf"), F.col("positions"), F.col("siblings"))
    assert found.filter(folded != F.col("root")).count() == 0
    wrong = merkle.folded(F.sha2("leaf", 256), F.col("positions"), F.col("siblings"))
    assert found.filter(wrong == F.col("root")).count() == 0


def test_manifest_of_none_and_one(spark):
    one = spark.createDataFrame([(3, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.merkle_manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == digest("1:3----") and row["positions"] == [] == row["siblings"]
    assert merkle.merkle_manifest(one.limit(0)).collect() == []


# ---- byte pairs -----------------------------------------------------------------------------------

TEXTS = [
    None, "", " ", "\n\n  \t x", "a" * 5000, "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endof", "don't we'll I'M it''s", "É" * 40 + " x" * 30,
    "\U00032400Ᲊ՘ x՘", "日本語のテキスト と english", "é‍👩‍👩‍👧 1٣½ 　\x85\x1c z", "long " * 3000, "\x00�￿", "tab\t\ttabs    end  ",
]


def test_byte_pairs_equal_the_library(spark, path, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "aAéñ ß.,'s1 9\n\t-_日<|endoftext|>"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)]
    ids = [None if i == 4 else 2**53 + i // 2 for i in range(len(texts))]  # one null, others twice
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    encoded = byte_pairs.encode_documents(df, path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    rows = [(i, len(w), np.array(w, "<u4").tobytes()) for i, w in zip(ids, want, strict=True)]
    assert sorted(map(str, map(tuple, [(r[0], r[1], bytes(r[2])) for r in encoded.collect()]))) == sorted(map(str, rows))
    back = byte_pairs.decode_documents(encoded, path).collect()
    assert Counter(r["text"] for r in back) == Counter(library.decode(w, skip_special_tokens=False) for w in want)
    assert encoded.limit(0).count() == 0
    # Cutting a text into parts, and emptying the table of pieces, change nothing.
    model = byte_pairs.BytePairs(path)
    monkeypatch.setattr(byte_pairs, "CHARS_AT_ONCE", 7)
    monkeypatch.setattr(byte_pairs, "HELD", 5)
    for text, w in zip(texts, want, strict=True):
        assert model.encode(text or "") == np.array(w, "<u4").tobytes()


def test_decoding_ids_that_are_no_text(path):
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(path), byte_pairs.BytePairs(path)
    rng = random.Random(4)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        byte_pairs.BytePairs(public_tokenizers.path("word_bpe_49k.json"))


def test_op12_digests(spark, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op12_byte_pairs"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ---- spelling variants ----------------------------------------------------------------------------


def plain_near(words):
    letters = sorted({c for w in words for c in w})
    known, out = set(words), set()
    for w in words:
        for i in range(len(w) + 1):
            edits = {w[:i] + w[i + 1 :], *(w[:i] + c + w[i:] for c in letters), *(w[:i] + c + w[i + 1 :] for c in letters if i < len(w))}
            out |= {(min(w, v), max(w, v)) for v in edits & known if v != w}
    return out


@pytest.mark.parametrize("most", [2, 7, 1024])
def test_near_words_lose_no_pair(spark, most):
    """Words that crowd blocks: all of one beginning, one end, repeated letters, and long ones."""
    rng = random.Random(most)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 11))) for _ in range(400)}
    words |= {"preface" + "".join(rng.choice("xyé") for _ in range(rng.randrange(4))) for _ in range(60)}
    words |= {"".join(rng.choice("xyz") for _ in range(rng.randrange(1, 4))) + "ending" for _ in range(60)}
    words |= {"z" * n for n in (6, 7, 8, 9, 40, 41, 200)} | {"q" * 100 + c + "q" * 100 for c in "abc"}
    rows = [(w, rng.randrange(5, 99)) for w in sorted(words)]
    n = dict(rows)
    found = spelling.near_pairs(spark.createDataFrame(rows, "word string, n long"), 6, most).collect()
    assert len(found) == len({(r["a"], r["b"]) for r in found}) and {(r["a"], r["b"]) for r in found} == plain_near(words)
    assert all((r["an"], r["bn"]) == (n[r["a"]], n[r["b"]]) for r in found)


def test_blocks_stay_small(spark):
    """Words of one first half and one last half: split until they are small or differ in one letter only."""
    rows = [(f"common{a}{b}{c}{d}shared", 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh" for d in "abcd"]
    words = spark.createDataFrame(rows, "word string, n long")
    sizes = [r["count"] for r in spelling.blocks(words, 6, 64).groupBy("key").count().collect()]
    assert max(sizes) <= 64


def test_forms_and_roots(spark):
    counts = {"strasse": 700, "strase": 130, "strae": 99, "strases": 20, "strasess": 3, "haeuser": 5, "haeusere": 25, "haeuserd": 25, "Wörter": 6, "wörter": 3, "lonely": 5}
    texts = [(i, " ".join([w] * n) + "\n\n1") for i, (w, n) in enumerate(counts.items())]
    df = spark.createDataFrame([*texts, (99, None), (None, "")], "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(0))
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(df, slip=10**9).collect()}
    assert got == {
        "strasse": (700, 1, None, None, "strasse"), "strase": (130, 2, "strasse", 700, "strasse"), "strases": (20, 1, "strase", 130, "strasse"),
        "haeuser": (5, 2, "haeuserd", 25, "haeuserd"), "haeusere": (25, 2, None, None, "haeusere"), "haeuserd": (25, 2, None, None, "haeuserd"),
        "wörter": (9, 0, None, None, "wörter"), "lonely": (5, 0, None, None, "lonely"),
    }
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def test_slips_remove_one_letter(spark):
    rows = [(i, f"Buchstabe {i} gröss") for i in range(400)]
    want = Counter()
    for i, _ in rows:
        h = zlib.crc32(f"{i}:buchstabe".encode())
        want["buchstabe"[: h % 9] + "buchstabe"[h % 9 + 1 :] if h % 7 == 0 else "buchstabe"] += 1
    got = spelling.counted_words(spark.createDataFrame(rows, "doc_id long, text string"), id_col="doc_id", text_col="text", least_chars=6, least_count=1, slip=7)
    assert {r["word"]: r["n"] for r in got.collect()} == dict(want)


def test_one_edit():
    assert all(spelling.one_edit(a, b) for a, b in (("abc", "abd"), ("abc", "ab"), ("ab", "abc"), ("aab", "ab"), ("", "x")))
    assert not any(spelling.one_edit(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abcd", "ab"), ("abc", "xyc")))
