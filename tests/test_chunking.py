import random
import re

from heronry.operators import chunking, code_chunks


def plain_windows(t, size=1200, overlap=200):
    t = t.strip()
    if len(t) <= size:
        return [t] if t else []
    out, at = [], 0
    while True:
        end = at + size
        if end < len(t) and (cut := t.rfind(" ", at + size // 2, end)) != -1:
            end = cut
        if t[at:end].strip():
            out.append(t[at:end].strip())
        if end >= len(t):
            return out
        at = end - overlap


def plain_sections(text, title):
    heads, out, held = ({0: title} if title and title != "NOT FOUND" else {}), [], []
    crumb = lambda: " > ".join(heads[k] for k in sorted(heads)) if heads else title
    now = crumb()
    for line in [*text.strip().splitlines(), None]:
        m = line is not None and (re.match(r"(#{1,6})\s+(.+)$", line.strip()) or re.match(r"(={1,6})\s*(.*?)\s*\1$", line.strip()))
        if line is None or m:
            body = "\n".join(held).strip()
            if body:
                out.append((now, body))
                held = []
            if m:
                level, t = len(m[1]), m[2].strip()
                if title and t.lower() == title.strip().lower():
                    level = None
                    heads[0] = t
                else:
                    heads = {k: v for k, v in heads.items() if k < level} | {level: t}
                now = crumb()
        else:
            held.append(line)
    return out


def documents(spark, rows):
    return spark.createDataFrame([(str(i), title, "u", text, "wiki", "") for i, (title, text) in enumerate(rows)], "page_id string, title string, url string, text string, source_type string, content_hash string")


def test_against_plain_fold(spark):
    rng = random.Random(5)
    lines = ["# A", "## B", "### C", "== W ==", "=== V ===", "====", "#x", "Title", "# title", "plain text here", "", "  spaced  ", "word " * 400]
    rows = [(rng.choice(["Title", "", "NOT FOUND"]), "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25)))) for _ in range(80)]
    rows += [("T", "x" * n) for n in (0, 19, 20, 1200, 1201, 5000)] + [("T", "a" * 600 + " " + "b" * 3000), (None, "é" * 1300)]
    got = {}
    for r in chunking.chunk_documents(documents(spark, rows)).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(int(r["doc_id"]), []).append((r["chunk_index"], r["breadcrumb"], r["text"]))
    for i, (title, text) in enumerate(rows):
        title = title or ""
        want = []
        if len(text.strip()) >= 20 and text.strip() != "NOT FOUND":
            want = [(c, w) for c, s in plain_sections(text, title) for w in plain_windows(s)]
        assert got.get(i, []) == [(n, c, w) for n, (c, w) in enumerate(want)], (i, title)


def test_overlap_is_checked():
    from pyspark.sql import functions as F

    for bad in (600, 700, -1):
        try:
            chunking.windows(F.lit("x"), 1200, bad)
        except ValueError:
            continue
        raise AssertionError(bad)


SOURCE = '''"""Doc."""
import os

@wraps
def f(a):
    return a


class Small:
    x = 1


async def g():
    pass

LOST = 1
'''


def test_code_units():
    units = dict(code_chunks.code_units(SOURCE, "m.py"))
    assert set(units) == {"m.py > Module Preamble", "m.py > def f()", "m.py > class Small", "m.py > def g()"}
    assert units["m.py > def f()"].startswith("@wraps") and "LOST" not in "".join(units.values())
    big = "class Big:\n    y = 12345678901\n" + "".join(f"    def m{i}(self):\n        return '{'x' * 100}'\n" for i in range(15))
    names = [c for c, _ in code_chunks.code_units(big, "t")]
    assert names[0] == "t > class Big (Overview)" and names[1] == "t > def m0()".replace("t > ", "t > class Big > ") and len(names) == 16
    assert code_chunks.code_units("def broken(:\n  x\n" + "y\n" * 20, "t")[0][0] == "t > Source"
    parts = code_chunks.code_units("a = 1\n" * 500, "t")
    assert parts[0][0] == "t > Module Preamble (part 1)" and all(len(x) <= 1200 for _, x in parts)
    assert code_chunks.code_units("", "t") == []
