"""Documents to chunks: heading-aware sections, then overlapping windows that end at words. Native folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions import text as T
from heronry.operators.code_chunks import chunk_code


def sections(text: Column, title: Column) -> Column:
    """array<struct<breadcrumb, text>>: a fold over the headings, with the active ones by level as its state.

    A heading clears the levels from its own on; one that equals the title only sets level 0. What stands between
    two headings is a section if it is more than white space.
    """
    heads = "array<struct<l:int,t:string>>"
    found = "array<struct<breadcrumb:string,text:string>>"

    def of(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), T.heading(x).alias("h"))), lambda m: m["h"].isNotNull())
        zero = F.struct(
            F.when((title != "") & (title != "NOT FOUND"), F.array(F.struct(F.lit(0).alias("l"), title.alias("t")))).otherwise(F.array().cast(heads)).alias("heads"),
            title.alias("crumb"), F.lit(0).alias("from"), F.array().cast(found).alias("out"),
        )
        crumb = lambda h: F.when(F.size(h) == 0, title).otherwise(F.array_join(F.transform(F.array_sort(h), lambda x: x["t"]), " > "))

        def until(s: Column, end: Column) -> Column:
            body = T.strip(F.array_join(F.slice(lines, s["from"] + 1, end - s["from"]), "\n"))
            section = lambda body: F.when(body != "", F.array(F.struct(s["crumb"].alias("breadcrumb"), body.alias("text")))).otherwise(F.array().cast(found))
            return F.concat(s["out"], T.bound(body, section))

        def fold(s: Column, mark: Column) -> Column:
            h = mark["h"]
            is_title = (title != "") & (F.lower(T.strip(h["text"])) == F.lower(T.strip(title)))
            level = F.when(is_title, F.lit(0)).otherwise(h["level"])
            others = F.filter(s["heads"], lambda x: F.when(level == 0, x["l"] != 0).otherwise(x["l"] < level))
            heads = F.concat(others, F.array(F.struct(level.alias("l"), h["text"].alias("t"))))
            return F.struct(heads.alias("heads"), crumb(heads).alias("crumb"), (mark["i"] + 1).alias("from"), until(s, mark["i"]).alias("out"))

        return F.aggregate(marks, zero, fold, lambda s: until(s, F.size(lines)))

    return T.bound(F.split(T.strip(text), T.LINE_ENDS, -1), of)


def windows(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Strings of at most size characters, each but the last ending at the last space of its second half.

    The text is stripped once and cut into blocks of size characters; a window lies in two blocks, so the work
    grows with the text's length and not with its square.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be less than half of the chunk size")
    half = size // 2

    def cut(d: Column) -> Column:
        n, blocks = d["n"], d["blocks"]
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def moved(s: Column, window: Column) -> Column:
            at = s["at"]

            def to(back: Column) -> Column:
                length = F.when((at + size < n) & (back > 0), size - back).otherwise(F.lit(size))
                piece = T.strip(F.substring(window, F.lit(1), length))
                out = T.bound(piece, lambda p: F.when(p != "", F.concat(s["out"], F.array(p))).otherwise(s["out"]))
                return F.struct(F.when(at + length >= n, n).otherwise(at + length - overlap).alias("at"), out.alias("out"))

            return T.bound(F.instr(F.reverse(F.substring(window, F.lit(half + 1), F.lit(size))), F.lit(" ")), to)

        def fold(s: Column, _: Column) -> Column:
            block = F.floor(s["at"] / size).cast("int")
            two = F.concat(F.get(blocks, block), F.coalesce(F.get(blocks, block + 1), F.lit("")))
            window = F.substring(two, s["at"] - block * size + 1, F.lit(size))
            return F.when(s["at"] >= n, s).otherwise(T.bound(window, lambda w: moved(s, w)))

        steps = F.sequence(F.lit(1), F.ceil(n / (size - half - overlap)).cast("int") + 1)
        return F.aggregate(steps, zero, fold, lambda s: s["out"])

    blocks = lambda t: F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    longer = lambda t: T.bound(F.struct(F.length(t).alias("n"), blocks(t).alias("blocks")), cut)
    return T.bound(T.strip(text), lambda t: F.when(F.length(t) <= size, F.filter(F.array(t), lambda x: x != "")).otherwise(longer(t)))


def chunk_documents(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """docs (schemas.DOCUMENT) to chunks (schemas.CHUNK). Texts under 20 characters and NOT FOUND give none;
    a null title counts as empty."""
    names = ("title", "url", "source_type", "content_hash")
    docs = docs.select("page_id", "text", *(F.coalesce(c, F.lit("")).alias(c) for c in names))
    piece = lambda crumb: lambda p: F.struct(crumb.alias("breadcrumb"), p.alias("text"))
    of = lambda text, title: F.flatten(F.transform(sections(text, title), lambda s: F.transform(windows(s["text"], size, overlap), piece(s["breadcrumb"]))))
    fit = lambda d: F.when((F.length(d["text"]) >= 20) & (d["text"] != "NOT FOUND"), of(d["text"], d["title"]))
    whole = docs.select("page_id", *names, T.bound(F.struct(T.strip(F.coalesce("text", F.lit(""))).alias("text"), F.col("title").alias("title")), fit).alias("chunks"))
    # The outer form, as the other one adds a filter that makes the chunks a second time.
    return whole.select("page_id", *names, F.posexplode_outer("chunks").alias("chunk_index", "chunk")).filter("chunk_index IS NOT NULL").select(
        F.concat_ws("-", "page_id", "chunk_index").alias("chunk_id"), F.col("page_id").alias("doc_id"), "title", "url",
        "chunk_index", "chunk.text", "chunk.breadcrumb", "source_type", "content_hash",
    )


def chunk_sources(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Chunks of any documents: Python files by their syntax tree, all others by their headings."""
    name = lambda c: F.lower(F.coalesce(c, F.lit(""))).endswith(".py")
    python = (F.coalesce("source_type", F.lit("")) == "code") & (name("url") | name("title"))
    text = T.strip(F.coalesce("text", F.lit("")))
    code = docs.filter(python & (F.length(text) >= 20) & (text != "NOT FOUND"))
    return chunk_documents(docs.filter(~python), size, overlap).unionByName(chunk_code(code, size))


def flat_chunks(docs: DataFrame, size: int = 1200, overlap: int = 200, min_length: int = 150) -> DataFrame:
    """Windows of the whole text, without headings: page_id, chunk_index, text."""
    docs = docs.filter(F.length("text") >= min_length)
    return docs.select("page_id", F.posexplode_outer(windows(F.col("text"), size, overlap)).alias("chunk_index", "text")).filter("chunk_index IS NOT NULL")
