"""Sources to documents (schemas.DOCUMENT): dumps, pages, files, tables, and pluggable extractors."""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry import schemas
from heronry.functions import text as T
from heronry.operators.numbering import numbered
from heronry.sources import fetch

# Kinds by file suffix, and folders that are passed over.
KINDS = {
    "text": [".md", ".markdown", ".mdx", ".txt", ".log"],
    "table": [".csv", ".tsv"],
    "code": [".py", ".rs", ".ts", ".js", ".jsx", ".tsx", ".cpp", ".c", ".h", ".hpp", ".go", ".java", ".toml", ".yaml", ".yml", ".json", ".sql", ".sh"],
    "pdf": [".pdf"],
    "image": [".png", ".jpg", ".jpeg", ".webp", ".bmp"],
    "audio": [".mp3", ".wav", ".m4a", ".mp4", ".flac", ".ogg"],
}
IGNORED = [".git", ".venv", "venv", "node_modules", "__pycache__", ".pytest_cache", ".ser", "dist", "build", ".idea", ".vscode", ".mypy_cache", ".ruff_cache"]
KIND_OF = {suffix: kind for kind, suffixes in KINDS.items() for suffix in suffixes}
DUMP_URL = "https://simple.wikipedia.org/wiki/"
LEAST_ARTICLE = 150


def kind_of(path: Column | str) -> Column:
    """The kind of a path by its lower-cased suffix, null if there is none."""
    path = F.col(path) if isinstance(path, str) else path
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in KIND_OF.items() for x in pair]), suffix)


def document(page_id: Column, title: Column, url: Column, text: Column, kind: Column | str, hashed: bool) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    digest = T.content_hash(text) if hashed else F.lit("")
    return [page_id.alias("page_id"), title.alias("title"), url.alias("url"), text.alias("text"), kind.alias("source_type"), digest.alias("content_hash")]


def articles(pages: DataFrame, least: int = LEAST_ARTICLE) -> DataFrame:
    """Dump pages (schemas.DUMP_PAGE) to documents: articles, no redirects, cleaned, of at least `least` characters."""
    pages = pages.filter("ns = '0' AND redirect IS NULL AND id IS NOT NULL")  # cheap tests before the cleaning
    cleaned = pages.withColumn("clean", T.clean_wikitext("revision.text._VALUE"))
    return cleaned.filter(F.length("clean") >= least).select(*document(F.col("id"), F.col("title"), T.page_url(DUMP_URL, "title"), F.col("clean"), "wiki", False))


def read_dump(spark: SparkSession, path: str, max_articles: int | None = None) -> DataFrame:
    """Documents of an XML dump (plain or .bz2); malformed pages are dropped."""
    pages = spark.read.format("xml").option("rowTag", "page").option("mode", "DROPMALFORMED").schema(schemas.DUMP_PAGE).load(path)
    found = articles(pages)
    return found if max_articles is None else found.limit(max_articles)


def web_documents(pages: DataFrame, url_col: str = "url", html_col: str = "html", bare: bool = True) -> DataFrame:
    """Fetched pages (url, html) to Markdown documents; the title falls back to the url. bare: see `functions.text.unescape`."""
    title = T.html_title(html_col, url_col)
    return pages.select(*document(T.uuid5(url_col, uuid.NAMESPACE_URL), title, F.col(url_col), T.html_to_markdown(html_col, title, bare), "web", False))


def fetch_pages(urls: list[str], get: Callable[[str], str | None], spark: SparkSession, **how) -> DataFrame:
    """url, html of pages fetched by tasks (`fetch.fetched`); a failure leaves html null."""
    rows = spark.createDataFrame([(u, [u]) for u in dict.fromkeys(urls)], "target string, urls array<string>")
    return fetch.fetched(rows, get, **how).select(F.col("target").alias("url"), F.col("body").alias("html"))


def article_documents(found: DataFrame) -> DataFrame:
    """Documents of the articles that were found; id, title and text as the answer gives them."""
    page = "map<string,struct<title:string,extract:string>>"
    held = found.filter("status = 'ok'").select("target", "url", F.explode(F.from_json("body", f"query struct<pages:{page}>")["query"]["pages"]).alias("id", "page"))
    held = held.select("id", F.coalesce("page.title", "target").alias("title"), F.concat(F.regexp_extract("url", "^https?://[^/]+", 0), F.lit("/wiki/")).alias("base"), T.strip(F.col("page.extract")).alias("text"))
    held = held.filter("id <> '-1' AND text <> ''")
    return held.select(*document(F.col("id"), F.col("title"), F.concat("base", F.replace("title", F.lit(" "), F.lit("_"))), F.col("text"), "wiki", False))


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of first, and those of second whose key first lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def suggest_titles(titles: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """Distinct titles that start with the query, then the nearest by edit distance."""
    near = F.levenshtein(F.lower("title"), F.lit(query.lower()))
    starts = F.lower("title").startswith(query.lower())
    return titles.select("title").distinct().orderBy(F.desc(starts), near, "title").limit(limit)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores if its scan has fewer tasks; for work that costs more than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _literal(path: str) -> str:
    """A path whose pattern characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """path, content and kind of all supported files below folder, without ignored folders (tested on the part of the
    path below folder). Spark's file scans pass over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_literal(folder))
    inner = F.regexp_replace(F.col("path"), "^.*?" + re.escape(folder.rstrip("/").removeprefix("file:")) + "/", "")
    skipped = F.arrays_overlap(F.split(inner, "/"), F.array(*map(F.lit, IGNORED)))
    # The choice is made on paths, before contents are read; it is a filter of the scan's own rows, so no list of
    # names passes through the driver, and names may hold any character.
    chosen = files.filter(kind_of("path").isNotNull() & ~skipped)
    return chosen.select("path", "content").withColumn("kind", kind_of("path"))


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where that is not valid."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "iso-8859-1"))


def text_documents(files: DataFrame) -> DataFrame:
    """Text, Markdown and code files (path, content, kind) to documents."""
    files = _named(files).withColumn("raw", decoded(F.col("content")))
    markdown, code = F.col("suffix").isin(".md", ".markdown", ".mdx"), F.col("kind") == "code"
    first = T.strip(F.regexp_extract("raw", r"(?m)^#\s+(.+)$", 1))
    title = F.when(F.col("suffix") == ".py", F.col("name")).when(markdown & (first != ""), first).otherwise(F.col("pretty"))
    head = F.when(markdown | (F.col("suffix") == ".py"), F.lit("")).when(code, F.concat(F.lit("# File: "), "name", F.lit("\n\n"))).otherwise(F.concat(F.lit("# Document: "), "name", F.lit("\n\n")))
    return files.select(*document(T.uuid5("url", uuid.NAMESPACE_URL), title, F.col("url"), F.concat(head, "raw"), F.col("kind"), True))


def table_sections(rows: DataFrame, columns: list[str], order: list[str], title: str, batch: int = 30, names: list[str] | None = None) -> DataFrame:
    """section, text: rows as Markdown tables of `batch` rows, blank rows left out before numbering. names: what the
    header shows for columns.

    Row numbers are global by `order` (ranges and prefix sums, see `numbering`); the batches are grouped in parallel.
    """
    cells = F.array(*(T.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))
    rows = rows.withColumn("cells", cells).filter(F.exists("cells", lambda c: c != "")).select(*order, "cells")
    rows = numbered(rows, order).withColumn("n", F.col("n") + 1).withColumn("section", F.floor((F.col("n") - 1) / batch) + 1)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", T.markdown_row(F.col("cells")).alias("line")))), lambda x: x["line"]), "\n")
    parts = rows.groupBy("section").agg(F.min("n").alias("a"), F.max("n").alias("b"), lines.alias("lines"))
    head = T.markdown_row(F.array(*map(F.lit, columns if names is None else names)))
    rule = T.markdown_row(F.array(*[F.lit("---")] * len(columns)))
    return parts.select("section", F.concat(F.lit("## Rows "), F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string"), F.lit("\n\n"), head, F.lit("\n"), rule, F.lit("\n"), "lines", F.lit("\n")).alias("text"))


def read_table(spark: SparkSession, path: str, batch: int = 30) -> DataFrame:
    """One document of a CSV or TSV file; short rows are padded, long ones trimmed. The same text as `table_documents`
    gives, without a task that holds the file's rows as numbers are dealt out (its text is one row in the end)."""
    # Latin-1 where some line is no UTF-8, as for other files. The header is in the first lines.
    text, separator = spark.read.text(_literal(path)), "\t" if path.lower().endswith(".tsv") else ","
    latin = not text.filter(~F.is_valid_utf8("value")).isEmpty()
    first = [r["v"] for r in text.select(F.decode(F.col("value").cast("binary"), "iso-8859-1" if latin else "utf-8").alias("v")).limit(64).collect()]
    header = next(csv.reader(io.StringIO("\n".join(first)), delimiter=separator), None) if first else None
    name = PurePosixPath(path).name
    stem = name.rsplit(".", 1)[0]
    title = spark.range(1).select(T.pretty_title(F.lit(stem)).alias("t")).first()["t"]
    url = path if "://" in path else f"file://{path}"
    ident = F.lit(str(uuid.uuid5(uuid.NAMESPACE_URL, url)))
    if header is None:
        return spark.range(1).select(*document(ident, F.lit(title), F.lit(url), F.lit(f"# Empty Table: {title}\n"), "table", True))
    names = [n.strip() for n in header]
    how = {"header": "true", "enforceSchema": "true", "sep": separator, "multiLine": "true", "escape": '"', "encoding": "ISO-8859-1" if latin else "UTF-8"}
    data = spark.read.options(**how).schema(", ".join(f"`{i}` string" for i in range(len(names)))).csv(_literal(path))
    data = data.withColumn("__row", F.monotonically_increasing_id())
    sections = table_sections(data, [str(i) for i in range(len(names))], ["__row"], title, batch, names)
    ordered = F.array_sort(F.collect_list(F.struct("section", "text")))
    body = sections.agg(F.transform(ordered, lambda x: x["text"]).alias("parts"))
    text = F.array_join(F.concat(F.array(F.lit(f"# Dataset: {title}\n\nSchema: {', '.join(names)}\n")), F.col("parts")), "\n\n")
    return body.select(*document(ident, F.lit(title), F.lit(url), text, "table", True))


def table_text(content: str, title: str, separator: str, batch: int = 30) -> str:
    """A CSV or TSV file as Markdown tables of `batch` rows, each under its numbers and the header."""
    rows = csv.reader(io.StringIO(content), delimiter=separator)
    names = next(rows, None)
    if names is None:
        return f"# Empty Table: {title}\n"
    names = [n.strip() for n in names]
    line = lambda cells: f"| {' | '.join(cells)} |"
    head = f"{line(names)}\n{line(['---'] * len(names))}"
    full = [line([*(c.strip() for c in r[: len(names)]), *[""] * (len(names) - len(r))]) for r in rows if any(c.strip() for c in r)]
    parts = [(at, full[at : at + batch]) for at in range(0, len(full), batch)]
    body = [f"## Rows {at + 1}–{at + len(part)}\n\n{head}\n" + "\n".join(part) + "\n" for at, part in parts]
    return "\n\n".join([f"# Dataset: {title}\n\nSchema: {', '.join(names)}\n", *body])


def table_documents(files: DataFrame) -> DataFrame:
    """CSV and TSV files (path, content, kind) to documents, many files in parallel, each whole in one task;
    `read_table` splits one large file."""
    files = _named(files.filter("kind = 'table'")).select("url", "pretty", "suffix", decoded(F.col("content")).alias("raw"))

    def rows(batches):
        for pdf in batches:
            text = [table_text(c, t, "\t" if s == ".tsv" else ",") for c, t, s in zip(pdf["raw"], pdf["pretty"], pdf["suffix"], strict=True)]
            yield pdf[["url", "pretty"]].assign(text=text)

    made = files.mapInPandas(rows, "url string, pretty string, text string")
    return made.select(*document(T.uuid5("url", uuid.NAMESPACE_URL), F.col("pretty"), F.col("url"), F.col("text"), "table", True))


def _named(files: DataFrame) -> DataFrame:
    """files with url, name, pretty (the stem as a title) and suffix."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    url = F.when(F.col("path").startswith("file:"), F.regexp_replace("path", "^file:/+", "file:///")).otherwise(F.col("path"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("*", url.alias("url"), name.alias("name"), T.pretty_title(F.regexp_replace(name, r"\.[^.]*$", "")).alias("pretty"), suffix.alias("suffix"))


def file_documents(files: DataFrame, extractors: dict[str, Callable[[bytes, str], str | None]] | None = None) -> DataFrame:
    """Files of all kinds (path, content, kind) to documents. PDF, image and audio files need an extractor of their
    kind; without it such a file still gives a document that says that nothing could be read."""
    docs = text_documents(files.filter("kind IN ('text', 'code')")).unionByName(table_documents(files))
    for kind in ("pdf", "image", "audio"):
        docs = docs.unionByName(extracted(files, kind, (extractors or {}).get(kind, lambda content, path: None)))
    return docs


def scanned_pages(pages: DataFrame, title_col: str = "title") -> DataFrame:
    """path, text of recognised page texts (path, title, page, text): `## Page i` above each page that has text."""
    part = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), T.strip("text"), F.lit("\n"))
    found = F.filter(F.array_sort(F.collect_list(F.struct("page", F.when(T.strip(F.coalesce("text", F.lit(""))) != "", part).alias("part")))), lambda x: x["part"].isNotNull())
    head = F.array(F.concat(F.lit("# Scanned Document: "), F.min(title_col), F.lit("\n")))
    return pages.groupBy("path").agg(F.array_join(F.concat(head, F.transform(found, lambda x: x["part"])), "\n").alias("text"))


def extracted(files: DataFrame, kind: str, extract: Callable[[bytes, str], str | None]) -> DataFrame:
    """PDF, image and audio files through a model that the caller brings: extract(content, path) -> text.

    The function runs on workers over Arrow batches. Where it gives nothing the document says so.
    """

    def rows(batches):
        for pdf in batches:
            yield pdf[["path"]].assign(raw=[extract(c, p) for c, p in zip(pdf["content"], pdf["path"], strict=True)])

    title = T.pretty_title(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    heads = {"image": "# Image: ", "audio": "# Audio: ", "pdf": "# "}
    found = files.filter(F.col("kind") == kind).select("path", "content").mapInPandas(rows, "path string, raw string")
    body = F.coalesce("raw", F.lit("(no text could be read from this file)"))
    text = F.when(F.lit(kind == "pdf") & body.startswith("#"), body).otherwise(F.concat(F.lit(heads[kind]), title, F.lit("\n\n"), body))
    return found.select(*document(T.uuid5("path", uuid.NAMESPACE_URL), title, F.col("path"), text, kind, True))


def transcript(segments: DataFrame) -> DataFrame:
    """path, text of speech segments (path, start, end, text): a heading with the times above each."""
    part = F.concat(F.lit("### "), T.time_span("start", "end"), F.lit("\n"), T.strip("text"))
    ordered = F.array_sort(F.collect_list(F.struct("start", part.alias("part"))))
    return segments.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("text"))


def has_text_layer(pages: DataFrame, sample: int = 3, least: int = 50) -> DataFrame:
    """path, digital of PDF page texts (path, page, text): more than `least` characters on the first pages."""
    n = F.sum(F.when(F.col("page") <= sample, F.length(T.strip(F.coalesce("text", F.lit(""))))).otherwise(0))
    return pages.groupBy("path").agg((n > least).alias("digital"))


def resolve(
    spark: SparkSession, target: str, get: Callable[[str], str] | None = None, article: Callable[[str], tuple[str, str] | None] | None = None,
    *, extractors: dict[str, Callable[[bytes, str], str | None]] | None = None, titles: DataFrame | None = None,
) -> tuple[str, DataFrame | None]:
    """(kind, documents) of a URL, a folder, a file, or an article's title, in this order. Without `article`, `get` asks
    both encyclopedias for the title. Where no article is found, kind is suggestions and the rows are up to three of titles, or else not_found."""
    target = target.strip().strip("'\"")
    if re.match(r"https?://", target):
        if get is None:
            return "not_found", None
        return "url", web_documents(fetch_pages([target], get, spark).filter("html IS NOT NULL"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop):
        if fs.getFileStatus(hadoop).isDirectory():
            files = walk(spark, target)
            return ("empty_directory" if files.select("path").isEmpty() else "directory"), file_documents(files, extractors)
        kind = KIND_OF.get(PurePosixPath(target).suffix.lower())
        if kind is None:
            raise ValueError(f"unsupported file type: {target}")
        if kind == "table":
            return "file", read_table(spark, target)
        if kind in ("pdf", "image", "audio") and kind not in (extractors or {}):
            raise ValueError(f"{kind} files need an extractor: see extracted()")
        return "file", file_documents(spark.read.format("binaryFile").load(_literal(target)).select("path", "content").withColumn("kind", F.lit(kind)), extractors)
    found = article(target) if article else None
    if article is None and get is not None:
        asked = fetch.article_targets(spark.createDataFrame([(target,)], "title string"))
        docs = article_documents(fetch.fetched(asked, fetch.article_body(get), rate=None, tries=1))
        if not docs.isEmpty():
            return "wiki", docs
    if found is None:
        near = suggest_titles(titles, target) if titles is not None else None
        return ("not_found", None) if near is None or near.isEmpty() else ("suggestions", near)
    title, text = found
    row = spark.createDataFrame([(title, text)], "title string, text string")
    return "wiki", row.select(*document(T.uuid5("title"), F.col("title"), T.page_url(DUMP_URL, "title"), F.col("text"), "wiki", False))
