"""Text functions as columns: cleaning, headings, ids, titles, rendering. All run in the JVM."""

from __future__ import annotations

import html.entities
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's splitlines boundaries.
LINE_ENDS = "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085  ]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sub(x: Column, *rules: tuple[str, str]) -> Column:
    """Regular-expression replacements, in order."""
    for pattern, new in rules:
        x = F.regexp_replace(x, pattern, new)
    return x


#: The characters that Python's str.strip takes off.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(x: Column | str) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(_col(x), F.lit(SPACES))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x made once, however often f names it: x is the one element of an array."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: Entities of most texts; they spare a search of the whole table.
COMMON = ("amp", "lt", "gt", "quot", "nbsp", "copy", "middot", "mdash", "ndash", "hellip", "rsquo", "lsquo", "rdquo", "ldquo")


def _numbered(name: Column) -> Column:
    """The character of `#65;` or `#x41`: code points that HTML forbids are replaced or left out."""
    digits = F.regexp_extract(name, "^#[xX]?0*([0-9a-fA-F]*);?$", 1)
    value = F.when(F.length(digits) > 7, F.lit("1114112")).when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
    windows = [bytes([c]).decode("cp1252", "replace") for c in range(0x80, 0xA0)]
    windows = F.array(*(F.lit(chr(0x80 + i) if w == "\ufffd" else w) for i, w in enumerate(windows)))

    def char(code: Column) -> Column:
        none = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        utf32 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "utf-32")
        out = F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd")).when(code.between(0x80, 0x9F), F.get(windows, (code - 0x80).cast("int")))
        return out.when(none, F.lit("")).otherwise(utf32)

    return bound(F.coalesce(value.try_cast("long"), F.lit(0)), char)


def _named(name: Column) -> Column:
    """`amp;`, or the longest old name that needs no semicolon and begins the text; without either, the text as it was."""
    table = F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")
    old = F.array(*(F.lit(n) for n in sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))))
    common = F.lit(None).cast("string")
    for n in reversed(COMMON):
        common = F.when(name == f"{n};", html.entities.html5[f"{n};"]).otherwise(common)
    start = F.get(F.filter(old, lambda n: name.startswith(n)), F.lit(0))
    rest = F.concat(F.try_element_at(table, start), F.substring(name, F.length(start) + 1, F.length(name)))
    return F.coalesce(common, F.try_element_at(table, name), rest, F.concat(F.lit("&"), name))


def unescape(x: Column | str, bare: bool = True) -> Column:
    """HTML entities to characters, as HTML reads them: numbers, names, and old names without a semicolon. With bare
    false, what has no semicolon stays as it is.

    Text without an ampersand costs one search. `&amp;` is not decoded twice: pieces are replaced one by one.
    """
    pattern = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
    pattern = pattern if bare else pattern.replace(";?", ";")

    def pieces(x: Column) -> Column:
        decoded = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda name: F.when(name.startswith("#"), _numbered(name)).otherwise(_named(name)))
        return F.array_join(F.zip_with(F.split(x, pattern, -1), F.concat(decoded, F.array(F.lit(""))), lambda gap, v: F.concat(gap, v)), "")

    return bound(_col(x), lambda x: F.when(x.contains("&"), pieces(x)).otherwise(x))


def clean_wikitext(x: Column | str) -> Column:
    """Prose of wiki markup. The order matters: references before tags, templates from the inside out."""
    # What is markup, in the order in which it goes.
    x = sub(
        F.coalesce(_col(x), F.lit("")),
        (r"(?s)<!--.*?-->", ""),
        (r"(?is)<ref[^>]*>.*?</ref>", ""),
        (r"(?i)<ref[^/>]*/>", ""),
        (r"</?[a-zA-Z][^>]*>", ""),
        (r"(?i)\[\[(?:File|Image|Category):[^\]]+\]\]", ""),
        *[(r"\{\{[^{}]*\}\}", "")] * 4,
        (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
        (r"(?U)\[https?://[^\s\]]+\s*([^\]]*)\]", "$1"),
        (r"(?U)https?://[^\s\]]+", ""),
        (r"(?dU)={2,6}\s*(.*?)\s*={2,6}", "\n$1\n"),
        (r"'{2,5}", ""),
    )
    return strip(sub(unescape(x), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


# Elements that hold no prose.
BOILERPLATE_TAGS = "script|style|nav|footer|header|aside|noscript|svg|form"


def html_title(x: Column | str, otherwise: Column | str) -> Column:
    found = F.regexp_extract(_col(x), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(_col(x).rlike(r"(?is)<title[^>]*>.*?</title>"), strip(found)).otherwise(_col(otherwise))


def html_to_markdown(x: Column | str, title: Column | str, bare: bool = True) -> Column:
    """`# title`, a blank line, and the page's lines: headings of three levels, paragraphs and breaks kept. bare: see `unescape`."""
    # The elements' patterns, in the order in which they are replaced.
    x = sub(_col(x), (rf"(?is)<({BOILERPLATE_TAGS})[^>]*>.*?</\1>", ""))
    x = sub(x, *[(rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", f"\n{'#' * n} $1\n") for n in (1, 2, 3)])
    x = sub(x, (r"(?is)<p[^>]*>(.*?)</p>", "\n$1\n"), (r"(?iU)<br\s*/?>", "\n"), ("<[^>]+>", " "))
    lines = F.transform(F.split(unescape(x, bare), LINE_ENDS, -1), strip)
    return F.concat(F.lit("# "), _col(title), F.lit("\n\n"), F.array_join(F.filter(lines, lambda s: s != ""), "\n"))


def heading(line: Column) -> Column:
    """struct(level, text) of a Markdown or wiki heading, null for other lines."""
    hashes, wiki = r"(?dU)^(#{1,6})\s+(.+)$", r"(?dU)^(={1,6})\s*(.*?)\s*\1$"
    made = lambda line, p: F.struct(F.length(F.regexp_extract(line, p, 1)).alias("level"), strip(F.regexp_extract(line, p, 2)).alias("text"))
    found = lambda line: F.when(line.rlike(hashes), made(line, hashes)).when(line.rlike(wiki), made(line, wiki))
    # Few lines begin like a heading; the others cost one test.
    return F.when(line.rlike(r"(?U)^[\s\x1c-\x1f]*[#=]"), bound(strip(line), found))


def uuid5(name: Column | str, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """RFC 4122 version 5: SHA-1 of namespace and name with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(_col(name), "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def content_hash(x: Column | str) -> Column:
    return F.substring(F.sha2(F.encode(_col(x), "utf-8"), 256), 1, 16)


def page_url(base: str, title: Column | str) -> Column:
    return F.concat(F.lit(base), F.replace(_col(title), F.lit(" "), F.lit("_")))


def pretty_title(stem: Column | str) -> Column:
    """Underscores and hyphens to spaces; each letter after a non-letter upper case, the others lower."""
    chars = F.split(F.translate(_col(stem), "_-", "  "), "")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("inside"))
    fold = lambda s, c: F.struct(F.concat(s["out"], F.when(s["inside"], F.lower(c)).otherwise(F.upper(c))).alias("out"), c.rlike(r"^\p{L}$").alias("inside"))
    return F.aggregate(chars, start, fold, lambda s: s["out"])


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))


def time_span(start: Column | str, end: Column | str) -> Column:
    """`[mm:ss – mm:ss]` of seconds."""
    part = lambda x: (F.floor(_col(x) / 60).cast("int"), (F.floor(_col(x)) % 60).cast("int"))
    return F.format_string("[%02d:%02d – %02d:%02d]", *part(start), *part(end))


def embed_text(breadcrumb: Column | str, title: Column | str, text: Column | str) -> Column:
    """What an embedder sees: the breadcrumb, or else the title, above the text."""
    over = F.when(_col(breadcrumb) != "", _col(breadcrumb)).when((_col(title) != "") & (_col(title) != "NOT FOUND"), _col(title))
    return F.when(over.isNotNull(), F.concat(over, F.lit("\n\n"), _col(text))).otherwise(_col(text))


def tokens(x: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9; the tokenizer of the lexical operators (no stemming, no stop words)."""
    return F.array_remove(F.split(F.lower(_col(x)), "[^a-z0-9]+", -1), "")
