"""Python source to chunks by its syntax tree; other lines by packing. SQL has no parser, so this is a Python operator."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame

from heronry import schemas

ATOMIC_CLASS = 1500
LEAST = 20
#: Sources whose chunks are held at once.
AT_ONCE = 64
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def packed_lines(head: str, body: str, crumb: str, size: int) -> Iterator[tuple[str, str]]:
    """(breadcrumb, text): whole lines packed to size, the head above each part; an overlong line stays whole."""
    parts: list[list[str]] = []
    room = 0
    for line in body.splitlines():
        if not parts or len(line) + 1 > room and parts[-1]:
            parts.append([])
            room = size - len(head)
        parts[-1].append(line)
        room -= len(line) + 1
    for i, part in enumerate(parts, 1):
        text = "\n".join(part).strip("\r\n")
        yield (f"{crumb} (part {i})" if len(parts) > 1 else crumb), (f"{head}\n{text}" if head else text)


def _first_line(node: ast.AST) -> int:
    return node.decorator_list[0].lineno if getattr(node, "decorator_list", None) else node.lineno


def code_units(code: str, title: str, size: int = 1200) -> list[tuple[str, str]]:
    """(breadcrumb, text) of the preamble, the top-level functions and classes, and the methods of large classes.

    Module code after the first definition, and class code after the first method, is in no unit.
    """
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return list(packed_lines("", code.strip(), f"{title} > Source", size))
    lines = code.splitlines()
    between = lambda a, b: "\n".join(lines[a - 1 : b]).strip()
    source = lambda node: between(_first_line(node), node.end_lineno)
    units: list[tuple[str, str]] = []

    def add(crumb: str, text: str, head: str = "", body: str | None = None) -> None:
        units.extend([(crumb, text)] if len(text) <= size else packed_lines(head, text if body is None else body, crumb, size))

    defs = [n for n in tree.body if isinstance(n, (*DEFS, ast.ClassDef))]
    top = lines[: _first_line(defs[0]) - 1] if defs else lines
    doc = ast.get_docstring(tree)
    real = any(x.strip() and not x.strip().startswith(('"""', "'''", "#")) for x in top)
    preamble = "\n\n".join([f'"""{doc}"""'] * bool(doc) + ["\n".join(top).strip()] * real).strip()
    if len(preamble) >= LEAST:
        add(f"{title} > Module Preamble", preamble)
    for node in defs:
        text = source(node)
        if isinstance(node, DEFS):
            own = text.splitlines()
            ends = next((i for i, x in enumerate(own, 1) if x.rstrip().endswith(":")), len(own))
            add(f"{title} > def {node.name}()", text, "\n".join(own[:ends]), "\n".join(own[ends:]))
        elif len(text) <= ATOMIC_CLASS:
            units.append((f"{title} > class {node.name}", text))
        else:
            crumb, methods = f"{title} > class {node.name}", [m for m in node.body if isinstance(m, DEFS)]
            overview = between(_first_line(node), _first_line(methods[0]) - 1 if methods else node.end_lineno)
            if len(overview) >= LEAST:
                units.append((f"{crumb} (Overview)", overview))
            for m in methods:
                head = f"# class {node.name}"
                add(f"{crumb} > def {m.name}()", f"{head}\n{source(m)}", head, source(m))
    if not units and len(code.strip()) >= LEAST:
        units.extend(packed_lines("", code.strip(), f"{title} > Script", size))
    return units


def chunk_code(docs: DataFrame, size: int = 1200) -> DataFrame:
    """docs (schemas.DOCUMENT) of Python sources to chunks (schemas.CHUNK). Null texts give none."""

    def rows(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in schemas.CHUNK.split(", ")]
        types = [pa.int32() if x.split()[1] == "int" else pa.string() for x in schemas.CHUNK.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                out = []
                for page_id, title, url, text, content_hash in zip(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns), strict=True):
                    for i, (crumb, unit) in enumerate(code_units(text or "", title or "", size)):
                        out.append((f"{page_id}-{i}", page_id, title, url, i, unit, crumb, "code", content_hash))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return docs.select("page_id", "title", "url", "text", "content_hash").mapInArrow(rows, schemas.CHUNK)
