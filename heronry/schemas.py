"""Schemas of the engine's tables."""

DOCUMENT = "page_id string, title string, url string, text string, source_type string, content_hash string"
CHUNK = "chunk_id string, doc_id string, title string, url string, chunk_index int, text string, breadcrumb string, source_type string, content_hash string"
POINT = f"{CHUNK}, point_id string, vector array<float>"
DUMP_PAGE = "title string, ns string, id string, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"
