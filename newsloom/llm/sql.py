"""The queries of this subpackage in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from newsloom.llm.license_scan import KNOWN, SPELLINGS, STRIPPED


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(x: str) -> str:
    s = f"lower({x})"
    for p in STRIPPED:
        s = f"regexp_replace({s}, {_quote(p)}, ' ', 'g')"
    s = f"' ' || trim({s}) || ' '"
    for a, b in SPELLINGS:
        s = f"replace({s}, {_quote(f' {a} ')}, {_quote(f' {b} ')})"
    return f"trim({s})"


_KNOWN = ", ".join(f"({_quote(name)}, {_quote(text)})" for name, text in KNOWN)
LICENSE_SCAN = f"""
WITH known AS (SELECT md5({_canonical('text')}) AS digest, min(license) AS license FROM (VALUES {_KNOWN}) AS v(license, text) GROUP BY 1),
units AS (
  SELECT doc_id, true AS whole, text AS unit FROM documents
  UNION ALL SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents
  UNION ALL SELECT doc_id, false, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) FROM documents WHERE regexp_matches(text, '\\n[ \\t]*\\n')),
hits AS (SELECT doc_id, whole, license FROM units JOIN known ON md5({_canonical('unit')}) = digest)
SELECT d.doc_id, max(license) FILTER (whole) AS whole_license,
  coalesce(array_to_string(list_sort(list(DISTINCT license) FILTER (NOT whole)), ','), '') AS notices,
  count(*) FILTER (NOT whole) AS n_notices
FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id GROUP BY d.doc_id
"""

# Words come from the same character class; windows of ten are joined and compared as text.
DECONTAMINATION = """
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)),
hits AS (SELECT d.doc_id, d.i, d.k, m.item_id FROM doc_windows d JOIN item_windows m ON d.k = m.k AND d.s = m.s),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLE_SQL = {"op1_license_scan": LICENSE_SCAN, "op8_decontamination": DECONTAMINATION}
