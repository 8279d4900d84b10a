"""DuckDB SQL of the queries that SQL can express: the same rows by another way."""

from __future__ import annotations

#: Links by a join on shingles and their transitive closure.
NGRAM_JACCARD = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS s FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
  edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
  smallest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN smallest USING (doc_id)"""


def repeated_bytes(length: int = 400) -> str:
    """Removal of every byte in a repeated string of ``length`` bytes, over 256 and under 512.

    Rows are bytes. The hash of 2 ** k bytes from each place on is that of two halves; two strings of
    256 bytes that overlap make one of ``length``.
    """
    halves = ",".join(
        f"""
  h{k + 1} AS (SELECT doc_id, i, hash(h, lead(h, {1 << k}) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h{k})"""
        for k in range(8)
    )
    return f"""WITH bytes AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS b, generate_subscripts(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), 1) AS i FROM documents),
  h0 AS (SELECT doc_id, i, hash(b) AS h FROM bytes),{halves},
  windows AS (SELECT doc_id, i, hash(h, lead(h, {length - 256}) OVER (PARTITION BY doc_id ORDER BY i)) AS h, i + {length - 1} <= max(i) OVER (PARTITION BY doc_id) AS whole FROM h8),
  repeated AS (SELECT h FROM windows WHERE whole GROUP BY h HAVING count(*) > 1),
  marked AS (SELECT w.doc_id, w.i, w.whole AND r.h IS NOT NULL AS begins FROM windows w LEFT JOIN repeated r ON w.h = r.h),
  covered AS (SELECT m.doc_id, m.i, b.b, coalesce(max(CASE WHEN begins THEN m.i END) OVER (PARTITION BY m.doc_id ORDER BY m.i) > m.i - {length}, FALSE) AS gone, CAST(concat('0x', b.b) AS INTEGER) & 192 <> 128 AS leads FROM marked m JOIN bytes b USING (doc_id, i)),
  placed AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER w, FALSE) AS starts, sum(CAST(leads AS INTEGER)) OVER w AS c FROM covered WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  chars AS (SELECT *, bool_or(gone) OVER (PARTITION BY doc_id, c) AS broken FROM placed),
  found AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept, string_agg(b, '' ORDER BY i) FILTER (NOT broken) AS text FROM chars GROUP BY doc_id)
  SELECT d.doc_id, CAST(strlen(coalesce(d.text, '')) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, decode(unhex(coalesce(f.text, ''))) AS text FROM documents d LEFT JOIN found f USING (doc_id)"""
