"""SQL with the same results as queries of this package, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"


def _shingles(words: str) -> str:
    return f"list_distinct([array_to_string({words}[i:i + 4], ' ') for i in range(1, len({words}) - 3)])"


LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no,
    unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, line_no, {_words("line")} AS w FROM lines),
sets AS (
  SELECT doc_id, line_no, CASE WHEN len(w) >= 5 THEN {_shingles("w")} ELSE [array_to_string(w, ' ')] END AS s
  FROM split WHERE len(w) > 0),
tokens AS (SELECT doc_id, line_no, len(s) AS n, unnest(s) AS t FROM sets),
gone AS (
  SELECT DISTINCT doc_id, line_no FROM (
    SELECT x.doc_id, x.line_no
    FROM tokens x JOIN tokens y ON x.t = y.t AND (y.doc_id < x.doc_id OR y.doc_id = x.doc_id AND y.line_no < x.line_no)
    GROUP BY x.doc_id, x.line_no, y.doc_id, y.line_no, x.n, y.n
    HAVING 7 * count(*) >= 3 * (x.n + y.n))),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM lines ANTI JOIN gone USING (doc_id, line_no) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS removed_lines,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE split AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN {_shingles("w")}
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON s.doc_id = m.a
"""

#: Items of one to four words are sought as runs of their own width.
DECONTAMINATION = f"""
WITH items AS (SELECT item_id, w, least(len(w), 5) AS size FROM (SELECT item_id, {_words("text")} AS w FROM benchmark) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_words("text")} AS w FROM documents),
held AS (
  SELECT DISTINCT doc_id, size, array_to_string(w[i:i + size - 1], ' ') AS t
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM items) WHERE len(w) >= size)),
sought AS (
  SELECT item_id, size, n, unnest(s) AS t FROM (SELECT item_id, size, len(s) AS n, s FROM (
    SELECT item_id, size, list_distinct([array_to_string(w[i:i + size - 1], ' ') for i in range(1, len(w) - size + 2)]) AS s FROM items)))
SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared
FROM held JOIN sought USING (size, t) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n
"""


def _centroid_rounds(rounds: int) -> str:
    """Assignments ``a1 ..`` and centroids ``c1 ..`` of so many rounds, and the last assignment."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS distance, arg_min(k, 16 * d + k) AS k
  FROM (SELECT r, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{i})
  GROUP BY r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY k, i) GROUP BY k) m USING (k))""")
    return ",\n".join(parts)


CENTROIDS = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 16)),
{_centroid_rounds(3)}
SELECT vec_id, CAST(a3.k AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY a3.k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON a3.k = c3.k
"""

SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": NGRAM_JOIN,
    "op4_benchmark_decontamination": DECONTAMINATION,
    "op8_line_dedup": LINE_DEDUP,
    "op12_centroid_clustering": CENTROIDS,
}
