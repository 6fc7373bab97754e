"""SQL (DuckDB) that gives the same rows as a query, where SQL can express it."""

from __future__ import annotations

from innings.llm.spotsigs import ORACLE as _SPOTS

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP = rf"""
WITH RECURSIVE lists AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
    FROM documents),
grams AS MATERIALIZED (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE
           array_to_string(w[i:i + 2], ' ') END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM lists WHERE len(w) > 0)),
sizes AS MATERIALIZED (
    SELECT l.doc_id, count(g) AS n FROM lists l LEFT JOIN grams USING (doc_id) GROUP BY l.doc_id),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g
    WHERE a.doc_id <> b.doc_id GROUP BY ALL),
linked AS MATERIALIZED (
    SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
    WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
reached(x, y) AS (
    SELECT doc_id, doc_id FROM sizes UNION SELECT r.x, l.y FROM reached r JOIN linked l ON l.x = r.y)
SELECT s.doc_id, s.n AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sizes s JOIN (SELECT x, min(y) AS component_id FROM reached GROUP BY x) r ON r.x = s.doc_id
"""

MIX_SOURCES = rf"""
WITH d AS MATERIALIZED (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
           substr(md5(concat(doc_id, ':0')), 1, 15) AS key FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
           row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(n - 1) % 3 + 1]::BIGINT AS weight FROM s),
r AS (
    SELECT *, most::DOUBLE / weight AS ratio,
           (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
    FROM w WINDOW b AS (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
    SELECT *, least(most::DOUBLE, weight * (SELECT arg_min(level, (ratio, n)) FROM r WHERE level <= ratio)) AS target
    FROM r),
e AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (
    SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.source_size AS rest,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM o
"""

SUBSTRING_DEDUP = rf"""
WITH lists AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS MATERIALIZED (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM lists WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS low FROM windows GROUP BY g),
gone AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
    FROM windows JOIN firsts USING (g) WHERE doc_id > low),
each AS (
    SELECT l.doc_id, l.i, l.word, g.i IS NOT NULL AS gone
    FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM lists) l
    LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i),
sums AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
           string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM each GROUP BY doc_id)
SELECT l.doc_id, len(l.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM lists l LEFT JOIN sums s ON s.doc_id = l.doc_id
"""

#: The checksum of a decimal id, bit by bit (polynomial of CRC-32).
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
           lambda c: ascii(c)::BIGINT)), lambda r, c: list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0],
           lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

PERIODIC_RUNS = rf"""
WITH base AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {_CRC} AS h FROM documents),
tailed AS (
    SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM base),
lists AS MATERIALIZED (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
           w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM tailed),
grams AS MATERIALIZED (
    SELECT doc_id, i, n, md5(array_to_string(w[i + 1:i + 8], ' ')) AS v
    FROM (SELECT *, unnest(range(n - 7)) AS i FROM lists WHERE n >= 24)),
again AS MATERIALIZED (SELECT doc_id, v FROM grams GROUP BY ALL HAVING count(*) > 1),
recurring AS MATERIALIZED (SELECT g.* FROM grams g JOIN again USING (doc_id, v)),
pairs AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM recurring x JOIN recurring y ON x.doc_id = y.doc_id AND x.v = y.v
    AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (
    SELECT doc_id, q, min(i) AS s, count(*) + 7 + q AS l FROM (
        SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
    GROUP BY doc_id, q, island HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM islands GROUP BY doc_id, s, l),
best AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
           first({{'s': s, 'l': l, 'q': q}} ORDER BY l::DOUBLE / q DESC, s, q) AS b FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
    SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t
    FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM lists) e ANTI JOIN gone g USING (doc_id, i)
    GROUP BY e.doc_id)
SELECT l.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period,
       1000 * b.l // b.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(t, '')) AS collapsed_sha256
FROM lists l LEFT JOIN best r ON r.doc_id = l.doc_id LEFT JOIN kept k ON k.doc_id = l.doc_id
"""

LINE_DEDUP = rf"""
WITH lines AS MATERIALIZED (
    SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS MATERIALIZED (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
    FROM lines),
held AS (
    SELECT key, min(doc_id) AS low FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, coalesce(k.doc_id > h.low, FALSE) AS gone FROM keyed k LEFT JOIN held h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and means, one pair of CTEs each; products of integers are exact in doubles."""
    steps = [f"""
vectors AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label,
           list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (
    SELECT n, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x
    FROM vectors, range({parts}) AS r(part)),
book0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x FROM pieces WHERE n <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS MATERIALIZED (
    SELECT p.n, p.part, any_value(p.x) AS x, min({{'d': list_inner_product(p.x, p.x) + list_inner_product(b.x, b.x)
           - 2 * list_inner_product(p.x, b.x), 'entry': entry}}) AS best
    FROM pieces p JOIN book{i} b ON b.part = p.part GROUP BY p.n, p.part)""")
        if i < rounds:
            steps.append(f"""
mean{i} AS MATERIALIZED (
    SELECT part, entry, list(m ORDER BY k) AS x FROM (
        SELECT part, best.entry AS entry, k, floor(sum(x[k]) / count(*)) AS m
        FROM near{i}, range(1, len(x) + 1) AS r(k) GROUP BY part, best.entry, k) GROUP BY part, entry),
book{i + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{i} b
    LEFT JOIN mean{i} m ON m.part = b.part AND m.entry = b.entry)""")
    return "WITH " + ",".join(steps) + f""",
coded AS (
    SELECT v.vec_id, v.label, string_agg(printf('%02x', best.entry::INTEGER), '' ORDER BY part) AS code,
           sum(best.d)::BIGINT AS error
    FROM near{rounds} a JOIN vectors v ON v.n = a.n GROUP BY v.n, v.vec_id, v.label),
digest AS (
    SELECT sha256(string_agg(c, ',' ORDER BY part, entry)) AS h FROM (
        SELECT part, entry, array_to_string(list_transform(x, lambda y: y::BIGINT), ',') AS c FROM book{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT h FROM digest) AS codebooks_sha256 FROM coded
"""


ORACLES: dict[str, str] = {
    "op4_near_dedup": NEAR_DEDUP,
    "op6_mix_sources": MIX_SOURCES,
    "op9_substring_dedup": SUBSTRING_DEDUP,
    "op10_fingerprints": _SPOTS,
    "op11_periodic_runs": PERIODIC_RUNS,
    "op12_vector_codes": _vector_codes(),
    "op13_line_dedup": LINE_DEDUP,
}
