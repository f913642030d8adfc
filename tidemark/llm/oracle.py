"""SQL equivalents of the operators that SQL can express: exact matching of windows, sets and word runs."""

from __future__ import annotations

from tidemark.llm.licenses import COVERAGE, DRIFT, LOWER, NOTICES, PHRASES, UPPER


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


LETTERS = _words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = _words(r"[^\x20\x09-\x0D]+")

DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, {LETTERS} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {LETTERS} AS w FROM benchmark),
piece AS (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
          FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS body FROM piece),
place AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM doc JOIN (SELECT DISTINCT size FROM windows) ON len(w) >= size),
met AS (SELECT DISTINCT doc_id, i, windows.size AS size, item_id
        FROM place JOIN windows ON windows.size = place.size
         AND windows.body = array_to_string(list_slice(w, i, i + place.size - 1), ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM met) GROUP BY doc_id),
owner AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN owner USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {BLANK} AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(
           CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM doc),
class AS (SELECT min(doc_id) AS id, s FROM sets WHERE len(s) > 0 GROUP BY s),
element AS (SELECT id, len(s) AS n, unnest(s) AS x FROM class),
pair AS (SELECT a.id AS a, b.id AS b FROM element a JOIN element b ON a.x = b.x AND a.id < b.id
         GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT id, id AS other FROM class UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.other = link.a),
label AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN class ON class.s = sets.s LEFT JOIN label ON label.id = class.id"""

_TEMPLATES = ", ".join(f"({i}, '{body}', '{label}')" for i, (label, body) in enumerate(NOTICES.items()))
_PHRASES = ", ".join(f"('{body}', '{label}')" for body, label in PHRASES.items())

LICENSES = f"""
WITH doc AS (SELECT doc_id, {LETTERS} AS w FROM documents),
phrase AS (SELECT label, string_split(body, ' ') AS t, len(string_split(body, ' ')) AS k FROM (VALUES {_PHRASES}) t(body, label)),
token AS (SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM doc),
start AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d FROM token
          WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
base AS (SELECT doc_id, i - 1 AS place, label FROM start
         JOIN phrase ON t[1] = a AND t[2] = b AND (k < 3 OR t[3] = c) AND (k < 4 OR t[4] = d)),
bases AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
notice AS (SELECT template, label, string_split(body, ' ') AS t FROM (VALUES {_TEMPLATES}) t(template, body, label)),
run AS (SELECT template, label, n_runs, i, t[i] AS a, t[i + 1] AS b FROM
        (SELECT template, label, t, len(t) - 1 AS n_runs, unnest(range(1, len(t))) AS i FROM notice)),
vote AS (SELECT doc_id, template, label, n_runs, start.i - run.i AS diagonal,
                bit_or(CAST(1 AS BIGINT) << CAST(run.i - 1 AS INTEGER)) AS votes, min(start.i) AS low, max(start.i) AS high
         FROM start JOIN run ON start.a = run.a AND start.b = run.b GROUP BY ALL),
several AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS gap
            FROM vote WHERE bit_count(votes) > 1),
island AS (SELECT *, count(*) FILTER (gap > {DRIFT}) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS g FROM several),
span AS (SELECT doc_id, label, n_runs, bit_count(bit_or(votes)) / n_runs AS share, max(high) - min(low) AS width
         FROM island GROUP BY doc_id, template, label, n_runs, g),
best AS (SELECT doc_id, max(share) AS share FROM span GROUP BY doc_id),
every AS (SELECT doc_id, label FROM base UNION
          SELECT doc_id, label FROM span WHERE share >= {COVERAGE} AND width <= 2 * n_runs),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE least(coalesce(share, 0.0), 1.0) END::DOUBLE AS score
FROM doc LEFT JOIN bases USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN named USING (doc_id)"""

_ROUND = """
near{n} AS (SELECT rid, min({{'d': d, 'j': j}}) AS best FROM (
  SELECT rid, j, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, center{n})
  GROUP BY rid)"""
_MOVE = """,
total{n} AS (SELECT best.j AS j, i, sum(v[i]) AS s, count(*) AS n
             FROM near{n} JOIN kept USING (rid), range(1, 65) t(i) GROUP BY ALL),
center{next} AS (SELECT center{n}.j, coalesce(m, c) AS c FROM center{n} LEFT JOIN (
  SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM total{n} GROUP BY j) t ON t.j = center{n}.j)"""

CLUSTERING = """
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id,
                     list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
              FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64),
center0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM kept QUALIFY j < 16),""" + (
    ",".join(_ROUND.format(n=n) + _MOVE.format(n=n, next=n + 1) for n in range(3)) + "," + _ROUND.format(n=3)) + """
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near3 JOIN kept USING (rid) JOIN center3 ON center3.j = best.j"""

ORACLE: dict[str, str] = {
    "op2_decontamination": DECONTAMINATION,
    "op4_near_duplicates": NEAR_DUPLICATES,
    "op8_licenses": LICENSES,
    "op12_clustering": CLUSTERING,
}
