"""DuckDB SQL of the queries that SQL can express, by another road: every window,
shingle and pair is spelled out and joined."""

from __future__ import annotations

from .quality_ledger import POLICIES, RULES

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BENCH_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

DECONTAMINATE = f"""
WITH items AS (SELECT item_id::VARCHAR AS id, {BENCH_WORDS} AS w, least(13, len(w)) AS n FROM benchmark),
windows AS (SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS s
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items WHERE n > 0)),
docs AS (SELECT doc_id, {BENCH_WORDS} AS w FROM documents),
runs AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, i, n, id FROM runs JOIN windows USING (n, s)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY ALL),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY ALL)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT *, CASE WHEN octet_length(b) < 100 THEN page_id ELSE min(page_id) OVER (PARTITION BY b) END AS first_id FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest,
       if(first_id = page_id, 'response', 'revisit') AS record_type, if(first_id = page_id, NULL, first_id) AS refers_to
FROM f"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w, least(4, len(w)) AS k FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d WHERE k > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)"""

_FAILED = " + ".join(f"if({r.fails}, {1 << r.bit}, 0)" for r in RULES)
_WEB = " AND ".join(f"NOT ({r.fails})" for r in RULES if r.name in POLICIES["web-1"])

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY ALL),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, len(l)::BIGINT AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_WEB} AS kept, ({_FAILED})::BIGINT AS failed
FROM m"""

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FLOORS = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"

HARD_NEGATIVES = f"""
WITH r AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_FLOORS} AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}),
c AS (SELECT u, vec_id, label, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM r),
s AS (SELECT a.u AS au, a.vec_id AS a_id, b.u, b.vec_id, a.label = b.label AS same, sum(a.v * b.v)::BIGINT AS s
      FROM c a JOIN c b ON a.i = b.i AND a.vec_id % 50 = 0 AND a.u <> b.u GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY au ORDER BY s DESC, vec_id) AS n FROM s WHERE same QUALIFY n <= 5),
n AS (SELECT p.a_id, p.au, p.n, p.vec_id AS p_id, p.s AS p_s, q.vec_id AS n_id, q.s AS n_s,
             row_number() OVER (PARTITION BY p.au, p.n ORDER BY q.s DESC, q.vec_id) AS rank
      FROM p JOIN s q ON q.au = p.au AND NOT q.same AND 50 * p.s <= 100 * q.s AND 100 * q.s <= 95 * p.s QUALIFY rank <= 3)
SELECT a_id AS anchor_id, p_id AS positive_id, rank::INT AS rank, n_id AS negative_id, p_s AS positive_score, n_s AS negative_score,
       n::INT AS positive_rank FROM n"""


def _centroids(clusters: int = 40, rounds: int = 5) -> str:
    """Every round spelled out: c<n> are the centroids, d<n> all distances, a<n> the nearest."""
    ctes = [f"v AS MATERIALIZED (SELECT vec_id, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM "
            f"(SELECT vec_id, {_FLOORS} AS x FROM embeddings WHERE {_USABLE} AND len(embedding) = 64))",
            f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM (SELECT DISTINCT vec_id FROM v) QUALIFY k < {clusters})",
            "c0 AS MATERIALIZED (SELECT k, i, x FROM f JOIN v USING (vec_id))"]
    for n in range(rounds + 1):
        ctes.append(f"d{n} AS (SELECT vec_id, k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{n} c USING (i) GROUP BY ALL)")
        ctes.append(f"a{n} AS MATERIALIZED (SELECT vec_id, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if n < rounds:
            ctes.append(f"m{n} AS (SELECT k, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM a{n} JOIN v USING (vec_id) GROUP BY ALL)")
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT k, i, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (k, i))")
    return f"""
WITH {", ".join(ctes)},
h AS (SELECT k, sha256(string_agg(x, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY ALL)
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN h USING (k)"""


ORACLE_SQL = {"op1_decontaminate": DECONTAMINATE, "op3_warc": WARC, "op4_ngram_join": NGRAM_JOIN, "op8_quality_ledger": QUALITY,
              "op11_hard_negatives": HARD_NEGATIVES, "op13_centroids": _centroids()}
