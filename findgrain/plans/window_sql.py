"""SQL counterparts of the rules around search."""

from __future__ import annotations

from findgrain.plans.search_sql import _CLICKS, _POSTINGS, EXT, NAME, _hits, words

_TEXT = "('txt','md','markdown','rst','org','tex','log','csv','tsv','json','yaml','yml','toml','xml','html','htm','css','py','rs','sh','sql')"


def oracle_sql() -> dict[str, str]:
    return {
        "access_scope": """SELECT doc_id, true AS "full", regexp_matches(path, '^/Users/baba/(Desktop|Documents|Downloads)(/|$)') AS limited, false AS denied FROM documents WHERE path IS NOT NULL""",
        "volume_rules": """SELECT doc_id, NOT starts_with(path, '/Volumes/') AS shown, NOT starts_with(path, '/Volumes/') OR contains(path, '/team/') AS read,
CASE WHEN starts_with(path, '/Volumes/') THEN 'poll every 300 s' ELSE 'events' END AS watch FROM documents WHERE path IS NOT NULL""",
        "window_scopes": "SELECT doc_id, true AS files, regexp_matches(path, '\\.app/?$') AS applications, false AS clipboard FROM documents WHERE path IS NOT NULL",
        "long_enough": f"SELECT DISTINCT word FROM (SELECT unnest({words(NAME)}) AS word FROM documents WHERE path IS NOT NULL) WHERE length(word) >= 2",
        "unread_filters": """SELECT * FROM (VALUES (1, 'budget', 'after:yesterday,size:big', NULL::VARCHAR, NULL::VARCHAR, true, ''), (2, 'x', 'before:2024-13,size:>5tb', '2024-05-01', NULL, true, ''),
(3, 'plan', '', NULL, NULL, true, ''), (4, '-', 'after:1969', NULL, NULL, true, ''), (5, '', '', NULL, NULL, true, '')) t(query_id, text, unrecognised, from_day, before_day, unbounded, excluded)""",
        "boundary_rows": f"SELECT doc_id, path, 1.0::DOUBLE AS score, {NAME} AS name FROM documents WHERE path IS NOT NULL",
        "word_spans": f"SELECT doc_id, array_to_string(regexp_extract_all({NAME}, '[\\p{{L}}\\p{{N}}]+'), '|') AS words FROM documents WHERE path IS NOT NULL",
        "expansion_weights": "SELECT * FROM (VALUES ('0', 0.6::DOUBLE), ('1', 0.6), ('2', 0.25), ('sound', 0.15)) t(found_by, weight)",
        "time_left": """SELECT DISTINCT query_id, greatest(1, ceil(latency_ms * (1 - d) / d / 60))::BIGINT AS minutes
FROM (SELECT query_id, latency_ms, ((query_id % 101 + 101) % 101) / 100 AS d FROM query_metrics WHERE latency_ms IS NOT NULL) WHERE latency_ms >= 3 AND d > 0.02 AND d < 1""",
        "memory_states": """SELECT CASE WHEN r > 0.95 THEN 'Critical' WHEN r > 0.80 THEN 'Minimal' WHEN r > 0.65 THEN 'Reduced' ELSE 'Normal' END AS state, count(*) AS n
FROM (SELECT latency_ms / 100 AS r FROM query_metrics WHERE latency_ms IS NOT NULL) GROUP BY 1""",
        "postings_bytes": f"WITH {_POSTINGS}, t AS (SELECT term, count(*) AS n FROM p GROUP BY term) SELECT sum(strlen(term) + 48 + 16 * n)::BIGINT AS bytes FROM t",
        "scope_hits": _hits("(1, 'snapshot')") + " SELECT doc_id, round(raw, 6) AS score FROM h JOIN (SELECT doc_id, path FROM documents) d USING (doc_id) WHERE starts_with(path, '/Volumes/team/')",
        "top_queries": f"WITH {_CLICKS} SELECT 'query ' || (click_id % 15) AS query, count(*) AS clicks FROM c GROUP BY 1 ORDER BY clicks DESC, query LIMIT 10",
        "top_paths": f"""WITH {_CLICKS}, s AS (SELECT string_split(path, '/') AS parts FROM c),
e AS (SELECT array_to_string(parts[1:k], '/') AS path FROM (SELECT parts, unnest(range(2, len(parts) + 1)) AS k FROM s)) SELECT path, count(*) AS clicks FROM e GROUP BY path ORDER BY clicks DESC, path LIMIT 10""",
        "query_history": """WITH l AS (SELECT query_id, min(ts) AS ts, 'q' || (((min(latency_ms) % 3) + 3) % 3) AS query FROM query_metrics WHERE latency_ms IS NOT NULL GROUP BY query_id),
u AS (SELECT *, query_id % 7 AS "user" FROM l), b AS (SELECT *, lag(query) OVER (PARTITION BY "user" ORDER BY ts, query_id) AS was FROM u)
SELECT "user", query_id, query FROM b WHERE was IS NULL OR was <> query QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, query_id DESC) <= 50""",
        "after_calls": "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 100",
        "roots": """WITH r(root) AS (VALUES ('/u/a'), ('/u/a'), ('/u/a/b'), ('/u/ab'), ('/u/a/c'), ('/w/x'), ('/w/x')), d AS (SELECT DISTINCT root FROM r)
SELECT root FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE starts_with(d.root, o.root || '/'))""",
        "text_cut": f"""SELECT doc_id, CASE WHEN contains(text, chr(0)) THEN '' ELSE substr(text, 1, list_max(list_filter(range(0, 101), lambda k: strlen(substr(text, 1, k)) <= 100))) END AS head, strlen(text) < 100 AS "full"
FROM documents WHERE path IS NOT NULL AND text IS NOT NULL AND {EXT} IN {_TEXT}""",
        "generation_round_trip": f"WITH {_POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM p GROUP BY term",
        "permission_audit": """WITH o AS (SELECT path, seq, max(mode) AS mode FROM wal_entries WHERE path IS NOT NULL AND mode IS NOT NULL GROUP BY path, seq),
b AS (SELECT *, lag(mode) OVER (PARTITION BY path ORDER BY seq) AS was FROM o) SELECT path, seq, coalesce(was, -1) AS was, mode FROM b WHERE was IS NULL OR was <> mode""",
        "permission_state": "SELECT path, mode, (mode & 256) = 256 AS readable FROM wal_entries WHERE path IS NOT NULL AND mode IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC, mode DESC) = 1",
        "merge_due": f"WITH {_POSTINGS} SELECT l AS letter, (SELECT count(*) FROM p WHERE starts_with(term, l)) >= 1000 AS due FROM (SELECT unnest(['a', 'e', 'q', 'x', 'z']) AS l)",
        "name_segments": """WITH s AS (SELECT DISTINCT unnest(string_split(lower(path), '/')) AS segment FROM documents WHERE path IS NOT NULL), w(word) AS (VALUES ('note'), ('vent'), ('ar'), ('zzz'), ('résu'), ('2024'))
SELECT word, segment FROM s, w WHERE segment <> '' AND contains(segment, word)""",
    }
