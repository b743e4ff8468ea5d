"""SQL counterparts of the maintenance, health and streaming queries."""

from __future__ import annotations

from findgrain.plans.search_sql import _INDEX, _POSTINGS

_LOG = "log AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM query_metrics WHERE latency_ms >= 0)"


def _listing(name: str, which: str) -> str:
    return f"""{name} AS (SELECT path, root, size, mtime_ns FROM index_snapshots WHERE snapshot_id = (SELECT {which}(snapshot_id) FROM index_snapshots)
QUALIFY row_number() OVER (PARTITION BY path ORDER BY walked_at DESC NULLS LAST, size DESC NULLS LAST, mtime_ns DESC NULLS LAST, root DESC) = 1)"""


_TWO = f"{_listing('d', 'max')}, {_listing('i', 'min')}"
_RATES = f"""r AS (SELECT count(*) AS checked, avg((d.path IS NULL)::INT) AS ph, avg((d.path IS NOT NULL AND i.mtime_ns IS DISTINCT FROM d.mtime_ns)::INT) AS stl FROM i LEFT JOIN d USING (path))"""
_RECON = "x AS (SELECT coalesce(d.path, i.path) AS path, i.root AS iroot, CASE WHEN i.path IS NULL THEN 'add' WHEN d.path IS NULL THEN 'delete' WHEN d.size IS DISTINCT FROM i.size OR d.mtime_ns IS DISTINCT FROM i.mtime_ns THEN 'update' END AS action FROM d FULL JOIN i ON d.path = i.path)"

_ALL = f"WITH {_POSTINGS}"
_CHANGES = """ch AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' WHEN 'purchase' THEN 'Renamed' ELSE 'Modified' END AS event_type,
concat('/Users/me/Documents/u', CAST(user_id % 7 AS VARCHAR), '/file_', CAST(user_id AS VARCHAR), '.txt') AS path, CAST(floor(value) AS BIGINT) AS size FROM events)"""
_RANKS = """ok AS (SELECT query_id AS list_id, doc_id, max(score) AS a, min(score) AS b FROM raw_results WHERE score >= 0 AND score < 1e300 AND NOT isnan(score) GROUP BY query_id, doc_id),
ra AS (SELECT list_id, doc_id, row_number() OVER (PARTITION BY list_id ORDER BY a DESC, doc_id) AS r FROM ok),
rb AS (SELECT list_id, doc_id, row_number() OVER (PARTITION BY list_id ORDER BY b + doc_id % 3 DESC, doc_id) AS r FROM ok),
n AS (SELECT list_id, count(*) AS n FROM ok GROUP BY list_id),
m AS (SELECT list_id, greatest(ra.r, rb.r) AS d FROM ra JOIN rb USING (list_id, doc_id)),
l AS (SELECT list_id, n, unnest(range(1, n + 1)) AS d FROM n),
g AS (SELECT l.list_id, l.n, l.d, (SELECT count(*) FROM m WHERE m.list_id = l.list_id AND m.d <= l.d) / l.d AS ag FROM l),
rbo AS (SELECT list_id, 0.1 * sum(ag * pow(0.9, d - 1)) + max(CASE WHEN d = n THEN ag * pow(0.9, n) END) AS rbo FROM g GROUP BY list_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "latency_percentiles": f"WITH {_LOG}, s AS (SELECT day, list_sort(list(latency_ms)) AS v FROM log GROUP BY day) SELECT day, v[len(v) * 50 // 100 + 1] AS p50, v[len(v) * 99 // 100 + 1] AS p99 FROM s",
        "zero_result_rate": f"WITH {_LOG} SELECT day, count(result_count) AS queries, round(coalesce(avg((result_count = 0)::INT), 0), 6) AS zero_rate FROM log GROUP BY day",
        "retention": f"WITH {_LOG} SELECT day, count(*) AS n FROM log WHERE ts >= timestamp '2025-02-16' - interval 7 day GROUP BY day",
        "oldest_dropped": f"WITH {_LOG}, k AS (SELECT ts, sum(count(*)) OVER (ORDER BY ts) AS upto, sum(count(*)) OVER () AS whole FROM log GROUP BY ts), e AS (SELECT min(ts) AS t FROM k WHERE upto > 0.1 * whole) SELECT day, count(*) AS n FROM log, e WHERE ts >= t GROUP BY day",
        "integrity_rates": f"WITH {_TWO}, {_RATES} SELECT checked, round(ph, 6) AS phantom_rate, round(stl, 6) AS stale_rate, ph > 0.05 AS reconcile FROM r",
        "health_status": f"""WITH {_TWO}, {_RATES}, v AS (SELECT list_sort(list(latency_ms)) AS v FROM query_metrics WHERE latency_ms >= 0),
p AS (SELECT v[len(v) * 50 // 100 + 1] AS p50, v[len(v) * 99 // 100 + 1] AS p99 FROM v)
SELECT checked, p50, p99, CASE WHEN ph > 0.05 OR p99 > 350 THEN 'UNHEALTHY' WHEN ph > 0.02 OR p99 > 150 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM r, p""",
        "content_coverage": """SELECT count(*) AS eligible, round(avg((coalesce(length(text), 0) > 0)::INT), 6) AS coverage FROM documents
WHERE regexp_matches(lower(path), '\\.(pdf|docx|doc|rtf|odt|txt|md|markdown|rst|org|tex|log|csv|tsv|json|yaml|yml|toml|xml|html|htm|css|py|rs|sh|sql)$')""",
        "reconcile_diff": f"WITH {_TWO}, {_RECON} SELECT path, action FROM x WHERE action IS NOT NULL",
        "reconcile_readable": f"WITH d0 AS (SELECT 1), {_TWO.replace('d AS (', 'dd AS (', 1)}, d AS (SELECT * FROM dd WHERE root = '/Users/baba'), {_RECON} SELECT path, action FROM x WHERE action IS NOT NULL AND (action <> 'delete' OR iroot = '/Users/baba')",
        "path_differences": f"WITH {_TWO} SELECT path, 'add' AS action FROM d WHERE path NOT IN (SELECT path FROM i) UNION ALL SELECT path, 'delete' FROM i WHERE path NOT IN (SELECT path FROM d)",
        "identity_allocate": """WITH s AS (SELECT volume_uuid, inode, min(doc_id) AS d FROM wal_entries WHERE inode IS NOT NULL GROUP BY volume_uuid, inode),
k AS (SELECT volume_uuid, inode, d AS doc_id FROM s WHERE inode % 2 = 0 AND d IS NOT NULL), t AS (SELECT coalesce(max(doc_id), 0) AS top FROM k),
n AS (SELECT volume_uuid, inode FROM s WHERE NOT (inode % 2 = 0 AND d IS NOT NULL))
SELECT * FROM k UNION ALL SELECT volume_uuid, inode, top + row_number() OVER (ORDER BY volume_uuid NULLS FIRST, inode) FROM n, t""",
        "delta_merge": f"""{_ALL}, live AS (SELECT * FROM p WHERE doc_id % 10 <> 6),
again AS (SELECT p.term, p.doc_id, p.field, p.tf FROM live p), more AS (SELECT unnest(['rewritten', 'file']) AS term),
x AS (SELECT term, doc_id, field, tf FROM again UNION ALL SELECT term, doc_id, 4, 1 FROM more, (SELECT doc_id FROM documents WHERE path IS NOT NULL AND doc_id % 10 = 7)),
y AS (SELECT term, doc_id, field = 4 AS c, sum(tf) AS tf FROM x GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM y GROUP BY term""".replace("GROUP BY ALL", "GROUP BY term, doc_id, field = 4"),
        "dead_set_search": f"""{_ALL}, x AS (SELECT term, doc_id, field, tf FROM p WHERE doc_id % 10 <> 6 UNION ALL SELECT 'rewritten', doc_id, 4, 1 FROM documents WHERE path IS NOT NULL AND doc_id % 10 = 7)
SELECT term, doc_id, field, sum(tf)::BIGINT AS tf FROM x WHERE term IN ('rewritten', 'snapshot', 'report') GROUP BY term, doc_id, field""",
        "change_log_latest_state": f"WITH {_CHANGES} SELECT path, seq, event_type, size FROM ch QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1",
        "log_monotonicity": "WITH s AS (SELECT seq, lead(seq) OVER (ORDER BY seq) AS next_seq FROM (SELECT DISTINCT seq FROM wal_entries)) SELECT seq, next_seq FROM s WHERE next_seq <> seq + 1",
        "replay_after_seq": "SELECT DISTINCT seq FROM wal_entries WHERE seq > 41000 AND seq < coalesce((SELECT min(seq) FROM wal_entries WHERE event_type = '?' AND seq > 41000), 1e18)",
        "event_dedup_100ms": """WITH RECURSIVE e AS (SELECT seq, min(path) AS path, min(timestamp_us) AS us FROM wal_entries WHERE path <> '' GROUP BY seq),
k AS (SELECT path, min(us) AS us FROM e GROUP BY path UNION ALL SELECT k.path, min(e.us) AS us FROM k JOIN e ON e.path = k.path AND e.us >= k.us + 100000 GROUP BY k.path)
SELECT path, us, min(seq) AS seq FROM k JOIN e USING (path, us) GROUP BY path, us""",
        "event_debounce": """WITH RECURSIVE e AS (SELECT path, timestamp_us AS us, count(DISTINCT timestamp_us) AS n FROM wal_entries WHERE path <> '' GROUP BY path, timestamp_us),
b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY path ORDER BY us) < 300000 THEN 0 ELSE 1 END AS s FROM e),
g AS (SELECT *, sum(s) OVER (PARTITION BY path ORDER BY us) AS k FROM b),
w AS (SELECT path, k, min(us) AS start FROM g GROUP BY path, k
  UNION ALL SELECT w.path, w.k, min(g.us) FROM w JOIN g ON g.path = w.path AND g.k = w.k AND g.us >= w.start + 2000000 GROUP BY w.path, w.k, w.start),
p AS (SELECT g.path, g.us, g.n, max(w.start) AS start FROM g JOIN w ON w.path = g.path AND w.k = g.k AND w.start <= g.us GROUP BY g.path, g.us, g.n)
SELECT path, start AS start_us, least(max(us) + 300000, start + 2000000) AS end_us, sum(n)::BIGINT AS events FROM p GROUP BY path, start""",
        "log_append": """WITH e AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' WHEN 'purchase' THEN 'Renamed' ELSE 'Modified' END AS event_type,
  concat('/Users/me/Documents/u', CAST(user_id % 7 AS VARCHAR), '/file_', CAST(user_id AS VARCHAR), '.txt') AS path, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events)
SELECT 1 + k + k // 256 AS seq, event_type, path FROM e UNION ALL SELECT 2 + k + k // 256, 'Checkpoint', NULL FROM e WHERE k % 256 = 255""",
        "subtree_deletes": "SELECT doc_id, path FROM documents WHERE starts_with(path, '/Users/baba/Documents/') OR starts_with(path, '/Volumes/team/Projects/lantern/docs/') OR starts_with(path, '/Users/bace/Desk/')",
        "rbo_eval": f"WITH {_RANKS} SELECT list_id, round(rbo, 12) AS rbo FROM rbo",
        "rbo_gate": f"WITH {_RANKS}, o AS (SELECT rbo, row_number() OVER (ORDER BY rbo, list_id) - 1 AS k, count(*) OVER () AS c FROM rbo) SELECT round(rbo, 12) AS p10, rbo >= 0.7 AS passes FROM o WHERE k = 10 * (c - 1) // 100",
        "duplicate_ids": "SELECT doc_id, count(*) AS n FROM raw_results GROUP BY doc_id HAVING count(*) > 1",
        "orphan_postings": "SELECT doc_id, count(*) AS n FROM tokens WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id",
    }
