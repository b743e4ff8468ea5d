"""SQL counterparts of the general data queries. Independent of the engine: plain group-bys and windows."""

from __future__ import annotations


def plain_path_sql(p: str) -> str:
    """Plain form of an absolute path."""
    parts = f"list_filter(string_split({p}, '/'), lambda c: c <> '' AND c <> '.')"
    return f"nfc_normalize(list_reduce({parts}, lambda acc, c: CASE WHEN c = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || c END, ''))"


def event_sql(e: str) -> str:
    """Lower-case name or number of an event type without blanks, hyphens and underscores."""
    plain = f"regexp_replace(regexp_replace(lower(trim({e})), '^eventtype::', ''), '[ _-]', '', 'g')"
    names = "'created','1'), ('modified','2'), ('deleted','3'), ('renamed','4'), ('permissionchanged','5'), ('metadatachanged','6'), ('checkpoint','255'"
    cases = " ".join(f"WHEN {plain} IN ({pair}) THEN {pair.split(',')[1].strip(chr(39))}" for pair in names.split("), ("))
    return f"CASE {cases} END"


P3 = f"""
WITH t AS (SELECT max(read_upto) AS upto FROM index_runs WHERE lower(trim(status)) = 'succeeded' AND finished_at IS NOT NULL),
e AS (SELECT seq, mtime_ns, received_at FROM wal_entries WHERE coalesce({event_sql('event_type')}, 0) <> 255),
v AS (SELECT seq, mtime_ns, min(received_at) AS first_at FROM e GROUP BY seq, mtime_ns)
SELECT DISTINCT seq FROM v, t WHERE t.upto IS NULL OR first_at > t.upto
"""

_STATES = f"""
r AS (SELECT snapshot_id, taken_at, root, {plain_path_sql('path')} AS path, size, mtime_ns // 1000 AS mt, content_hash, walked_at FROM index_snapshots),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY snapshot_id, path ORDER BY walked_at DESC) = 1),
o AS (SELECT snapshot_id, row_number() OVER (ORDER BY min(taken_at)) AS i FROM index_snapshots GROUP BY snapshot_id),
s AS (SELECT l.*, o.i FROM l JOIN o USING (snapshot_id)),
c AS (
  SELECT b.i, b.path, b.root, 'added' AS change FROM s b LEFT JOIN s a ON a.path = b.path AND a.i = b.i - 1 WHERE a.path IS NULL AND b.i > 1
  UNION ALL
  SELECT a.i + 1, a.path, a.root, 'removed' FROM s a LEFT JOIN s b ON a.path = b.path AND a.i = b.i - 1 WHERE b.path IS NULL
  UNION ALL
  SELECT b.i, b.path, b.root, 'changed' FROM s a JOIN s b ON a.path = b.path AND a.i = b.i - 1
  WHERE a.size <> b.size OR a.content_hash <> b.content_hash OR a.mt IS DISTINCT FROM b.mt
)
"""

P4 = f"WITH {_STATES} SELECT o.snapshot_id, c.path, c.change FROM c JOIN o USING (i)"

P4_DIFF = f"""WITH {_STATES} SELECT o.snapshot_id, c.root,
count(*) FILTER (change = 'added') AS n_to_add, min(path) FILTER (change = 'added') AS first_to_add, max(path) FILTER (change = 'added') AS last_to_add,
count(*) FILTER (change = 'removed') AS n_to_delete, min(path) FILTER (change = 'removed') AS first_to_delete, max(path) FILTER (change = 'removed') AS last_to_delete,
count(*) FILTER (change = 'changed') AS n_to_update, min(path) FILTER (change = 'changed') AS first_to_update, max(path) FILTER (change = 'changed') AS last_to_update
FROM c JOIN o USING (i) GROUP BY o.snapshot_id, c.root"""

P4_LISTS = f"""WITH {_STATES}, li AS (SELECT o.snapshot_id, c.root, CASE c.change WHEN 'added' THEN 'to_add' WHEN 'removed' THEN 'to_delete' ELSE 'to_update' END AS list, path FROM c JOIN o USING (i)),
n AS (SELECT *, ceil(count(*) OVER (PARTITION BY snapshot_id, root, list) / 10000)::BIGINT AS parts FROM li)
SELECT snapshot_id, root, list, (('0x' || substr(md5(path), 1, 8))::BIGINT % parts)::INT AS part, string_agg(path, chr(10) ORDER BY path) AS paths FROM n GROUP BY 1, 2, 3, 4"""

P6 = f"""
WITH e AS (SELECT seq, doc_id, path, {event_sql('event_type')} AS code, received_at FROM wal_entries),
ok AS (SELECT * FROM e WHERE code <> 255 AND doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq ORDER BY received_at DESC) = 1),
last AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1)
SELECT doc_id, path FROM last WHERE code <> 3
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3, "p4_found": P4, "p4_diff_sizes": P4_DIFF, "p4_lists": P4_LISTS, "p6_found": P6}
