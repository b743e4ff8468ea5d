"""SQL counterparts of the llm queries, by plain group-bys and windows."""

from __future__ import annotations

from findgrain.llm.leakage import UNITS
from findgrain.plans.data_sql import event_sql, plain_path_sql

_RUNS = f"""
WITH e AS (
  SELECT seq, any_value(timestamp_us) AS ts, any_value({plain_path_sql('path')}) AS p, any_value({event_sql('event_type')}) AS code
  FROM wal_entries WHERE path IS NOT NULL AND {event_sql('event_type')} <> 255 GROUP BY seq
),
b AS (SELECT *, CASE WHEN lag(code) OVER w = code AND ts - lag(ts) OVER w <= 2000000 THEN 0 ELSE 1 END AS new_run FROM e WINDOW w AS (PARTITION BY p ORDER BY ts, seq)),
r AS (SELECT *, sum(new_run) OVER (PARTITION BY p ORDER BY ts, seq) AS run FROM b),
g AS (SELECT p, run, code, arg_min(seq, (ts, seq)) AS first_seq, arg_max(seq, (ts, seq)) AS last_seq, count(*) AS n, max(ts) - min(ts) AS duration_us FROM r GROUP BY p, run, code)
"""
P1 = _RUNS + "SELECT first_seq, last_seq FROM g WHERE n >= 2"
P1_COLLAPSED = _RUNS + """SELECT first_seq, last_seq, CASE code WHEN 1 THEN 'Created' WHEN 2 THEN 'Modified' WHEN 3 THEN 'Deleted' WHEN 4 THEN 'Renamed'
WHEN 5 THEN 'PermissionChanged' WHEN 6 THEN 'MetadataChanged' END AS event_type, n, duration_us FROM g"""

_OCC = "o AS (SELECT doc_id, field, token_pos, min(trim(lower(nfc_normalize(term)))) AS term FROM tokens WHERE doc_id IS NOT NULL AND trim(term) <> '' GROUP BY ALL)"
_OCC = _OCC.replace("GROUP BY ALL", "GROUP BY doc_id, field, token_pos")
_FREQ = f"""
WITH {_OCC}, n AS (SELECT count(DISTINCT doc_id) AS n FROM o),
f AS (SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS files FROM o GROUP BY term),
m AS (SELECT f.*, CASE WHEN files = 1 THEN 'rare' WHEN files * 10 > n.n THEN 'common' END AS mark FROM f, n)
"""
P2 = _FREQ + "SELECT term, mark FROM m WHERE mark IS NOT NULL"
P2_TERMS = _FREQ + "SELECT term, occurrences, files, mark FROM m"

P5 = """
WITH q AS (SELECT query_id, min(ts) AS ts, min(latency_ms) AS v FROM query_metrics WHERE latency_ms >= 0 GROUP BY query_id),
d AS (SELECT strftime(ts, '%Y-%m-%d') AS metric_day, list_sort(list(v)) AS s FROM q GROUP BY 1),
a AS (SELECT list_sort(list(v)) AS s FROM q),
p AS (SELECT unnest([50, 90, 99])::INT AS pct)
SELECT metric_day, pct FROM d, a, p WHERE d.s[len(d.s) * pct // 100 + 1] > 1.5 * a.s[len(a.s) * pct // 100 + 1]
"""

P5_RANK = """
WITH q AS (SELECT query_id, min(ts) AS ts, 'latency_ms' AS metric FROM query_metrics WHERE latency_ms >= 0 GROUP BY query_id
  UNION ALL SELECT query_id, min(ts), 'result_count' FROM query_metrics WHERE result_count >= 0 GROUP BY query_id),
g AS (SELECT metric, strftime(ts, '%Y-%m-%d') AS metric_day, count(*) AS size FROM q GROUP BY 1, 2 UNION ALL SELECT metric, 'all', count(*) FROM q GROUP BY 1)
SELECT metric, metric_day, pct, size, true AS within FROM g, (SELECT unnest([50, 90, 99])::INT AS pct)
"""

_TFIDF = f"""
WITH {_OCC}, tf AS (SELECT doc_id, term, count(*) AS n FROM o GROUP BY doc_id, term),
t AS (SELECT term, count(*) AS files, sum(n)::BIGINT AS term_n FROM tf GROUP BY term),
d AS (SELECT doc_id, sum(n)::BIGINT AS doc_n FROM tf GROUP BY doc_id),
a AS (SELECT count(*) AS docs, sum(doc_n)::BIGINT AS all_n FROM d),
s AS (SELECT tf.doc_id, tf.term, tf.n, t.files, round(tf.n * ln(a.docs / t.files), 6) AS weight,
  tf.n::DOUBLE AS ka, (t.term_n - tf.n)::DOUBLE AS kb, (d.doc_n - tf.n)::DOUBLE AS kc, (a.all_n - d.doc_n - t.term_n + tf.n)::DOUBLE AS kd
  FROM tf JOIN t USING (term) JOIN d USING (doc_id), a)
"""
P7 = _TFIDF + """, w AS (SELECT DISTINCT doc_id FROM raw_results WHERE score IS NULL OR isnan(score) OR isinf(score) OR score < 0)
SELECT doc_id, term FROM s JOIN w USING (doc_id) WHERE files >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) = 1"""


def _g(o: str, row: str, col: str) -> str:
    return f"CASE WHEN {o} > 0 THEN {o} * ln({o} * (ka + kb + kc + kd) / (({row}) * ({col}))) ELSE 0 END"


_LLR = f"2 * ({_g('ka', 'ka + kb', 'ka + kc')} + {_g('kb', 'ka + kb', 'kb + kd')} + {_g('kc', 'kc + kd', 'ka + kc')} + {_g('kd', 'kc + kd', 'kb + kd')})"
P7_SCORES = _TFIDF + f"SELECT doc_id, term, n, files, round(CASE WHEN ka * (kb + kd) >= kb * (ka + kc) THEN 1 ELSE -1 END * {_LLR}, 4) AS llr, round(weight, 4) AS weight FROM s"

_SINGLE = r"[\p{Han}\x{3041}-\x{3096}\x{309d}-\x{309f}\x{30a1}-\x{30fa}\x{30fc}-\x{30ff}]"


def _words(text: str) -> str:
    """Runs of letters and digits of a text, each Han or kana letter by itself."""
    folded = f"nfc_normalize(lower({text}))"
    return f"regexp_extract_all(regexp_replace({folded}, '({_SINGLE})', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')".replace("\\\\", "\\")


P8 = f"""
WITH i AS (SELECT item_id, {_words('text')} AS w FROM eval_items WHERE text IS NOT NULL),
il AS (SELECT item_id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM il)),
d AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, ks.k, unnest(range(1, len(w) - ks.k + 2)) AS s FROM d, (SELECT DISTINCT k FROM il) ks))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (k, g)
"""


_UNITS = ", ".join(f"'{u}'" for u in UNITS)
_NUMBER = "regexp_matches({w}, '^\\p{{Nd}}')"


def _templates(windows: str) -> str:
    """Windows ``(id, k, g, x)`` with words ``g`` and the word before each ``x``: a template in which numbers and units after numbers stand as the place of their first occurrence."""
    number, follows = _NUMBER.format(w="g[i]"), _NUMBER.format(w="g[i - 1]")
    return f"""SELECT id, k, array_to_string(g, ' ') AS words, CASE WHEN len(list_filter(t, lambda v: v = '')) = 0 THEN '= ' || array_to_string(g, ' ')
  ELSE array_to_string(list_transform(range(1, k + 1), lambda i: CASE WHEN t[i] = '' THEN g[i] ELSE t[i] || list_position(list_transform(range(1, k + 1), lambda j: t[j] || g[j]), t[i] || g[i]) END), ' ') END AS template
FROM (SELECT *, list_transform(range(1, k + 1), lambda i: CASE WHEN {number} THEN '#' WHEN i > 1 AND g[i] IN ({_UNITS}) AND {follows} THEN '%' ELSE '' END) AS t FROM {windows})"""


P8_NUMBERS = f"""
WITH i AS (SELECT item_id AS id, {_words('text')} AS w FROM eval_items WHERE text IS NOT NULL),
il AS (SELECT id, w, least(13, len(w)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT id, k, w[s:s + k - 1] AS g FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM il)),
d AS (SELECT doc_id AS id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT id, k, w[s:s + k - 1] AS g, s FROM (SELECT id, w, ks.k, unnest(range(1, len(w) - ks.k + 2)) AS s FROM d, (SELECT DISTINCT k FROM il) ks)),
it AS ({_templates('iw')}), dt AS ({_templates('dw')})
SELECT dt.id AS doc_id, it.id AS item_id, count(*) AS windows, count(*) FILTER (dt.words = it.words) AS verbatim FROM dt JOIN it USING (k, template) GROUP BY dt.id, it.id
"""

# sized in tokens of the tokenizer whose tokens are bytes
P9 = """
WITH d AS (SELECT lower(trim(source)) AS source, strlen(text)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size) AS size FROM d GROUP BY source), w AS (SELECT sum(size) AS size FROM d)
SELECT lower(trim(t.source)) AS source FROM mix_targets t LEFT JOIN s ON s.source = lower(trim(t.source)), w WHERE coalesce(s.size, 0) * t.max_repeats < t.target_share * w.size
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1,
        "p1_collapsed": P1_COLLAPSED,
        "p2_found": P2,
        "p2_terms": P2_TERMS,
        "p5_found": P5,
        "p5_rank_error": P5_RANK,
        "p7_found": P7,
        "p7_scores": P7_SCORES,
        "p8_found": P8,
        "p8_numbers": P8_NUMBERS,
        "p9_found": P9,
    }
