"""SQL counterparts of the search queries, without use of the engine's output."""

from __future__ import annotations

from findgrain.functions.analyze import STOP_WORDS
from findgrain.plans.fixtures import CHIP_QUERIES, ENGINE_QUERIES, NOW_NS, QUERIES

_BLANK = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STOPPED = ", ".join(f"'{w}'" for w in STOP_WORDS)


def camel(e: str) -> str:
    return rf"regexp_replace({e}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')"


def terms(e: str) -> str:
    """Index terms of a text as a list."""
    words = rf"regexp_split_to_array(lower({camel(f'nfc_normalize(coalesce({e}, $$$$))')}), '[{_BLANK}!-/:-@\[-`{{-~]+')"
    return f"list_filter({words}, lambda w: w <> '' AND w NOT IN ({_STOPPED}))"


def words(e: str) -> str:
    """Query words of a text as a list."""
    return rf"list_filter(regexp_split_to_array(lower({camel(e)}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


NAME = "regexp_replace(path, '^.*/', '')"
FOLDER = "regexp_replace(path, '/[^/]*$', '')"
STEM = rf"regexp_replace({NAME}, '^(.+)\.[^.]*$', '\1')"
EXT = rf"lower(regexp_extract({NAME}, '^.+\.([^.]*)$', 1))"
BELOW = f"CASE WHEN {FOLDER} = folder THEN '' WHEN starts_with({FOLDER}, folder || '/') THEN substr({FOLDER}, length(folder) + 2) ELSE {FOLDER} END"

_NAME_OCC = f"""
no AS (SELECT doc_id, unnest({terms(NAME)}) AS term, 1 AS field FROM documents WHERE path IS NOT NULL
  UNION ALL SELECT doc_id, unnest({terms(BELOW)}), 2 FROM documents WHERE path IS NOT NULL),
np AS (SELECT term, doc_id, bit_or(field)::INT AS field, count(*) AS tf FROM no GROUP BY term, doc_id)"""
_POSTINGS = f"""{_NAME_OCC},
co AS (SELECT doc_id, unnest({terms('text')}) AS term FROM documents WHERE path IS NOT NULL),
cp AS (SELECT term, doc_id, 4 AS field, count(*) AS tf FROM co GROUP BY term, doc_id),
p AS (SELECT * FROM np UNION ALL SELECT * FROM cp)"""
_INDEX = f"""{_POSTINGS},
dl AS (SELECT d.doc_id, coalesce(l.n, 0) AS doc_len FROM (SELECT doc_id FROM documents WHERE path IS NOT NULL) d LEFT JOIN (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id) l USING (doc_id)),
sz AS (SELECT count(*) AS n_docs, greatest(avg(doc_len), 1.0) AS avg_len FROM dl),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
_BM25 = """ln((greatest(n_docs - df, 0) + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(doc_len, 1) / avg_len))
  * CASE WHEN field & 1 <> 0 THEN 3.0 WHEN field & 2 <> 0 THEN 1.5 ELSE 1.0 END"""


def _hits(rows: str) -> str:
    return f"""WITH {_INDEX}, q(query_id, term) AS (VALUES {rows}),
h AS (SELECT query_id, doc_id, sum({_BM25}) AS raw FROM q JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id), sz GROUP BY query_id, doc_id)"""


_Q = ", ".join(f"({i}, '{q}')" for i, q in QUERIES)
_FILTER = r"(^| )((?i:kind|in|after|before|size|tag):\S*|-\S+)"
# text of each query without filters, as a fixed list: filters are tested by filter_files
_TEXTS = {
    i: " ".join(t for t in q.split(" ") if not t.lower().startswith(("kind:", "in:", "after:", "before:", "size:", "tag:")) and not (t.startswith("-") and len(t) > 1))
    for i, q in QUERIES
}
_A = ", ".join(f"({i}, '{t}')" for i, t in _TEXTS.items())
_ASKED = f"""r(query_id, txt) AS (VALUES {_A}), a AS (SELECT query_id, lower(trim(txt)) AS q, {words('trim(txt)')} AS w, {terms('trim(txt)')} AS t, regexp_matches(txt, '[./]') AS literal FROM r)"""

_OF = lambda key, alias: f"list_transform(list_filter(s, lambda x: starts_with(lower(x), '{key}:')), lambda x: substr(lower(x), {len(key) + 2})) AS {alias}"
_PARSED = f"""WITH r(query_id, query) AS (VALUES {_Q}), l AS (SELECT query_id, string_split(query, ' ') AS s FROM r),
v AS (SELECT query_id, s, {", ".join(_OF(k, a) for k, a in (("kind", "kind"), ("in", "inn"), ("tag", "tag"), ("after", "after"), ("before", "before"), ("size", "size")))} FROM l)
"""

_LOC = "CASE WHEN contains(lower(path), '/downloads/') THEN 35 WHEN contains(lower(path), '/documents/') THEN 30 WHEN contains(lower(path), '/desktop/') THEN 25 ELSE 0 END"
_DAYS = f"floor(greatest({NOW_NS} - mtime_ns, 0)::DOUBLE / 86400000000000)"
_AGE = f"CASE WHEN {_DAYS} <= 1 THEN 8.0 WHEN {_DAYS} <= 7 THEN 5.0 WHEN {_DAYS} <= 30 THEN 2.0 ELSE 0.0 END"
_NAME_SCORE = f"""{_ASKED},
f AS (SELECT doc_id, path, mtime_ns, lower({NAME}) AS fn, lower({STEM}) AS st, {words(STEM)} AS sw, lower(path) AS p FROM documents WHERE path IS NOT NULL),
g AS (SELECT a.query_id, a.q, a.w, f.* FROM f, a WHERE contains(CASE WHEN literal THEN p ELSE fn END, q) OR len(list_filter(w, lambda x: contains(CASE WHEN literal THEN p ELSE fn END, x))) > 0),
s AS (SELECT *, CASE WHEN fn = q OR st = q THEN 250 WHEN list_contains(sw, q) THEN 180 ELSE 0 END
  + CASE WHEN starts_with(fn, q) OR starts_with(st, q) THEN 160 ELSE 0 END
  + CASE WHEN contains(fn, q) OR contains(st, q) OR (contains(q, '/') AND contains(p, q)) THEN 110 ELSE 0 END
  + coalesce(list_sum(list_transform(w, lambda x: CASE WHEN list_contains(sw, x) THEN 50 WHEN starts_with(st, x) THEN 35 WHEN contains(st, x) OR contains(fn, x) THEN 22 WHEN contains(p, x) THEN 6 ELSE 0 END)), 0)
  + CASE WHEN len(w) > 0 AND len(list_filter(w, lambda x: NOT (list_contains(sw, x) OR contains(st, x) OR contains(fn, x)))) = 0 THEN 80 ELSE 0 END
  + CASE WHEN len(w) > 1 AND len(list_filter(w, lambda x: NOT contains(fn, x))) = 0
      AND list_transform(w, lambda x: instr(fn, x)) = list_sort(list_transform(w, lambda x: instr(fn, x))) THEN 50 ELSE 0 END AS base FROM g),
n AS (SELECT query_id, doc_id, path, mtime_ns, (base + {_LOC})::DOUBLE AS score FROM s WHERE base > 0 AND NOT (contains(q, '.') AND NOT contains(fn, q) AND NOT contains(p, q)))"""

_BONUS = "0.2 * len(list_filter(w, lambda x: contains(lower(path), x))) + CASE WHEN len(w) > 1 AND len(list_filter(w, lambda x: contains(lower(path), x))) > 1 THEN len(list_filter(w, lambda x: contains(lower(path), x))) / len(w) ELSE 0 END"

_DOC = "CASE WHEN {e} IN ('png','jpg','jpeg','gif','webp','heic','tiff','bmp','svg') THEN ['image','photo','picture'] WHEN {e} IN ('rs','swift','ts','tsx','js','jsx','py','go','java','kt','cpp','c','h','rb','sh','sql') THEN ['code','source'] ELSE ['document','doc'] END".replace("{e}", EXT)
_DAY_NS = lambda d: f"(date '{d}' - date '1970-01-01')::BIGINT * 86400000000000"
_PASSES = {
    4: f"list_contains({_DOC}, 'doc') OR {EXT} = 'doc'",
    5: f"contains(lower({FOLDER}), 'documents') AND NOT contains(lower({NAME}), 'draft')",
    7: "size > 300",
    9: f"mtime_ns >= {_DAY_NS('2024-06-01')}",
    10: "lower(tag) = 'work' OR list_contains(string_split(lower(tag), ','), 'work')",
    14: f"mtime_ns < {_DAY_NS('2025-01-01')}",
}
_ALLOWED = "ok AS (" + " UNION ALL ".join(f"SELECT {i} AS query_id, doc_id FROM documents WHERE path IS NOT NULL AND ({_PASSES.get(i, 'true')})" for i, _ in QUERIES) + ")"

_SEARCH = f"""WITH {_INDEX}, {_NAME_SCORE.replace('n AS (', 'nm AS (')}, {_ALLOWED},
qt AS (SELECT query_id, unnest(t) AS term FROM a WHERE NOT literal),
h AS (SELECT query_id, doc_id, sum({_BM25}) AS raw FROM qt JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id), sz GROUP BY query_id, doc_id),
z AS (SELECT h.query_id, h.doc_id, raw / max(raw) OVER (PARTITION BY h.query_id) AS s FROM h),
b AS (SELECT z.query_id, z.doc_id, d.path, s + {_BONUS} AS s FROM z JOIN ok USING (query_id, doc_id) JOIN (SELECT doc_id, path FROM documents) d USING (doc_id) JOIN a ON a.query_id = z.query_id),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path, doc_id) <= 100),
u AS (SELECT query_id, doc_id, 20 * s AS s FROM t UNION ALL SELECT nm.query_id, nm.doc_id, score + {_AGE} FROM nm JOIN ok USING (query_id, doc_id)),
m AS (SELECT query_id, doc_id, sum(s) AS s FROM u GROUP BY query_id, doc_id)
SELECT query_id, doc_id, path, round(s, 6) AS score FROM m JOIN (SELECT doc_id, path FROM documents) d USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, path, doc_id) <= 100"""

_CLICKS = """c AS (SELECT r.query_id AS click_id, r.found_at AS ts, d.path FROM raw_results r JOIN documents d USING (doc_id) WHERE r.exact AND r.doc_id IS NOT NULL)"""


def _tri(e: str) -> str:
    return f"list_distinct(list_transform(range(1, length({e}) - 1), lambda i: substr({e}, i, 3)))"


def _edits(term: str, name: str) -> str:
    """Edit distance in letters: it is counted in bytes, so letters beyond ASCII, which no asked word has, become one byte each."""
    return f"damerau_levenshtein({term}, regexp_replace({name}, '[^\\x00-\\x7F]', '~', 'g'))"


_FULL = f"""WITH {_INDEX}, {_NAME_SCORE.replace('n AS (', 'nm AS (')}, {_ALLOWED}, {_CLICKS},
ck AS (SELECT path, count(*) AS clicks FROM (SELECT array_to_string(parts[1:k], '/') AS path FROM (SELECT parts, unnest(range(2, len(parts) + 1)) AS k FROM (SELECT string_split(path, '/') AS parts FROM c))) GROUP BY path),
qt AS (SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM a WHERE NOT literal),
v AS (SELECT DISTINCT term AS name FROM np), ww AS (SELECT DISTINCT term FROM qt),
nr AS (SELECT term, name, {_edits('term', 'name')} AS dist FROM ww, v WHERE name <> term AND {_edits('term', 'name')} <= CASE WHEN length(term) >= 5 THEN 2 ELSE 1 END),
ex AS (SELECT query_id, name AS term, arg_min(CASE WHEN dist <= 1 THEN 0.6 ELSE 0.25 END, pos) AS w, min(pos) AS pos FROM qt JOIN nr USING (term) GROUP BY query_id, name),
ty AS (SELECT query_id, term, min(pos) AS at FROM qt GROUP BY query_id, term),
wt AS (SELECT query_id, term, 1.0 AS w, true AS exact FROM qt UNION ALL SELECT ex.query_id, ex.term, ex.w, false FROM ex LEFT JOIN ty USING (query_id, term) WHERE ty.at IS NULL OR ty.at > ex.pos),
h AS (SELECT query_id, doc_id, sum({_BM25} * w) AS raw, bool_or(exact) AS exact FROM wt JOIN p USING (term) JOIN df USING (term) JOIN dl USING (doc_id), sz GROUP BY query_id, doc_id),
z AS (SELECT h.query_id, h.doc_id, exact, raw / max(raw) OVER (PARTITION BY h.query_id) AS s FROM h),
b AS (SELECT z.query_id, z.doc_id, d.path, exact, s + {_BONUS} AS s FROM z JOIN ok USING (query_id, doc_id) JOIN (SELECT doc_id, path FROM documents) d USING (doc_id) JOIN a ON a.query_id = z.query_id),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path, doc_id) <= 100),
u AS (SELECT query_id, doc_id, 20 * s AS s, exact FROM t UNION ALL SELECT nm.query_id, nm.doc_id, score + {_AGE}, true FROM nm JOIN ok USING (query_id, doc_id)),
m AS (SELECT query_id, doc_id, path, s + 40 * ln(1 + coalesce(clicks, 0)) AS s, exact FROM (SELECT query_id, doc_id, sum(s) AS s, bool_or(exact) AS exact FROM u GROUP BY query_id, doc_id)
  JOIN (SELECT doc_id, path FROM documents) d USING (doc_id) LEFT JOIN ck USING (path)),
th AS (SELECT query_id, w FROM a WHERE query_id NOT IN (SELECT query_id FROM m WHERE exact GROUP BY query_id HAVING count(*) >= 5)),
tw AS (SELECT th.query_id, unnest(th.w) AS word FROM th JOIN a USING (query_id) WHERE NOT literal),
tn AS (SELECT doc_id, path, lower(regexp_replace({NAME}, '\\.[^.]*$', '')) AS n FROM documents WHERE path IS NOT NULL),
tk AS (SELECT query_id, doc_id, path, len(list_intersect({_tri('word')}, {_tri('n')})) AS k, length(word) + length(n) - 4 AS l FROM tw, tn WHERE length(n) >= 3 AND length(word) >= 3),
al AS (SELECT query_id, doc_id, path, 20 * k / (l - k) AS s FROM tk JOIN ok USING (query_id, doc_id) WHERE k > 0 AND k / (l - k) >= 0.5 AND (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM m WHERE exact)),
lo AS (SELECT query_id, doc_id, path, sum(s) AS s FROM (SELECT query_id, doc_id, path, s FROM al UNION ALL SELECT query_id, doc_id, path, s FROM m JOIN (SELECT query_id FROM th) th USING (query_id) WHERE NOT exact) GROUP BY query_id, doc_id, path),
lt AS (SELECT * FROM (SELECT *, max(s) OVER (PARTITION BY query_id) AS top FROM lo) WHERE s >= 0.5 * top QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path, doc_id) <= 20),
r2 AS (SELECT query_id, doc_id, path, round(s, 6) AS score, true AS exact FROM m WHERE exact UNION ALL SELECT query_id, doc_id, path, round(s, 6), false FROM lt)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, doc_id)::INT AS rank, doc_id, path, score, exact FROM r2 QUALIFY rank <= 100"""

#: The same with filters after ranking: every file may be ranked, and rows keep the rank they had. No clicks.
_POST = (
    _FULL.replace(_ALLOWED, _ALLOWED.replace("ok AS (", "passes AS (") + ", ok AS (SELECT query_id, doc_id FROM r, (SELECT doc_id FROM documents WHERE path IS NOT NULL))")
    .replace("ln(1 + coalesce(clicks, 0))", "ln(1)")
    .replace("path, score, exact FROM r2 QUALIFY rank <= 100", "path, score, exact FROM r2")
)
_POST = f"SELECT f.* FROM ({_POST}) f JOIN ({_ALLOWED[len('ok AS ('):-1]}) o USING (query_id, doc_id) WHERE rank <= 100"


_ALL_NAMES = f"WITH {_NAME_OCC}, v AS (SELECT DISTINCT term FROM np)"


def _values(rows) -> str:
    return ", ".join(f"({i}, $${q}$$)" for i, q in rows)


def _chips_sql() -> str:
    """Each chip in turn: its first match, and the query without that text."""
    steps = [
        ("kind", "kind:([\\p{L}\\p{N}_]+)"), ("in", "in:([\\p{L}\\p{N}_~/.-]+)"), ("after", "after:([0-9-]+)"), ("before", "before:([0-9-]+)"),
        ("size", "(?i)size:([><][0-9]+(?:mb|gb|kb))"), ("tag", "tag:([\\p{L}\\p{N}_]+)"), ("content", 'content:"([^"]+)"'),
    ]
    sql = f"WITH c0(query_id, rest) AS (VALUES {_Q}, {_values(CHIP_QUERIES)})"
    names: list[str] = []
    for i, (name, pattern) in enumerate(steps):
        kept = "".join(f', "{n}"' for n in names)
        found = f"regexp_extract(rest, '{pattern}')"
        sql += f", c{i + 1} AS (SELECT query_id, CASE WHEN {found} = '' THEN rest ELSE replace(rest, {found}, '') END AS rest{kept}, nullif(regexp_extract(rest, '{pattern}', 1), '') AS \"{name}\" FROM c{i})"
        names.append(name)
    sql += f", w AS (SELECT *, list_filter(string_split_regex(rest, '\\s+'), lambda x: x <> '') AS l FROM c{len(steps)})"
    out = "regexp_matches(x, '^-[\\p{L}\\p{N}_]+$')"
    chips = ", ".join(f'"{n}"' for n in names)
    return sql + f" SELECT query_id, {chips}, array_to_string(list_transform(list_filter(l, lambda x: {out}), lambda x: substr(x, 2)), ',') AS exclude, array_to_string(list_filter(l, lambda x: NOT {out}), ' ') AS text FROM w"


def oracle_sql() -> dict[str, str]:
    return {
        "tokenize_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({terms('text')}) AS term FROM documents) GROUP BY term",
        "name_terms": f"WITH {_NAME_OCC} SELECT term, doc_id, field, tf FROM np",
        "query_tokens": f"SELECT word, count(*) AS n FROM (SELECT unnest({words(NAME)}) AS word FROM documents WHERE path IS NOT NULL) GROUP BY word",
        "postings": f"WITH {_POSTINGS} SELECT term, doc_id, field, tf FROM p",
        "vocab": f"WITH {_POSTINGS} SELECT term, bool_or(field <> 4) AS is_name, count(*) AS df FROM p GROUP BY term",
        "doc_lengths": f"WITH {_POSTINGS} SELECT doc_id, sum(tf)::BIGINT AS doc_len FROM p GROUP BY doc_id",
        "corpus_stats": f"WITH {_INDEX} SELECT n_docs, round(avg_len, 6) AS avg_len FROM sz",
        "bm25_single_term": _hits("(1, 'snapshot')") + " SELECT doc_id, round(raw, 6) AS score FROM h",
        "bm25_multi_term_or": _hits("(1, 'index'), (1, 'snapshot'), (2, 'archive'), (2, 'report'), (2, 'report'), (3, 'медиана'), (3, 'fichier')")
        + " SELECT query_id, doc_id, round(raw, 6) AS score FROM h",
        "bm25_normalized": _hits("(1, 'inventory'), (1, 'merge'), (2, 'notes')") + " SELECT query_id, doc_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM h",
        "search_exact_batch": _SEARCH,
        "search_fuzzy_batch": _FULL,
        "search_post_filtered": _POST,
        "trigram_provider": f"""WITH w(query_id, word) AS (VALUES (1, 'inventry'), (2, 'traval'), (2, 'plans'), (3, 'minutess')),
d AS (SELECT doc_id, lower(regexp_replace({NAME}, '\\.[^.]*$', '')) AS n FROM documents WHERE path IS NOT NULL),
x AS (SELECT query_id, doc_id, len(list_intersect({_tri('word')}, {_tri('n')})) AS k, length(word) + length(n) - 4 AS s FROM w, d WHERE length(n) >= 3)
SELECT query_id, doc_id, count(*)::DOUBLE AS raw, false AS exact FROM x WHERE k > 0 AND k / (s - k) >= 0.5 GROUP BY query_id, doc_id""",
        "name_score": f"WITH {_NAME_SCORE} SELECT query_id, doc_id, score FROM n WHERE score > 0",
        "recency_boost": f"SELECT doc_id, {_AGE} AS boost FROM documents",
        "location_boost": f"SELECT doc_id, ({_LOC})::DOUBLE AS boost FROM documents WHERE path IS NOT NULL",
        "click_boost": f"""WITH {_CLICKS}, s AS (SELECT string_split(path, '/') AS parts FROM c),
e AS (SELECT array_to_string(parts[1:k], '/') AS path FROM (SELECT parts, unnest(range(2, len(parts) + 1)) AS k FROM s))
SELECT path, count(*) AS clicks, round(40 * ln(1 + count(*)), 6) AS boost FROM e GROUP BY path""",
        "proximity_folders": f"""WITH {_CLICKS}, l AS (SELECT path FROM c GROUP BY path ORDER BY max((ts, click_id)) DESC, path DESC LIMIT 3)
SELECT doc_id, {FOLDER} AS folder, 1.5 AS boost FROM documents WHERE {FOLDER} IN (SELECT {FOLDER} FROM l)""",
        "top_clicked_terms": f"WITH {_CLICKS} SELECT word, count(*) AS n FROM (SELECT unnest({words(NAME)}) AS word FROM c) GROUP BY word ORDER BY n DESC, word LIMIT 20",
        "path_bonus": f"WITH {_ASKED}, b AS (SELECT query_id, doc_id, round({_BONUS}, 6) AS bonus FROM documents, a WHERE path IS NOT NULL) SELECT * FROM b WHERE bonus > 0",
        "filter_files": " UNION ALL ".join(f"SELECT {i} AS query_id, doc_id FROM documents WHERE path IS NOT NULL AND ({p})" for i, p in _PASSES.items()),
        "fuzzy_terms_k1": f"{_ALL_NAMES}, w(term) AS (VALUES ('scna'), ('plna'), ('lgo'), ('note'), ('idea'), ('spce'), ('copi')) SELECT w.term, v.term AS name, {_edits('w.term', 'v.term')}::INT AS distance FROM w, v WHERE {_edits('w.term', 'v.term')} <= 1",
        "parse_requests": _PARSED
        + """SELECT query_id, array_to_string(list_filter(s, lambda x: NOT regexp_matches(lower(x), '^(kind|in|after|before|size|tag):') AND NOT (starts_with(x, '-') AND length(x) > 1)), ' ') AS text,
array_to_string(kind, ',') AS kinds, array_to_string(inn, ',') AS folders,
array_to_string(list_transform(list_filter(s, lambda x: starts_with(x, '-') AND length(x) > 1), lambda x: substr(lower(x), 2)), ',') AS excluded, array_to_string(tag, ',') AS tags, '' AS unrecognised,
after[-1] || substr('0000-01-01', length(after[-1]) + 1) AS from_day, before[-1] || substr('0000-01-01', length(before[-1]) + 1) AS before_day,
CASE WHEN starts_with(size[-1], '>') THEN substr(size[-1], 2) END AS min_bytes, CASE WHEN starts_with(size[-1], '<') THEN substr(size[-1], 2) END AS max_bytes FROM v""",
        "query_intent": f"""WITH r(query_id, query) AS (VALUES {_Q}, {_values(ENGINE_QUERIES)}), p AS (SELECT query_id, string_split_regex(trim(query), '\\s+') AS s FROM r),
x AS (SELECT *, list_filter(s, lambda x: NOT starts_with(x, 'in:') AND contains(x, ':') AND regexp_matches(x, '\\p{{L}}')) AS f FROM p),
y AS (SELECT *, array_to_string(list_filter(s, lambda x: NOT starts_with(x, 'in:') AND NOT (contains(x, ':') AND regexp_matches(x, '\\p{{L}}'))), ' ') AS rest, array_to_string(list_filter(s, lambda x: NOT contains(x, ':')), ' ') AS again FROM x),
z AS (SELECT *, {terms("CASE WHEN len(" + terms("rest") + ") > 0 THEN rest ELSE again END")} AS t, list_sort(list_distinct(list_transform(f, lambda x: split_part(x, ':', 1)))) AS keys FROM y)
SELECT query_id, array_to_string(t, ' ') AS words, CASE WHEN list_has_any(keys, ['after', 'before']) THEN 'Recovery'
  WHEN len(list_filter(t, lambda x: regexp_matches(x, '^(exist(s|ed|ing)?|find(s|ing)?|check(s|ed|ing)?)$'))) > 0 THEN 'Verification' ELSE 'Lookup' END AS intent,
substr(list_filter(s, lambda x: starts_with(x, 'in:'))[-1], 4) AS scope,
array_to_string(list_transform(keys, lambda k: k || '=' || substr(list_filter(f, lambda x: split_part(x, ':', 1) = k)[-1], length(k) + 2)), ',') AS filters FROM z""",
        "query_chips": _chips_sql(),
        "row_details": """WITH d AS (SELECT path, size, mtime_ns FROM index_snapshots WHERE snapshot_id = (SELECT max(snapshot_id) FROM index_snapshots)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY walked_at DESC NULLS LAST, size DESC NULLS LAST, mtime_ns DESC NULLS LAST, root DESC) = 1),
i AS (SELECT DISTINCT path FROM index_snapshots WHERE snapshot_id = (SELECT min(snapshot_id) FROM index_snapshots))
SELECT i.path, CASE WHEN size >= 1e12 THEN round(size / 1e12, 1) || ' TB' WHEN size >= 1e9 THEN round(size / 1e9, 1) || ' GB' WHEN size >= 1e6 THEN round(size / 1e6, 1) || ' MB'
  WHEN size >= 1000 THEN round(size / 1000, 1) || ' KB' ELSE size || ' B' END AS size,
strftime(make_timestamp(mtime_ns // 1000), '%Y-%m-%d %H:%M') AS modified, d.path IS NULL AS missing FROM i LEFT JOIN d USING (path)""",
        "fuzzy_terms_k2": f"{_ALL_NAMES}, w(term) AS (VALUES ('inventry'), ('sumary'), ('reprot'), ('skecth'), ('budgte'), ('trvl')), x AS (SELECT w.term, v.term AS name, {_edits('w.term', 'v.term')}::INT AS distance FROM w, v) SELECT * FROM x WHERE distance <= CASE WHEN length(term) >= 5 THEN 2 ELSE 1 END",
        "in_scope": f"""WITH s AS (SELECT doc_id, path, CASE WHEN starts_with(path, '/Users/baba/') THEN '/Users/baba' WHEN starts_with(path, '/Volumes/team/') THEN '/Volumes/team' END AS r FROM documents WHERE path IS NOT NULL),
t AS (SELECT *, string_split(substr(path, length(r) + 2), '/') AS parts FROM s)
SELECT doc_id, CASE WHEN r IS NOT NULL AND len(parts) <= 6 AND len(list_filter(parts, lambda c: starts_with(c, '~$') OR starts_with(c, '.') OR lower(c) IN ('node_modules','target','dist','build','tmp','temp','cache','caches','deriveddata','modulecache','trash','__pycache__','venv','site-packages','pods'))) = 0
  AND len(list_filter(parts[1:len(parts) - 1], lambda c: regexp_matches(lower(c), '\\.(app|photoslibrary|framework|bundle|xcodeproj|xcworkspace)$'))) = 0 THEN r END AS root,
regexp_matches(lower(path), '\\.(pem|key|p12|pfx|asc)$') AS secret, NOT starts_with(path, '/Volumes/') AS queryable,
CASE WHEN regexp_matches(path, '/(Desktop|Documents|Downloads)/') THEN 100 WHEN regexp_matches(path, '/\\.(cache|local|config)/') THEN 1 ELSE 10 END AS priority FROM t""",
        "external_hits": """WITH f AS (SELECT doc_id, path FROM documents WHERE path IS NOT NULL), o AS (SELECT 1 AS query_id, path FROM f WHERE path LIKE '%inventory%'),
n AS (SELECT query_id, count(*) AS n FROM o GROUP BY query_id), e AS (SELECT q AS query_id, doc_id, path FROM f, (SELECT unnest([1, 2]) AS q) WHERE path LIKE '%note%')
SELECT query_id, doc_id, path, 0.5::DOUBLE AS score, false AS exact FROM e WHERE query_id NOT IN (SELECT query_id FROM n WHERE n >= 5) AND (query_id, path) NOT IN (SELECT query_id, path FROM o)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY path) <= 20""",
        "trigram_jaccard": f"""{_ALL_NAMES}, w(word) AS (VALUES ('inventory'), ('summaries'), ('quarterly'), ('changelogs')),
x AS (SELECT word, term, {_tri('word')} AS a, {_tri('term')} AS b FROM w, v WHERE length(term) >= 3),
y AS (SELECT word, term, len(list_intersect(a, b)) AS k, len(a) + len(b) AS n FROM x) SELECT word, term, round(k / (n - k), 6) AS score FROM y WHERE k / (n - k) >= 0.3""",
        "trigram_fallback": f"""WITH w(query_id, word) AS (VALUES (1, 'inventry'), (2, 'traval'), (2, 'plans'), (3, 'minutess')),
d AS (SELECT doc_id, path, lower(regexp_replace({NAME}, '\\.[^.]*$', '')) AS n FROM documents WHERE path IS NOT NULL),
x AS (SELECT query_id, doc_id, path, len(list_intersect({_tri('word')}, {_tri('n')})) AS k, length(word) + length(n) - 4 AS s FROM w, d WHERE length(n) >= 3),
y AS (SELECT query_id, doc_id, path, k / (s - k) AS sim FROM x WHERE k > 0 AND k / (s - k) >= 0.5),
z AS (SELECT query_id, doc_id, path, round(20 * sum(sim), 6) AS score FROM y GROUP BY query_id, doc_id, path),
t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM z)
SELECT query_id, doc_id, score FROM t WHERE score >= 0.5 * top QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, doc_id) <= 20""",
        "prefix_cache_topk": """WITH c AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split(lower(path), '/'), lambda x: x <> '')) AS c FROM documents WHERE path IS NOT NULL),
p AS (SELECT DISTINCT doc_id, substr(c, 1, n) AS prefix FROM c, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE n <= length(c))
SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY doc_id DESC)::INT AS rank, doc_id FROM p QUALIFY rank <= 5""",
        "prefix_search": f"SELECT doc_id, path, 1.0::DOUBLE AS score FROM documents WHERE starts_with(lower({NAME}), 'inv') OR starts_with(lower({NAME}), 'not')",
        "substring_search": f"SELECT doc_id, path FROM documents WHERE contains(lower({NAME}), 'vent')",
        "path_scope": "SELECT doc_id, path FROM documents WHERE path = '/Volumes/team/Projects/lantern/docs' OR starts_with(path, '/Volumes/team/Projects/lantern/docs/')",
        "path_parts": f"SELECT doc_id, {NAME} AS name, {STEM} AS stem, {EXT} AS ext, {FOLDER} AS folder, {BELOW} AS below FROM documents WHERE path IS NOT NULL".replace(" AS folder,", " AS folder_,").replace("folder_", '"folder"'),
        "display_path": "SELECT doc_id, regexp_replace(path, '^/Users/baba(/|$)', '~\\1') AS shown, strftime(make_timestamp(mtime_ns // 1000), '%Y-%m-%d') AS modified FROM documents WHERE path IS NOT NULL",
        "content_kinds": f"""SELECT CASE WHEN {EXT} = 'pdf' THEN 'pdf' WHEN {EXT} IN ('docx','doc','rtf','odt') THEN 'rich' WHEN {EXT} IN ('txt','md','markdown','rst','org','tex','log','csv','tsv','json','yaml','yml','toml','xml','html','htm','css','py','rs','sh','sql') THEN 'text' ELSE 'unsupported' END AS kind, count(*) AS n FROM documents WHERE path IS NOT NULL GROUP BY 1""",
        "file_kinds": f"SELECT doc_id, array_to_string(list_append({_DOC}, {EXT}), ',') AS kinds FROM documents WHERE path IS NOT NULL",
        "content_phrase": "SELECT doc_id FROM documents WHERE contains(lower(text), 'joke of the week')",
        "provider_union": _hits("(1, 'index'), (1, 'snapshot'), (2, 'archive')")
        + """, w AS (SELECT query_id, doc_id, count(DISTINCT term) AS n FROM q JOIN p USING (term) GROUP BY query_id, doc_id),
u AS (SELECT query_id, doc_id, raw / max(raw) OVER (PARTITION BY query_id) AS s FROM h UNION ALL SELECT query_id, doc_id, n / max(n) OVER (PARTITION BY query_id) FROM w)
SELECT query_id, doc_id, round(sum(s), 6) AS score, true AS exact FROM u GROUP BY query_id, doc_id""",
        "content_fingerprints": "SELECT min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1",
    }
