"""Queries of the choice of a kernel case's files. Parts are lines of a tree; orders are cases, their lines the frames of a report."""

from __future__ import annotations

from ..operators import kernel, seeding
from .domain import view, with_views

_FN = "replace(p_name, ' ', '_') || '_' || cast(p_partkey % 30 AS string)"
_FN2 = "replace(p_name, ' ', '_') || '_' || cast((p_partkey + 7) % 30 AS string)"
_PATH = (
    "CASE p_size % 9 WHEN 0 THEN 'fs/ext' WHEN 1 THEN 'fs/nfs' WHEN 2 THEN 'net/core' WHEN 3 THEN 'drivers/usb' WHEN 4 THEN 'arch/x86/crypto' WHEN 5 THEN 'arch/arm/mm' WHEN 6 THEN 'lib'"
    " WHEN 7 THEN 'tools/perf' ELSE 'fs' END || '/' || lower(p_type) || '_' || cast(p_partkey % 17 AS string) || CASE WHEN p_partkey % 17 % 5 = 0 THEN '.h' ELSE '.c' END"
)
_LINES = f"""
SELECT {_PATH} AS path, CASE p_partkey % 5 WHEN 0 THEN 'static inline unsigned int *' || {_FN} || ' (void)' WHEN 1 THEN 'struct a ' || {_FN} || '(int a)'
    WHEN 2 THEN '  x = ' || {_FN} || ' (y) + ' || {_FN2} || '(z);' WHEN 3 THEN '#define ' || {_FN} || '(x) x' ELSE '  return ' || {_FN} || '(z);' END AS line FROM {{part}}"""
_CALLS = f"""
SELECT {_PATH} AS path, p_partkey * 2 AS pos, {_FN} AS name FROM {{part}} WHERE p_partkey % 5 IN (2, 4)
UNION ALL SELECT {_PATH}, p_partkey * 2 + 1, {_FN2} FROM {{part}} WHERE p_partkey % 5 = 2"""
_FRAMES = f"""
SELECT DISTINCT 'k' || cast(l_orderkey AS string) AS case_id, l_linenumber * 1000000 + p_partkey AS pos, CASE WHEN p_partkey % 6 = 0 THEN 'dump_stack' ELSE {_FN} END AS function,
    CASE WHEN p_partkey % 11 > 0 THEN {_PATH} END AS file FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""
_REPORTS = f"""
SELECT 'k' || cast(o_orderkey AS string) AS case_id, 'WARNING in ' || {_FN} || '() and kfree ()' || chr(10) || ' Call Trace: ' || upper({_FN2}) || '+0x1f/0x20 ' || p_brand AS text
FROM {{orders}} JOIN {{part}} ON o_custkey = p_partkey"""
_PROGRAMS = """
SELECT 'k' || cast(o_orderkey AS string) AS case_id, 'r0 = open$' || lower(p_type) || '(&(0x7f)=''' || split_part(p_name, ' ', 1) || ''')' || chr(10) || 'write$9x(r0) ' || lower(p_type) || '(r0)' AS text
FROM {orders} JOIN {part} ON o_custkey = p_partkey WHERE o_orderkey % 3 > 0"""
_WANTED = f"SELECT DISTINCT 'k' || cast(l_orderkey AS string) AS case_id, {_FN} AS name FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey"
_NEAR = f"SELECT DISTINCT 'k' || cast(l_orderkey AS string) AS case_id, {_PATH} AS path FROM {{lineitem}} JOIN {{part}} ON l_suppkey = p_partkey WHERE l_linenumber < 4"
_LISTING = """
SELECT cast(o_custkey AS string) AS case_id, CASE o_orderkey % 9 WHEN 0 THEN 'assets/repro.syz' WHEN 1 THEN 'assets/logs/repro.prog' WHEN 2 THEN 'assets/repro.cprog' WHEN 3 THEN 'assets/logs/repro.txt'
    WHEN 4 THEN 'assets/repro.report' WHEN 5 THEN 'assets/logs/dmesg.txt' WHEN 6 THEN 'datasets/testcases/' || cast(o_custkey AS string) || '.syz' WHEN 7 THEN 'datasets/bug_report/' || cast(o_custkey AS string) || '.txt'
    ELSE 'old/assets/repro.syz' END AS path, max(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 10 END) AS size FROM {orders} GROUP BY 1, 2"""


def k10_keyword_terms(spark, sf_dir):
    return seeding.keyword_terms(view(spark, sf_dir, _PROGRAMS), view(spark, sf_dir, _REPORTS))


def k10_keyword_files(spark, sf_dir):
    return seeding.keyword_files(k10_keyword_terms(spark, sf_dir), view(spark, sf_dir, _LINES))


def k11_defining_files(spark, sf_dir):
    return seeding.defining_file(view(spark, sf_dir, _LINES), view(spark, sf_dir, _WANTED), view(spark, sf_dir, _NEAR))


def k12_seed_paths(spark, sf_dir):
    return seeding.seed_paths(*(view(spark, sf_dir, v) for v in (_FRAMES, _REPORTS, _PROGRAMS, _LINES, _CALLS)))


def k13_artifacts(spark, sf_dir):
    return seeding.choose_artifacts(view(spark, sf_dir, _LISTING))


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "k" and name[1:2].isdigit()}

_TERMS = """raw AS (SELECT coalesce(p.case_id, r.case_id) AS case_id,
    list_concat(coalesce(flatten(list_transform(regexp_extract_all(lower(p.text), '\\b[a-z_][a-z0-9_]*(\\$[a-z0-9_]+)?\\b'), lambda x: string_split(x, '$'))), []),
        coalesce(regexp_extract_all(lower(r.text), '\\b([a-z_][a-z0-9_]{3,})\\+0x[0-9a-f]+', 1), [])) AS l FROM programs p FULL JOIN reports r ON p.case_id = r.case_id),
fit AS (SELECT case_id, list_filter(l, lambda x: len(x) >= 4 AND NOT list_contains(STOP_WORDS, x) AND regexp_matches(x, '^[a-z_]')) AS l FROM raw),
each AS (SELECT case_id, unnest(l) AS term, unnest(range(len(l))) AS i FROM fit), first AS (SELECT case_id, term, min(i) AS i FROM each GROUP BY ALL),
terms AS (SELECT case_id, (row_number() OVER (PARTITION BY case_id ORDER BY i) - 1)::INT AS pos, term FROM first QUALIFY pos < 32)""".replace("STOP_WORDS", str(kernel.STOP_WORDS))
_FILES = """vocabulary AS (SELECT DISTINCT term FROM terms),
mentioned AS (SELECT DISTINCT path, term FROM lines JOIN vocabulary ON contains(lower(line), term) WHERE path NOT LIKE 'tools/%'),
candidates AS (SELECT DISTINCT case_id, path FROM mentioned JOIN terms USING (term)),
inpath AS (SELECT path, term, 100 + CASE WHEN contains(string_split(path, '/')[-1], term) THEN 25 ELSE 0 END AS points FROM (SELECT DISTINCT path FROM mentioned) JOIN vocabulary ON contains(path, term)),
points AS (SELECT case_id, path, sum(points)::BIGINT AS score FROM inpath JOIN terms USING (term) GROUP BY ALL),
files AS (SELECT case_id, path, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, len(path), path DESC)::INT AS rank
    FROM (SELECT case_id, path, coalesce(score, 0) AS score FROM candidates LEFT JOIN points USING (case_id, path)) QUALIFY rank <= 40)"""
_HITS = f"""named AS (SELECT {_PATH} AS path, {_FN} AS name, p_partkey % 5 IN (0, 1, 4) AS defines FROM part UNION ALL SELECT {_PATH}, {_FN2}, false FROM part WHERE p_partkey % 5 = 2),
hits AS (SELECT name, path FROM (SELECT name, path, bool_or(defines) AS d, max(bool_or(defines)) OVER (PARTITION BY name) AS known FROM named WHERE path LIKE '%.c' GROUP BY name, path) WHERE d OR NOT known)""".replace("AS string", "AS varchar")


def _rank(path: str, near: str) -> str:
    """SQL of a path's nearness to a list of paths; every path of the tree lies in a folder."""
    folder, top, arch = (f"regexp_extract({{0}}, '{p}', 1)" for p in ("^(.*)/", "^([^/]*)/", "^arch/([^/]*)"))
    has = lambda part: f"list_contains(list_transform({near}, lambda q: {part.format('q')}), {part.format(path)})"
    foreign = f"{path} LIKE 'arch/%' AND len(list_filter({near}, lambda q: q LIKE 'arch/%')) > 0 AND NOT {has(arch)}"
    return f"CASE WHEN list_contains({near}, {path}) THEN 0 WHEN {has(folder)} THEN 1 WHEN {foreign} THEN 80 WHEN {has(top)} THEN 2 WHEN {path} LIKE 'drivers/%' THEN 90 ELSE 20 END"


_ALLOWED = "path NOT LIKE 'tools/%' AND CASE WHEN path LIKE 'arch/%' THEN path LIKE '%/crypto/%' ELSE list_contains(tops, string_split(path, '/')[1]) END"
SQL = {
    "k10_keyword_terms": with_views(f"WITH {_TERMS} SELECT * FROM terms", programs=_PROGRAMS, reports=_REPORTS),
    "k10_keyword_files": with_views(f"WITH {_TERMS}, {_FILES} SELECT * FROM files", programs=_PROGRAMS, reports=_REPORTS, lines=_LINES),
    "k11_defining_files": with_views(f"""
WITH {_HITS}, n AS (SELECT case_id, list(path) AS l FROM near GROUP BY ALL),
ranked AS (SELECT w.case_id, w.name, path, {_rank("path", "coalesce(l, [])")} AS rank FROM wanted w JOIN hits USING (name) LEFT JOIN n ON n.case_id = w.case_id)
SELECT case_id, name, CASE WHEN rank < 80 THEN path END AS path, rank FROM ranked QUALIFY row_number() OVER (PARTITION BY case_id, name ORDER BY rank, ranked.path) = 1""", wanted=_WANTED, near=_NEAR),
    "k12_seed_paths": with_views(f"""
WITH RECURSIVE {_TERMS}, {_FILES}, {_HITS},
telling AS (SELECT * FROM frames WHERE function <> 'dump_stack' AND file IS NOT NULL),
reported AS (SELECT case_id, {_FN} AS name FROM (SELECT 'k' || o_orderkey AS case_id, p_partkey, p_name FROM orders JOIN part ON o_custkey = p_partkey)),
defined AS (SELECT case_id, arg_min(path, (path LIKE 'drivers/%', path)) AS path FROM reported JOIN hits USING (name) GROUP BY case_id HAVING arg_min(path, (path LIKE 'drivers/%', path)) NOT LIKE 'drivers/%'),
cases AS (SELECT case_id FROM frames UNION SELECT case_id FROM reports),
alltops AS (SELECT case_id, t FROM (SELECT case_id, string_split(arg_min(file, pos), '/')[1] AS t FROM telling GROUP BY case_id) WHERE t <> 'arch' UNION SELECT case_id, string_split(path, '/')[1] FROM defined UNION SELECT case_id, 'lib' FROM cases),
tops AS (SELECT case_id, list(t) AS tops FROM alltops GROUP BY case_id),
sure AS (SELECT case_id, 0 AS source, pos, file AS path FROM frames WHERE file IS NOT NULL UNION ALL SELECT case_id, 1, 0, path FROM defined),
placed AS (SELECT case_id, path, min((source, pos)) AS place FROM (SELECT case_id, source, pos, path FROM sure JOIN tops USING (case_id) WHERE {_ALLOWED} UNION ALL SELECT case_id, 2, rank, path FROM files) GROUP BY ALL),
begun AS (SELECT case_id, path, place, row_number() OVER (PARTITION BY case_id ORDER BY place) AS position FROM placed QUALIFY position <= 40 OR place[1] < 2),
start AS (SELECT case_id, arg_min(file, pos) AS path FROM telling JOIN tops USING (case_id) WHERE file LIKE '%.c' AND list_contains(tops, string_split(file, '/')[1]) GROUP BY case_id),
called AS (SELECT case_id, name, min(pos) AS pos FROM start SEMI JOIN begun USING (case_id, path) JOIN calls USING (path) GROUP BY ALL),
turns AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS i, c FROM called JOIN (SELECT name, list(path) AS c FROM hits GROUP BY name) USING (name)),
grown AS (SELECT case_id, 0::BIGINT AS i, list(path ORDER BY position) AS l FROM begun GROUP BY case_id
    UNION ALL SELECT s.case_id, s.i, CASE WHEN len(l) < 40 AND b.rank < 80 AND NOT list_contains(l, b.path) AND (SELECT {_ALLOWED.replace("path", "b.path")}) THEN list_append(l, b.path) ELSE l END
    FROM (SELECT g.case_id, t.i, l, tops, list_min(list_transform(c, lambda x: {{'rank': {_rank("x", "l")}, 'path': x}})) AS b FROM grown g JOIN turns t ON t.case_id = g.case_id AND t.i = g.i + 1 JOIN tops ON tops.case_id = g.case_id) AS s),
final AS (SELECT case_id, arg_max(l, i) AS l FROM grown GROUP BY case_id)
SELECT case_id, unnest(l) AS path, unnest(range(1, len(l) + 1))::INT AS position FROM final""", frames=_FRAMES, reports=_REPORTS, programs=_PROGRAMS, lines=_LINES, calls=_CALLS),
    "k13_artifacts": with_views("""
WITH p AS (SELECT *, CASE path WHEN 'assets/repro.syz' THEN 0 WHEN 'assets/logs/repro.prog' THEN 1 WHEN 'assets/repro.cprog' THEN 2 WHEN 'assets/logs/repro.txt' THEN 3 WHEN 'datasets/testcases/' || case_id || '.syz' THEN 4
    WHEN 'assets/repro.report' THEN 10 WHEN 'assets/logs/dmesg.txt' THEN 11 WHEN 'datasets/bug_report/' || case_id || '.txt' THEN 12 END AS priority FROM listing)
SELECT case_id, kind, path, CASE WHEN path LIKE '%.syz' OR path LIKE '%.prog' THEN 'syz' WHEN path LIKE '%.cprog' THEN 'gcc' END AS recipe
FROM (SELECT case_id, CASE WHEN priority < 10 THEN 'reproducer' ELSE 'report' END AS kind, path, priority FROM p WHERE priority IS NOT NULL AND (priority NOT IN (10, 11) OR size > 0))
QUALIFY row_number() OVER (PARTITION BY case_id, kind ORDER BY priority) = 1""", listing=_LISTING),
}
