"""Queries of upkeep, bookkeeping and kernel evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernel, upkeep
from .domain import table, view, with_views

_OLD = "SELECT source AS case_id, lang || '/' || cast(doc_id AS string) AS path, doc_id, text FROM {documents} WHERE doc_id % 13 <> 0"
_NEW = "SELECT source AS case_id, lang || '/' || cast(doc_id AS string) AS path, doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END AS text FROM {documents} WHERE doc_id % 17 <> 0"
_NODES = "SELECT p_brand AS case_id, 'n' || cast(p_partkey AS string) AS entity_id, p_type AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS node_id, p_partkey FROM {part}"
_EDGES = "SELECT DISTINCT p_brand AS case_id, 'n' || cast(l_partkey AS string) AS source, 'calls' AS kind, 'n' || cast(l_partkey - l_partkey % 50 AS string) AS target, p_type AS file, l_partkey AS p FROM {lineitem} JOIN {part} ON p_partkey = l_partkey"
_BUGS = "SELECT o_orderpriority AS project, cast(substr(o_orderpriority, 1, 1) AS int) AS project_pos, CASE WHEN o_orderkey % 50 = 0 THEN 'x' ELSE '' END || cast(o_orderkey AS string) AS bug_id, o_orderstatus FROM {orders}"
_USAGE = "SELECT 'c' || cast(conv_id % 20 AS string) AS case_id, role AS agent, CASE WHEN turn % 3 > 0 THEN length(text) END AS input_tokens, CASE WHEN turn % 3 > 0 THEN turn END AS output_tokens FROM {conversations}"
_CFN = "SELECT p_brand AS case_id, 'fs/' || p_type || '.c#' || replace(p_name, ' ', '_') || '@' || cast(p_partkey AS string) AS method_id, replace(p_name, ' ', '_') || cast(p_size % 20 AS string) AS name, 'fs/' || p_type || '.c' AS file, cast(p_partkey % 900 AS int) AS start_line, cast(p_partkey % 900 + p_size * 3 AS int) AS end_line, p_partkey FROM {part}"
_SYMS = "SELECT DISTINCT p_brand AS case_id, replace(p_name, ' ', '_') || cast(l_quantity % 20 AS int) || CASE WHEN l_linenumber = 1 THEN '.isra.0' WHEN l_linenumber = 2 THEN '.part.3' ELSE '' END AS symbol FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
_COVERED = "SELECT p_brand AS case_id, CASE WHEN l_linenumber = 7 THEN 'extra' ELSE cast(l_linenumber * 2 AS string) END AS call, method_id FROM {lineitem} JOIN (" + _CFN + ") AS f ON f.p_partkey = l_partkey JOIN {part} AS q ON q.p_partkey = l_partkey"
_PCALLS = "SELECT DISTINCT p_brand AS case_id, cast(p_size % 11 AS int) AS call_index FROM {part}"
_COMPLETE = "SELECT p_brand AS case_id, min(p_partkey) % 3 > 0 AS coverage_complete FROM {part} GROUP BY p_brand"
_DEFS = "SELECT 'u' || cast(user_id AS string) AS case_id, 'r' || regexp_extract(props, '([0-9]+)', 1) AS reference, event_id AS call FROM {events} WHERE event_type = 'signup'"
_USES = "SELECT 'u' || cast(user_id AS string) AS case_id, 'r' || regexp_extract(props, '([0-9]+)', 1) AS reference, event_id AS call FROM {events} WHERE event_type <> 'error'"
_OPS = "SELECT p_brand AS case_id, 'op' || cast(p_partkey AS string) AS operation_id, 'fs/' || p_type || '.c' AS file, cast(p_partkey % 1100 AS int) AS line FROM {part}"

_MADE_FROM = "SELECT DISTINCT cast(s_nationkey AS string) AS case_id, cast(s_suppkey AS string) AS import_id, 'f' || cast(l_partkey AS string) AS file, CASE WHEN l_partkey % 40 = s_suppkey % 40 THEN 'new' ELSE 'old' END AS sha256 FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey"
_ROOTS = "SELECT cast(n_nationkey AS string) AS case_id, CASE WHEN n_nationkey % 3 > 0 THEN '/src/true' END AS indexed_root FROM {nation}"
_INDEXED = "SELECT cast(n_nationkey AS string) AS case_id, 'f' || cast(p_partkey AS string) AS file, 'old' AS sha256 FROM {part} JOIN {nation} ON p_partkey % 25 <> n_nationkey AND p_size % 5 = n_nationkey % 5"


def b1_round_robin(spark, sf_dir):
    bugs = view(spark, sf_dir, _BUGS)
    return upkeep.round_robin(bugs, bugs.where("o_orderstatus = 'P'").select("project", "bug_id"))


def b2_tally(spark, sf_dir):
    bugs = view(spark, sf_dir, _BUGS)
    results = bugs.where("o_orderstatus <> 'P'").select("project", "bug_id", F.when(F.col("o_orderstatus") == "F", F.when(F.col("bug_id").like("%7"), "2").otherwise("0")).otherwise("1").alias("rc"))
    return upkeep.tally(bugs.select("project", "bug_id"), results)


def b3_usage_totals(spark, sf_dir):
    return upkeep.usage_totals(view(spark, sf_dir, _USAGE))


def _digests(spark, sf_dir):
    return tuple(view(spark, sf_dir, v).select("case_id", "path", "doc_id", F.sha2("text", 256).alias("sha256")) for v in (_OLD, _NEW))


def i1_refresh(spark, sf_dir):
    nodes, edges = view(spark, sf_dir, _NODES), view(spark, sf_dir, _EDGES)
    touched = nodes.where("file IN ('ECONOMY', 'SMALL')").select("case_id", "file").distinct()
    new_nodes = nodes.where("file IN ('ECONOMY', 'SMALL')").select("case_id", F.when(F.col("p_partkey") % 9 == 0, F.concat("entity_id", F.lit("x"))).otherwise(F.col("entity_id")).alias("entity_id"), "file")
    new_edges = edges.where("file IN ('ECONOMY', 'SMALL') AND p % 9 <> 0 AND p % 2 = 0")
    after, kept = upkeep.refresh(nodes, edges, touched, new_nodes, new_edges)
    outs = kept.groupBy("case_id", F.col("source").alias("entity_id")).agg(F.count("*").alias("edges"))
    return after.join(outs, ["case_id", "entity_id"], "left").select("case_id", "entity_id", "file", "node_id", F.coalesce("edges", F.lit(0)).alias("edges"))


def i2_changed_files(spark, sf_dir):
    old, new = _digests(spark, sf_dir)
    errors = new.where("doc_id % 20 = 0").select("case_id", "path")
    return upkeep.accepted_changes(upkeep.changed_files(old, new), errors)


def i3_snapshot_diff(spark, sf_dir):
    out = upkeep.snapshot_diff(view(spark, sf_dir, _OLD), view(spark, sf_dir, _NEW))
    return out.select("case_id", "path", F.startswith("diff", F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@"))).alias("good_head"), F.length(F.regexp_replace("diff", r"(?m)^[^+].*\n?|^\+\+\+.*\n?", "")).cast("long").alias("added_chars"))


def _resolved(spark, sf_dir):
    fns = view(spark, sf_dir, _CFN)
    known = fns.where("start_line % 5 = 0").groupBy("case_id", F.concat("name", F.lit(".isra.0")).alias("alias")).agg(F.max("method_id").alias("method_id"))
    return kernel.resolve_symbols(view(spark, sf_dir, _SYMS), fns, known)


def k1_symbols(spark, sf_dir):
    return _resolved(spark, sf_dir)


def k2_coverage(spark, sf_dir):
    return kernel.merge_coverage(view(spark, sf_dir, _CFN).select("case_id", "method_id"), view(spark, sf_dir, _COVERED), view(spark, sf_dir, _PCALLS), view(spark, sf_dir, _COMPLETE))


def k2_unknown_calls(spark, sf_dir):
    return kernel.unknown_calls(view(spark, sf_dir, _COVERED), view(spark, sf_dir, _PCALLS))


def k3_observed_edges(spark, sf_dir):
    syms = view(spark, sf_dir, _SYMS)
    edges = syms.alias("a").join(syms.alias("b"), (F.col("a.case_id") == F.col("b.case_id")) & (F.substring("a.symbol", 1, 5) == F.substring("b.symbol", 1, 5)))
    edges = edges.select("a.case_id", F.col("a.symbol").alias("caller"), F.col("b.symbol").alias("callee"), F.when(F.length("b.symbol") % 2 == 0, F.length("a.symbol")).alias("count"))
    return kernel.observed_edges(edges, _resolved(spark, sf_dir))


def k4_provenance(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    # The other commit has a digit that no digest has, so that no commit begins with it.
    full = F.md5(F.col("o_orderkey").cast("string"))
    return kernel.provenance_problems(o.select(F.col("o_orderkey").cast("string").alias("case_id"), full.alias("commit"), F.when(F.col("o_custkey") % 3 == 0, F.lit("zzzz")).otherwise(F.left(full, F.lit(12))).alias("executed_commit"), full.alias("sha"), F.when(F.col("o_custkey") % 4 == 0, "other").otherwise(full).alias("executed_sha"), (F.col("o_custkey") % 5 > 0).alias("has_manifest")))


def k4_imported_matches(spark, sf_dir):
    """Suppliers are imports of matches into the cases of their nation, parts the files that they were made from."""
    imports = view(spark, sf_dir, "SELECT cast(s_nationkey AS string) AS case_id, cast(s_suppkey AS string) AS import_id, CASE WHEN s_suppkey % 17 = 0 THEN 2 ELSE 1 END AS schema_version, '/src/' || cast(s_suppkey % 5 > 0 AS string) AS source_root FROM {supplier}")
    return kernel.imported_matches_problems(imports, view(spark, sf_dir, _MADE_FROM), view(spark, sf_dir, _ROOTS), view(spark, sf_dir, _INDEXED))


def k5_definition_uses(spark, sf_dir):
    return kernel.definition_uses(view(spark, sf_dir, _DEFS), view(spark, sf_dir, _USES))[0]


def k5_double_definitions(spark, sf_dir):
    return kernel.definition_uses(view(spark, sf_dir, _DEFS), view(spark, sf_dir, _USES))[1]


def k6_program_calls(spark, sf_dir):
    """Calls of each user's program, and the errors of the programs of each tenth that have a call without an end, or a line that is none."""
    e = table(spark, sf_dir, "events")
    k, user = F.regexp_extract("props", "([0-9]+)", 1), F.col("user_id") % 10
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("r"), k, F.lit(" = openat(0x0,\n  &(0x7f)='a)\\x00', 0x0)"))).when(F.col("event_type") == "error", F.lit("# comment("))
    line = line.when(F.col("event_type") == "click", F.concat(F.lit("ioctl$A(r"), k, F.lit(", {<r9=>0x0}) (fail_nth: 1)"))).when(user == 0, F.lit("broken((0x0)")).when(user == 1, F.lit("bad line")).otherwise(F.concat(F.lit("close(r"), k, F.lit(")")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n")
    scanned = kernel.scan_programs(e.groupBy(F.col("user_id").cast("string").alias("case_id")).agg(listed.alias("text")))
    flat = lambda c: F.array_join(F.transform(c, lambda d: F.concat_ws("@", d["reference"], F.replace(d["position"], F.lit("arguments@"), F.lit("")))), ",")
    calls = kernel.program_calls(scanned).select("case_id", "call_index", "name", "arguments", flat("definitions").alias("definitions"), flat("uses").alias("uses"), F.lit(None).cast("string").alias("error"))
    return calls.unionByName(kernel.program_errors(scanned), allowMissingColumns=True)


def k7_reproducer_calls(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    calls = li.groupBy(F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_partkey").alias("pos")).agg(F.when(F.min("l_suppkey") % 3 == 0, "ioctl").when(F.min("l_suppkey") % 3 == 1, "openat").otherwise("printf").alias("name"), F.when(F.min("l_suppkey") % 2 == 0, F.concat(F.lit("CMD"), F.min("l_suppkey").cast("string"))).alias("command"))
    allowed = calls.select("name").distinct().where("name <> 'printf'")
    return kernel.reproducer_calls(calls, allowed)


def k8_containing_function(spark, sf_dir):
    return kernel.containing_function(view(spark, sf_dir, _OPS), view(spark, sf_dir, _CFN))


def k8_snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(kernel.snippet(F.col("text"), (F.col("doc_id") % 6 + 1).cast("int"))).alias("snippet_md5"))


def k9_operation_pairs(spark, sf_dir):
    ops = view(spark, sf_dir, _OPS)
    pairs = ops.select("case_id", F.col("file").alias("from_file"), F.col("line").alias("from_line"), F.col("file").alias("to_file"), "line").withColumn("d", F.explode(F.array(*map(F.lit, range(1, 30)))))
    pairs = pairs.select("case_id", "from_file", "from_line", "to_file", (F.col("line") + F.col("d")).alias("to_line"))
    return kernel.operation_pairs(pairs, kernel.containing_function(ops, view(spark, sf_dir, _CFN)))


_KREP = "SELECT 'k' || cast(s_suppkey AS string) AS case_id, 'Call trace with ' || lower(p_name) || ' ' || lower(p_type) AS text FROM {supplier} JOIN {part} ON s_suppkey = p_partkey"


def k12_report_names(spark, sf_dir):
    reports = view(spark, sf_dir, _KREP).select("case_id", F.concat(F.lit("BUG in "), F.replace(F.split_part("text", F.lit("with "), F.lit(2)), F.lit(" "), F.lit("() ")), F.lit("() kfree() ab() WARN()")).alias("text"))
    return kernel.report_names(reports)


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] in "bik" and name[1:2].isdigit()}

_RES = """fn1 AS (SELECT case_id, name, min(method_id) AS only_one, count(*) AS n FROM fns GROUP BY ALL), al AS (SELECT case_id, name || '.isra.0' AS symbol, max(method_id) AS m FROM fns WHERE start_line % 5 = 0 GROUP BY ALL),
res AS (SELECT s.case_id, s.symbol, coalesce(al.m, CASE WHEN n = 1 THEN only_one END) AS method_id, coalesce(n, 0) AS candidates FROM syms s LEFT JOIN al ON al.case_id = s.case_id AND al.symbol = s.symbol
    LEFT JOIN fn1 ON fn1.case_id = s.case_id AND fn1.name = regexp_replace(s.symbol, '\\.(isra|part)\\.[0-9]+$', ''))"""
_LOC = """loc AS (SELECT o.case_id, operation_id, o.file, o.line, count(f.method_id) AS holders, CASE WHEN count(f.method_id) = 1 THEN min(f.method_id) END AS method_id FROM ops o LEFT JOIN fns f ON f.case_id = o.case_id AND f.file = o.file AND start_line <= line AND line <= end_line GROUP BY ALL)"""
SQL = {
    "b1_round_robin": with_views("""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY bug_id::BIGINT) - 1 AS turn FROM bugs WHERE bug_id NOT LIKE 'x%' AND o_orderstatus <> 'P')
SELECT project, bug_id, turn::INT AS turn, row_number() OVER (ORDER BY turn, project_pos) AS position FROM v""", bugs=_BUGS),
    "b2_tally": with_views("SELECT project, count(*) FILTER (o_orderstatus = 'F' AND bug_id NOT LIKE '%7') AS ok, count(*) FILTER (o_orderstatus = 'F' AND bug_id LIKE '%7') AS skip, count(*) FILTER (o_orderstatus <> 'F') AS fail FROM bugs GROUP BY project", bugs=_BUGS),
    "b3_usage_totals": with_views("SELECT case_id, agent, count(*) AS requests, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, (coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0))::BIGINT AS total_tokens FROM u GROUP BY ROLLUP (case_id, agent)", u=_USAGE),
    "i1_refresh": with_views("""
WITH nn AS (SELECT case_id, CASE WHEN p_partkey % 9 = 0 THEN entity_id || 'x' ELSE entity_id END AS entity_id, file, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE node_id END AS node_id FROM nodes WHERE file IN ('ECONOMY', 'SMALL')),
fresh AS (SELECT case_id, entity_id, file, row_number() OVER (PARTITION BY case_id ORDER BY entity_id) + (SELECT max(node_id) FROM nodes m WHERE m.case_id = nn.case_id) AS node_id FROM nn WHERE node_id IS NULL),
a AS (SELECT case_id, entity_id, file, node_id FROM nodes WHERE file NOT IN ('ECONOMY', 'SMALL') UNION ALL SELECT * FROM nn WHERE node_id IS NOT NULL UNION ALL SELECT * FROM fresh),
lost AS (SELECT case_id, entity_id FROM nodes WHERE file IN ('ECONOMY', 'SMALL') AND p_partkey % 9 = 0),
e AS (SELECT case_id, source, kind, target FROM edges WHERE file NOT IN ('ECONOMY', 'SMALL') AND NOT EXISTS (FROM lost WHERE lost.case_id = edges.case_id AND lost.entity_id = edges.target)
    UNION SELECT case_id, source, kind, target FROM edges WHERE file IN ('ECONOMY', 'SMALL') AND p % 9 <> 0 AND p % 2 = 0)
SELECT a.case_id, a.entity_id, a.file, a.node_id::BIGINT AS node_id, count(e.source) AS edges FROM a LEFT JOIN e ON e.case_id = a.case_id AND e.source = a.entity_id GROUP BY ALL""", nodes=_NODES, edges=_EDGES),
    "i2_changed_files": with_views("""
WITH c AS (SELECT coalesce(o.case_id, n.case_id) AS case_id, coalesce(o.path, n.path) AS path, coalesce(o.doc_id, n.doc_id) AS d, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.text <> n.text THEN 'changed' END AS change, n.path IS NOT NULL AS inn
    FROM o FULL JOIN n ON o.case_id = n.case_id AND o.path = n.path)
SELECT case_id, path, change, CASE WHEN change = 'added' THEN 'not in baseline' WHEN inn AND d % 20 = 0 THEN 'kept old' ELSE 'refresh' END AS status FROM c WHERE change IS NOT NULL""", o=_OLD, n=_NEW),
    "i3_snapshot_diff": with_views("""
SELECT coalesce(o.case_id, n.case_id) AS case_id, coalesce(o.path, n.path) AS path, true AS good_head,
    CASE WHEN n.path IS NULL THEN 0 WHEN o.path IS NULL THEN len(n.text) + len(string_split(n.text, chr(10))) + 1 ELSE len(string_split(o.text, chr(10))[-1]) + 9 END::BIGINT AS added_chars
FROM o FULL JOIN n ON o.case_id = n.case_id AND o.path = n.path WHERE o.text IS DISTINCT FROM n.text""", o=_OLD, n=_NEW),
    "k12_report_names": with_views("""
WITH w AS (SELECT case_id, list_filter(string_split(string_split(text, 'with ')[2], ' '), lambda x: len(x) >= 4) AS l FROM rep),
u AS (SELECT case_id, unnest(l) AS name, unnest(range(len(l))) AS i FROM w), f AS (SELECT case_id, name, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, (row_number() OVER (PARTITION BY case_id ORDER BY i) - 1)::INT AS pos FROM f)
SELECT case_id, pos, name FROM r""", rep=_KREP),
    "k1_symbols": with_views(f"WITH {_RES} SELECT * FROM res", fns=_CFN, syms=_SYMS),
    "k2_coverage": with_views("""
WITH c AS (SELECT covered.case_id, method_id, call, call_index FROM covered LEFT JOIN pcalls ON pcalls.case_id = covered.case_id AND call_index::VARCHAR = call),
o AS (SELECT case_id, method_id, coalesce(string_agg(DISTINCT call_index::VARCHAR, ',' ORDER BY call_index::VARCHAR), '') AS unsorted, list_sort(list_distinct(list(call_index) FILTER (call_index IS NOT NULL))) AS l, bool_or(call = 'extra') AS unassigned FROM c GROUP BY ALL)
SELECT f.case_id, f.method_id, CASE WHEN o.case_id IS NOT NULL THEN 'observed' WHEN coverage_complete THEN 'not_observed' ELSE 'unavailable' END AS status, coalesce(array_to_string(l, ','), '') AS syscalls, coalesce(unassigned, false) AS unassigned
FROM fns f LEFT JOIN o USING (case_id, method_id) LEFT JOIN comp USING (case_id)""", fns=_CFN, covered=_COVERED, pcalls=_PCALLS, comp=_COMPLETE),
    "k2_unknown_calls": with_views("SELECT c.case_id, call, count(*) AS rows FROM covered c WHERE call <> 'extra' AND NOT EXISTS (FROM pcalls p WHERE p.case_id = c.case_id AND p.call_index::VARCHAR = c.call) GROUP BY ALL", covered=_COVERED, pcalls=_PCALLS),
    "k3_observed_edges": with_views(f"""WITH {_RES}, e AS (SELECT a.case_id, a.symbol AS caller, b.symbol AS callee, CASE WHEN len(b.symbol) % 2 = 0 THEN len(a.symbol) ELSE 1 END AS n FROM syms a JOIN syms b ON a.case_id = b.case_id AND a.symbol[:5] = b.symbol[:5])
SELECT e.case_id, x.method_id AS caller, y.method_id AS callee, sum(n)::BIGINT AS count FROM e JOIN res x ON x.case_id = e.case_id AND x.symbol = caller AND x.method_id IS NOT NULL JOIN res y ON y.case_id = e.case_id AND y.symbol = callee AND y.method_id IS NOT NULL GROUP BY ALL""", fns=_CFN, syms=_SYMS),
    "k4_provenance": "SELECT o_orderkey::VARCHAR AS case_id, CASE WHEN o_custkey % 5 = 0 THEN 'manifest missing' WHEN o_custkey % 3 = 0 THEN 'other commit' WHEN o_custkey % 4 = 0 THEN 'other reproducer' END AS problem FROM orders",
    "k4_imported_matches": """
WITH x AS (SELECT s_suppkey, min('f' || l_partkey) AS file FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE l_partkey % 40 = s_suppkey % 40 AND p_partkey % 25 <> s_nationkey AND p_size % 5 = s_nationkey % 5 GROUP BY s_suppkey),
p AS (SELECT s_nationkey::VARCHAR AS case_id, s_suppkey::VARCHAR AS import_id, CASE WHEN s_suppkey % 17 = 0 THEN 'other schema' WHEN s_nationkey % 3 > 0 AND s_suppkey % 5 = 0 THEN 'other source root' WHEN file IS NOT NULL THEN 'other content' END AS problem, file FROM supplier LEFT JOIN x USING (s_suppkey))
SELECT case_id, import_id, problem, CASE WHEN problem = 'other content' THEN file END AS file FROM p""",
    "k5_definition_uses": with_views("SELECT u.case_id, u.reference, u.call, max(d.call) FILTER (d.call < u.call) AS defined_by FROM uses u LEFT JOIN defs d ON d.case_id = u.case_id AND d.reference = u.reference GROUP BY ALL", defs=_DEFS, uses=_USES),
    "k5_double_definitions": with_views("SELECT case_id, reference, count(*) AS definitions FROM defs GROUP BY ALL HAVING count(*) > 1", defs=_DEFS),
    "k6_program_calls": """
WITH e AS (SELECT user_id::VARCHAR AS case_id, user_id % 10 AS u, event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events),
bad AS (SELECT case_id, CASE u WHEN 0 THEN 'unbalanced brackets' ELSE 'no call' END AS error FROM e WHERE u < 2 AND event_type NOT IN ('signup', 'error', 'click') GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY event_id) - 1 AS i FROM e ANTI JOIN bad USING (case_id) WHERE event_type <> 'error')
SELECT case_id, i::INT AS call_index, CASE event_type WHEN 'signup' THEN 'openat' WHEN 'click' THEN 'ioctl$A' ELSE 'close' END AS name,
    CASE event_type WHEN 'signup' THEN '0x0,' || chr(10) || '  &(0x7f)=''a)\\x00'', 0x0' WHEN 'click' THEN 'r' || k || ', {<r9=>0x0}' ELSE 'r' || k END AS arguments,
    CASE event_type WHEN 'signup' THEN 'r' || k || '@return' WHEN 'click' THEN 'r9@' || (len(k) + 4) ELSE '' END AS definitions, CASE event_type WHEN 'signup' THEN '' ELSE 'r' || k || '@0' END AS uses, NULL::VARCHAR AS error FROM c
UNION ALL SELECT case_id, NULL, NULL, NULL, NULL, NULL, error FROM bad""",
    "k7_reproducer_calls": """
WITH c AS (SELECT l_orderkey::VARCHAR AS case_id, l_partkey AS pos, min(l_suppkey) AS s FROM lineitem GROUP BY ALL)
SELECT case_id, (row_number() OVER (PARTITION BY case_id ORDER BY pos) - 1)::INT AS call_index, CASE WHEN s % 3 = 0 THEN CASE WHEN s % 2 = 0 THEN 'ioctl$CMD' || s ELSE 'ioctl' END ELSE 'openat' END AS name FROM c WHERE s % 3 < 2""",
    "k8_containing_function": with_views(f"WITH {_LOC} SELECT case_id, operation_id, file, line, holders, method_id FROM loc", ops=_OPS, fns=_CFN),
    "k8_snippets": """
SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[greatest(doc_id % 6 - 1, 1):doc_id % 6 + 3], chr(10))) AS snippet_md5 FROM documents""",
    "k9_operation_pairs": with_views(f"""WITH {_LOC}, kn AS (SELECT DISTINCT case_id, file, line, method_id FROM loc WHERE method_id IS NOT NULL)
SELECT DISTINCT a.case_id, a.file AS from_file, a.line AS from_line, b.file AS to_file, b.line AS to_line, a.method_id FROM kn a JOIN kn b ON a.case_id = b.case_id AND a.file = b.file AND a.method_id = b.method_id AND b.line - a.line BETWEEN 1 AND 29""", ops=_OPS, fns=_CFN),
}
