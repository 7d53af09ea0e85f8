"""Queries of symbol resolution and of members. Parts are types: T<k> of package p<k mod 5>, below T<k/4> and, if even, T<k/6>."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import erased_type
from ..operators import graph, members, symbols
from .domain import table, view, with_views


def _tid(k: str) -> str:
    return f"'p' || cast(({k}) % 5 AS string) || '.T' || cast({k} AS string)"


_TYPES = f"SELECT 'j' AS case_id, {_tid('p_partkey')} AS type_id, 'p' || cast(p_partkey % 5 AS string) AS package, p_partkey % 6 = 5 AS is_interface, p_partkey AS k FROM {{part}}"
_UP4, _UP6 = "cast(floor(p_partkey / 4) AS bigint)", "cast(floor(p_partkey / 6) AS bigint)"
_INH = f"SELECT 'j' AS case_id, {_tid('p_partkey')} AS child, CASE WHEN p_partkey >= 4 THEN {_tid(_UP4)} END AS parent FROM {{part}} UNION ALL SELECT 'j', {_tid('p_partkey')}, {_tid(_UP6)} FROM {{part}} WHERE p_partkey >= 6 AND p_partkey % 2 = 0"
_ONE = "SELECT p_partkey AS k, p_size AS z, 0 AS x FROM {part} UNION ALL SELECT p_partkey, p_size, 1 FROM {part}"
_METHODS = f"""
SELECT 'j' AS case_id, owner_type || '#' || name || '(' || params || ')' || cast(x AS string) AS method_id, * FROM (
SELECT {_tid('k')} AS owner_type, CASE WHEN k % 13 = 0 AND x = 1 THEN '<init>' ELSE 'm' || cast((z + x) % 5 AS string) END AS name, k % 13 = 0 AND x = 1 AS constructor, (k + x) % 7 = 0 AS static, k % 11 = 0 AS varargs,
    CASE (z + x) % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'protected' WHEN 2 THEN 'private' ELSE 'package' END AS visibility, 'p' || cast(k % 5 AS string) AS package, cast(k % 3 AS int) AS n, x, k,
    CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN {_tid('k % 8')} ELSE {_tid('k % 8')} || ',' || {_tid('k % 4')} END AS params FROM (""" + _ONE + """) AS o) AS m"""
_SITES = f"""
SELECT DISTINCT 'j' AS case_id, cast(l_partkey AS string) || '/' || cast(l_suppkey AS string) || '/' || cast(l_linenumber AS string) AS site_id, {_tid('l_partkey')} AS owner_type, 'm' || cast(l_suppkey % 5 AS string) AS name, cast(l_linenumber % 3 AS int) AS arity, false AS is_constructor,
    {_tid('l_suppkey % 40')} AS a0, {_tid('l_partkey % 30')} AS a1, 's' || cast(l_suppkey AS string) AS caller_id FROM {{lineitem}}"""
_CCALLS = "SELECT DISTINCT 'c' AS case_id, 'fn' || cast(l_suppkey AS string) AS caller, 'f' || cast(l_suppkey % 9 AS string) AS file, replace(p_name, ' ', '_') || cast(p_partkey % 30 AS string) AS name, cast(l_linenumber AS int) AS line FROM {lineitem} JOIN {part} ON p_partkey = l_partkey"
_CDEFS = "SELECT 'c' AS case_id, 'd' || cast(p_partkey AS string) AS method_id, replace(p_name, ' ', '_') || cast(p_partkey % 30 AS string) AS name, 'f' || cast(p_size % 9 AS string) AS file, p_size % 2 = 0 AS is_static FROM {part}"


def _array(c: str):
    return F.filter(F.split(c, ","), lambda x: x != "")


def _methods(spark, sf_dir):
    return view(spark, sf_dir, _METHODS).withColumn("parameter_types", _array("params"))


def _types(spark, sf_dir):
    return view(spark, sf_dir, _TYPES)


def _lineage(spark, sf_dir):
    return graph.lineage(_types(spark, sf_dir), view(spark, sf_dir, _INH))


def _sites(spark, sf_dir):
    return view(spark, sf_dir, _SITES)


def r1_c_callees(spark, sf_dir):
    return symbols.c_callees(view(spark, sf_dir, _CCALLS).drop("line"), view(spark, sf_dir, _CDEFS))


def r1_c_call_graph(spark, sf_dir):
    defs = view(spark, sf_dir, _CDEFS)
    edges = symbols.c_callees(view(spark, sf_dir, _CCALLS).drop("line"), defs).withColumn("caller", F.concat(F.lit("d"), F.substring("caller", 3, 20)))
    allowed = defs.where("NOT is_static").select("case_id", F.col("method_id").alias("node"))
    return symbols.c_call_graph(edges, allowed).select("case_id", "node", F.array_join("callees", ",").alias("callees"))


def r2_c_candidates(spark, sf_dir):
    return symbols.c_candidates(view(spark, sf_dir, _CCALLS), view(spark, sf_dir, _CDEFS))


_DECL = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '@Nullable Map<String, List<' || p_type || '>>' WHEN 1 THEN p_type || ' [ ]' WHEN 2 THEN p_type || '...' ELSE 'a.b.' || p_type || '<? extends X>' END AS declared, p_type FROM {part}"


def r3_erased_types(spark, sf_dir):
    return view(spark, sf_dir, _DECL).select("p_partkey", erased_type(F.col("declared")).alias("erased"))


def _refs(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").distinct()
    tid = lambda k: F.concat(F.lit("p"), (F.col(k) % 5).cast("string"), F.lit(".T"), F.col(k).cast("string"))
    n, simple = F.col("l_linenumber"), F.concat(F.lit("T"), F.col("l_partkey").cast("string"))
    value = F.when(n == 1, tid("l_partkey")).when(n == 5, F.concat(simple, F.lit("[]"))).when(n == 6, F.replace(tid("l_partkey"), F.lit("."), F.lit("$"))).otherwise(simple)
    return s.select(
        F.lit("j").alias("case_id"), F.concat_ws("/", "l_partkey", "l_suppkey", "l_linenumber").alias("ref_id"), value.alias("value"), tid("l_suppkey").alias("owner_type"), F.concat(F.lit("p"), (F.col("l_suppkey") % 5).cast("string")).alias("package"),
        F.when(n == 3, F.create_map(simple, tid("l_partkey"))).alias("imports"), F.when(n == 4, F.array(F.lit("p0"), F.lit("p1"))).alias("wildcards"), F.when(n == 7, F.array(simple)).alias("type_parameters"), "l_partkey", "l_suppkey", "l_linenumber",
    )


def r4_type_names(spark, sf_dir):
    return symbols.resolve_types(_refs(spark, sf_dir), _types(spark, sf_dir))


def r5_method_ids(spark, sf_dir):
    m = _methods(spark, sf_dir).withColumn("entity_id", F.col("method_id"))
    declared = F.concat(F.transform("parameter_types", lambda t: t), F.when(F.col("k") % 2 == 0, F.array(F.lit("int[]"), F.lit("String"))).otherwise(F.array(F.lit("Foo"))))
    each = m.select("case_id", "entity_id", F.posexplode(declared).alias("pos", "erased")).unionByName(m.select("case_id", "entity_id", F.lit(-1).alias("pos"), F.when(F.col("x") == 0, "void").otherwise("long[][]").alias("erased")))
    known = _types(spark, sf_dir).select("case_id", F.col("type_id").alias("erased"), F.col("type_id").alias("resolved"))
    params = each.join(known, ["case_id", "erased"], "left").select("case_id", "entity_id", "pos", symbols.type_descriptor(F.col("erased"), F.col("resolved")).alias("descriptor"))
    return symbols.method_ids(m, params)


def _found(spark, sf_dir, lineage):
    return symbols.lookup(_sites(spark, sf_dir).drop("a0", "a1", "caller_id"), lineage, _methods(spark, sf_dir), _types(spark, sf_dir))


def r6_method_lookup(spark, sf_dir):
    return _found(spark, sf_dir, _lineage(spark, sf_dir)).select("case_id", "site_id", "declared_in", "method_id")


def _chosen(spark, sf_dir):
    s = _sites(spark, sf_dir)
    args = s.select("case_id", "site_id", F.posexplode(F.slice(F.array("a0", "a1"), F.lit(1), F.col("arity"))).alias("pos", "type"))
    lineage = _lineage(spark, sf_dir)
    return symbols.best_overloads(_found(spark, sf_dir, lineage), args, lineage)


def r7_overloads(spark, sf_dir):
    return _chosen(spark, sf_dir).select("case_id", "site_id", "method_id", "score")


def r8_dispatch(spark, sf_dir):
    lineage = _lineage(spark, sf_dir)
    return symbols.dispatch(_found(spark, sf_dir, lineage), _methods(spark, sf_dir), lineage)


_VARS = f"SELECT 'j' AS case_id, 'u' || cast(user_id AS string) AS method_id, event_type AS name, event_id AS starts, event_id + 300 AS ends, event_id AS declared, {_tid('event_id % 100')} AS type FROM {{events}} WHERE event_type IN ('click', 'view')"
_FIELDS = f"SELECT 'j' AS case_id, {_tid('p_partkey')} AS owner_type, CASE p_size % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'signup' WHEN 2 THEN 'f2' ELSE 'f' || cast(p_size % 6 AS string) END AS name, {_tid('p_size')} AS type, p_partkey % 3 = 0 AS static, CASE p_partkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'protected' WHEN 2 THEN 'private' ELSE 'package' END AS visibility, 'p' || cast(p_partkey % 5 AS string) AS package FROM {{part}}"
_USES = f"SELECT 'j' AS case_id, cast(event_id AS string) AS use_id, 'u' || cast(user_id AS string) AS method_id, {_tid('user_id')} AS owner_type, CASE WHEN event_type = 'error' THEN 'T' || cast(user_id AS string) ELSE event_type END AS name, event_id AS place FROM {{events}}"


def r9_receiver_types(spark, sf_dir):
    return symbols.receiver_types(view(spark, sf_dir, _USES), view(spark, sf_dir, _VARS), view(spark, sf_dir, _FIELDS), _lineage(spark, sf_dir), _types(spark, sf_dir))


def r9_chained_receivers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sites = e.select(F.lit("j").alias("case_id"), F.col("event_id").alias("site_id"), F.when(F.col("event_id") % 12 > 0, F.col("event_id") - 1).alias("receiver_site"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("method_id"), F.when(F.col("event_id") % 12 == 0, "Head").alias("type"))
    returns = e.select(F.lit("j").alias("case_id"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("method_id"), F.when(F.col("user_id") % 9 > 0, F.concat(F.lit("R"), F.col("user_id").cast("string"))).alias("type")).distinct()
    return symbols.chained_receivers(sites, returns)


def r10_unqualified_calls(spark, sf_dir):
    s = _sites(spark, sf_dir).withColumn("owner_type", F.concat("owner_type", F.lit(".N")))
    s = s.withColumn("static_imports", F.array(F.concat("a0", F.lit("."), F.when(F.col("arity") == 0, F.lit("*")).otherwise(F.col("name")))))
    return symbols.unqualified(s.select("case_id", "site_id", "owner_type", "name", "static_imports"), _methods(spark, sf_dir), _lineage(spark, sf_dir))


def r11_call_statistics(spark, sf_dir):
    lineage = _lineage(spark, sf_dir)
    return symbols.dispatch_statistics(_sites(spark, sf_dir), _found(spark, sf_dir, lineage), _methods(spark, sf_dir), lineage)


_IDS = "SELECT 'i' AS case_id, p_partkey AS k, 'a.B' || cast(p_partkey % 100 AS string) || '#m' || cast(p_size % 3 AS string) || '(' || repeat('I', cast(p_size % 2 AS int)) || CASE p_partkey % 3 WHEN 0 THEN '[Ljava/lang/String;' WHEN 1 THEN 'LFoo;J' ELSE '' END || ')' || CASE WHEN p_size % 2 = 0 THEN 'V' ELSE '[[D' END AS id FROM {part}"
_RIDS = _IDS.replace("'LFoo;J'", "'Lx/Foo;J'")


def r12_fingerprints(spark, sf_dir):
    out = view(spark, sf_dir, _IDS).select("k", symbols.fingerprint(F.col("id")).alias("f")).select("k", "f.*")
    return out.select("k", "class_name", "name", "arity", F.array_join("parameters", ",").alias("parameters"), "returns", "unqualified")


def _pair_ids(spark, sf_dir):
    s = view(spark, sf_dir, _IDS).select("case_id", F.col("id").alias("source_id")).distinct()
    r = view(spark, sf_dir, _RIDS).select("case_id", F.col("id").alias("runtime_id")).distinct()
    return s, r


def r13_source_to_runtime(spark, sf_dir):
    return symbols.source_to_runtime(*_pair_ids(spark, sf_dir))


def r14_two_sided_match(spark, sf_dir):
    return symbols.two_sided_match(*_pair_ids(spark, sf_dir))


def r15_invented_ids(spark, sf_dir):
    s, r = _pair_ids(spark, sf_dir)
    bare = table(spark, sf_dir, "part").select(F.lit("i").alias("case_id"), F.concat(F.lit("x.m"), (F.col("p_partkey") % 7).cast("string")).alias("asked")).distinct()
    return symbols.resolve_invented(s.select("case_id", F.col("source_id").alias("asked")).unionByName(bare), r.select("case_id", F.col("runtime_id").alias("method_id")))


def r16_overload_selection(spark, sf_dir):
    m = _methods(spark, sf_dir)
    asks = m.where("k % 3 > 0").select("case_id", F.concat(F.lit("q"), "method_id").alias("ask_id"), "owner_type", "name", F.when(F.col("k") % 5 == 0, F.transform("parameter_types", lambda t: F.concat(F.lit("z."), F.regexp_extract(t, r"([^.]*)$", 1)))).when(F.col("k") % 5 == 1, F.transform("parameter_types", lambda t: F.lit("Other"))).when(F.col("k") % 5 == 2, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.col("parameter_types")).alias("parameters"))
    return symbols.select_overload(asks, m)


_DOTTED = "SELECT DISTINCT 'd' AS case_id, 'a.' || replace(p_name, ' ', '.') || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.' || lower(p_type) END AS path FROM {part} UNION SELECT DISTINCT 'd', 'a.' || split_part(p_name, ' ', 1) FROM {part} WHERE p_size = 7"


def r17_prefixes(spark, sf_dir):
    return symbols.reduce_prefixes(view(spark, sf_dir, _DOTTED), ".")


def r17_include_list(spark, sf_dir):
    p = symbols.reduce_prefixes(view(spark, sf_dir, _DOTTED), ".")
    part = table(spark, sf_dir, "part")
    return symbols.include_list(p, part.select(F.lit("d").alias("case_id"), F.col("p_type").alias("value")), part.select(F.lit("d").alias("case_id"), F.col("p_brand").alias("value")))


_CLS = "SELECT p_partkey AS k, 'a.' || CASE p_partkey % 4 WHEN 0 THEN 'test.' WHEN 1 THEN 'junit.' ELSE '' END || p_type || CASE p_size % 5 WHEN 0 THEN 'Test' WHEN 1 THEN 'TestCase' WHEN 2 THEN 'IT$Inner' ELSE '' END AS class_name, CASE WHEN p_size % 2 = 0 THEN 'testA' ELSE 'runA' END AS name FROM {part}"


def r18_probable_tests(spark, sf_dir):
    c, m = symbols.probable_test(F.col("class_name"), F.col("name"))
    prefixes = F.array(F.lit("a.test"), F.lit("a.E"))
    return view(spark, sf_dir, _CLS).select("k", c.alias("is_class"), m.alias("is_method"), F.exists(prefixes, lambda p: F.startswith("class_name", p)).alias("included"))


def r19_test_methods(spark, sf_dir):
    m = view(spark, sf_dir, _CLS).select(F.lit("t").alias("case_id"), F.concat("class_name", F.lit(".java")).alias("file"), F.col("k").alias("pos"), "class_name", "name", F.when(F.col("k") % 3 == 0, F.array(F.lit("Test"))).alias("annotations"))
    return symbols.test_methods(m)


_MVARS = "SELECT 'j' AS case_id, cast(l_partkey AS string) AS method_id, 'v' || cast(l_suppkey % 6 AS string) AS name, 'int' || cast(l_linenumber AS string) AS type, cast(l_linenumber * 5 AS int) AS start_line, cast(l_linenumber * 5 + l_quantity AS int) AS end_line FROM {lineitem}"
_MMETH = f"SELECT 'j' AS case_id, cast(p_partkey AS string) AS method_id, {_tid('p_partkey')} AS owner_type, 'p' || cast(p_partkey % 5 AS string) AS package, p_partkey % 4 = 1 AS static, 20 AS line FROM {{part}}"


def m1_accessible_variables(spark, sf_dir):
    return members.accessible_variables(view(spark, sf_dir, _MMETH), view(spark, sf_dir, _MVARS), view(spark, sf_dir, _FIELDS), _lineage(spark, sf_dir))


def m2_visibility(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mods = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("static"))).when(F.col("p_size") % 5 == 1, F.array(F.lit("final"), F.lit("private"))).when(F.col("p_size") % 5 == 2, F.array(F.lit("protected"))).otherwise(F.array(F.lit("public"), F.lit("static")))
    owner = F.concat(F.lit("a.T"), (F.col("p_partkey") % 3).cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".N").otherwise(""))
    held = p.select("p_partkey", members.visibility(mods, F.col("p_partkey") % 7 == 0).alias("visibility"), owner.alias("owner"), F.concat(F.lit("a.T"), (F.col("p_size") % 3).cast("string")).alias("here"), F.when(F.col("p_size") % 4 == 0, "b").otherwise("a").alias("here_package"))
    return held.withColumn("visible", members.visible(F.col("visibility"), F.col("owner"), F.lit("a"), F.col("here"), F.col("here_package"), F.col("p_partkey") % 3 == 0))


def _asks(spark, sf_dir):
    t = _types(spark, sf_dir)
    return t.select("case_id", F.col("k").alias("ask_id"), "type_id", (F.col("k") % 3 == 0).alias("is_class_name"), F.when(F.col("k") % 2 == 0, F.col("type_id")).otherwise("p1.Q").alias("here"), F.when(F.col("k") % 2 == 0, F.col("package")).otherwise("p1").alias("here_package"), F.when(F.col("k") % 4 == 0, "M1").alias("query"), F.lit(3).alias("limit"))


def m3_callable_methods(spark, sf_dir):
    m = _methods(spark, sf_dir).withColumns({"return_type": F.lit("void"), "comment": F.lit("")})
    return members.callable_methods(_asks(spark, sf_dir), m, _lineage(spark, sf_dir), _types(spark, sf_dir))


def m3_ask_status(spark, sf_dir):
    asks = table(spark, sf_dir, "part").select(F.lit("j").alias("case_id"), F.col("p_partkey").alias("ask_id"), F.concat(F.lit("T"), (F.col("p_partkey") * 2).cast("string")).alias("name"))
    twice = _types(spark, sf_dir).unionByName(_types(spark, sf_dir).where("k % 10 = 0").withColumn("type_id", F.concat(F.lit("other."), F.col("type_id"))))
    return members.ask_status(asks, twice)


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] in "rm" and name[1:2].isdigit()}

_LIN = """lin AS (SELECT type_id, ancestor, min(depth) AS depth FROM lin0 GROUP BY ALL)"""
_LIN0 = """lin0 AS (SELECT type_id, type_id AS ancestor, 0 AS depth FROM types UNION SELECT lin0.type_id, inh.parent, depth + 1 FROM lin0 JOIN inh ON inh.child = lin0.ancestor WHERE inh.parent IS NOT NULL)"""
_FOUND = f"""{_LIN0}, {_LIN},
fnd AS (SELECT s.site_id, m.owner_type AS declared_in, m.method_id, m.params, m.n, m.static, m.visibility, m.name, s.a0, s.a1, s.arity, s.caller_id FROM sites s JOIN lin ON lin.type_id = s.owner_type JOIN types t ON t.type_id = lin.ancestor JOIN types h ON h.type_id = s.owner_type
    JOIN methods m ON m.owner_type = lin.ancestor AND m.name = s.name AND (m.n = arity OR varargs AND arity >= m.n - 1) AND NOT m.constructor
    WHERE NOT (depth > 0 AND (visibility = 'private' OR visibility = 'package' AND t.package <> h.package))
    QUALIFY row_number() OVER (PARTITION BY site_id, params ORDER BY t.is_interface, depth, ancestor, method_id) = 1)"""
_DISP = """dis AS (SELECT site_id, method_id FROM fnd UNION SELECT f.site_id, o.method_id FROM fnd f JOIN lin ON lin.ancestor = f.declared_in AND lin.depth > 0 JOIN methods o ON o.owner_type = lin.type_id AND o.name = f.name AND o.params = f.params AND NOT o.static AND NOT o.constructor
    WHERE NOT f.static AND f.visibility <> 'private')"""
_S = dict(types=_TYPES, inh=_INH, methods=_METHODS, sites=_SITES)
_C = dict(calls=_CCALLS, defs=_CDEFS)
_RULE = """w AS (SELECT DISTINCT c.case_id, caller, file, name FROM calls c),
q AS (SELECT w.*, count(d.method_id) AS n, count(*) FILTER (NOT is_static) AS ext, count(*) FILTER (d.file = w.file) AS here FROM w JOIN defs d ON d.name = w.name GROUP BY ALL),
e AS (SELECT DISTINCT q.case_id, caller, d.method_id AS callee, CASE WHEN here > 0 THEN 'same file' WHEN ext = 1 THEN 'only external' WHEN n = 1 THEN 'only one' WHEN ext > 0 THEN 'all external' ELSE 'all' END AS rule FROM q JOIN defs d ON d.name = q.name
    AND CASE WHEN here > 0 THEN d.file = q.file WHEN ext > 0 THEN NOT is_static ELSE true END)"""
_FP = """f AS (SELECT id, k, regexp_extract(id, '^([^#]*)#', 1) AS class_name, regexp_extract(id, '#([^(]*)', 1) AS name, regexp_extract_all(regexp_extract(id, '\\(([^)]*)', 1), '\\[*(?:[BCDFIJSZ]|L[^;]+;)') AS args, regexp_extract(id, '\\)(.*)$', 1) AS ret, src FROM ids)"""
_IDSQL = dict(ids="SELECT DISTINCT id, 0 AS k, 's' AS src FROM (" + _IDS + ") AS a UNION ALL SELECT DISTINCT id, 0, 'r' FROM (" + _RIDS + ") AS b")
_SHORT = "list_transform(args, lambda a: regexp_replace(a, 'L(?:[^;]*/)?([^;/]+);', 'L\\1;'))"
SQL = {
    "r1_c_callees": with_views(f"WITH {_RULE} SELECT * FROM e", **_C),
    "r1_c_call_graph": with_views(f"""WITH {_RULE}, v AS (SELECT method_id AS node FROM defs WHERE NOT is_static)
SELECT 'c' AS case_id, v.node, coalesce(string_agg(DISTINCT t.node, ',' ORDER BY t.node), '') AS callees FROM v LEFT JOIN e ON 'd' || caller[3:] = v.node LEFT JOIN v t ON t.node = e.callee GROUP BY v.node""", **_C),
    "r2_c_candidates": with_views("""
WITH q AS (SELECT c.case_id, caller, c.name, line, c.file, count(*) FILTER (NOT is_static) AS ext, count(*) FILTER (d.file = c.file) AS here FROM calls c JOIN defs d ON d.name = c.name GROUP BY ALL)
SELECT q.case_id, caller, q.name, line, d.method_id AS callee, CASE WHEN here > 0 THEN here ELSE ext END AS candidate_count FROM q JOIN defs d ON d.name = q.name AND CASE WHEN here > 0 THEN d.file = q.file ELSE NOT is_static END""", **_C),
    "r3_erased_types": with_views("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Map' WHEN 3 THEN 'a.b.' || p_type ELSE p_type || '[]' END AS erased FROM d", d=_DECL),
    "r4_type_names": f"""
WITH s AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s, l_linenumber AS n, {_tid('l_partkey').replace('string', 'VARCHAR')} AS tid FROM lineitem)
SELECT 'j' AS case_id, k || '/' || s || '/' || n AS ref_id, CASE n WHEN 1 THEN tid WHEN 5 THEN 'T' || k || '[]' WHEN 6 THEN replace(tid, '.', '$') ELSE 'T' || k END AS value,
    CASE WHEN n IN (1, 3, 6) THEN tid WHEN n IN (5, 7) THEN NULL WHEN k % 5 = s % 5 THEN tid WHEN n = 4 AND k % 5 < 2 THEN tid END AS resolved FROM s""",
    "r5_method_ids": with_views("""
SELECT case_id, method_id AS entity_id, owner_type || '#' || name || '(' || array_to_string(list_transform(list_filter(string_split(params, ','), lambda p: p <> ''), lambda p: 'L' || replace(p, '.', '/') || ';'), '') || CASE WHEN k % 2 = 0 THEN '[ILjava/lang/String;' ELSE 'LFoo;' END
    || ')' || CASE WHEN constructor OR x = 0 THEN 'V' ELSE '[[J' END AS method_id FROM methods""", methods=_METHODS),
    "r6_method_lookup": with_views(f"WITH RECURSIVE {_FOUND} SELECT 'j' AS case_id, site_id, declared_in, method_id FROM fnd", **_S),
    "r7_overloads": with_views(f"""WITH RECURSIVE {_FOUND},
c AS (SELECT *, count(*) OVER (PARTITION BY site_id) AS cnt FROM fnd), p AS (SELECT site_id, method_id, cnt, unnest(string_split(params, ',')) AS par, unnest(range(len(string_split(params, ',')))) AS i, a0, a1, arity FROM c WHERE params <> ''),
z AS (SELECT site_id, method_id, sum(CASE WHEN i >= arity THEN 0 WHEN par = CASE i WHEN 0 THEN a0 ELSE a1 END THEN 2 WHEN EXISTS (FROM lin WHERE lin.type_id = CASE i WHEN 0 THEN a0 ELSE a1 END AND lin.ancestor = par) THEN 1 ELSE 0 END) AS score FROM p WHERE cnt > 1 GROUP BY ALL)
SELECT 'j' AS case_id, c.site_id, c.method_id, coalesce(score, 0)::BIGINT AS score FROM c LEFT JOIN z USING (site_id, method_id) QUALIFY coalesce(score, 0) = max(coalesce(score, 0)) OVER (PARTITION BY c.site_id)""", **_S),
    "r8_dispatch": with_views(f"WITH RECURSIVE {_FOUND}, {_DISP} SELECT 'j' AS case_id, site_id, method_id FROM dis", **_S),
    "r9_receiver_types": with_views(f"""WITH RECURSIVE {_LIN0}, {_LIN},
v AS (SELECT use_id, arg_max(v.type, (starts, declared)) AS variable FROM uses JOIN vars v USING (method_id, name) WHERE starts <= place AND place < ends AND declared <= place GROUP BY use_id),
f AS (SELECT use_id, arg_min(f.type, (depth, ancestor)) AS field FROM uses u JOIN lin ON lin.type_id = u.owner_type JOIN fields f ON f.owner_type = ancestor AND f.name = u.name GROUP BY use_id)
SELECT 'j' AS case_id, u.use_id, coalesce(variable, field, t.type_id) AS type, CASE WHEN variable IS NOT NULL THEN 'variable' WHEN field IS NOT NULL THEN 'field' WHEN t.type_id IS NOT NULL THEN 'type' ELSE 'unknown' END AS origin
FROM uses u LEFT JOIN v USING (use_id) LEFT JOIN f USING (use_id) LEFT JOIN types t ON string_split(t.type_id, '.')[-1] = u.name""", types=_TYPES, inh=_INH, uses=_USES, vars=_VARS, fields=_FIELDS),
    "r9_chained_receivers": """
WITH RECURSIVE r AS (SELECT event_id AS site_id, 'Head' AS type, 0 AS d FROM events WHERE event_id % 12 = 0
    UNION ALL SELECT e.event_id, 'R' || p.user_id, d + 1 FROM r JOIN events p ON p.event_id = r.site_id AND p.user_id % 9 > 0 JOIN events e ON e.event_id = r.site_id + 1 AND e.event_id % 12 > 0 WHERE d < 8)
SELECT 'j' AS case_id, site_id, type FROM r""",
    "r10_unqualified_calls": with_views(f"""WITH RECURSIVE {_LIN0}, {_LIN}, i AS (SELECT DISTINCT s.site_id, s.owner_type FROM sites s JOIN lin ON lin.type_id = s.owner_type JOIN methods m ON m.owner_type = lin.ancestor AND m.name = s.name)
SELECT 'j' AS case_id, site_id, owner_type, 1 AS depth FROM i UNION ALL SELECT DISTINCT 'j', s.site_id, a0, -1 FROM sites s JOIN methods m ON m.owner_type = a0 AND m.name = s.name AND m.static WHERE s.site_id NOT IN (SELECT site_id FROM i)""", **_S),
    "r11_call_statistics": with_views(f"""WITH RECURSIVE {_FOUND}, {_DISP}, c AS (SELECT s.site_id, s.caller_id, count(d.method_id) AS t FROM sites s LEFT JOIN dis d USING (site_id) GROUP BY ALL)
SELECT 'j' AS case_id, count(*) AS sites, count(*) FILTER (t > 0) AS resolved, count(*) FILTER (t = 0) AS unresolved, sum(t)::BIGINT AS targets, (SELECT count(*) FROM (SELECT DISTINCT caller_id, method_id FROM sites JOIN dis USING (site_id))) AS edges FROM c""", **_S),
    "r12_fingerprints": with_views("""
SELECT k, regexp_extract(id, '^([^#]*)#', 1) AS class_name, 'm' || regexp_extract(id, '#m(.)', 1) AS name, (CASE WHEN id LIKE '%(I%' THEN 1 ELSE 0 END + CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END)::INT AS arity,
    concat_ws(',', CASE WHEN id LIKE '%(I%' THEN 'int' END, CASE k % 3 WHEN 0 THEN 'java.lang.String[]' WHEN 1 THEN 'Foo,long' END) AS parameters, CASE WHEN id LIKE '%V' THEN 'void' ELSE 'double[][]' END AS returns, k % 3 = 1 AS unqualified FROM ids""", ids=_IDS),
    "r13_source_to_runtime": with_views(f"""WITH {_FP}, p AS (SELECT s.id AS source_id, r.id AS runtime_id, len(list_filter(list_zip(s.args, r.args), lambda z: z[1] = z[2])) AS o FROM f s JOIN f r ON s.src = 's' AND r.src = 'r' AND s.class_name = r.class_name AND s.name = r.name AND len(s.args) = len(r.args))
SELECT 'i' AS case_id, source_id, arg_max(runtime_id, (o, len(runtime_id) - len(replace(runtime_id, '/', '')), len(runtime_id), runtime_id)) AS runtime_id FROM p GROUP BY source_id""", **_IDSQL),
    "r14_two_sided_match": with_views(f"""WITH {_FP}, ex AS (SELECT a.id FROM f a JOIN f b ON a.id = b.id AND a.src = 's' AND b.src = 'r'),
g AS (SELECT *, class_name || name || array_to_string({_SHORT}, '') || ret AS shape FROM f WHERE id NOT IN (SELECT id FROM ex)),
n AS (SELECT shape, count(*) FILTER (src = 's') AS ns, count(*) FILTER (src = 'r') AS nr, min(id) FILTER (src = 'r') AS rid FROM g GROUP BY shape)
SELECT 'i' AS case_id, id AS source_id, id AS runtime_id, 'exact' AS status FROM ex UNION ALL SELECT 'i', id, CASE WHEN ns = 1 AND nr = 1 THEN rid END, CASE WHEN ns = 1 AND nr = 1 THEN 'unique' ELSE 'ambiguous' END FROM g JOIN n USING (shape) WHERE src = 's' AND nr > 0""", **_IDSQL),
    "r15_invented_ids": with_views(f"""WITH {_FP}, s AS (SELECT * FROM f WHERE src = 's'), r AS (SELECT * FROM f WHERE src = 'r'),
a AS (SELECT s.id AS asked, CASE WHEN EXISTS (FROM r WHERE r.id = s.id) THEN s.id ELSE (SELECT arg_max(r.id, (len(r.id) - len(replace(r.id, '/', '')), len(r.id), r.id)) FROM r WHERE r.class_name = s.class_name AND r.name = s.name AND len(r.args) = len(s.args)) END AS method_id, EXISTS (FROM r WHERE r.id = s.id) AS ex FROM s)
SELECT 'i' AS case_id, asked, method_id, CASE WHEN ex THEN 'exact' WHEN method_id IS NOT NULL THEN 'fingerprint' ELSE 'unknown' END AS how FROM a UNION ALL SELECT DISTINCT 'i', 'x.m' || (p_partkey % 7), NULL, 'unknown' FROM part""", **_IDSQL),
    "r16_overload_selection": with_views("""
SELECT case_id, 'q' || method_id AS ask_id, CASE WHEN k % 5 <> 2 THEN method_id END AS method_id, CASE k % 5 WHEN 0 THEN 'compatible' WHEN 1 THEN 'arity' WHEN 2 THEN 'none' ELSE 'exact' END AS how FROM methods WHERE k % 3 > 0""", methods=_METHODS),
    "r17_prefixes": with_views("SELECT case_id, path FROM d WHERE NOT EXISTS (FROM d e WHERE starts_with(d.path, e.path || '.'))", d=_DOTTED),
    "r17_include_list": with_views("""
WITH u AS (SELECT path AS value, 0 AS s FROM d WHERE NOT EXISTS (FROM d e WHERE starts_with(d.path, e.path || '.')) UNION ALL SELECT p_type, 1 FROM part UNION ALL SELECT p_brand, 2 FROM part), f AS (SELECT value, min(s) AS s FROM u GROUP BY value)
SELECT 'd' AS case_id, value, row_number() OVER (ORDER BY s, value)::INT AS position FROM f""", d=_DOTTED),
    "r18_probable_tests": with_views("""
SELECT k, k % 4 < 2 OR regexp_matches(string_split(class_name, '$')[1], '(Test|TestCase|IT)$') AS is_class, name = 'testA' AND string_split(class_name, '$')[1] LIKE '%TestCase' AS is_method, class_name LIKE 'a.test%' OR class_name LIKE 'a.E%' AS included FROM c""", c=_CLS),
    "r19_test_methods": with_views("SELECT 't' AS case_id, class_name || '::' || name AS test_id, arg_min(class_name || '.java', (class_name, k)) AS file, min(k) AS pos FROM c WHERE name LIKE 'test%' OR k % 3 = 0 GROUP BY ALL", c=_CLS),
    "m1_accessible_variables": with_views(f"""WITH RECURSIVE {_LIN0}, {_LIN},
l AS (SELECT m.method_id, v.name, arg_max(v.type, (start_line, v.type)) AS type FROM mm m JOIN vars v USING (method_id) WHERE start_line <= line AND line <= end_line GROUP BY ALL),
f AS (SELECT m.method_id, m.owner_type, m.package, m.static AS ms, f.owner_type AS anc, f.name, f.type, f.static, f.visibility, f.package AS fp FROM mm m JOIN lin ON lin.type_id = m.owner_type JOIN fields f ON f.owner_type = lin.ancestor
    QUALIFY row_number() OVER (PARTITION BY m.method_id, f.name ORDER BY depth, ancestor) = 1)
SELECT 'j' AS case_id, method_id, name, 'local' AS kind, type, name AS receiver FROM l
UNION ALL SELECT 'j', method_id, name, 'field', type, CASE WHEN static THEN anc || '.' || name ELSE 'this.' || name END FROM f WHERE (visibility IN ('public', 'protected') OR anc = owner_type OR visibility = 'package' AND fp = package) AND (NOT ms OR static) AND NOT EXISTS (FROM l WHERE l.method_id = f.method_id AND l.name = f.name)""", types=_TYPES, inh=_INH, mm=_MMETH, vars=_MVARS.replace("cast(l_linenumber * 5 + l_quantity AS int)", "cast(floor(l_linenumber * 5 + l_quantity) AS int)"), fields=_FIELDS),
    "m2_visibility": """
WITH h AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_partkey % 7 = 0 THEN 'public' ELSE 'package' END WHEN p_size % 5 = 1 THEN 'private' WHEN p_size % 5 = 2 THEN 'protected' ELSE 'public' END AS visibility,
    'a.T' || (p_partkey % 3) || CASE WHEN p_partkey % 2 = 0 THEN '.N' ELSE '' END AS owner, 'a.T' || (p_size % 3) AS here, CASE WHEN p_size % 4 = 0 THEN 'b' ELSE 'a' END AS here_package, p_partkey % 3 = p_size % 3 AS same FROM part)
SELECT p_partkey, visibility, owner, here, here_package, visibility = 'public' OR owner = here OR visibility = 'private' AND same OR visibility <> 'private' AND here_package = 'a' OR visibility = 'protected' AND p_partkey % 3 = 0 AS visible FROM h""",
    "m3_callable_methods": with_views(f"""WITH RECURSIVE {_LIN0}, {_LIN},
a AS (SELECT k AS ask, type_id, k % 3 = 0 AS cn, CASE WHEN k % 2 = 0 THEN type_id ELSE 'p1.Q' END AS here, CASE WHEN k % 2 = 0 THEN package ELSE 'p1' END AS hp, CASE WHEN k % 4 = 0 THEN 'm1' END AS qy FROM types),
h AS (SELECT ask, m.*, lin.depth, t.is_interface, qy FROM a JOIN lin ON lin.type_id = a.type_id JOIN types t ON t.type_id = lin.ancestor JOIN methods m ON m.owner_type = lin.ancestor
    WHERE NOT constructor AND (NOT cn OR static) AND NOT (static AND is_interface AND depth > 0) AND NOT (depth > 0 AND visibility = 'private')
    AND (visibility = 'public' OR m.owner_type = here OR visibility <> 'private' AND m.package = hp OR visibility = 'protected' AND here = a.type_id)
    QUALIFY row_number() OVER (PARTITION BY ask, name, params ORDER BY is_interface, depth, ancestor, method_id) = 1),
s AS (SELECT ask, method_id, name, depth > 0 AS inherited FROM h WHERE qy IS NULL OR contains(name || ' void ', qy))
SELECT 'j' AS case_id, ask AS ask_id, method_id, inherited, row_number() OVER w::INT AS position, count(*) OVER (PARTITION BY ask) AS total, count(*) OVER (PARTITION BY ask) > 3 AS truncated FROM s WINDOW w AS (PARTITION BY ask ORDER BY inherited, name, method_id) QUALIFY position <= 3""", types=_TYPES, inh=_INH, methods=_METHODS),
    "m3_ask_status": "SELECT 'j' AS case_id, p_partkey AS ask_id, CASE WHEN p_partkey * 2 > (SELECT max(p_partkey) FROM part) THEN 'unresolved' WHEN p_partkey * 2 % 10 = 0 THEN 'ambiguous' ELSE 'ok' END AS status FROM part",
}
