"""Queries of the evidence graph and of walks over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .domain import ENTITIES, RELATIONS, duck, view, with_views

#: Every order line's supplier is a dangling source in its part's case where the supplier is none of it.
_LOOSE = """
SELECT p_brand AS case_id, 'supplier:' || cast(l_suppkey AS string) AS source, 'declares' AS kind, 'part:' || cast(l_partkey AS string) AS target, l_linestatus AS provenance FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
#: Parts under their name within a brand: ids that repeat.
_NAMED = """
SELECT p_brand AS case_id, 'part:' || cast(p_partkey AS string) AS entity_id, replace(p_name, ' ', '_') AS method_id, p_type AS file, cast(p_partkey AS int) AS line FROM {part}"""
#: Spans in files: documents' ranges of lines, small ones within large ones.
_INNER = """
SELECT p_brand AS case_id, p_type AS file, 'part:' || cast(p_partkey AS string) AS entity_id, cast(p_partkey % 700 AS int) AS line, cast(p_partkey % 700 + p_size % 9 AS int) AS end_line FROM {part}"""
_OUTER = """
SELECT p_brand AS case_id, p_type AS file, 'span:' || cast(p_partkey AS string) AS entity_id, cast(p_partkey % 600 AS int) AS line, cast(p_partkey % 600 + p_size * 12 AS int) AS end_line FROM {part}"""
_HIERARCHY = """
SELECT 'parts' AS case_id, cast(p_partkey AS string) AS child, CASE WHEN p_partkey > 1 THEN cast(cast(floor(p_partkey / 2) AS bigint) AS string) END AS parent FROM {part}
UNION ALL SELECT 'parts', cast(p_partkey AS string), CASE WHEN p_partkey > 2 THEN cast(cast(floor(p_partkey / 3) AS bigint) AS string) END FROM {part}"""
#: Calls between parts: a part calls the two that stand at half and a third of its key.
_CALLS = "SELECT case_id, child AS source, 'calls_candidate' AS kind, parent AS target, '' AS provenance FROM (" + _HIERARCHY + ") AS h WHERE parent IS NOT NULL"
_OWNERS = "SELECT 'parts' AS case_id, cast(p_partkey AS string) AS entity_id, p_brand AS owner, p_size FROM {part}"

_TESTS = "SELECT 'o' AS case_id, 'T::m' || cast(o_orderkey AS string) AS test_id, CASE WHEN o_custkey % 4 > 0 THEN 'test_method:' || cast(o_custkey AS string) END AS source_entity_id FROM {orders}"
_TOLD = "SELECT 'o' AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'report:' ELSE 'note:' END || 'T::m' || cast(o_orderkey AS string) AS entity_id, o_orderpriority AS content FROM {orders}"


def _graph(spark, sf_dir):
    return view(spark, sf_dir, ENTITIES), graph.build_relations(view(spark, sf_dir, RELATIONS))


def g1_duplicate_entities(spark, sf_dir):
    named = view(spark, sf_dir, _NAMED).select("case_id", F.col("method_id").alias("entity_id"))
    return graph.duplicate_entities(named)


def g2_relations(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


def g3_dangling_endpoints(spark, sf_dir):
    loose = graph.build_relations(view(spark, sf_dir, _LOOSE))
    return graph.dangling(loose, view(spark, sf_dir, ENTITIES)).join(loose.select("edge_id", "source", "target", "provenance"), "edge_id").select("case_id", "side", "endpoint", "source", "target", "provenance")


def g4_aliases(spark, sf_dir):
    e = view(spark, sf_dir, _NAMED).withColumn("kind", F.lit("function"))
    return graph.aliases(e)


def g5_disambiguation(spark, sf_dir):
    return graph.disambiguate(view(spark, sf_dir, _NAMED)).select("case_id", "entity_id", "unique_id", "diagnostic")


def g6_search_document(spark, sf_dir):
    from ..operators.search import search_document

    return view(spark, sf_dir, ENTITIES).select("case_id", "entity_id", search_document(F.col("entity_id"), F.col("name"), F.to_json(F.struct(F.col("content").alias("content")))).alias("document"))


def g7_compact_tables(spark, sf_dir):
    nodes, edges = graph.compact(*_graph(spark, sf_dir))
    return edges.drop("edge_id").join(nodes.select(F.col("node_id").alias("source_node"), F.col("entity_id").alias("source")), "source_node")


def g8_containment(spark, sf_dir):
    return graph.innermost(view(spark, sf_dir, _INNER), view(spark, sf_dir, _OUTER))


def g9_resolve_ids(spark, sf_dir):
    e, _ = _graph(spark, sf_dir)
    asked = e.select("case_id", F.col("entity_id").alias("asked")).unionByName(e.where("kind = 'function'").select("case_id", F.col("method_id").alias("asked"))).unionByName(e.select("case_id", F.col("name").alias("asked"))).distinct()
    return graph.resolve_ids(asked, e, graph.aliases(e))


def _spans(spark, sf_dir):
    from .domain import table

    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("file"), F.col("text").cast("binary").alias("content"), F.octet_length(F.left("text", F.lit(40))).alias("head"), "doc_id")
    files = docs.select("case_id", "file", "content", F.when(F.col("doc_id") % 11 == 0, F.lit("changed")).otherwise(F.sha2("content", 256)).alias("sha256"), F.lit("utf-8").alias("encoding"))
    spans = docs.select("case_id", "file", F.concat(F.lit("doc:"), "file").alias("entity_id"), F.lit(0).cast("long").alias("start_byte"), F.when(F.col("doc_id") % 7 == 0, F.lit(10**9)).otherwise(F.col("head")).cast("long").alias("end_byte"))
    return spans, files


def g10_span_text(spark, sf_dir):
    out = graph.span_text(*_spans(spark, sf_dir))
    return out.select("case_id", "entity_id", F.hex(F.encode(F.col("text"), "UTF-8")).alias("text_hex"), "stale")


def g11_cards(spark, sf_dir):
    return graph.cards(view(spark, sf_dir, ENTITIES))


def g12_summary(spark, sf_dir):
    return graph.summary(*_graph(spark, sf_dir))


def g13_method_records(spark, sf_dir):
    e, _ = _graph(spark, sf_dir)
    texts = e.select("case_id", "entity_id", F.concat(F.lit("body of "), "name").alias("text"))
    return graph.method_records(e, texts, graph.aliases(e))


def g13_test_records(spark, sf_dir):
    """Documents are sources, orders failing tests; orders of even keys have a report."""
    texts = view(spark, sf_dir, "SELECT 'o' AS case_id, 'test_method:' || cast(doc_id AS string) AS entity_id, text FROM {documents}")
    out = graph.test_records(view(spark, sf_dir, _TESTS), texts, view(spark, sf_dir, _TOLD))
    return out.withColumn("source", F.md5("source"))


def g13_record_entities(spark, sf_dir):
    methods = view(spark, sf_dir, "SELECT case_id, method_id, CASE WHEN line % 20 = 0 THEN name END AS name, file, line, end_line, content AS source FROM (" + ENTITIES + ") AS e WHERE kind = 'function'")
    tests = view(spark, sf_dir, "SELECT cast(o_orderkey AS string) AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS failure_text FROM {orders}")
    return graph.record_entities(methods, tests)


def n1_relation_counts(spark, sf_dir):
    return graph.relation_counts(_graph(spark, sf_dir)[1])


def n2_neighbours(spark, sf_dir):
    e, r = _graph(spark, sf_dir)
    out = graph.neighbours(r, e)
    return out.groupBy("case_id", "node", "direction", "kind", "neighbour", "neighbour_name", "total").agg(F.count("*").alias("edges"))


def n4_ranked_callers(spark, sf_dir):
    own = view(spark, sf_dir, _OWNERS)
    return graph.ranked_callers(view(spark, sf_dir, _CALLS), own, own.where("p_size = 1"))


def n5_shortest_paths(spark, sf_dir):
    own = view(spark, sf_dir, _OWNERS)
    callers = graph.ranked_callers(view(spark, sf_dir, _CALLS), own, own.where("p_size = 1"))
    found = graph.shortest_path(callers, own, own.where("p_size = 1"))
    return found.select("case_id", "target", F.array_join("path", ">").alias("path"))


def n6_executed_paths(spark, sf_dir):
    own, calls = view(spark, sf_dir, _OWNERS), view(spark, sf_dir, _CALLS)
    callers = graph.ranked_callers(calls, own.withColumn("owner", F.lit("")), own.where("1 = 0"), most=1 << 30)
    found = graph.nearest_anchor_path(callers, own, own.where("p_size = 2"))
    return found.select("case_id", "target", F.array_join("path", ">").alias("path"))


def n7_lineage(spark, sf_dir):
    h = view(spark, sf_dir, _HIERARCHY)
    return graph.lineage(h.select("case_id", F.col("child").alias("type_id")), h)


def n8_pruned_graph(spark, sf_dir):
    covered = view(spark, sf_dir, _OWNERS).where("p_size <= 25").select("case_id", F.col("entity_id").alias("node"))
    return graph.prune(view(spark, sf_dir, _CALLS), covered).select("case_id", "node", F.array_join("callees", ",").alias("callees"))


def n9_adjacency(spark, sf_dir):
    calls = view(spark, sf_dir, _CALLS)
    both = graph.adjacency(calls).withColumn("direction", F.lit("out")).unionByName(graph.adjacency(calls, True).withColumn("direction", F.lit("in")))
    return both.select("case_id", "node", "direction", F.array_join("others", ",").alias("others"))


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] in "gn" and name[1:2].isdigit()}

_REL = "SELECT DISTINCT case_id, source, kind, target, provenance FROM (" + duck(RELATIONS) + ")"
def _levels(depth: int, budget: int) -> str:
    """The queue of each target, level by level, with the turn that each node has in it."""
    out = "WITH callers AS ({callers}), anchor AS (SELECT entity_id AS node FROM own WHERE p_size = 1), f0 AS MATERIALIZED (SELECT entity_id AS target, entity_id AS node, 1 AS rank, entity_id AS path FROM own), s0 AS (SELECT target, node FROM f0)"
    for k in range(depth + 1):
        before = f"SELECT * FROM h{k - 1} UNION ALL" if k else ""
        out += f""",
h{k} AS MATERIALIZED ({before} SELECT target, arg_min(path, rank) AS path FROM f{k} JOIN anchor USING (node) GROUP BY target)"""
        if k < depth:
            out += f""",
w{k} AS (SELECT f.target, c.caller AS node, f.rank, c.position, f.path, f.last FROM (SELECT *, max(rank) OVER (PARTITION BY target) AS last FROM f{k} ANTI JOIN h{k} USING (target)) f JOIN callers c ON c.target = f.node QUALIFY row_number() OVER (PARTITION BY f.target, c.caller ORDER BY f.rank, c.position) = 1),
f{k + 1} AS MATERIALIZED (SELECT target, node, last + row_number() OVER (PARTITION BY target ORDER BY w.rank, position) AS rank, node || '>' || path AS path FROM w{k} w ANTI JOIN s{k} USING (target, node) QUALIFY last + row_number() OVER (PARTITION BY target ORDER BY w.rank, position) <= {budget}),
s{k + 1} AS MATERIALIZED (SELECT * FROM s{k} UNION ALL SELECT target, node FROM f{k + 1})"""
    return out + f"\nSELECT 'parts' AS case_id, target, path FROM h{depth}"


_RANKED = """SELECT target, caller, position FROM (SELECT c.target, caller, row_number() OVER (PARTITION BY c.target ORDER BY o.p_size = 1 DESC, o.owner = coalesce(t.owner, '') DESC, caller) AS position
    FROM (SELECT DISTINCT source AS caller, target FROM calls) c LEFT JOIN own o ON o.entity_id = caller LEFT JOIN own t ON t.entity_id = c.target) WHERE position <= 100"""
#: Any shortest walk to an anchor, and of these the one whose callers come first from the target on.
_NEAREST = """
WITH RECURSIVE c AS MATERIALIZED (SELECT target, caller, row_number() OVER (PARTITION BY target ORDER BY caller) AS position FROM (SELECT DISTINCT target, source AS caller FROM calls)), anchor AS MATERIALIZED (SELECT entity_id AS node FROM own WHERE p_size = 2),
b AS (SELECT entity_id AS target, entity_id AS node, 1 AS n FROM own UNION SELECT b.target, c.caller, n + 1 FROM b JOIN c ON c.target = b.node WHERE b.node NOT IN (SELECT node FROM anchor)),
far AS MATERIALIZED (SELECT node AS target, node, 0 AS left_over FROM anchor UNION ALL SELECT b.target, NULL, min(n) - 1 FROM b JOIN anchor USING (node) WHERE b.target NOT IN (SELECT node FROM anchor) GROUP BY b.target),
d AS MATERIALIZED (SELECT target, left_over FROM far),
next AS MATERIALIZED (SELECT c.target, arg_min(c.caller, c.position) AS caller FROM c JOIN d me ON me.target = c.target JOIN d up ON up.target = c.caller AND up.left_over = me.left_over - 1 WHERE me.left_over > 0 GROUP BY c.target),
walk AS (SELECT target, target AS node, target AS path FROM d UNION ALL SELECT w.target, n.caller, n.caller || '>' || w.path FROM walk w JOIN next n ON n.target = w.node)
SELECT 'parts' AS case_id, target, path FROM walk WHERE node IN (SELECT node FROM anchor)"""
SQL = {
    "g1_duplicate_entities": with_views("SELECT case_id, method_id AS entity_id, count(*) AS copies FROM named GROUP BY ALL HAVING count(*) > 1", named=_NAMED),
    "g2_relations": with_views("""SELECT *, 'edge:' || sha256('{"kind":"' || kind || '","provenance":"' || provenance || '","source":"' || source || '","target":"' || target || '"}')[1:24] AS edge_id FROM rel""", rel=_REL),
    "g3_dangling_endpoints": with_views("""
WITH r AS (SELECT DISTINCT case_id, source, target, provenance FROM loose),
x AS (SELECT *, 'source' AS side, source AS endpoint FROM r UNION ALL SELECT *, 'target', target FROM r)
SELECT case_id, side, endpoint, source, target, provenance FROM x ANTI JOIN entities e ON e.case_id = x.case_id AND e.entity_id = x.endpoint""", loose=_LOOSE, entities=ENTITIES),
    "g4_aliases": with_views("SELECT case_id, method_id, min(entity_id) AS entity_id, count(*) > 1 AS ambiguous FROM named GROUP BY ALL", named=_NAMED),
    "g5_disambiguation": with_views("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY case_id, method_id ORDER BY file, line, entity_id) > 1 AS later FROM named)
SELECT case_id, entity_id, CASE WHEN later THEN method_id || '@' || file || ':' || line ELSE method_id END AS unique_id, CASE WHEN later THEN 'duplicate ' || method_id END AS diagnostic FROM r""", named=_NAMED),
    "g6_search_document": with_views("""SELECT case_id, entity_id, lower(concat_ws(' ', entity_id, name, '{"content":"' || content || '"}')) AS document FROM entities""", entities=ENTITIES),
    "g7_compact_tables": with_views("""
WITH n AS (SELECT case_id, entity_id, row_number() OVER (ORDER BY case_id, entity_id) AS node_id FROM entities)
SELECT s.node_id AS source_node, r.case_id, t.node_id AS target_node, kind, provenance, source FROM rel r JOIN n s ON s.case_id = r.case_id AND s.entity_id = source JOIN n t ON t.case_id = r.case_id AND t.entity_id = target""", rel=_REL, entities=ENTITIES),
    "g8_containment": with_views("""
WITH p AS (SELECT i.case_id, i.entity_id, o.entity_id AS outer_id, row_number() OVER (PARTITION BY i.case_id, i.entity_id ORDER BY o.end_line - o.line, o.entity_id) AS k
    FROM inner_spans i JOIN outer_spans o ON i.case_id = o.case_id AND i.file = o.file AND o.line <= i.line AND i.end_line <= o.end_line)
SELECT i.case_id, i.entity_id, outer_id FROM inner_spans i LEFT JOIN (SELECT * FROM p WHERE k = 1) p USING (case_id, entity_id)""", inner_spans=_INNER, outer_spans=_OUTER),
    "g9_resolve_ids": with_views("""
WITH a AS (SELECT case_id, entity_id AS asked FROM entities UNION SELECT case_id, method_id FROM entities WHERE kind = 'function' UNION SELECT case_id, name FROM entities),
k AS (SELECT case_id, method_id, min(entity_id) AS e FROM entities WHERE kind = 'function' GROUP BY ALL HAVING count(*) = 1)
SELECT a.case_id, asked, coalesce(d.entity_id, k.e) AS entity_id, CASE WHEN d.entity_id IS NOT NULL THEN 'id' WHEN k.e IS NOT NULL THEN 'alias' ELSE 'unknown' END AS status
FROM a LEFT JOIN entities d ON d.case_id = a.case_id AND d.entity_id = asked LEFT JOIN k ON k.case_id = a.case_id AND k.method_id = asked""", entities=ENTITIES),
    "g10_span_text": """
SELECT source AS case_id, 'doc:' || doc_id AS entity_id, CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND text IS NOT NULL THEN hex(encode(left(text, 40))) END AS text_hex, doc_id % 11 = 0 AS stale FROM documents""",
    "g11_cards": with_views("""
SELECT case_id, entity_id, kind, name, coalesce(method_id, '') AS method_id, file || ':' || line || '-' || end_line AS location, coalesce(operation_kind, '') AS operation_kind,
    CASE WHEN observed THEN 'observed' WHEN NOT observed THEN 'not_observed' ELSE 'unavailable' END AS coverage FROM entities""", entities=ENTITIES),
    "g12_summary": with_views("""
SELECT case_id, count(*) AS entities, count(*) FILTER (kind = 'function') AS functions, 0::BIGINT AS tests, count(DISTINCT file) AS files, coalesce(any_value(r.n), 0) AS relations
FROM entities LEFT JOIN (SELECT case_id, count(*) AS n FROM rel GROUP BY case_id) r USING (case_id) GROUP BY case_id""", rel=_REL, entities=ENTITIES),
    "g13_method_records": with_views("""
SELECT case_id, method_id, string_split(method_id, '#')[1] AS class_name, name, file, line, end_line, 'body of ' || name AS source FROM entities WHERE kind = 'function'
QUALIFY count(*) OVER (PARTITION BY case_id, method_id) = 1""", entities=ENTITIES),
    "g13_test_records": """
SELECT 'o' AS case_id, 'T::m' || o_orderkey AS test_id, CASE WHEN o_custkey % 4 > 0 THEN 'test_method:' || o_custkey END AS source_entity_id, md5(text) AS source, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS failure_text
FROM orders LEFT JOIN documents ON doc_id = o_custkey AND o_custkey % 4 > 0""",
    "g13_record_entities": with_views("""
SELECT case_id, 'func:' || method_id AS entity_id, 'function' AS kind, CASE WHEN line % 20 = 0 THEN name ELSE string_split(method_id, '#')[-1] END AS name, method_id, file, line, end_line, content FROM entities WHERE kind = 'function'
UNION ALL SELECT o_orderkey::VARCHAR, 'report', 'crash_report', 'crash report', NULL, NULL, NULL, NULL, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END FROM orders""", entities=ENTITIES),
    "n1_relation_counts": with_views("SELECT case_id, node, kind, direction, count(*) AS n FROM (SELECT case_id, kind, source AS node, 'out' AS direction FROM rel UNION ALL SELECT case_id, kind, target, 'in' FROM rel) GROUP BY case_id, node, kind, direction", rel=_REL),
    "n2_neighbours": with_views("""
WITH s AS (SELECT case_id, kind, 'out' AS direction, source AS node, target AS neighbour FROM rel UNION ALL SELECT case_id, kind, 'in', target, source FROM rel),
n AS (SELECT s.*, e.name AS neighbour_name, count(*) OVER (PARTITION BY s.case_id, node, direction) AS total FROM s JOIN entities e ON e.case_id = s.case_id AND e.entity_id = neighbour)
SELECT case_id, node, direction, kind, neighbour, neighbour_name, total, count(*) AS edges FROM n GROUP BY ALL""", rel=_REL, entities=ENTITIES),
    "n4_ranked_callers": with_views("""
WITH c AS (SELECT DISTINCT case_id, source AS caller, target FROM calls)
SELECT * FROM (SELECT c.case_id, c.target, caller, row_number() OVER (PARTITION BY c.case_id, c.target ORDER BY o.p_size = 1 DESC, o.owner = coalesce(t.owner, '') DESC, caller)::INT AS position
    FROM c LEFT JOIN own o ON o.entity_id = caller LEFT JOIN own t ON t.entity_id = c.target) WHERE position <= 100""", calls=_CALLS, own=_OWNERS),
    "n5_shortest_paths": with_views(_levels(8, 120).replace("{callers}", _RANKED), calls=_CALLS, own=_OWNERS),
    "n6_executed_paths": with_views(_NEAREST, calls=_CALLS, own=_OWNERS),
    "n7_lineage": with_views("""
WITH RECURSIVE r AS (SELECT DISTINCT case_id, child AS type_id, child AS ancestor, 0 AS depth FROM h UNION SELECT r.case_id, r.type_id, h.parent, depth + 1 FROM r JOIN h ON h.child = r.ancestor WHERE h.parent IS NOT NULL)
SELECT case_id, type_id, ancestor, min(depth) AS depth FROM r GROUP BY ALL""", h=_HIERARCHY),
    "n8_pruned_graph": with_views("""
WITH v AS (SELECT case_id, entity_id AS node FROM own WHERE p_size <= 25)
SELECT v.case_id, v.node, coalesce(string_agg(DISTINCT t.node, ',' ORDER BY t.node), '') AS callees FROM v LEFT JOIN calls c ON c.source = v.node LEFT JOIN v t ON t.node = c.target GROUP BY ALL""", calls=_CALLS, own=_OWNERS),
    "n9_adjacency": with_views("""
SELECT case_id, source AS node, 'out' AS direction, string_agg(DISTINCT target, ',' ORDER BY target) AS others FROM calls GROUP BY ALL
UNION ALL SELECT case_id, target, 'in', string_agg(DISTINCT source, ',' ORDER BY source) FROM calls GROUP BY ALL""", calls=_CALLS),
}
