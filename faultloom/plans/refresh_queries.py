"""The query of the whole refresh: parts are entities, their types files, and a third of the files changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import refresh
from ..operators.lineage import shared_folder
from .domain import view, with_views

_BEFORE = """
SELECT p_brand AS case_id, 'n' || cast(p_partkey AS string) AS entity_id, CASE WHEN p_size % 4 = 0 THEN 'field' ELSE 'function' END AS kind, p_name AS name, p_brand || '.m#' || cast(p_partkey AS string) AS method_id, p_type AS file,
    p_type || ' size_' || cast(p_size AS string) AS content, length(p_type) % 3 = 0 AS touched, p_partkey AS k FROM {part}"""
#: In changed files each ninth entity has another id, each seventh is gone, each fifth another text, and each eleventh another method id.
_AFTER = f"""
SELECT case_id, entity_id || CASE WHEN touched AND k % 9 = 0 THEN 'x' ELSE '' END AS entity_id, kind, name, method_id || CASE WHEN touched AND k % 11 = 0 THEN 'v2' ELSE '' END AS method_id, file, content || CASE WHEN touched AND k % 5 = 0 THEN ' changed Text' ELSE '' END AS content, touched, k, entity_id AS was
FROM ({_BEFORE}) AS before WHERE NOT (touched AND k % 7 = 0)"""
#: What the lines say: a part relates to the part before it of its brand.
_EDGES = """
SELECT DISTINCT case_id, 'n' || cast(k AS string) AS source, l_returnflag AS kind, 'n' || cast(prior AS string) AS target, l_linestatus AS provenance, touched, k FROM {lineitem}
JOIN (SELECT p_brand AS case_id, p_partkey AS k, lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prior, length(p_type) % 3 = 0 AS touched FROM {part}) AS p ON l_partkey = k WHERE prior IS NOT NULL"""
#: The changed files' relations: out of entities that are left, those of odd keys no more of one kind, into what their targets are now.
_NEW_EDGES = f"""
SELECT a.case_id, a.entity_id AS source, e.kind, coalesce(t.entity_id, e.target) AS target, e.provenance FROM ({_EDGES}) AS e JOIN ({_AFTER}) AS a ON a.case_id = e.case_id AND a.was = e.source LEFT JOIN ({_AFTER}) AS t ON t.case_id = e.case_id AND t.was = e.target
WHERE e.touched AND NOT (a.k % 2 = 1 AND e.kind = 'R')"""
_ROWS = {"before": _BEFORE, "after": _AFTER, "edges": _EDGES, "new_edges": _NEW_EDGES}


def _fragment(spark, sf_dir, entities, relations, version):
    own = view(spark, sf_dir, _ROWS[entities])
    own = own.where("touched") if version == "v2" else own
    # A file's digest and declarations come from its entities; a message stands for each file with a field.
    files = own.groupBy("case_id", F.col("file").alias("path")).agg(F.concat(F.lit(version), F.lit(":"), F.count("*").cast("string")).alias("sha256"))
    catalog = own.where("kind = 'function'").select("case_id", "file", F.lit("method").alias("record"), "name", F.col("entity_id").alias("owner"))
    messages = own.where("kind = 'field'").select("case_id", "file", F.concat(F.lit(version), F.lit(" field in "), "file").alias("message")).distinct()
    return refresh.Fragment(files, own.select("case_id", "entity_id", "kind", "name", "method_id", "file", "content"), view(spark, sf_dir, _ROWS[relations]).select("case_id", "source", "kind", "target", "provenance"), catalog, messages)


def i1_refresh_tables(spark, sf_dir):
    """All tables after a refresh of the stored index, as (case_id, part, key, node, value)."""
    first, _ = refresh.build(_fragment(spark, sf_dir, "before", "edges", "v1"))
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    refresh.store(first, folder, 16)
    stored = refresh.load(spark, folder, first)
    touched = view(spark, sf_dir, _BEFORE).where("touched").select("case_id", "file").distinct()
    made, _ = refresh.changes(stored, touched, _fragment(spark, sf_dir, "after", "new_edges", "v2"))
    refresh.apply(folder, made, 16)
    now = refresh.load(spark, folder, first)
    row = lambda rows, part, key, node, value: rows.select("case_id", F.lit(part).alias("part"), key.alias("key"), node.cast("long").alias("node"), value.alias("value"))
    c, none = F.col, F.lit(None)
    parts = [
        row(now.files, "file", c("path"), none, c("sha256")), row(now.entities, "entity", c("entity_id"), c("node_id"), F.concat_ws("|", "kind", "name", "method_id", "file", "content")), row(now.aliases, "alias", c("method_id"), none, c("entity_id")),
        row(now.documents, "document", F.lit(""), c("node_id"), c("document")), row(now.postings, "posting", c("term"), c("node_id"), c("tf").cast("string")),
        row(now.relations, "relation", F.concat_ws("|", "kind", "provenance"), c("source_node"), c("target_node").cast("string")),
        row(now.catalog, "catalog", c("file"), none, F.concat_ws("|", "record", "name", "owner")), row(now.diagnostics, "diagnostic", c("file"), none, c("message")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


QUERIES = {"i1_refresh_tables": i1_refresh_tables}
SQL = {
    "i1_refresh_tables": with_views("""
WITH old AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY entity_id) AS node_id FROM before),
v2 AS (SELECT a.case_id, a.entity_id, a.kind, a.name, a.method_id, a.file, a.content, a.touched, o.node_id FROM after a LEFT JOIN old o ON o.case_id = a.case_id AND o.entity_id = a.entity_id),
now AS (SELECT * EXCLUDE (node_id), coalesce(node_id, (SELECT max(node_id) FROM old WHERE old.case_id = v2.case_id) + row_number() OVER (PARTITION BY case_id, node_id IS NULL ORDER BY entity_id)) AS node_id FROM v2),
edge AS (SELECT case_id, source, kind, target, provenance FROM edges WHERE NOT touched UNION SELECT case_id, source, kind, target, provenance FROM new_edges),
doc AS (SELECT case_id, node_id, lower(concat_ws(' ', entity_id, name, content)) AS document FROM now)
SELECT case_id, 'file' AS part, file AS key, NULL::BIGINT AS node, CASE WHEN any_value(touched) THEN 'v2:' ELSE 'v1:' END || count(*) AS value FROM now GROUP BY case_id, file
UNION ALL SELECT case_id, 'entity', entity_id, node_id, concat_ws('|', kind, name, method_id, file, content) FROM now
UNION ALL SELECT case_id, 'alias', method_id, NULL, entity_id FROM now WHERE kind = 'function'
UNION ALL SELECT case_id, 'document', '', node_id, document FROM doc
UNION ALL SELECT case_id, 'posting', term, node_id, count(*)::VARCHAR FROM (SELECT case_id, node_id, unnest(regexp_extract_all(document, '[a-z0-9_]+')) AS term FROM doc) GROUP BY ALL
UNION ALL SELECT e.case_id, 'relation', concat_ws('|', e.kind, e.provenance), s.node_id, t.node_id::VARCHAR FROM edge e JOIN now s ON s.case_id = e.case_id AND s.entity_id = e.source JOIN now t ON t.case_id = e.case_id AND t.entity_id = e.target
UNION ALL SELECT case_id, 'catalog', file, NULL, concat_ws('|', 'method', name, entity_id) FROM now WHERE kind = 'function'
UNION ALL SELECT DISTINCT case_id, 'diagnostic', file, NULL, CASE WHEN touched THEN 'v2' ELSE 'v1' END || ' field in ' || file FROM now WHERE kind = 'field'""", before=_BEFORE, after=_AFTER, edges=_EDGES, new_edges=_NEW_EDGES),
}
