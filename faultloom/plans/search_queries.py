"""Queries of the search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import code_tokens
from ..operators import search
from .domain import ENTITIES, QUERIES as ASKED, table, view, with_views

_DOCS = "SELECT lang AS case_id, doc_id, text FROM {documents}"
_BENCH = "SELECT case_id, item_id AS query_id, text AS query, 10 AS top_k FROM {benchmark} CROSS JOIN (SELECT DISTINCT lang AS case_id FROM {documents}) AS c"
_TOKENS = r"list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+'), lambda x: lower(x))"


def q3_code_tokens(spark, sf_dir):
    t = code_tokens(F.col("text"))
    return view(spark, sf_dir, _DOCS).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def q4_bm25_index(spark, sf_dir):
    return search.postings(view(spark, sf_dir, _DOCS), code_tokens(F.col("text")))


def q4_bm25_stats(spark, sf_dir):
    out = search.document_lengths(view(spark, sf_dir, _DOCS), code_tokens(F.col("text")))
    return out.groupBy("case_id", "n_docs").agg(F.round(F.first("avg_length"), 6).alias("avg_length"), F.max("length").cast("long").alias("longest"))


def q5_bm25_topk(spark, sf_dir):
    index, lengths = search.bm25_tables(view(spark, sf_dir, _DOCS), code_tokens(F.col("text")))
    return search.bm25_topk(index, lengths, view(spark, sf_dir, _BENCH))


def q1_term_search(spark, sf_dir):
    return search.term_search(view(spark, sf_dir, ENTITIES), view(spark, sf_dir, ASKED))


def q2_prefix_search(spark, sf_dir):
    return search.prefix_search(view(spark, sf_dir, ENTITIES), view(spark, sf_dir, ASKED))



def q6_cursor_page(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_partkey", "l_linenumber", "l_suppkey")
    scope = F.concat(F.lit("order "), F.col("order_id").cast("string"))
    cursor = F.when(F.col("order_id") % 5 == 0, "foreign:2").when(F.col("order_id") % 2 == 0, search.cursor_of(scope, F.lit(2)))
    asks = lines.select("order_id").distinct().select("order_id", scope.alias("scope"), F.lit(2).alias("limit"), cursor.alias("cursor"))
    return search.page(lines, asks, ["order_id"], ["l_partkey", "l_linenumber", "l_suppkey"])


def q6_text_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 3 * 500).cast("int").alias("offset"))
    out = search.text_page(docs, 1000)
    return out.select("doc_id", F.md5("part").alias("part_md5"), F.col("total").cast("long").alias("total"), F.col("next_offset").cast("long").alias("next_offset"))


def q7_greedy_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    out = search.greedy_budget(turns, ["conv_id"], ["turn"], F.length("text").cast("long"), 800)
    return out.withColumn("omitted", F.col("omitted").cast("long"))


QUERIES = {f.__name__: f for f in (q1_term_search, q2_prefix_search, q3_code_tokens, q4_bm25_index, q4_bm25_stats, q5_bm25_topk, q6_cursor_page, q6_text_page, q7_greedy_budget)}

_SEEN = "e AS (SELECT *, lower(concat_ws(' ', entity_id, name, content)) AS doc FROM entities)"
_EXACT = "coalesce(lower(e.entity_id) = lower(trim(query)), false) OR coalesce(lower(name) = lower(trim(query)), false) OR coalesce(lower(method_id) = lower(trim(query)), false)"
SQL = {
    "q3_code_tokens": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)",
    "q4_bm25_index": f"SELECT case_id, term, doc_id, count(*) AS tf FROM (SELECT lang AS case_id, doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL",
    "q4_bm25_stats": f"SELECT lang AS case_id, count(*) AS n_docs, round(avg(len({_TOKENS})), 6) AS avg_length, max(len({_TOKENS}))::BIGINT AS longest FROM documents GROUP BY lang",
    "q5_bm25_topk": f"""
WITH t AS (SELECT lang AS case_id, doc_id, {_TOKENS} AS ts FROM documents),
p AS (SELECT case_id, term, doc_id, count(*) AS tf FROM (SELECT case_id, doc_id, unnest(ts) AS term FROM t) GROUP BY ALL),
df AS (SELECT case_id, term, count(*) AS df FROM p GROUP BY ALL),
st AS (SELECT case_id, count(*) AS n, avg(len(ts)) AS av FROM t GROUP BY case_id),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
s AS (SELECT p.case_id, query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / av))), 6) AS score
    FROM p JOIN q USING (term) JOIN df USING (case_id, term) JOIN st USING (case_id) JOIN t ON t.case_id = p.case_id AND t.doc_id = p.doc_id GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY case_id, query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY case_id, query_id ORDER BY score DESC, doc_id) <= 10""",
    "q1_term_search": with_views(f"""
WITH {_SEEN}, t AS (SELECT DISTINCT case_id, query_id, query, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS term FROM asked),
m AS (SELECT e.case_id, query_id, e.entity_id, {_EXACT} AS exact, coalesce(observed, false) AS seen, term FROM e JOIN t ON e.case_id = t.case_id AND contains(doc, term)),
g AS (SELECT case_id, query_id, entity_id, exact, seen, count(*)::INT AS matched, string_agg(term, ' ' ORDER BY term) AS terms FROM m GROUP BY ALL)
SELECT case_id, query_id, entity_id, exact, matched, terms, row_number() OVER (PARTITION BY case_id, query_id ORDER BY exact DESC, matched DESC, seen DESC, entity_id)::INT AS rank FROM g""", entities=ENTITIES, asked=ASKED),
    "q2_prefix_search": with_views(f"""
WITH {_SEEN}, tok AS (SELECT case_id, entity_id, regexp_extract_all(doc, '[a-z0-9_]+') AS ts FROM e),
p AS (SELECT case_id, entity_id, unnest(ts) AS term FROM tok), st AS (SELECT case_id, count(*) AS n, avg(len(ts)) AS av FROM tok GROUP BY case_id),
t AS (SELECT DISTINCT case_id, query_id, query, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS prefix FROM asked),
h AS (SELECT p.case_id, prefix, entity_id, count(*) AS tf FROM p JOIN (SELECT DISTINCT case_id, prefix FROM t) x ON p.case_id = x.case_id AND starts_with(term, prefix) GROUP BY ALL),
d AS (SELECT case_id, prefix, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT h.case_id, query_id, query, h.entity_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / av))), 6) AS score
    FROM h JOIN t USING (case_id, prefix) JOIN d USING (case_id, prefix) JOIN st USING (case_id) JOIN tok ON tok.entity_id = h.entity_id AND tok.case_id = h.case_id GROUP BY ALL),
r AS (SELECT s.case_id, query_id, e.entity_id, {_EXACT} AS exact, score, coalesce(observed, false) AS seen FROM s JOIN e ON e.entity_id = s.entity_id AND e.case_id = s.case_id)
SELECT case_id, query_id, entity_id, exact, score, row_number() OVER (PARTITION BY case_id, query_id ORDER BY exact DESC, score DESC, seen DESC, entity_id)::INT AS rank FROM r""", entities=ENTITIES, asked=ASKED),
    "q6_cursor_page": """
WITH l AS (SELECT l_orderkey AS order_id, l_partkey, l_linenumber, l_suppkey, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY l_orderkey) AS total
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey)),
r AS (SELECT *, CASE WHEN order_id % 2 = 0 THEN 2 ELSE 0 END AS off FROM l WHERE order_id % 5 <> 0)
SELECT order_id, l_partkey, l_linenumber, l_suppkey, position::INT AS position, total,
    CASE WHEN off + 2 < total THEN substr(sha256('order ' || order_id), 1, 12) || ':' || (off + 2) END AS next_cursor FROM r WHERE position >= off AND position < off + 2""",
    "q6_text_page": """
SELECT doc_id, md5(substr(text, (doc_id % 3 * 500 + 1)::INT, 1000)) AS part_md5, len(text)::BIGINT AS total,
    CASE WHEN doc_id % 3 * 500 + 1000 < len(text) THEN doc_id % 3 * 500 + 1000 END AS next_offset FROM documents""",
    "q7_greedy_budget": """
WITH RECURSIVE r AS (SELECT conv_id, len(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
f AS (SELECT conv_id, p, total, CASE WHEN n <= 800 THEN n ELSE 0 END AS used, CASE WHEN n <= 800 THEN [p] ELSE [] END AS kept FROM r WHERE p = 1
    UNION ALL SELECT f.conv_id, r.p, f.total, CASE WHEN used + n <= 800 THEN used + n ELSE used END, CASE WHEN used + n <= 800 THEN list_append(kept, r.p) ELSE kept END
    FROM f JOIN r ON r.conv_id = f.conv_id AND r.p = f.p + 1)
SELECT conv_id, array_to_string(kept, ',') AS kept, used::BIGINT AS used, (total - len(kept))::BIGINT AS omitted FROM f WHERE p = total""",
}
