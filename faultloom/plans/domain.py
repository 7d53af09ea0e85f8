"""Domain tables derived from the driver's tables, in SQL that Spark and DuckDB both run, and helpers to register queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A domain table; {name} stands for a table of the driver."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def with_views(sql: str, **views: str) -> str:
    """An oracle's SQL, with domain tables as common table expressions before it."""
    head = ", ".join(f"{name} AS ({duck(v)})" for name, v in views.items())
    body = duck(sql).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"


#: Parts as functions, suppliers as types and customers as fields; a case is a brand or a nation.
ENTITIES = """
SELECT p_brand AS case_id, 'part:' || cast(p_partkey AS string) AS entity_id, 'function' AS kind, p_name AS name,
    p_brand || '.' || replace(p_name, ' ', '_') || '#' || cast(p_partkey AS string) AS method_id, p_type AS operation_kind, p_size % 3 = 0 AS observed,
    p_brand || '/' || p_type || '.java' AS file, p_size * 10 AS line, p_size * 10 + 8 AS end_line, 'type ' || lower(p_type) || ' size_' || cast(p_size AS string) AS content FROM {part}
UNION ALL SELECT 'Brand#' || cast(s_nationkey + 1 AS string), 'supplier:' || cast(s_suppkey AS string), 'type_definition', s_name, NULL, NULL, s_acctbal > 0,
    'n' || cast(s_nationkey AS string) || '.java', 1, 400, 'supplies parts' FROM {supplier}
UNION ALL SELECT 'Brand#' || cast(c_nationkey + 1 AS string), 'customer:' || cast(c_custkey AS string), 'field', c_name, NULL, NULL, NULL,
    'n' || cast(c_nationkey AS string) || '.java', 5, 5, lower(c_mktsegment) FROM {customer}"""

#: Order lines as relations from a supplier's type to a part's function of the part's case, with the ship mode as provenance.
RELATIONS = """
SELECT p_brand AS case_id, 'part:' || cast(l_partkey AS string) AS source, CASE WHEN l_returnflag = 'R' THEN 'calls_candidate' ELSE 'covers' END AS kind,
    'part:' || cast(p_partkey - p_partkey % 7 AS string) AS target, l_linestatus AS provenance FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

#: Each name is asked in each case that has it.
QUERIES = """
SELECT DISTINCT p_brand AS case_id, p_name AS query_id, p_name AS query FROM {part}"""
