"""Keeping tables current, and batch bookkeeping."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(case_id, path, change) of files (case_id, path, sha256): added, deleted, changed or unchanged."""
    o = old.select("case_id", "path", F.col("sha256").alias("old_sha"))
    n = new.select("case_id", "path", F.col("sha256").alias("new_sha"))
    change = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "deleted").when(F.col("old_sha") != F.col("new_sha"), "changed").otherwise("unchanged")
    return o.join(n, ["case_id", "path"], "full").select("case_id", "path", change.alias("change"))


def accepted_changes(changes: DataFrame, parse_errors: DataFrame) -> DataFrame:
    """Changed files to refresh; one that no longer parses keeps its old version, and one that the baseline lacks is refused."""
    bad = parse_errors.select("case_id", "path", F.lit(True).alias("bad"))
    held = changes.where("change <> 'unchanged'").join(bad, ["case_id", "path"], "left")
    status = F.when(F.col("change") == "added", "not in baseline").when(F.col("bad"), "kept old").otherwise("refresh")
    return held.select("case_id", "path", "change", status.alias("status"))


def refresh(nodes: DataFrame, edges: DataFrame, touched: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (case_id, entity_id, file, node_id) and edges (case_id, source, kind, target) after the touched files' rows are replaced.

    Surviving ids keep their node ids, others get ids above the case's largest. Edges out of touched nodes are rebuilt; edges into nodes that
    vanished go, all others into survivors stay. Only touched files' rows and their edges are joined.
    """
    gone = nodes.join(touched.select("case_id", "file"), ["case_id", "file"], "left_semi")
    kept = nodes.join(touched.select("case_id", "file"), ["case_id", "file"], "left_anti")
    top = nodes.groupBy("case_id").agg(F.max("node_id").alias("top"))
    matched = new_nodes.select("case_id", "entity_id", "file").join(gone.select("case_id", "entity_id", "node_id"), ["case_id", "entity_id"], "left")
    fresh = numbered(matched.where("node_id IS NULL"), ["case_id"], ["entity_id"], "rank").join(top, "case_id", "left")
    fresh = fresh.select("case_id", "entity_id", "file", (F.coalesce("top", F.lit(0)) + F.col("rank")).alias("node_id"))
    after = kept.select("case_id", "entity_id", "file", "node_id").unionByName(matched.where("node_id IS NOT NULL")).unionByName(fresh)
    lost = gone.select("case_id", "entity_id").join(new_nodes.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_anti")
    staying = edges.join(gone.select("case_id", F.col("entity_id").alias("source")), ["case_id", "source"], "left_anti").join(lost.select("case_id", F.col("entity_id").alias("target")), ["case_id", "target"], "left_anti")
    return after, staying.select("case_id", "source", "kind", "target").unionByName(new_edges.select("case_id", "source", "kind", "target")).distinct()


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(case_id, path, diff): unified diffs of the paths whose texts (case_id, path, text) differ, a missing side being empty.

    Digests find the changed paths before any text moves.
    """

    @F.pandas_udf("string")
    def unified(path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        whole = lambda x: x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n"
        return pd.Series(["".join(map(whole, difflib.unified_diff(b.splitlines(True), a.splitlines(True), f"a/{p}", f"b/{p}"))) for p, b, a in zip(path, before, after, strict=True)], dtype=object)

    digest = lambda df: df.select("case_id", "path", F.sha2("text", 256).alias("sha256"))
    changed = changed_files(digest(old), digest(new)).where("change <> 'unchanged'").select("case_id", "path")
    held = changed.join(old.select("case_id", "path", F.col("text").alias("before")), ["case_id", "path"], "left").join(new.select("case_id", "path", F.col("text").alias("after")), ["case_id", "path"], "left")
    return held.select("case_id", "path", unified("path", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))).alias("diff"))


def round_robin(bugs: DataFrame, done: DataFrame) -> DataFrame:
    """(project, bug_id, position): the i-th open bug of every project in project order, then the next ones.

    bugs: (project, project_pos, bug_id); invalid ids and finished bugs are left out. Both the turn within a project and the place in the queue are numbered in ranges.
    """
    valid = bugs.where(F.col("bug_id").rlike("^[0-9]+$")).join(done, ["project", "bug_id"], "left_anti").withColumn("id", F.col("bug_id").cast("long"))
    held = numbered(valid, ["project"], ["id"], "place").withColumn("turn", (F.col("place") - 1).cast("int"))
    return numbered(held, [], ["turn", "project_pos", "project"], "position").select("project", "bug_id", "turn", "position")


def tally(queue: DataFrame, results: DataFrame) -> DataFrame:
    """(project, ok, skip, fail) of return codes: 0 ok, 2 skip, all else and none fail."""
    held = queue.join(results, ["project", "bug_id"], "left")
    ok, skip = F.coalesce(F.col("rc") == "0", F.lit(False)), F.coalesce(F.col("rc") == "2", F.lit(False))
    return held.groupBy("project").agg(F.count_if(ok).alias("ok"), F.count_if(skip).alias("skip"), F.count_if(~ok & ~skip).alias("fail"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """(case_id, agent, requests, input_tokens, output_tokens, total_tokens) with subtotals by rollup; null usage is a request only."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    out = usage.rollup("case_id", "agent").agg(F.count("*").alias("requests"), n("input_tokens").alias("input_tokens"), n("output_tokens").alias("output_tokens"))
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
