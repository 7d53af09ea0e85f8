"""Connected components and the tables that their rounds leave."""

import os
import random

from faultloom.llm import common, ngram_join
from faultloom.llm.common import checkpointed, components, shared_folder


def union(edges):
    head = {}

    def top(v):
        while head.setdefault(v, v) != v:
            v = head[v]
        return v

    for a, b in edges:
        if a != b:
            lo, hi = sorted((top(a), top(b)))
            head[hi] = lo
    return {v: top(v) for v in head}


def tables(spark):
    return {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("table-")}


def test_components_equal_union_find_and_leave_one_table(spark):
    r = random.Random(1)
    path = r.sample(range(500, 600), 60)
    for edges in (
        [],
        [(7, 7)],
        [(1, i) for i in range(2, 50)] + [(99, i) for i in range(60, 99)],
        list(zip(path, path[1:], strict=False)) + [(i, i - 1) for i in range(1, 40)],
        [(r.randrange(80), r.randrange(80)) for _ in range(60)] * 2 + [(i + 1000, i) for i in range(20)],
    ):
        before = tables(spark)
        got = [tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()]
        assert len(got) == len(dict(got)) and dict(got) == union(edges)
        # Tables of the rounds before are gone; the answer's stays.
        assert len(tables(spark) - before) == 1


def test_stars_take_no_round_to_find_that_nothing_changes(spark):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("stars"))
    spark.sparkContext.setJobGroup("stars", "")
    try:
        components(spark.createDataFrame([(i, 1) for i in range(2, 30)], "a long, b long"))
        assert jobs() <= 8
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_round_has_one_shuffle_and_short_lists_none(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(old, ("37", "false"), strict=True):
        spark.conf.set(k, v)
    tracker = spark.sparkContext.statusTracker()

    def dealt(group, run):
        """What run() returns, and how many stages had a task for each shuffle partition."""
        spark.sparkContext.setJobGroup(group, "")
        out = run()
        ids = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        return out, sum(i.numTasks == 37 and i.numCompletedTasks > 0 for s in ids if (i := tracker.getStageInfo(s)))

    try:
        # Trees of several levels, and an edge between leaves of two of them.
        edges = [(i, i // 2) for i in range(2, 64)] + [(i, (i - 1) // 2 + 500) for i in range(1000, 1040)] + [(1039, 63)]
        got, stages = dealt("rounds", lambda: components(spark.createDataFrame(edges, "a long, b long").coalesce(1)))
        assert dict(tuple(x) for x in got.collect()) == union(edges)
        assert 1 <= stages <= 3
        sets = checkpointed(spark.createDataFrame([(i, 10 * i) for i in range(50)], "name long, size long").coalesce(1))
        pairs = checkpointed(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (7, 60)], "a long, b long").coalesce(1))
        some, stages = dealt("some", lambda: ngram_join._some(sets, pairs))
        assert sorted((r.name, r["size"]) for r in some.collect()) == [(1, 10), (2, 20), (3, 30), (7, 70)] and not stages
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)


def test_what_is_too_long_to_broadcast_meets_in_shuffles(spark, monkeypatch):
    monkeypatch.setattr(common, "SENT", 0)
    monkeypatch.setattr(ngram_join, "SENT", 0)
    edges = [(i, i - 1) for i in range(1, 30)] + [(90 - i, 60 + i // 2) for i in range(15)]
    assert dict(tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()) == union(edges)
    sets = spark.createDataFrame([(i, 10 * i) for i in range(50)], "name long, size long")
    some = ngram_join._some(sets, spark.createDataFrame([(1, 2), (1, 3), (7, 60)], "a long, b long"))
    assert sorted((r.name, r["size"]) for r in some.collect()) == [(1, 10), (2, 20), (3, 30), (7, 70)]
