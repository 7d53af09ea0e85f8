"""Lineage and call paths against plain queues, and long chains."""

import random
from collections import deque

from faultloom.operators import graph

CALLERS = "case_id string, target string, caller string, position int"
IDS = "case_id string, entity_id string"


def world(dice, n, edges):
    incoming = {}
    for _ in range(edges):
        a, b = f"n{dice.randrange(n)}", f"n{dice.randrange(n)}"
        if a not in incoming.setdefault(b, []):
            incoming[b].append(a)
    rows = [("c", t, c, i + 1) for t, cs in incoming.items() for i, c in enumerate(cs)]
    return incoming, rows, {f"n{dice.randrange(n)}" for _ in range(2)}


def queue_path(incoming, target, anchors, depth=None, budget=None):
    pending, seen, visited = deque([(target, [target])]), {target}, 0
    while pending and (budget is None or visited < budget):
        node, path = pending.popleft()
        visited += 1
        if node in anchors:
            return path
        if depth is not None and len(path) > depth:
            continue
        for c in incoming.get(node, []):
            if c not in seen:
                seen.add(c)
                pending.append((c, [c, *path]))
    return None


def test_paths_equal_the_queue(spark):
    dice = random.Random(8)
    n = 60
    incoming, rows, anchors = world(dice, n, 130)
    nodes = [("c", f"n{i}") for i in range(n)]
    callers, targets = spark.createDataFrame(rows, CALLERS), spark.createDataFrame(nodes, IDS)
    at = spark.createDataFrame([("c", a) for a in anchors], IDS)
    got = {r.target: list(r.path) for r in graph.nearest_anchor_path(callers, targets, at).collect()}
    assert got == {t: p for _, t in nodes if (p := queue_path(incoming, t, anchors))} and max(map(len, got.values())) > 6
    for depth, budget in ((8, 12), (3, 120), (8, 1)):
        got = {r.target: list(r.path) for r in graph.shortest_path(callers, targets, at, depth, budget).collect()}
        assert got == {t: p for _, t in nodes if (p := queue_path(incoming, t, anchors, depth, budget))}


def test_long_chains_are_whole(spark):
    n = 1000
    inherits = spark.createDataFrame([("c", f"t{i}", f"t{i + 1}") for i in range(n)], "case_id string, child string, parent string")
    got = graph.lineage(spark.createDataFrame([("c", "t0"), ("c", f"t{n - 5}")], "case_id string, type_id string"), inherits).collect()
    assert sorted((r.type_id, r.depth) for r in got) == sorted([("t0", d) for d in range(n + 1)] + [(f"t{n - 5}", d) for d in range(6)])
    assert all(r.ancestor == f"t{int(r.type_id[1:]) + r.depth}" for r in got)
    calls = spark.createDataFrame([("c", f"t{i}", f"t{i + 1}", 1) for i in range(300)] + [("c", "t300", "t0", 1)], CALLERS)
    found = graph.nearest_anchor_path(calls, spark.createDataFrame([("c", "t0"), ("c", "t250"), ("c", "alone")], IDS), spark.createDataFrame([("c", "t249")], IDS)).collect()
    assert {r.target: list(r.path) for r in found} == {"t0": [f"t{i}" for i in range(249, -1, -1)], "t250": [f"t{i}" for i in [*range(249, -1, -1), *range(300, 249, -1)]]}


def test_lineage_on_random_hierarchies(spark):
    dice = random.Random(2)
    edges = {(f"a{dice.randrange(40)}", f"a{dice.randrange(40)}") for _ in range(70)}
    inherits = spark.createDataFrame([("c", *e) for e in edges], "case_id string, child string, parent string")
    want = set()
    for t in (f"a{i}" for i in range(40)):
        depth, front = {t: 0}, [t]
        while front:
            front = [p for c in front for a, p in sorted(edges) if a == c and p not in depth and not depth.update({p: depth[c] + 1})]
        want |= {(t, a, d) for a, d in depth.items()}
    got = graph.lineage(spark.createDataFrame([("c", f"a{i}") for i in range(40)], "case_id string, type_id string"), inherits).collect()
    assert {(r.type_id, r.ancestor, r.depth) for r in got} == want
