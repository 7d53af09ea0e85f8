"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from faultloom.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    rows = [(d, Counter(t := plain_terms(text)), len(t)) for d, text in docs]
    rows = [r for r in rows if r[2]]
    total, length, df = len(rows), sum(r[2] for r in rows), Counter(t for r in rows for t in r[1])
    out = []
    for item, text in items:
        scored = []
        for d, held, n in rows:
            m, score = 100 - 75 + 75 * n * total // length, 0
            for t in plain_terms(text):
                if held[t]:
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * held[t] // (1000 * held[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def words(dice, n):
    return " ".join(dice.choice(["Alpha", "beta,", "gamma", "é", "漢字.", "X1", "und", "der", "a_b", f"w{min(int(dice.expovariate(0.05)), 90)}"]) for _ in range(n))


@pytest.mark.parametrize("shard, block", [(10**6, 10**6), (300, 10**6), (10**6, 40)])
def test_equals_plain_scoring(spark, shard, block):
    dice = random.Random(shard + block)
    docs = [(i, words(dice, dice.randint(0, 60))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(5, docs[5][1]), (None, docs[9][1]), (None, None), (400, ""), (401, "... !"), (402, "gamma " * 20_000)]
    items = [(i, words(dice, dice.randint(0, 25))) for i in range(12)] + [(3, docs[7][1]), (50, None), (51, "absent"), (None, docs[9][1] + " beta beta")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    d, q = d.selectExpr("*", "1 AS n", "'x' AS terms", "2 AS score", "3 AS item"), q.selectExpr("*", "1 AS item", "2 AS rank")
    got = sorted((tuple(r) for r in rs.search(d, q, block_terms=block, shard_postings=shard).collect()), key=repr)
    assert got == brute(docs, items)
    assert rs.search(d.where("1 = 0"), q).count() == 0 and rs.search(d, q.where("1 = 0")).count() == 0


def test_reading_stops_before_the_ends_of_lists():
    """Two terms; one short document holds both, so the long list's tail is not needed for the best one."""
    n = 50_000
    doc, term = np.concatenate([np.arange(n), [7]]), np.concatenate([np.zeros(n, int), [1]])
    count = np.ones(n + 1, np.int64)
    size = np.full(n, 10_000)
    count[7], size[7] = 50, 10
    shard = rs.Shard(np.arange(n), size, doc, term, count, rs.Statistics(n, 10 * n, np.array([100, 5000])))
    read = []

    class Seen(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append((key.stop or 0) - (key.start or 0))
            return super().__getitem__(key)

    lists = shard.lists({0: 1, 1: 1})
    shard.lists = lambda asked: [(d.view(Seen), g) for d, g in lists]
    ids, scores = shard.best({0: 1, 1: 1}, 1)
    assert ids.tolist() == [7] and scores[0] == sum(int(g[list(d).index(7)]) for d, g in lists) and sum(read) < n / 10


def test_many_ties_all_stay(spark):
    docs = [(i, "same words here") for i in range(500, 0, -1)]
    got = rs.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "same other")], "item_id long, text string"), k=10)
    assert [r.doc_id for r in got.orderBy("rank").collect()] in ([], list(range(1, 11)))


def test_products_beyond_64_bits():
    of = rs.Statistics(10**12, 10**15, np.array([1]))
    assert of.ratios(np.array([10**9]), np.array([3]))[0] == 3_000_000_000 // (3000 + 8 * (25 + 75 * 10**9 * 10**12 // 10**15))
