"""Substring and prefix joins against plain Python."""

import random

import pytest

from faultloom.operators import containment


def strings(dice, n, longest):
    return ["".join(dice.choices("ab_1é😀", k=dice.randint(0, longest))) for _ in range(n)] + [None, "", "aaaa", "a"]


@pytest.mark.parametrize("by", [[], ["case_id"]])
def test_pairs_equal_plain_search(spark, by):
    dice = random.Random(len(by))
    texts, terms = [(dice.choice("xy"), t) for t in strings(dice, 300, 9)], [(dice.choice("xy"), t) for t in strings(dice, 60, 5)]
    a, b = spark.createDataFrame(texts, "case_id string, text string"), spark.createDataFrame(terms, "case_id string, term string")
    same = lambda c, d: not by or c == d
    key = lambda r, *names: (*(r[c] for c in by), *(r[n] for n in names))
    want = {(*([c] if by else []), t, q) for c, t in texts for d, q in terms if same(c, d) and t and q and q in t}
    got = [key(r, "text", "term") for r in containment.substring_pairs(a, b, by).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    want = {(*([c] if by else []), t, q) for c, t in texts for d, q in terms if same(c, d) and t and q and t.startswith(q)}
    got = [key(r, "text", "prefix") for r in containment.prefix_pairs(a, b.withColumnRenamed("term", "prefix"), by).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_plans_have_no_loops_over_pairs(spark, capsys):
    a, b = spark.createDataFrame([("x", "abcd")], "case_id string, text string"), spark.createDataFrame([("x", "bc")], "case_id string, term string")
    containment.substring_pairs(a, b, []).explain()
    containment.prefix_pairs(a, b.withColumnRenamed("term", "prefix"), []).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan
    assert containment.substring_pairs(a, b.where("1 = 0"), []).count() == 0 == containment.prefix_pairs(a.where("1 = 0"), b.withColumnRenamed("term", "prefix"), []).count()
