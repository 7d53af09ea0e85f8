"""Operators on tables with very common names and crowded files: right rows, and no step that makes a row for each pair."""

import random
import re

import pytest

from faultloom.operators import graph, kernel, reports, seeding, symbols
from faultloom.operators import lineage as lineage_tables


def most_rows(spark, run, metric="number of output rows"):
    """The rows that a query gives, and the most that any step of it or of its tables makes, or has of another metric."""
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsCount()
    rows = [tuple(r) for r in run().collect()]
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    most = 0
    for i in range(done, store.executionsCount()):
        at = store.executionsList().apply(i).executionId()
        known, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for k in range(nodes.size()):
            metrics = nodes.apply(k).metrics()
            for m in range(metrics.size()):
                value = known.get(metrics.apply(m).accumulatorId())
                if metrics.apply(m).name() == metric and value.isDefined():
                    most = max(most, int(re.sub(r"\D", "", value.get()) or 0))
    return rows, most


def no_join_conditions(capsys, df):
    df.explain("formatted")
    conditions = set(re.findall(r"Join condition: (.*)", capsys.readouterr().out))
    assert conditions == {"None"}


def test_java_frames_meet_the_best_candidates(spark):
    dice = random.Random(1)
    frames = [("c", f"r{i}", 0, "p.C", "m", "C.java", dice.choice([None, dice.randint(0, 60)])) for i in range(900)]
    catalog = [("c", f"p.C#m({'I' * dice.randint(1, 9)})V{i}", "p.C", "m", a, a + dice.randint(0, 20)) for i in range(900) for a in [dice.randint(0, 50)]]
    df = spark.createDataFrame(frames, "case_id string, report_id string, pos int, class_name string, method string, file string, line int")
    of = spark.createDataFrame(catalog, "case_id string, method_id string, class_name string, method string, start_line int, end_line int")
    got, most = most_rows(spark, lambda: reports.attribute_java(df, of))
    inside = lambda line: [(b - a, i) for _, i, _, _, a, b in catalog if line is not None and a <= line <= b]
    plain = max((len(i), i) for _, i, *_ in catalog)[1]
    assert {(r, m) for _, r, _, m in got} == {(r, min(inside(line))[1] if inside(line) else plain) for _, r, *_, line in frames}
    assert len(got) == 900 and most < 20_000


def test_kernel_frames_meet_the_lowest_candidates(spark):
    dice = random.Random(2)
    frames = [("c", f"r{i}", k, dice.choice(["f", "g", "h"]), dice.choice([None, "a.c", "b.c"])) for i in range(500) for k in range(2)]
    functions = [("c", f"{i:03}", dice.choice("ff"), dice.choice(["b.c", "z.c"])) for i in range(800)] + [("c", "900", "g", None)]
    df = spark.createDataFrame(frames, "case_id string, report_id string, pos int, function string, file string")
    of = spark.createDataFrame(functions, "case_id string, method_id string, name string, file string")
    got, most = most_rows(spark, lambda: reports.attribute_kernel(df, of))
    want = {}
    for _, r, pos, name, file in frames:
        fits = [(pos, file is None or at != file, m) for _, m, n, at in functions if n == name]
        want[r] = min([*([want[r]] if r in want else []), *fits], default=None) or want.get(r)
        if want[r] is None:
            del want[r]
    assert {r: m for _, r, m in got} == {r: w[2] for r, w in want.items()} and len(got) == len(want)
    assert most < 10_000


@pytest.mark.parametrize("low", [0, -40])
def test_lines_meet_blocks_of_functions(spark, low):
    dice = random.Random(3)
    functions = [("c", f"f{i}", "x.c", a, a + dice.choice([-1, 0, 1, 3, 70])) for i in range(700) for a in [dice.randint(low, 3000)]]
    functions += [("c", f"g{i}", "y.c", 5, 9) for i in range(900)]
    operations = [("c", f"o{i}", dice.choice(["x.c", "x.c", "z.c"]), dice.randint(low, 3100)) for i in range(700)] + [("c", f"p{i}", "y.c", 7) for i in range(900)]
    of = spark.createDataFrame(functions, "case_id string, method_id string, file string, start_line int, end_line int")
    df = spark.createDataFrame(operations, "case_id string, operation_id string, file string, line int")
    got, most = most_rows(spark, lambda: kernel.containing_function(df, of))
    want = []
    for c, o, file, line in operations:
        held = [m for _, m, f, a, b in functions if f == file and a <= line <= b]
        want.append((c, o, file, line, len(held), held[0] if len(held) == 1 else None))
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(w[5] for w in want)
    assert most < 30_000


def test_operation_pairs_in_a_crowded_file(spark):
    of = spark.createDataFrame([("c", f"g{i}", "y.c", 5, 9) for i in range(900)] + [("c", "one", "x.c", 1, 90)], "case_id string, method_id string, file string, start_line int, end_line int")
    df = spark.createDataFrame([("c", f"p{i}", "y.c", 7) for i in range(900)] + [("c", f"q{i}", "x.c", i) for i in range(1, 4)], "case_id string, operation_id string, file string, line int")
    pairs = df.selectExpr("case_id", "file AS from_file", "line AS from_line", "file AS to_file", "line + 1 AS to_line")
    got, most = most_rows(spark, lambda: kernel.operation_pairs(pairs, kernel.containing_function(df, of)))
    assert sorted(got) == [("c", "x.c", 1, "x.c", 2, "one"), ("c", "x.c", 2, "x.c", 3, "one")]
    assert most < 30_000


@pytest.mark.parametrize("same", [False, True])
def test_innermost_spans_in_a_crowded_file(spark, same):
    """Same: inner and outer spans are one table, where some entities have several spans."""
    dice = random.Random(4)
    span = lambda: (lambda a: (a, a + dice.choice([0, 2, 9, 300, 400])))(dice.randint(0, 300))
    outer = [("c", dice.choice("xxxxy"), f"s{dice.randint(0, 900) if same else i:03}", *span()) for i in range(1200)]
    inner = outer if same else [("c", dice.choice("xxxz"), f"i{i:03}", *span()) for i in range(1200)]
    load = lambda rows: spark.createDataFrame(rows, "case_id string, file string, entity_id string, line int, end_line int")
    got, most = most_rows(spark, lambda: graph.innermost(load(inner), load(outer)))
    best = {}
    for _, f, i, a, b in inner:
        best.setdefault(i, []).extend((hi - lo, o) for _, g, o, lo, hi in outer if f == g and lo <= a and b <= hi and o != i)
    assert sorted(got, key=repr) == sorted((("c", i, min(best[i])[1] if best[i] else None) for _, _, i, *_ in inner), key=repr)
    assert len(got) == 1200 and most < 50_000


def test_c_calls_meet_only_their_definitions(spark, capsys):
    dice = random.Random(5)
    calls = sorted({("c", f"k{dice.randint(0, 20)}", f"f{dice.randint(0, 5)}", f"n{dice.randint(0, 9)}") for _ in range(200)})
    functions = [("c", f"d{i % 170}", f"n{dice.randint(0, 9)}", f"f{dice.randint(0, 9)}", dice.choice([True, True, False])) for i in range(180)]
    functions = [f if f[2] not in ("n8", "n9") else (*f[:4], True) for f in functions] + [("c", "only", "n9", "f9", None)]
    functions = [f for f in functions if f[2] != "n9" or f[1] == "only"]
    df = spark.createDataFrame(calls, "case_id string, caller string, file string, name string")
    of = spark.createDataFrame(functions, "case_id string, method_id string, name string, file string, is_static boolean")
    want, candidates = set(), []
    for c, caller, file, name in calls:
        of_name = [f for f in functions if f[2] == name]
        here, external = [f for f in of_name if f[3] == file], [f for f in of_name if f[4] is False]
        rule = "same file" if here else "only external" if len(external) == 1 else "only one" if len(of_name) == 1 else "all external" if external else "all"
        want |= {(c, caller, f[1], rule) for f in here or external or of_name}
        candidates += [(c, caller, name, 7, f[1], len(here or external)) for f in here or external]
    out = symbols.c_callees(df, of)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({r for *_, r in want}) >= 4
    no_join_conditions(capsys, out)
    out = symbols.c_candidates(df.selectExpr("*", "7 AS line"), of)
    assert sorted(tuple(r) for r in out.collect()) == sorted(candidates)
    no_join_conditions(capsys, out)


def test_other_commits_are_other_commits_for_every_order(spark, tmp_path):
    """Digests of these orders begin with ffff, those of a real commit can too."""
    import hashlib

    from __spark_entry__ import queries

    keys = [k for k in range(500_000) if hashlib.md5(str(k).encode()).hexdigest().startswith("ffff")]
    spark.createDataFrame([(k, 3) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.problem for r in queries()["k4_provenance"](spark, str(tmp_path)).collect()}
    assert len(keys) > 3 and got == {"other commit"}


def test_programs_are_scanned_in_pieces(spark, monkeypatch):
    import pandas as pd

    texts = pd.Series(["a()"] * 5 + [None, "b()\n" * 40, "", "c()"])
    pieces = list(kernel._pieces(texts, 20))
    assert [i for a, b in pieces for i in range(a, b)] == list(range(9)) and all(sum(len(t or "") + 1 for t in texts[a : b - 1]) < 20 for a, b in pieces) and len(pieces) == 3
    assert list(kernel._pieces(texts[:0], 20)) == [(0, 0)]
    monkeypatch.setattr(kernel, "_PIECE", 20)
    rows = [(str(i), t) for i, t in enumerate(texts)]
    got = {r.case_id: (r.calls and len(r.calls), r.error) for r in kernel.scan_programs(spark.createDataFrame(rows, "case_id string, text string").coalesce(1)).collect()}
    assert got["6"] == (40, None) and got["0"] == (1, None) and got["8"] == (1, None) and len(got) == 9


def hierarchy(spark, dice, n=40):
    """Types in a chain with side branches, methods of few names and signatures, lineage; and plain ancestors with depths."""
    parent = {i: i - 1 if dice.random() < 0.7 else dice.randint(0, i - 1) for i in range(1, n)}
    up = {}
    for i in range(n):
        at, depth = i, 0
        while at is not None:
            up[f"t{i}", f"t{at}"] = depth
            at, depth = parent.get(at), depth + 1
    types = [("c", f"t{i}", f"p{i % 2}", i % 5 == 4) for i in range(n)]
    methods = [("c", f"m{k:03}", f"t{dice.randint(0, n - 1)}", dice.choice("ab"), k % 17 == 0, dice.choice(["public", "public", "private", "package", None]), k % 5 == 0, ["x"] * dice.randint(0, 2), k % 6 == 0) for k in range(90)]
    load = spark.createDataFrame
    return types, methods, up, (
        load([("c", *k, d) for k, d in up.items()], "case_id string, type_id string, ancestor string, depth int"),
        load(methods, "case_id string, method_id string, owner_type string, name string, constructor boolean, visibility string, static boolean, parameter_types array<string>, varargs boolean"),
        load(types, "case_id string, type_id string, package string, is_interface boolean"),
    )


def plain_lookup(types, methods, up, owner, name, arity, constructor):
    package, interface = {t: p for _, t, p, _ in types}, {t: i for _, t, _, i in types}
    best = {}
    for _, m, at, n, con, vis, static, params, varargs in methods:
        depth = up.get((owner, at))
        if depth is None or n != name or con != constructor or not (len(params) == arity or varargs and arity >= len(params) - 1):
            continue
        if depth and (con or vis in ("private", None) or vis == "package" and package[at] != package[owner]):
            continue
        sig = ",".join(params)
        best[sig] = min(best.get(sig, (True, 10**9, "z", "z")), (interface[at], depth, at, m))
    return {m for *_, m in best.values()}


def test_lookup_asks_once_for_equal_sites(spark):
    dice = random.Random(6)
    types, methods, up, (lineage, of, kinds) = hierarchy(spark, dice)
    sites = [(f"s{i}", dice.choice(["t30", "t39", "t5"]), dice.choice("ab"), dice.randint(0, 2), dice.random() < 0.1) for i in range(3000)]
    df = spark.createDataFrame([("c", *s) for s in sites], "case_id string, site_id string, owner_type string, name string, arity int, is_constructor boolean")
    got, most = most_rows(spark, lambda: symbols.lookup(df, lineage, of, kinds).select("site_id", "method_id"))
    want = [(s, m) for s, *ask in sites for m in plain_lookup(types, methods, up, *ask)]
    assert sorted(got) == sorted(want) and len(want) > 1000
    assert most <= max(len(want), 6000)


def test_dispatch_targets_are_not_dealt_again(spark):
    dice = random.Random(7)
    types, methods, up, (lineage, of, kinds) = hierarchy(spark, dice)
    sites = [(f"s{i}", dice.choice(["t0", "t1", "t2", "t9"]), dice.choice("ab"), dice.randint(0, 2), False, f"k{i % 7}") for i in range(2000)]
    df = spark.createDataFrame([("c", *s) for s in sites], "case_id string, site_id string, owner_type string, name string, arity int, is_constructor boolean, caller_id string")
    found = lineage_tables.cut_lineage(symbols.lookup(df, lineage, of, kinds))
    detail = {m[1]: m for m in methods}
    targets = {}
    for r in found.collect():
        _, _, at, name, _, vis, static, params, _ = detail[r.method_id]
        own = targets.setdefault(r.site_id, set())
        own.add(r.method_id)
        if not static and vis not in ("private", None):
            own |= {m[1] for m in methods if up.get((m[2], at), 0) > 0 and m[3] == name and m[7] == params and not m[6] and not m[4]}
    want = {(s, m) for s, own in targets.items() for m in own}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got, dealt = most_rows(spark, lambda: symbols.dispatch(found, of, lineage).select("site_id", "method_id"), "shuffle records written")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(set(got)) and set(got) == want and dealt < len(want) - 500
    # Two chosen methods of one signature may share overrides.
    got = [tuple(r) for r in symbols.dispatch(found.withColumn("site_id", found.caller_id) if "caller_id" in found.columns else found.selectExpr("case_id", "'s' AS site_id", "declared_in", "name", "signature", "method_id", "static", "visibility"), of, lineage).select("method_id").collect()]
    assert len(got) == len(set(got)) and {m for m, in got} == {m for _, m in want}
    got, most = most_rows(spark, lambda: symbols.dispatch_statistics(df, found, of, lineage))
    edges = {(caller, m) for s, *_, caller in sites for m in targets.get(s, ())}
    assert got == [("c", 2000, len(targets), 2000 - len(targets), len(want), len(edges))] and most < len(want)
    assert got == [tuple(r) for r in symbols.call_statistics(df, symbols.dispatch(found, of, lineage)).collect()]


def test_overloads_stay_where_they_meet_their_arguments(spark, capsys):
    dice = random.Random(8)
    up = {("a", "a"), ("b", "b"), ("b", "a"), ("e", "e"), ("e", "b"), ("e", "a")} | {(f"u{i}", "a") for i in range(300)}
    lineage = spark.createDataFrame([("c", t, s, int(t != s)) for t, s in up], "case_id string, type_id string, ancestor string, depth int")
    found = [("c", f"s{i}", f"m{i}-{k}", dice.choices("abe", k=dice.randint(0, 2))) for i in range(400) for k in range(dice.randint(1, 3))]
    arguments = [("c", f"s{i}", k, dice.choice(["a", "b", "e", None])) for i in range(400) for k in range(dice.randint(0, 3))]
    of = spark.createDataFrame(found, "case_id string, site_id string, method_id string, parameter_types array<string>")
    df = spark.createDataFrame(arguments, "case_id string, site_id string, pos int, type string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = [tuple(r) for r in symbols.best_overloads(of, df, lineage).select("site_id", "method_id", "score").collect()]
        symbols.best_overloads(of, df, lineage).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = capsys.readouterr().out.count("Exchange hashpartitioning")
    given, several = {(s, k): t for _, s, k, t in arguments}, {}
    for _, s, m, params in found:
        several.setdefault(s, []).append((m, sum(2 if given[s, k] == p else 1 if (given[s, k], p) in up else 0 for k, p in enumerate(params) if (s, k) in given)))
    want = []
    for s, own in several.items():
        own = own if len(own) > 1 else [(own[0][0], 0)]
        want += [(s, m, x) for m, x in own if x == max(y for _, y in own)]
    assert sorted(got) == sorted(want) and dealt <= 6


def test_unqualified_calls_ask_once_for_equal_sites(spark):
    methods = spark.createDataFrame([("c", f"a.T{i}", f"m{i % 3}", i % 2 == 0) for i in range(30)], "case_id string, owner_type string, name string, static boolean")
    lineage = spark.createDataFrame([("c", "a.T1", f"a.T{i}", i) for i in range(1, 30, 3)] + [("c", "a.T1.N", "a.T1.N", 0)], "case_id string, type_id string, ancestor string, depth int")
    rows = [("c", f"s{i}", "a.T1.N", f"m{i % 3 if i < 90 else 1}", [f"a.T{i % 6}.*", "a.T4.m1", "a.T8.m2"]) for i in range(3000)]
    df = spark.createDataFrame(rows, "case_id string, site_id string, owner_type string, name string, static_imports array<string>")
    got, most = most_rows(spark, lambda: symbols.unqualified(df, methods, lineage).select("site_id", "owner_type", "depth"))
    want = [(f"s{i}", "a.T1", 1) for i in range(3000) if i % 3 == 1 or i >= 90] + [(f"s{i}", {0: "a.T0", 2: "a.T2", 5: "a.T8"}[i % 6], -1) for i in range(90) if i % 6 in (0, 2, 5)]
    assert sorted(got) == sorted(want) and most < 4000


def test_cases_of_equal_terms_share_their_files(spark):
    lines = spark.createDataFrame([(f"fs/alpha_{i}.c", "alpha beta") for i in range(200)] + [("lib/b.h", "betamax")], "path string, line string")
    terms = [("c%03d" % i, t) for i in range(600) for t in (["alpha"] if i % 2 else ["beta", "alpha"])]
    df = spark.createDataFrame(terms, "case_id string, term string")
    got, most = most_rows(spark, lambda: seeding.keyword_files(df, lines, 5))
    paths = sorted((f"fs/alpha_{i}.c" for i in range(200)), key=lambda p: (-len(p), p), reverse=True)[:5]
    assert sorted(got) == sorted(("c%03d" % i, p, 125, k + 1) for i in range(600) for k, p in enumerate(paths))
    assert most <= 3000


def test_near_files_meet_wanted_names_within_the_case(spark):
    dice = random.Random(9)
    path = lambda k: f"{['fs/a', 'fs/b', 'net', 'arch/x86/m', 'arch/arm/m', 'drivers/u'][k % 6]}/f{k}.c"
    lines = sorted({(path(k), f"int name_{dice.randint(0, 59) if k else j % 60}(void)") for k in range(30) for j in range(60 if k in (0, 12) else 3)})
    wanted = sorted({(f"c{i}", f"name_{dice.randint(0, 64)}") for i in range(200) for _ in range(2)})
    near = sorted({(f"c{i}", path(dice.randint(0, 40))) for i in range(190) for _ in range(3)})
    load = spark.createDataFrame
    got, most = most_rows(spark, lambda: seeding.defining_file(load(lines, "path string, line string"), load(wanted, "case_id string, name string"), load(near, "case_id string, path string")))

    def rank(p, own):
        arch = {q.split("/")[1] for q in own if q.startswith("arch/")}
        folder, top = {q.rsplit("/", 1)[0] for q in own}, {q.split("/")[0] for q in own}
        if p in own or p.rsplit("/", 1)[0] in folder:
            return int(p not in own)
        if p.startswith("arch/") and arch and p.split("/")[1] not in arch:
            return 80
        return 2 if p.split("/")[0] in top else 90 if p.startswith("drivers/") else 20

    want = []
    for c, name in wanted:
        own = {p for d, p in near if c == d}
        best = min(((rank(p, own), p) for p, t in lines if f" {name}(" in t), default=None)
        want += [(c, name, best[1] if best[0] < 80 else None, best[0])] if best else []
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r for *_, r in want} >= {0, 1, 2, 20}
    assert most < 1800


def test_full_cases_take_no_more_files(spark):
    load = spark.createDataFrame
    lines = [(f"fs/f{i:02}.c", f"int alpha_{i % 30}(void)") for i in range(60)] + [("fs/lone.c", "int omega_run(void)")]
    calls = load([("fs/f00.c", k, f"alpha_{k % 30}") for k in range(29)] + [("fs/lone.c", 1, "alpha_7")], "path string, pos long, name string")
    cases = [f"c{i}" for i in range(100)]
    frames = load([(c, 1, "start", "fs/f00.c") for c in cases] + [("d", 1, "start", "fs/lone.c")], "case_id string, pos long, function string, file string")
    reports = load([(c, "") for c in [*cases, "d"]], "case_id string, text string")
    programs = load([(c, "alpha()") for c in cases], "case_id string, text string")
    got, most = most_rows(spark, lambda: seeding.seed_paths(frames, reports, programs, load(lines, "path string, line string"), calls, 10))
    of = {}
    for c, p, k in got:
        of.setdefault(c, []).append((k, p))
    full = ["fs/f00.c", *sorted((f"fs/f{i:02}.c" for i in range(1, 60)), reverse=True)[:9]]
    assert all([p for _, p in sorted(of[c])] == full for c in cases) and sorted(of["d"]) == [(1, "fs/lone.c"), (2, "fs/f07.c")]
    assert most < 1800
