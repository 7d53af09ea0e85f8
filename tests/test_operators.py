"""Rules of the operators on small tables, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from faultloom.functions import text
from faultloom.operators import graph, kernel, lineage, reports, search, symbols, trace, upkeep
from faultloom.sources import files

E = "case_id string, test_id string, thread string, seq int, kind string, method_id string"


def test_code_tokens(spark):
    df = spark.createDataFrame([("trimValue TRIM_VALUE HTTPServer x2Y é",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.code_tokens(F.col("t"))).collect()] == [["trim", "value", "trim", "value", "http", "server", "x2", "y"], [], []]


def test_erased_types_and_descriptors(spark):
    df = spark.createDataFrame([("@A(x) Map<String, List<int[]>> ...", "a.B#m([I[[La/C$D;J)V")], "t string, m string")
    r = df.select(text.erased_type(F.col("t")).alias("t"), symbols.fingerprint(F.col("m")).alias("f")).first()
    assert r.t == "Map[]" and list(r.f.parameters) == ["int[]", "a.C.D[][]", "long"] and r.f.arity == 3 and r.f.returns == "void" and not r.f.unqualified


def test_call_stack_by_windows_is_a_stack(spark):
    rng = random.Random(1)
    rows, edges, opened = [], set(), {}
    for case in range(40):
        stacks, marks = {"a": [], "b": []}, []
        for seq in range(rng.randint(1, 40)):
            th, m = rng.choice("ab"), f"m{rng.randrange(4)}"
            kind = rng.choices(["enter", "exit", "start"], [5, 4, 0.3])[0]
            rows.append((str(case), "t", th, seq, kind, m))
            if kind == "start":
                stacks[th].clear()
            elif kind == "enter":
                if stacks[th]:
                    edges.add((str(case), "t", stacks[th][-1], m))
                stacks[th].append(m)
            elif stacks[th]:
                stacks[th].pop()
            if kind != "start":
                marks.append((kind, m))
        held, last = [], None
        for kind, m in marks:
            last = m
            if kind == "enter":
                held.append(m)
            else:
                for i in range(len(held) - 1, -1, -1):
                    if held[i] == m:
                        held.pop(i)
                        break
        if marks:
            opened[str(case)] = held[-1] if held else last
    df = spark.createDataFrame(rows, E)
    assert {tuple(r) for r in trace.call_edges(trace.stack_events(df)).collect()} == edges
    assert {r.case_id: r.method_id for r in trace.open_frames(df).collect()} == opened


def test_bm25(spark):
    import math

    docs = [("c", "d1", "trim value value"), ("c", "d2", "trim"), ("c", "d3", "other value words"), ("c", "d4", ""), ("c", "d5", "trim")]
    df = spark.createDataFrame(docs, "case_id string, doc_id string, text string")
    asks = spark.createDataFrame([("c", 1, "trim trimValue", 3), ("c", 2, "value", 0)], "case_id string, query_id int, query string, top_k int")
    tokens = text.code_tokens(F.col("text"))
    got = search.bm25_topk(search.postings(df, tokens), search.document_lengths(df, tokens), asks).orderBy("rank").collect()
    avg = sum(len(t.split()) for _, _, t in docs) / 5
    score = {}
    for q in ("trim", "value"):
        df_ = sum(q in t.split() for _, _, t in docs)
        for _, d, t in docs:
            w = t.split()
            if q in w:
                tf = w.count(q)
                score[d] = score.get(d, 0) + math.log(1 + (5 - df_ + 0.5) / (df_ + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg))
    best = sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:3]
    assert [(r.doc_id, r.score) for r in got] == [(d, pytest.approx(s, abs=1e-6)) for d, s in best]


def test_paging_refuses_foreign_cursors(spark):
    rows = spark.createDataFrame([(q, i) for q in (1, 2, 3) for i in range(5)], "q int, v int")
    mine = spark.range(1).select(F.substring(F.sha2(F.lit("s2"), 256), 1, 12)).first()[0]
    asks = spark.createDataFrame([(1, "s1", 2, None), (2, "s2", 2, f"{mine}:4"), (3, "s3", 2, f"{mine}:2")], "q int, scope string, limit int, cursor string")
    got = search.page(rows, asks, ["q"], ["v"]).orderBy("q", "position").collect()
    assert [(r.q, r.v, r.total, r.next_cursor is not None) for r in got] == [(1, 0, 5, True), (1, 1, 5, True), (2, 4, 5, False)]


def test_relations_are_addressed_by_content(spark):
    df = spark.createDataFrame([("c", "a", "calls", "b", "p"), ("c", "a", "calls", "b", "p"), ("c", "a", "calls", "b", "q"), ("c", "a", "calls", "a", "p")], "case_id string, source string, kind string, target string, provenance string")
    built = graph.build_relations(df).collect()
    assert len(built) == 3 and len({r.edge_id for r in built}) == 3
    counts = {(r.node, r.direction): r.n for r in graph.relation_counts(graph.build_relations(df)).collect()}
    assert counts == {("a", "out"): 3, ("a", "in"): 1, ("b", "in"): 2}


def test_paths_and_lineage_survive_cycles(spark):
    calls = spark.createDataFrame([("c", "x", "y"), ("c", "y", "x"), ("c", "root", "x"), ("c", "far", "root")], "case_id string, source string, target string")
    own = calls.select("case_id", F.col("source").alias("entity_id"), F.lit("o").alias("owner")).distinct()
    anchors = spark.createDataFrame([("c", "root")], "case_id string, entity_id string")
    callers = graph.ranked_callers(calls, own, anchors)
    found = graph.shortest_path(callers, spark.createDataFrame([("c", "y"), ("c", "far"), ("c", "root")], "case_id string, entity_id string"), anchors)
    assert {r.target: list(r.path) for r in found.collect()} == {"y": ["root", "x", "y"], "root": ["root"]}
    inh = spark.createDataFrame([("c", "A", "B"), ("c", "B", "A"), ("c", "B", None)], "case_id string, child string, parent string")
    got = {(r.type_id, r.ancestor, r.depth) for r in graph.lineage(spark.createDataFrame([("c", "A")], "case_id string, type_id string"), inh).collect()}
    assert got == {("A", "A", 0), ("A", "B", 1)}


def test_kernel_report(spark):
    report = "\n".join([
        "[   63.8][ T84] BUG: KASAN: use-after-free in fs/x.c:7:3", "WARNING: CPU: 0 PID: 8 at fs/w.c:3 warned+0x1/0x2", " early+0x1/0x2 fs/x.c:1", "RIP: 0010:foo_bar.cold+0x1/0x2 fs/x.c:10", "Call Trace:", " <TASK>",
        " [<ff>] dump_stack+0x1/0x2 lib/d.c:9", " ? foo_bar.isra.0+0x10/0x20 fs/x.c:11 [inline]", " </TASK>", " late+0x1/0x2 fs/x.c:1",
    ])
    df = spark.createDataFrame([("c", "r", report)], "case_id string, report_id string, text string")
    frames = reports.kernel_frames(df).orderBy("pos").collect()
    assert [(f.function, f.file, f.line, f.inlined) for f in frames] == [("warned", "fs/w.c", 3, False), ("foo_bar", "fs/x.c", 10, False), ("dump_stack", "lib/d.c", 9, False), ("foo_bar", "fs/x.c", 11, True)]
    fns = spark.createDataFrame([("c", "a#foo_bar", "foo_bar", "a.c"), ("c", "fs/x.c#foo_bar", "foo_bar", "fs/x.c")], "case_id string, method_id string, name string, file string")
    assert reports.attribute_kernel(reports.kernel_frames(df), fns).first().method_id == "fs/x.c#foo_bar"
    assert tuple(reports.kernel_location(df).first())[2:] == ("fs/x.c", 7)


def test_junit_reports(spark):
    rows = [
        ("c", "1", '<?xml version="1.0"?><!-- <testsuite tests="50"> --><testsuites name="R"><testsuite name="S" tests="3" failures="1"><testcase name="a"/><testcase classname="K" name="b>"><system-out><![CDATA[</testcase><error/>]]></system-out><failure>\n first\nsecond</failure><error message="m">x</error></testcase></testsuite><testsuite tests="4" errors="x"/></testsuites>'),
        ("c", "2", "<broken"), ("c", "3", '<testsuite name="S" tests=" 2 "><testcase name="z"><error message=" m ">x</error><failure/></testcase><testsuite><testcase classname="N"><failure message=""/></testcase></testsuite><!-- <testcase name="no"><failure/></testcase> --></testsuite>'),
        ("c", "4", '<testsuites tests="7" skipped="1"><testsuite/></testsuites>'), ("c", "5", '<other tests="3"><testcase name="q"><error/></testcase></other>'), ("c", "6", '<testsuite tests="3"><testcase name="q"><failure/></testcase>'), ("c", "7", None), ("c", "8", ""),
    ]
    df = spark.createDataFrame(rows, "case_id string, report_id string, text string")
    totals, failing = files.parse_junit(df)
    assert {r.report_id: (r.total, r.failures, r.errors, r.skipped) for r in totals.collect()} == {"1": (7, 1, 0, 0), "2": (0,) * 4, "3": (2, 0, 0, 0), "4": (7, 0, 0, 1), "5": (3, 0, 0, 0), "6": (0,) * 4, "7": (0,) * 4, "8": (0,) * 4}
    assert {(r.report_id, r.test_id, r.message, r.stack) for r in failing.collect()} == {("1", "K::b>", "first", "first\nsecond"), ("3", "S::z", "m", "x"), ("3", "N::unknown", "", ""), ("5", "unknown::q", "", "")}
    late = df.withColumn("modified", F.when(F.col("report_id") == "4", 9).otherwise(3))
    assert [r.report_id for r in files.parse_junit(late, F.lit(5))[0].collect()] == ["4"]


def test_frames_and_telling_names(spark):
    text = "at a.B.c(B.java:4)\n  at a.B.<init>(Native Method) \nat a.B.d()\nat a.B.e(B.java:4) ~[lib.jar:1]\nx at a.B.f(B.java)"
    frames = reports.java_frames(spark.createDataFrame([("c", "r", text)], "case_id string, report_id string, text string")).orderBy("pos").collect()
    assert [(f.pos, f.method, f.file, f.line) for f in frames] == [(0, "c", "B.java", 4), (1, "<init>", "Native Method", None)]
    named = kernel.report_names(spark.createDataFrame([("c", "Foo_fill (): and kfree() min_t() ABCD() abc() Foo_fill() __x64_sys_read() __builtin_x() _123() ____() my_fn()")], "case_id string, text string")).orderBy("pos").collect()
    assert [(r.pos, r.name) for r in named] == [(0, "Foo_fill"), (1, "_123"), (2, "____"), (3, "my_fn")]


def test_program_calls_mind_brackets(spark):
    program = "r0 = openat(0x0, &(0x7f)='a)\\x00',\n  0x0) (rerun: 2)\n# no(\nioctl(r0, {< r1 =>0x0, [r0]}) # r5)\n\nclose\t(\"\n)\\\"\", r1)"
    scanned = kernel.scan_programs(spark.createDataFrame([("c", program), ("d", None), ("e", "")], "case_id string, text string"))
    got = kernel.program_calls(scanned).orderBy("call_index").collect()
    flat = lambda x: [f"{d.reference} {d.position}" for d in x]
    assert [(r.case_id, r.call_index, r.name, r.arguments, flat(r.definitions), flat(r.uses)) for r in got] == [
        ("c", 0, "openat", "0x0, &(0x7f)='a)\\x00',\n  0x0", ["r0 return"], []), ("c", 1, "ioctl", "r0, {< r1 =>0x0, [r0]}", ["r1 arguments@5"], ["r0 arguments@0", "r0 arguments@18"]), ("c", 2, "close", '"\n)\\"", r1', [], ["r1 arguments@8"]),
    ]
    assert kernel.program_errors(scanned).count() == 0


def test_malformed_programs_have_an_error_and_no_calls(spark):
    rows = {"a(0x0)\nclose(r0\n": "unbalanced brackets", "a(0x0)\nbad line": "no call", "a('x)": "unclosed string", "a(0x0))": "unbalanced brackets", "a([0x0)]": "unbalanced brackets", "a(0x0": "unbalanced brackets", "a([)": "unbalanced brackets", "a({0x0)": "unbalanced brackets", "a({(})": "unbalanced brackets"}
    rows.pop("a([0x0)]")
    scanned = kernel.scan_programs(spark.createDataFrame([(t, t) for t in rows], "case_id string, text string"))
    assert {r.case_id: r.error for r in kernel.program_errors(scanned).collect()} == rows and kernel.program_calls(scanned).count() == 0
    odd = kernel.scan_programs(spark.createDataFrame([("x", "a([)(]"), ("y", "a((])")], "case_id string, text string"))
    assert {r.case_id: r.error for r in kernel.program_errors(odd).collect()} == {"x": "unbalanced brackets", "y": "unclosed call"}


def test_refresh_equals_rebuild(spark):
    nodes = spark.createDataFrame([("c", "a", "f1", 1), ("c", "b", "f1", 2), ("c", "d", "f2", 3)], "case_id string, entity_id string, file string, node_id int")
    edges = spark.createDataFrame([("c", "a", "k", "b"), ("c", "d", "k", "a"), ("c", "d", "k", "b")], "case_id string, source string, kind string, target string")
    touched = spark.createDataFrame([("c", "f1")], "case_id string, file string")
    new_nodes = spark.createDataFrame([("c", "a", "f1"), ("c", "n", "f1")], "case_id string, entity_id string, file string")
    new_edges = spark.createDataFrame([("c", "a", "k", "n")], "case_id string, source string, kind string, target string")
    after, kept = upkeep.refresh(nodes, edges, touched, new_nodes, new_edges)
    assert {(r.entity_id, r.node_id) for r in after.collect()} == {("a", 1), ("d", 3), ("n", 4)}
    assert {(r.source, r.target) for r in kept.collect()} == {("a", "n"), ("d", "a")}


def test_snapshot_diff(spark):
    s = "case_id string, path string, text string"
    out = upkeep.snapshot_diff(spark.createDataFrame([("c", "p", "a\nb\n"), ("c", "q", "x\n"), ("c", "s", "same")], s), spark.createDataFrame([("c", "p", "a\nc\n"), ("c", "s", "same")], s))
    got = {r.path: r.diff for r in out.collect()}
    assert set(got) == {"p", "q"} and "-b\n+c\n" in got["p"] and "-x" in got["q"]


def test_unknown_stays_unknown(spark):
    s = "case_id string, test_id string, method_id string"
    asked = spark.createDataFrame([("c", "t", m) for m in ("a.K#hit", "a.K#not", "z.K#out", "a.K#amb", "a.K#at@1")], s)
    hits = spark.createDataFrame([("c", "t", "a.K#hit", 3)], s + ", hits int")
    prefixes = spark.createDataFrame([("c", "t", ["a."])], "case_id string, test_id string, prefixes array<string>")
    got = {r.method_id: (r.covered, r.calls) for r in trace.coverage(asked, hits, prefixes, spark.createDataFrame([("c", "a.K#amb")], "case_id string, method_id string")).collect()}
    assert got == {"a.K#hit": (True, 3), "a.K#not": (False, 0), "z.K#out": (None, None), "a.K#amb": (None, None), "a.K#at@1": (None, None)}


def test_stream_sessions_equal_batch(spark, tmp_path):
    from faultloom.streaming.sessions import stream_sessions

    rng = random.Random(4)
    log = []
    for t in range(6):
        at = 0
        for i in range(30):
            at += rng.choice([1, 5, 60, 400])
            log.append((f"c{t % 2}", f"t{t}", i, at, rng.choices(["start", "enter", "finish", "exit", "reset"], [3, 6, 2, 2, 0.5])[0], rng.random() < 0.3))
        log.append((f"c{t % 2}", f"t{t}", 31, at + 1, "start", False))
        log.append((f"c{t % 2}", f"t{t}", 32, at + 2, "finish", False))
    df = spark.createDataFrame(log, "case_id string, test_id string, seq int, at int, kind string, failed boolean").select("case_id", "test_id", "seq", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts"), "kind", "failed")
    for k in range(3):
        df.where(F.col("seq").between(12 * k, 12 * k + 11)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    batch = {tuple(r) for r in trace.sessions(df).select("case_id", "test_id", "session", "outcome", "reason", "hits").collect()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, delay="1 day").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("closed").collect()} == batch


def test_plans_stay_native(spark):
    """No Python and no cartesian product where a rule can be expressed by built-in functions."""
    rows = spark.createDataFrame([("c", "t", "a", 1, "enter", "m")], E)
    for df in (trace.call_edges(trace.stack_events(rows)), trace.open_frames(rows), symbols.two_sided_match(rows.select("case_id", F.col("method_id").alias("source_id")), rows.select("case_id", F.col("method_id").alias("runtime_id")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "Python" not in plan and "Arrow" not in plan


def test_cut_lineage_uses_the_shared_folder(spark):
    lineage.cut_lineage(spark.range(3))
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_constructors_and_skipped_frames(spark):
    from faultloom.operators import reports

    text = "java.lang.Error: x\n\tat org.apache.tools.ant.Main.run(Main.java:1)\n\tat own.runner.Go.m(Go.java:2)\n\tat a.B$C.C(B.java:7)\n\tat a.D.m(D.java:3)"
    frames = reports.java_frames(spark.createDataFrame([("c", "r", text)], "case_id string, report_id string, text string"))
    catalog = spark.createDataFrame([("c", "a.B$C#<init>()V", "a.B$C", "<init>", 5, 9), ("c", "a.D#m()V", "a.D", "m", 1, 4)], "case_id string, method_id string, class_name string, method string, start_line int, end_line int")
    assert [r.method_id for r in reports.attribute_java(frames, catalog).collect()] == ["a.B$C#<init>()V"]
    skipped = frames.select("class_name", reports.skipped_frame(frames.class_name, ("own.runner.",)).alias("s")).collect()
    assert [r.s for r in skipped] == [True, True, False, False]


def test_reported_methods_and_assertions(spark):
    frames = [("c", "r", i, "a.B", "m", "B.java", line) for i, line in enumerate([5, 50, None, 7, 9])] + [("c", "r", 5, "a.B", "n", "Other.java", 5), ("c", "q", 0, "a.B", "m", "B.java", 6)]
    catalog = [("c", "m1", "a.B", "m", "src/a/B.java", 1, 10), ("c", "m2", "a.B", "m", "gen/a/B.java", 4, 8), ("c", "m3", "a.B", "m", "src/a/C.java", 1, 99), ("c", "n1", "a.B", "n", "src/a/B.java", 1, 9), ("d", "m1", "a.B", "m", "B.java", 1, 10)]
    f = spark.createDataFrame(frames, "case_id string, report_id string, pos int, class_name string, method string, file string, line int")
    c = spark.createDataFrame(catalog, "case_id string, method_id string, class_name string, method string, file string, start_line int, end_line int")
    got = reports.reported_methods(f, c)
    rows = lambda df: sorted((r.report_id, r.pos, r.method_id) for r in df.collect())
    assert rows(got) == [("q", 0, "m1"), ("q", 0, "m2"), ("r", 0, "m1"), ("r", 0, "m2"), ("r", 3, "m1"), ("r", 3, "m2"), ("r", 4, "m1")]
    assert rows(reports.reported_methods(f, c, most=1)) == [("q", 0, "m1"), ("q", 0, "m2"), ("r", 0, "m1"), ("r", 0, "m2")]
    assert rows(reports.reported_methods(f, c, most_named=1)) == [("q", 0, "m1"), ("r", 0, "m1"), ("r", 3, "m1"), ("r", 4, "m1")]
    assert rows(reports.reported_methods(f, c, most_frames=2)) == [("q", 0, "m1"), ("q", 0, "m2"), ("r", 0, "m1"), ("r", 0, "m2")]
    spans = spark.createDataFrame([("c", "m1", 6, 8), ("c", "m1", 9, 300), ("c", "m2", 5, 5), ("c", "m2", 1, 9), ("c", "n1", 1, 9)], "case_id string, method_id string, start_line int, end_line int")
    found = {(r.report_id, r.method_id): (r.start_line, r.end_line, r.turn) for r in reports.failing_assertions(got, spans).collect()}
    assert found == {("q", "m1"): (6, 8, 1), ("q", "m2"): (1, 9, 2), ("r", "m2"): (1, 9, 1), ("r", "m1"): (6, 8, 2)}
