"""Queries of report sources and operators. Reports are built from order lines in the exact line formats and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..sources import files
from .domain import ENTITIES, table, view, with_views

#: One line of a stack trace for each order line; positions by line number.
_LINES = """
SELECT 'c' || cast(l_orderkey % 7 AS string) AS case_id, cast(l_orderkey AS string) AS report_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_extendedprice AS e, l_returnflag AS flag, l_quantity AS q,
    CASE WHEN l_partkey % 10 = 0 THEN 'java.util.List' WHEN l_partkey % 10 = 1 THEN 'p.FooTest' ELSE 'p.C' || cast(l_partkey % 40 AS string) END AS class_name,
    CASE WHEN l_suppkey % 7 = 0 THEN '<init>' ELSE 'm' || cast(l_suppkey % 7 AS string) END AS method, CASE WHEN l_partkey % 4 > 0 THEN cast(l_partkey % 60 AS int) END AS line FROM {lineitem}"""
_RANKED = "SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY n, p, s, e) AS k FROM (" + _LINES + ") AS l"
#: Parts as a catalog of methods with ranges of lines that overlap.
_CATALOG = """
SELECT case_id, method_id || '@c' AS unused, method_id, class_name, method, file, start_line, end_line FROM (SELECT 'c' || cast(c AS string) AS case_id, 'p.C' || cast(p_partkey % 40 AS string) || '#' || CASE WHEN p_size % 7 = 0 THEN '<init>' ELSE 'm' || cast(p_size % 7 AS string) END
    || '(' || repeat('I', p_size) || ')V' || cast(p_partkey AS string) AS method_id, 'p.C' || cast(p_partkey % 40 AS string) AS class_name, CASE WHEN p_size % 7 = 0 THEN '<init>' ELSE 'm' || cast(p_size % 7 AS string) END AS method,
    'src/p/C' || cast(p_partkey % 40 AS string) || CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE '' END || '.java' AS file, cast(p_partkey % 50 AS int) AS start_line, cast(p_partkey % 50 + p_size AS int) AS end_line FROM {part} CROSS JOIN (SELECT DISTINCT l_orderkey % 7 AS c FROM {lineitem}) AS cs) AS x"""
_FUNCTIONS = """
SELECT 'c' || cast(c AS string) AS case_id, 'fs/f' || cast(p_partkey % 9 AS string) || '.c#fn' || cast(p_size AS string) || '@' || cast(p_partkey AS string) AS method_id, 'fn' || cast(p_size AS string) AS name, 'fs/f' || cast(p_partkey % 9 AS string) || '.c' AS file
    FROM {part} CROSS JOIN (SELECT DISTINCT l_orderkey % 7 AS c FROM {lineitem}) AS cs"""
_BEFORE = "SELECT 'c' || cast(o_custkey AS string) AS case_id, o_orderpriority || '::t' || cast(cast(floor(o_totalprice) AS int) % 8 AS string) AS test_id FROM {orders} WHERE o_orderstatus = 'F' AND o_orderdate < timestamp '1998-07-01 00:00:00'"
_AFTER = _BEFORE.replace("o_orderdate <", "o_orderdate >=")


def _text(df, *parts):
    """Reports (case_id, report_id, text) of ordered lines (…, place, line)."""
    listed = F.array_sort(F.collect_list(F.struct("place", "line")))
    return df.groupBy("case_id", "report_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))


def _ranked(spark, sf_dir):
    return view(spark, sf_dir, _RANKED)


def _java_reports(spark, sf_dir):
    where = F.concat(F.regexp_extract("class_name", r"([^.]*)$", 1), F.lit(".java"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    rows = _ranked(spark, sf_dir).select("case_id", "report_id", F.col("k").alias("place"), F.concat(F.lit("\tat "), "class_name", F.lit("."), "method", F.lit("("), where, F.lit(")")).alias("line"))
    head = rows.select("case_id", "report_id").distinct().select("case_id", "report_id", F.lit(0).alias("place"), F.lit("java.lang.Error: at nothing").alias("line"))
    return _text(rows.unionByName(head))


def _kernel_reports(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    site = F.concat(F.lit("fs/f"), (F.col("p") % 9).cast("string"), F.lit(".c:"), (F.col("p") % 60).cast("string"))
    fn = F.when(F.col("s") % 5 == 0, "kasan_report").otherwise(F.concat(F.lit("fn"), (F.col("s") % 50).cast("string")))
    frame = F.concat(F.lit("[   63.8][ T8] "), F.when(F.col("n") % 2 == 0, "? ").otherwise(""), fn, F.when(F.col("n") == 4, ".isra.0").otherwise(""), F.lit("+0x1/0x20 "), site, F.when(F.col("n") == 3, " [inline]").otherwise(""))
    rip = F.concat(F.lit("RIP: 0010:"), fn, F.lit(".cold+0x1/0x2 "), site)
    rows = r.select("case_id", "report_id", (F.col("n") * 1000 + F.col("k")).alias("place"), F.when(F.col("n") == 1, rip).otherwise(frame).alias("line"))
    marks = rows.select("case_id", "report_id").distinct().select("case_id", "report_id", F.explode(F.array(
        F.struct(F.lit(0).alias("place"), F.concat(F.lit("BUG: KASAN: use-after-free in fs/g.c:"), F.col("report_id"), F.lit(":3")).alias("line")),
        F.struct(F.lit(2900).alias("place"), F.lit("Call Trace:").alias("line")), F.struct(F.lit(2901).alias("place"), F.lit(" <TASK>").alias("line")), F.struct(F.lit(5900).alias("place"), F.lit(" </TASK>").alias("line")),
    )).alias("m")).select("case_id", "report_id", "m.*")
    warned = rows.select("case_id", "report_id").distinct().where(F.col("report_id").cast("long") % 4 == 0).select("case_id", "report_id", F.lit(1).alias("place"), F.lit("WARNING: CPU: 0 PID: 8 at fs/w.c:301 warned_fn+0x2/0x4").alias("line"))
    return _text(rows.unionByName(marks.withColumn("place", F.col("place").cast("long"))).unionByName(warned.withColumn("place", F.col("place").cast("long"))))


def f1_java_frames(spark, sf_dir):
    return reports.java_frames(_java_reports(spark, sf_dir))


def f2_skipped_frames(spark, sf_dir):
    frames = reports.java_frames(_java_reports(spark, sf_dir))
    return frames.groupBy("case_id", "report_id").agg(F.count_if(reports.skipped_frame(F.col("class_name"))).alias("skipped"), F.count("*").alias("frames"))


def f3_crash_attribution(spark, sf_dir):
    return reports.attribute_java(reports.java_frames(_java_reports(spark, sf_dir)), view(spark, sf_dir, _CATALOG))


def f4_kernel_frames(spark, sf_dir):
    return reports.kernel_frames(_kernel_reports(spark, sf_dir))


def f4_kernel_location(spark, sf_dir):
    return reports.kernel_location(_kernel_reports(spark, sf_dir))


def f5_kernel_attribution(spark, sf_dir):
    return reports.attribute_kernel(reports.kernel_frames(_kernel_reports(spark, sf_dir)), view(spark, sf_dir, _FUNCTIONS))


def f6_failure_refresh(spark, sf_dir):
    r = _ranked(spark, sf_dir).where("k = 1")
    failing = r.select("case_id", F.col("report_id").alias("test_id"), F.when(F.col("flag") == "A", F.col("class_name")).otherwise("").alias("stack"), F.when(F.col("flag") == "R", F.col("method")).alias("message"))
    tests = _ranked(spark, sf_dir).select("case_id", F.col("report_id").alias("test_id"), F.concat(F.lit("test:"), F.col("k").cast("string")).alias("entity_id"), F.col("k").alias("indexed"))
    crash = f3_crash_attribution(spark, sf_dir)
    entities, edges = reports.failure_context(failing, tests, crash, None)
    return edges.join(entities.select("case_id", F.col("entity_id").alias("source"), "content"), ["case_id", "source"])


def f7_reported_methods(spark, sf_dir):
    return reports.reported_methods(reports.java_frames(_java_reports(spark, sf_dir)), view(spark, sf_dir, _CATALOG))


#: An assertion for each fourth line of a method, over three lines.
_ASSERTIONS = "SELECT case_id, method_id, cast(start_line + 4 * n_nationkey AS int) AS start_line, cast(start_line + 4 * n_nationkey + 2 AS int) AS end_line FROM (" + _CATALOG + ") AS c JOIN {nation} ON start_line + 4 * n_nationkey + 2 <= end_line"


def f7_failing_assertions(spark, sf_dir):
    return reports.failing_assertions(f7_reported_methods(spark, sf_dir), view(spark, sf_dir, _ASSERTIONS))


def f8_repair_context(spark, sf_dir):
    texts = view(spark, sf_dir, _CATALOG).select("case_id", "method_id", F.concat(F.lit("body "), "method_id").alias("text"))
    out = reports.repair_context(_java_reports(spark, sf_dir), f7_reported_methods(spark, sf_dir), texts, 600, 200, 80)
    return out.select("case_id", "report_id", "chain", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("context_md5"))


def f9_run_summary(spark, sf_dir):
    suites = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("case_id"), F.col("l_quantity").cast("long").alias("total"), (F.col("l_partkey") % 3).alias("failures"), (F.col("l_suppkey") % 2).alias("errors"), (F.col("l_linenumber") % 2).cast("long").alias("skipped"))
    exits = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("case_id"), (F.col("o_custkey") % 2).cast("int").alias("exit_code"))
    return reports.run_summary(suites, exits)


def _compared(spark, sf_dir):
    return reports.compare_runs(view(spark, sf_dir, _BEFORE), view(spark, sf_dir, _AFTER))


def f10_regression_comparison(spark, sf_dir):
    return _compared(spark, sf_dir)


def f10_regression_gate(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("case_id"), (F.col("c_acctbal") < 0).alias("execution_error"))
    return reports.regression_gate(_compared(spark, sf_dir), runs)


def f11_trigger_tests(spark, sf_dir):
    return reports.flag_triggers(view(spark, sf_dir, _AFTER).distinct(), view(spark, sf_dir, _BEFORE))


def f12_selected_test(spark, sf_dir):
    fails = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("case_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("t"), (F.col("o_orderkey") % 10).cast("string")).alias("test_id"))
    cases = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("case_id"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("t"), (F.col("c_custkey") % 10).cast("string"))).alias("explicit"))
    return reports.select_test(cases, fails)


def f13_failure_digest(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang").alias("case_id"), F.col("doc_id").alias("pos"), "text")
    out = reports.failure_digest(texts, 2000, 12_000, 10_000)
    return out.select("case_id", F.length("digest").cast("long").alias("n_chars"), F.md5("digest").alias("digest_md5"))


_PATHS = """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'src/main/java/A' WHEN 1 THEN 'target/classes/A' WHEN 2 THEN 'build/gen/A' WHEN 3 THEN 'src/build/A' WHEN 4 THEN '.git/A'
    WHEN 5 THEN 'src/test/java/A' WHEN 6 THEN 'mod/out/A' ELSE 'lib/B' END || cast(doc_id AS string) || CASE WHEN doc_id % 3 = 0 THEN 'Test.java' ELSE '.java' END AS path FROM {documents}"""


def s1_source_tree(spark, sf_dir):
    return files.select_sources(view(spark, sf_dir, _PATHS))


def s2_fingerprints(spark, sf_dir):
    """Every text's bytes; each fifth has one more that no UTF-8 holds."""
    content = F.encode("text", "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(content, F.unhex(F.lit("FF")))).otherwise(content).alias("content"))
    return files.fingerprint(docs).select("doc_id", "sha256", "encoding", F.char_length("text").cast("long").alias("n_chars"))


def _junit(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    body = F.when(F.col("flag") == "R", F.concat(F.lit('<failure message="m'), F.col("p").cast("string"), F.lit('">at x\nat y</failure>'))).when(F.col("flag") == "A", F.when(F.col("s") % 3 == 0, F.lit('<error message=" ">first line\nat z</error><!-- <failure/> --><failure message="later"/>')).otherwise(F.lit("<error><![CDATA[first line\nat z]]></error>"))).when(F.col("n") == 1, F.lit("<skipped/>")).otherwise("")
    cls = F.when(F.col("n") % 2 == 0, F.concat(F.lit(' classname="K'), F.col("s").cast("string"), F.lit('"'))).otherwise("")
    rows = r.select("case_id", "report_id", F.col("k").cast("long").alias("place"), F.concat(F.lit("<testcase"), cls, F.lit(' name="t'), F.col("k").cast("string"), F.lit('">'), body, F.lit("</testcase>")).alias("line"))
    ends = rows.select("case_id", "report_id").distinct().withColumn("many", F.col("report_id").cast("long") % 3 == 0).select("case_id", "report_id", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("place"), F.concat(F.when(F.col("many"), '<testsuites tests="9" skipped="2">').otherwise(""), F.lit('<testsuite name="S'), F.col("report_id"), F.lit('" errors="x" tests="'), (F.col("report_id").cast("long") % 50).cast("string"), F.lit('" failures="'), (F.col("report_id").cast("long") % 4).cast("string"), F.lit('">')).alias("line")),
        F.struct(F.lit(10**6).cast("long").alias("place"), F.concat(F.when(F.col("report_id").cast("long") % 10 == 7, "<broken").otherwise(F.concat(F.lit("</testsuite>"), F.when(F.col("many"), "</testsuites>").otherwise("")))).alias("line")),
    )).alias("m")).select("case_id", "report_id", "m.*")
    return files.parse_junit(_text(rows.unionByName(ends)))


def s4_junit_totals(spark, sf_dir):
    return _junit(spark, sf_dir)[0]


def s4_junit_failures(spark, sf_dir):
    return _junit(spark, sf_dir)[1]


def s5_failing_tests(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    line = F.when(F.col("flag") == "R", F.concat(F.lit("--- p.T::t"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("at "), F.col("class_name")))
    return files.parse_failing_tests(_text(r.select("case_id", "report_id", F.col("k").alias("place"), line.alias("line"))))


def _junitcore(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    line = F.when(F.col("flag") == "R", F.concat(F.col("k").cast("string"), F.lit(") t"), F.col("p").cast("string"), F.lit("(p.T)"))).when(F.col("flag") == "A", F.concat(F.lit("at "), F.col("class_name"))).when(F.col("n") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("Tests run: "), F.col("s").cast("string"), F.lit(",  Failures: "), F.col("n").cast("string")))
    return files.parse_junitcore(_text(r.select("case_id", "report_id", F.col("k").alias("place"), line.alias("line"))))


def s6_junitcore_failures(spark, sf_dir):
    return _junitcore(spark, sf_dir)[0]


def s6_junitcore_totals(spark, sf_dir):
    return _junitcore(spark, sf_dir)[1]


def s7_listings(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    line = F.when(F.col("n") == 1, F.lit("# comment")).when(F.col("n") == 2, F.concat(F.lit("TESTNG,p.K#m"), F.col("s").cast("string"))).when(F.col("n") == 3, F.concat(F.lit("- p.L::m"), F.col("s").cast("string"))).when(F.col("n") == 4, F.lit("two words")).otherwise(F.concat(F.lit("p.M"), F.col("s").cast("string")))
    return files.parse_listings(_text(r.select("case_id", "report_id", F.col("k").alias("place"), line.alias("line")))).drop("pos").groupBy("case_id", "report_id", "framework", "class_name", "method").count()


def s8_runner_outcomes(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    line = F.concat(F.lit("[x-runner] p.K::m"), (F.col("s") % 4).cast("string"), F.lit(" "), F.when(F.col("flag") == "R", "PASS").when(F.col("flag") == "A", "FAIL").otherwise("ERROR"), F.lit(" 0.1s"))
    tests = r.select("case_id", "report_id").distinct().select("case_id", "report_id", F.explode(F.array(F.lit("p.K::m1"), F.lit("q.Z::m2"))).alias("test_id"))
    return files.runner_outcomes(_text(r.select("case_id", "report_id", F.col("k").alias("place"), line.alias("line"))), tests)


def s9_probe_lines(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    line = F.concat(F.lit("MARK m call="), (F.col("p") % 9).cast("string"), F.lit(" k"), (F.col("s") % 2).cast("string"), F.lit("=a.b.Cls@1f"), F.col("s").cast("string"))
    return files.probe_observations(_text(r.select("case_id", "report_id", F.col("k").alias("place"), line.alias("line"))), 3)


def s10_json_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("not json "), "props")).when(F.col("event_id") % 7 == 0, F.lit('{"k": ')).otherwise(F.col("props")).alias("line"))
    return files.json_rows(lines, "k int")


def _matches(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.when(F.col("p_partkey") % 6 == 0, F.lit("warning: skipped")).otherwise(F.to_json(F.struct(F.lit("operation").alias("record_type"), F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("/root/tree/")).otherwise(""), F.lit("fs/"), F.col("p_type"), F.lit(".c")).alias("file"), F.col("p_size").alias("line"), F.col("p_name").alias("api"))))
    output = p.select(F.col("p_brand").alias("case_id"), line.alias("line"))
    digests = p.select(F.col("p_brand").alias("case_id"), F.concat(F.lit("fs/"), "p_type", F.lit(".c")).alias("file"), F.md5("p_type").alias("sha256")).distinct()
    return output, digests


def s11_match_records(spark, sf_dir):
    return files.match_records(*_matches(spark, sf_dir), "/root/tree")


def s12_write_tables(spark, sf_dir):
    from ..sources.traces import report_folder
    from . import graph_queries

    entities, relations = graph_queries._graph(spark, sf_dir)
    folder = report_folder(spark)
    files.write_case_tables(folder, entities=entities, relations=relations)
    return spark.read.parquet(f"{folder}/entities").groupBy("case_id", "kind").agg(F.count("*").alias("entities"), F.countDistinct("entity_id").alias("ids"))


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] in "fs" and name[1:2].isdigit()}

_FR = "fr AS (SELECT case_id, report_id, (k - 1)::INT AS pos, class_name, method, line FROM r)"
_SKIP = "(class_name LIKE 'java.%' OR regexp_extract(class_name, '([^.]*)$', 1) LIKE '%Test%')"
_CASES = f"""{_FR}, h AS (SELECT fr.*, method_id, start_line, end_line FROM fr JOIN catalog c USING (case_id, class_name, method)),
own AS (SELECT * FROM h WHERE NOT {_SKIP} QUALIFY pos = min(pos) OVER (PARTITION BY case_id, report_id)),
best AS (SELECT case_id, report_id, pos, coalesce(arg_min(method_id, (end_line - start_line, method_id)) FILTER (start_line <= line AND line <= end_line), arg_max(method_id, (length(method_id), method_id))) AS method_id FROM own GROUP BY ALL)"""
_KFN = "CASE WHEN s % 5 = 0 THEN 'kasan_report' ELSE 'fn' || (s % 50) END"
_KERNEL = f"""kf AS (SELECT case_id, report_id, n * 1000 + k AS place, {_KFN} AS function, 'fs/f' || (p % 9) || '.c' AS file, (p % 60)::INT AS line, n = 3 AS inlined FROM r WHERE n = 1 OR n BETWEEN 3 AND 5
    UNION ALL SELECT DISTINCT case_id, report_id, -1, 'warned_fn', 'fs/w.c', 301, false FROM r WHERE report_id::BIGINT % 4 = 0),
kp AS (SELECT *, (row_number() OVER (PARTITION BY report_id ORDER BY place) - 1)::INT AS pos FROM kf)"""
_R = dict(r=_RANKED)
_RC = dict(r=_RANKED, catalog=_CATALOG)
_REP = """asked AS (SELECT * FROM fr WHERE line IS NOT NULL QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY pos) <= 64),
named AS (SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY case_id, class_name, method ORDER BY method_id) <= 20),
rm AS (SELECT a.case_id, report_id, pos, method_id, line FROM asked a JOIN named n ON n.case_id = a.case_id AND n.class_name = a.class_name AND n.method = a.method AND string_split(n.file, '/')[-1] = regexp_extract(a.class_name, '([^.]*)$', 1) || '.java' AND start_line <= line AND line <= end_line),
rep AS (SELECT * FROM rm QUALIFY count(*) OVER (PARTITION BY report_id ORDER BY pos) - count(*) OVER (PARTITION BY report_id, pos) < 12)"""
_ENT = """SELECT case_id, kind, count(*) AS entities, count(DISTINCT entity_id) AS ids FROM entities GROUP BY ALL"""
SQL = {
    "s12_write_tables": with_views(_ENT, entities=ENTITIES),
    "f1_java_frames": with_views("SELECT case_id, report_id, (k - 1)::INT AS pos, class_name, method, regexp_extract(class_name, '([^.]*)$', 1) || '.java' AS file, line FROM r", **_R),
    "f2_skipped_frames": with_views(f"SELECT case_id, report_id, count(*) FILTER {_SKIP} AS skipped, count(*) AS frames FROM r GROUP BY case_id, report_id", **_R),
    "f3_crash_attribution": with_views(f"WITH {_CASES} SELECT * FROM best", **_RC),
    "f4_kernel_frames": with_views(f"WITH {_KERNEL} SELECT case_id, report_id, pos, function, file, line, inlined FROM kp", **_R),
    "f4_kernel_location": with_views("SELECT DISTINCT case_id, report_id, 'fs/g.c' AS file, report_id::INT AS line FROM r", **_R),
    "f5_kernel_attribution": with_views(f"WITH {_KERNEL} SELECT kp.case_id, report_id, arg_min(method_id, (pos, CASE WHEN f.file = kp.file THEN 0 ELSE 1 END, method_id)) AS method_id FROM kp JOIN fns f ON f.case_id = kp.case_id AND f.name = function GROUP BY ALL", fns=_FUNCTIONS, **_R),
    "f6_failure_refresh": with_views(f"""WITH {_CASES}, e AS (SELECT case_id, report_id, CASE WHEN flag = 'A' THEN class_name WHEN flag = 'R' THEN method ELSE 'no failure text' END AS content FROM r WHERE k = 1),
ed AS (SELECT case_id, report_id, 'failure_of' AS kind, 'test:' || max(k) AS target FROM r GROUP BY ALL UNION SELECT case_id, report_id, 'reports_frame', method_id FROM best)
SELECT ed.case_id, 'report:' || ed.report_id AS source, kind, target, content FROM ed JOIN e USING (case_id, report_id)""", **_RC),
    "f7_reported_methods": with_views(f"WITH {_FR}, {_REP} SELECT * FROM rep", **_RC),
    "f7_failing_assertions": with_views(f"""WITH {_FR}, {_REP},
h AS (SELECT r.case_id, r.report_id, r.method_id, min((pos, start_line, end_line)) AS f FROM rep r JOIN assertions a ON a.case_id = r.case_id AND a.method_id = r.method_id AND start_line <= line AND line <= end_line GROUP BY ALL)
SELECT case_id, report_id, method_id, f[2] AS start_line, f[3] AS end_line, row_number() OVER (PARTITION BY report_id ORDER BY f[1], method_id)::INT AS turn FROM h""", assertions=_ASSERTIONS, **_RC),
    "f8_repair_context": with_views(f"""
WITH RECURSIVE {_FR}, {_REP}, d AS (SELECT case_id, report_id, method_id, min(pos) AS pos FROM rep GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pos DESC, method_id DESC) AS i FROM d),
t AS (SELECT case_id, report_id, left('java.lang.Error: at nothing' || chr(10) || string_agg(chr(9) || 'at ' || class_name || '.' || method || '(' || regexp_extract(class_name, '([^.]*)$', 1) || '.java' || coalesce(':' || line, '') || ')', chr(10) ORDER BY k), 200) AS head FROM r GROUP BY ALL),
f AS (SELECT case_id, report_id, head, greatest(600 - len(head), 80) AS room, '' AS doc, '' AS chain, 0 AS i FROM t
    UNION ALL SELECT f.case_id, f.report_id, head, room, CASE WHEN len(doc) < room THEN doc || chr(10) || left('// ' || method_id || chr(10) || 'body ' || method_id, room - len(doc)) ELSE doc END,
    CASE WHEN f.i = 0 THEN method_id ELSE chain || ' > ' || method_id END, o.i FROM f JOIN o ON o.report_id = f.report_id AND o.i = f.i + 1)
SELECT case_id, report_id, arg_max(chain, i) AS chain, len(head || arg_max(doc, i))::BIGINT AS n_chars, md5(head || arg_max(doc, i)) AS context_md5 FROM f GROUP BY case_id, report_id, head""", **_RC),
    "f9_run_summary": """
WITH s AS (SELECT 'c' || l_orderkey AS case_id, l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS total, sum(l_partkey % 3)::BIGINT AS failed, sum(l_suppkey % 2)::BIGINT AS errors, sum(l_linenumber % 2)::BIGINT AS skipped FROM lineitem GROUP BY ALL),
x AS (SELECT s.*, coalesce(o_custkey % 2, 0) AS code FROM s LEFT JOIN orders ON o_orderkey = l_orderkey),
y AS (SELECT * REPLACE (CASE WHEN code <> 0 THEN greatest(errors, 1 - least(failed, 1)) ELSE errors END AS errors) FROM x)
SELECT case_id, total, failed, errors::BIGINT AS errors, skipped, greatest(total - failed - errors, 0)::BIGINT AS passed, failed = 0 AND errors = 0 AND code = 0 AS success FROM y""",
    "f10_regression_comparison": with_views("""
SELECT case_id, test_id, 'fixed' AS state FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT case_id, test_id, 'introduced' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT case_id, test_id, 'remaining' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""", b=_BEFORE, a=_AFTER),
    "f10_regression_gate": with_views("""
WITH s AS (SELECT case_id, test_id, 'fixed' AS state FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT case_id, test_id, 'introduced' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT case_id, test_id, 'remaining' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)),
n AS (SELECT 'c' || c_custkey AS case_id, c_acctbal < 0 AS err, count(*) FILTER (state = 'fixed') AS fixed, count(*) FILTER (state = 'introduced') AS introduced, count(*) FILTER (state = 'remaining') AS remaining FROM customer LEFT JOIN s ON s.case_id = 'c' || c_custkey GROUP BY c_custkey, c_acctbal)
SELECT case_id, fixed, introduced, remaining, CASE WHEN err OR introduced > 0 THEN 'reject' WHEN remaining = 0 THEN 'finish' ELSE 'continue' END AS verdict FROM n""", b=_BEFORE, a=_AFTER),
    "f11_trigger_tests": with_views("SELECT DISTINCT a.case_id, a.test_id, b.test_id IS NOT NULL AS \"trigger\" FROM a LEFT JOIN (SELECT DISTINCT * FROM b) b USING (case_id, test_id)", b=_BEFORE, a=_AFTER),
    "f12_selected_test": """
WITH f AS (SELECT o_custkey, arg_min('t' || (o_orderkey % 10), o_orderkey) AS first, list('t' || (o_orderkey % 10)) AS failing FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT 'c' || c_custkey AS case_id, CASE WHEN c_nationkey % 2 <> 0 THEN first WHEN list_contains(failing, 't' || (c_custkey % 10)) THEN 't' || (c_custkey % 10) END AS selected FROM customer LEFT JOIN f ON o_custkey = c_custkey""",
    "f13_failure_digest": """
WITH d AS (SELECT source || '/' || lang AS case_id, left(string_agg(CASE WHEN len(text) > 10000 THEN left(text, 1333) || right(text, 667) ELSE left(text, 2000) END, chr(10) || chr(10) ORDER BY doc_id), 12000) AS t FROM documents GROUP BY source, lang)
SELECT case_id, len(t)::BIGINT AS n_chars, md5(t) AS digest_md5 FROM d""",
    "s1_source_tree": with_views("SELECT doc_id, path, path LIKE '%/test/%' OR path LIKE '%Test.java' AS is_test FROM p WHERE doc_id % 8 IN (0, 3, 5, 7)", p=_PATHS),
    "s2_fingerprints": """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(encode(text) || '\\xFF'::BLOB) ELSE sha256(encode(text)) END AS sha256, CASE WHEN doc_id % 5 > 0 THEN 'utf-8' ELSE 'iso-8859-1' END AS encoding, CASE WHEN doc_id % 5 = 0 THEN octet_length(encode(text)) + 1 ELSE len(text) END::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id, NULL, 'iso-8859-1', NULL FROM documents WHERE text IS NULL""",
    "s4_junit_totals": with_views("""WITH t AS (SELECT DISTINCT case_id, report_id, report_id::BIGINT AS i, report_id::BIGINT % 10 = 7 AS broken, report_id::BIGINT % 3 = 0 AS many FROM r)
SELECT case_id, report_id, CASE WHEN broken THEN 0 WHEN many AND i % 50 = 0 THEN 9 ELSE i % 50 END AS total, CASE WHEN broken THEN 0 ELSE i % 4 END AS failures, 0::BIGINT AS errors, CASE WHEN many AND NOT broken THEN 2 ELSE 0 END::BIGINT AS skipped FROM t""", **_R),
    "s4_junit_failures": with_views("""SELECT case_id, report_id, (k - 1)::INT AS pos, CASE WHEN n % 2 = 0 THEN 'K' || s WHEN report_id::BIGINT % 3 = 0 THEN 'unknown' ELSE 'S' || report_id END || '::t' || k AS test_id,
    CASE WHEN flag = 'R' THEN 'm' || p ELSE 'first line' END AS message, CASE WHEN flag = 'R' THEN 'at x' || chr(10) || 'at y' ELSE 'first line' || chr(10) || 'at z' END AS stack FROM r WHERE flag IN ('A', 'R') AND report_id::BIGINT % 10 <> 7""", **_R),
    "s5_failing_tests": with_views("""
WITH g AS (SELECT *, sum((flag = 'R')::INT) OVER (PARTITION BY report_id ORDER BY k) AS record FROM r)
SELECT case_id, report_id, record::BIGINT AS record, 'p.T::t' || min(k) AS test_id, coalesce(arg_min('at ' || class_name, k) FILTER (flag <> 'R'), '') AS message, coalesce(string_agg('at ' || class_name, chr(10) ORDER BY k) FILTER (flag <> 'R'), '') AS stack
FROM g WHERE record > 0 GROUP BY case_id, report_id, record""", **_R),
    "s6_junitcore_failures": with_views("""
WITH g AS (SELECT *, sum((flag = 'R')::INT) OVER (PARTITION BY report_id ORDER BY k) AS record FROM r),
x AS (SELECT *, max((flag NOT IN ('R', 'A') AND n % 2 = 0)::INT) OVER (PARTITION BY report_id, record ORDER BY k) AS ended FROM g WHERE record > 0)
SELECT case_id, report_id, record::BIGINT AS record, 'p.T::t' || arg_min(p, k) AS test_id, coalesce(string_agg(CASE WHEN flag = 'A' THEN 'at ' || class_name ELSE 'Tests run: ' || s || ',  Failures: ' || n END, chr(10) ORDER BY k) FILTER (flag <> 'R' AND ended = 0), '') AS stack FROM x GROUP BY case_id, report_id, record""", **_R),
    "s6_junitcore_totals": with_views("SELECT case_id, report_id, arg_max(s, k) FILTER (flag = 'N' AND n % 2 = 1)::BIGINT AS total, arg_max(n, k) FILTER (flag = 'N' AND n % 2 = 1)::BIGINT AS failures FROM r GROUP BY case_id, report_id", **_R),
    "s7_listings": with_views("""SELECT case_id, report_id, CASE n WHEN 2 THEN 'TESTNG' ELSE 'JUNIT' END AS framework, CASE n WHEN 2 THEN 'p.K' WHEN 3 THEN 'p.L' ELSE 'p.M' || s END AS class_name, CASE WHEN n <= 3 THEN 'm' || s ELSE '*' END AS method, count(*) AS count
FROM r WHERE n NOT IN (1, 4) GROUP BY ALL""", **_R),
    "s8_runner_outcomes": with_views("""
WITH l AS (SELECT case_id, report_id, k, s % 4 AS m, CASE flag WHEN 'R' THEN 'PASS' WHEN 'A' THEN 'FAIL' ELSE 'ERROR' END AS o FROM r)
SELECT case_id, report_id, 'p.K::m1' AS test_id, arg_max(o, k) FILTER (m = 1) AS outcome FROM l GROUP BY case_id, report_id UNION ALL SELECT case_id, report_id, 'q.Z::m2', arg_max(o, k) FILTER (m = 2) FROM l GROUP BY case_id, report_id""", **_R),
    "s9_probe_lines": with_views("""
WITH l AS (SELECT case_id, report_id, p % 9 AS call, s % 2 AS key, arg_max('k' || (s % 2) || '=Cls' || CASE WHEN false THEN '' ELSE '' END, k) AS v FROM r GROUP BY ALL),
c AS (SELECT case_id, report_id, call, string_agg(v, ' ' ORDER BY key) AS fields FROM l GROUP BY ALL)
SELECT case_id, report_id, 'm' AS method, call, fields, count(*) OVER w AS total, count(*) OVER w > 3 AS truncated FROM c WINDOW w AS (PARTITION BY report_id) QUALIFY dense_rank() OVER (PARTITION BY report_id ORDER BY call) <= 3""", **_R),
    "s10_json_lines": "SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0",
    "s11_match_records": "SELECT p_brand AS case_id, 'fs/' || p_type || '.c' AS file, p_size AS line, p_name AS api, md5(p_type) AS sha256 FROM part WHERE p_partkey % 6 <> 0",
}
