"""Queries of the trace operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, trace
from ..sources import traces
from ..streaming.sessions import stream_sessions
from .domain import table, view, with_views

#: Events as probes: a user is a test, an error an exit, all others enters of a method named by type and k.
_PROBES = """
SELECT 'c' || cast(user_id % 5 AS string) AS case_id, cast(user_id AS string) AS test_id, cast(event_id % 2 AS string) AS thread, event_id AS seq, ts,
    CASE WHEN event_type = 'error' THEN 'exit' ELSE 'enter' END AS kind, 'p.' || event_type || '#m' || cast(cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 6 AS string) AS method_id FROM {events}"""
#: The same with sessions: a signup starts, a purchase finishes, of which one of high value is a failure; a worthless click resets.
_LOG = """
SELECT 'c' || cast(user_id % 5 AS string) AS case_id, cast(user_id AS string) AS test_id, event_id AS seq, ts, value > 20 AS failed,
    CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'exit' WHEN 'click' THEN CASE WHEN value < 1 THEN 'reset' ELSE 'enter' END ELSE 'enter' END AS kind FROM {events}"""
_RUNS = """
SELECT 'c' || cast(o_custkey % 5 AS string) AS case_id, cast(o_orderkey AS string) AS test_id, o_orderstatus = 'F' AS failed, o_orderpriority = '1-URGENT' AS error,
    CASE WHEN o_orderkey % 3 > 0 THEN cast(o_totalprice AS bigint) END AS runtime_ms, o_orderkey AS started_ms, o_orderkey + o_custkey AS finished_ms FROM {orders}"""
_LIMIT_S = 2 * 86_400


def _probes(spark, sf_dir):
    return view(spark, sf_dir, _PROBES)


def _outcomes(spark, sf_dir):
    tests = _probes(spark, sf_dir).groupBy("case_id", "test_id").agg(F.count("*").alias("n"))
    return tests.select("case_id", "test_id", F.when(F.col("n") % 3 == 0, "PASS").otherwise("FAIL").alias("outcome"), (F.col("n") / 7).alias("seconds"))


def _report(spark, sf_dir):
    p = _probes(spark, sf_dir)
    stack = trace.stack_events(p)
    sign = _outcomes(spark, sf_dir).select("case_id", "test_id", F.when(F.col("outcome") == "PASS", "+").otherwise("-").alias("sign"))
    return trace.report_rows(trace.hit_counts(p), trace.call_edges(stack), trace.probe_order(stack), trace.method_numbers(p), sign)


def t1_hit_counts(spark, sf_dir):
    return trace.hit_counts(_probes(spark, sf_dir))


def t2_call_edges(spark, sf_dir):
    return trace.call_edges(trace.stack_events(_probes(spark, sf_dir)))


def t3_probe_order(spark, sf_dir):
    return trace.probe_order(trace.stack_events(_probes(spark, sf_dir))).select("case_id", "test_id", F.array_join("probes", ",").alias("probes"))


def t4_method_numbers(spark, sf_dir):
    return trace.method_numbers(_probes(spark, sf_dir))


def t5_outcomes(spark, sf_dir):
    return trace.outcomes(view(spark, sf_dir, _RUNS))


def t6_sessions(spark, sf_dir):
    return trace.sessions(view(spark, sf_dir, _LOG), _LIMIT_S).select("case_id", "test_id", "session", "outcome", "reason")


def t6_stream_sessions(spark, sf_dir):
    """The sessions as a stream of the events' file, until all of it is read."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = table(spark, sf_dir, "events").schema
    log = spark.sql(_LOG, events=spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    folder = traces.report_folder(spark)
    q = stream_sessions(log, _LIMIT_S).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(f"{folder}/out").select("case_id", "test_id", "session", "outcome", "reason", "hits")


def t7_late_events(spark, sf_dir):
    return trace.sessions(view(spark, sf_dir, _LOG), 1e9).select("case_id", "test_id", "session", "hits")


def t8_timeouts(spark, sf_dir):
    out = trace.sessions(view(spark, sf_dir, _LOG), _LIMIT_S)
    return out.groupBy("case_id", "reason").agg(F.count("*").alias("sessions"), F.sum("hits").alias("hits"), F.max("ended").alias("last_end"))


def t9_validation(spark, sf_dir):
    rows = _report(spark, sf_dir)
    broken = rows.withColumn("counts", F.when(F.col("test_id").cast("int") % 7 == 0, F.concat("counts", F.lit(",0:0"))).otherwise(F.col("counts")))
    broken = broken.withColumn("calls", F.when(F.col("test_id").cast("int") % 11 == 0, F.concat("calls", F.lit(",99>0"))).otherwise(F.col("calls")))
    return trace.validate_report(broken, _outcomes(spark, sf_dir))


def _coverage(spark, sf_dir):
    p = _probes(spark, sf_dir)
    hits = trace.hit_counts(p)
    methods = p.select("case_id", "method_id").distinct()
    asked = p.select("case_id", "test_id").distinct().join(methods, "case_id")
    prefixes = p.groupBy("case_id", "test_id").agg(F.when(F.col("test_id").cast("int") % 2 == 0, F.array(F.lit("p.view"), F.lit("p.click"))).otherwise(F.array(F.lit("p.error"))).alias("prefixes"))
    return trace.coverage(asked, hits, prefixes, methods.where("method_id LIKE '%#m5'"))


def t10_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir)


def _observed(spark, sf_dir):
    p = _probes(spark, sf_dir)
    edges = trace.call_edges(trace.stack_events(p))
    return trace.observed_calls(edges.select("case_id", "caller", "callee").distinct(), _coverage(spark, sf_dir), edges)


def t11_observed_calls(spark, sf_dir):
    return _observed(spark, sf_dir).groupBy("case_id", "caller", "callee").agg(F.count_if("observed").alias("seen"), F.count_if(~F.col("observed")).alias("unseen"), F.count_if(F.col("observed").isNull()).alias("unknown"))


def t12_trace_summary(spark, sf_dir):
    p = _probes(spark, sf_dir)
    return trace.trace_summary(trace.hit_counts(p), trace.call_edges(trace.stack_events(p)), _outcomes(spark, sf_dir))


def t13_open_frames(spark, sf_dir):
    return trace.open_frames(_probes(spark, sf_dir))


def n3_neighbours_with_execution(spark, sf_dir):
    """Candidate calls, as neighbours of the caller, with the coverage of the neighbour and whether the call was observed."""
    seen = _observed(spark, sf_dir)
    cov = _coverage(spark, sf_dir).select("case_id", "test_id", F.col("method_id").alias("callee"), "covered")
    out = seen.join(cov, ["case_id", "test_id", "callee"]).groupBy("case_id", "caller", "callee").agg(F.max("covered").alias("covered"), F.max("observed").alias("observed_call"))
    return out.withColumnsRenamed({"caller": "node", "callee": "neighbour"})


def s3_read_trace_reports(spark, sf_dir):
    folder = traces.report_folder(spark)
    traces.write_reports(_report(spark, sf_dir), trace.method_numbers(_probes(spark, sf_dir)), _outcomes(spark, sf_dir), folder)
    return traces.read_trace(spark, folder)


def s13_write_trace_reports(spark, sf_dir):
    return _report(spark, sf_dir)


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] in "tns" and name[1:2].isdigit()}

_STACK = """
r AS (SELECT *, sum(CASE WHEN kind = 'enter' THEN 1 ELSE -1 END) OVER w AS s FROM probes WINDOW w AS (PARTITION BY case_id, test_id, thread ORDER BY seq)),
d AS (SELECT *, s - least(0, min(s) OVER w) AS depth FROM r WINDOW w AS (PARTITION BY case_id, test_id, thread ORDER BY seq)),
b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY case_id, test_id, thread ORDER BY seq), 0) AS before FROM d),
en AS (SELECT case_id, test_id, thread, depth AS at, seq AS eseq, method_id AS top FROM b WHERE kind = 'enter'),
k AS (SELECT b.*, en.top FROM b ASOF LEFT JOIN en ON b.case_id = en.case_id AND b.test_id = en.test_id AND b.thread = en.thread
    AND en.at = CASE WHEN kind = 'enter' THEN depth - 1 ELSE before END AND b.seq > en.eseq)"""
_EDGES = "ed AS (SELECT DISTINCT case_id, test_id, top AS caller, method_id AS callee FROM k WHERE kind = 'enter' AND depth > 1)"
_HITS = "h AS (SELECT case_id, test_id, method_id, count(*) AS hits FROM probes WHERE kind = 'enter' GROUP BY ALL)"
_NUM = "num AS (SELECT case_id, method_id, (row_number() OVER (PARTITION BY case_id ORDER BY seq, method_id) - 1)::INT AS number FROM (SELECT case_id, method_id, min(seq) AS seq FROM probes WHERE kind = 'enter' GROUP BY ALL))"
_OUT = "o AS (SELECT case_id, test_id, CASE WHEN count(*) % 3 = 0 THEN 'PASS' ELSE 'FAIL' END AS outcome, count(*) / 7 AS seconds FROM probes GROUP BY ALL)"
_PROBE = "pr AS (SELECT case_id, test_id, probe, min(seq) AS seq FROM (SELECT case_id, test_id, seq, CASE WHEN kind = 'enter' THEN 'e:' || method_id WHEN before > 0 THEN 'x:' || top END AS probe FROM k) WHERE probe IS NOT NULL GROUP BY ALL)"
_REPORT = f"""{_STACK}, {_EDGES}, {_HITS}, {_NUM}, {_OUT}, {_PROBE},
ev AS (SELECT pr.case_id, test_id, string_agg(probe[1] || number, ',' ORDER BY seq) AS events FROM pr JOIN num ON num.case_id = pr.case_id AND num.method_id = probe[3:] GROUP BY ALL),
ct AS (SELECT h.case_id, test_id, string_agg(number || ':' || hits, ',' ORDER BY number) AS counts FROM h JOIN num USING (case_id, method_id) GROUP BY ALL),
ca AS (SELECT ed.case_id, test_id, string_agg(a.number || '>' || b.number, ',' ORDER BY a.number, b.number) AS calls FROM ed JOIN num a ON a.case_id = ed.case_id AND a.method_id = caller JOIN num b ON b.case_id = ed.case_id AND b.method_id = callee GROUP BY ALL),
rep AS (SELECT o.case_id, o.test_id, CASE outcome WHEN 'PASS' THEN '+' ELSE '-' END AS sign, coalesce(events, '') AS events, coalesce(counts, '') AS counts, coalesce(calls, '') AS calls
    FROM o LEFT JOIN ev USING (case_id, test_id) LEFT JOIN ct USING (case_id, test_id) LEFT JOIN ca USING (case_id, test_id))"""
_COV = """
m AS (SELECT DISTINCT case_id, method_id FROM probes), te AS (SELECT DISTINCT case_id, test_id FROM probes),
hh AS (SELECT case_id, test_id, method_id, count(*) AS hits FROM probes WHERE kind = 'enter' GROUP BY ALL),
cov AS (SELECT te.case_id, te.test_id, m.method_id, hits, CASE WHEN m.method_id LIKE '%#m5' THEN NULL WHEN hits IS NOT NULL THEN true
    WHEN test_id::INT % 2 = 0 AND (m.method_id LIKE 'p.view%' OR m.method_id LIKE 'p.click%') OR test_id::INT % 2 = 1 AND m.method_id LIKE 'p.error%' THEN false END AS covered
    FROM te JOIN m USING (case_id) LEFT JOIN hh USING (case_id, test_id, method_id))"""
_OBS = f"""{_STACK}, {_EDGES}, {_COV}, st AS (SELECT DISTINCT case_id, caller, callee FROM ed),
ob AS (SELECT st.case_id, a.test_id, st.caller, st.callee, b.covered, CASE WHEN a.covered IS NOT NULL AND b.covered IS NOT NULL THEN ed.caller IS NOT NULL END AS observed
    FROM st JOIN cov a ON a.case_id = st.case_id AND a.method_id = st.caller JOIN cov b ON b.case_id = st.case_id AND b.method_id = st.callee AND b.test_id = a.test_id
    LEFT JOIN ed ON ed.case_id = st.case_id AND ed.test_id = a.test_id AND ed.caller = st.caller AND ed.callee = st.callee)"""
_SES = f"""
n AS (SELECT *, sum((kind = 'start')::INT) OVER (PARTITION BY case_id, test_id ORDER BY seq) AS session FROM log QUALIFY session > 0),
op AS (SELECT case_id, test_id, session, min(ts) FILTER (kind = 'start') AS started, arg_min(ts, seq) FILTER (kind IN ('finish', 'reset')) AS cts, arg_min(kind, seq) FILTER (kind IN ('finish', 'reset')) AS ck,
    arg_min(failed, seq) FILTER (kind IN ('finish', 'reset')) AS cf, min(seq) FILTER (kind IN ('finish', 'reset')) AS cs FROM n GROUP BY ALL),
nx AS (SELECT *, coalesce(cts, lead(started) OVER (PARTITION BY case_id, test_id ORDER BY session)) AS fin, started + to_seconds(LIMIT_S) AS lim FROM op),
se AS (SELECT *, CASE WHEN fin IS NULL THEN 'still open' WHEN fin > lim THEN 'timed out' WHEN ck IS NULL THEN 'replaced' WHEN ck = 'reset' THEN 'reset' ELSE 'finished' END AS reason,
    CASE WHEN fin IS NULL THEN NULL ELSE least(fin, lim) END AS ended FROM nx),
hi AS (SELECT n.case_id, n.test_id, n.session, count(*) AS hits FROM n JOIN se USING (case_id, test_id, session) WHERE kind = 'enter' AND (cs IS NULL OR seq < cs) AND (ended IS NULL OR ts <= ended) GROUP BY ALL)"""
_L = dict(log=_LOG)
_P = dict(probes=_PROBES)
SQL = {
    "t1_hit_counts": with_views(f"WITH {_HITS} SELECT * FROM h", **_P),
    "t2_call_edges": with_views(f"WITH {_STACK}, {_EDGES} SELECT * FROM ed", **_P),
    "t3_probe_order": with_views(f"WITH {_STACK}, {_PROBE} SELECT case_id, test_id, string_agg(probe, ',' ORDER BY seq) AS probes FROM pr GROUP BY ALL", **_P),
    "t4_method_numbers": with_views(f"WITH {_NUM} SELECT * FROM num", **_P),
    "t5_outcomes": with_views("SELECT case_id, test_id, CASE WHEN error THEN 'ERROR' WHEN failed THEN 'FAIL' ELSE 'PASS' END AS outcome, coalesce(runtime_ms, finished_ms - started_ms) / 1000 AS seconds FROM runs", runs=_RUNS.replace("cast(o_totalprice AS bigint)", "cast(trunc(o_totalprice) AS bigint)")),
    "t6_sessions": with_views(f"WITH {_SES} SELECT case_id, test_id, session::BIGINT AS session, CASE WHEN reason <> 'finished' THEN 'ERROR' WHEN cf THEN 'FAIL' ELSE 'PASS' END AS outcome, reason FROM se".replace("LIMIT_S", str(_LIMIT_S)), **_L),
    "t6_stream_sessions": with_views(f"""WITH {_SES}, mx AS (SELECT max(ts) AS m FROM log),
st AS (SELECT *, CASE WHEN reason = 'still open' THEN 'timed out' ELSE reason END AS r2 FROM se, mx WHERE reason <> 'still open' OR lim < m - INTERVAL 10 MINUTE),
h2 AS (SELECT n.case_id, n.test_id, n.session, count(*) AS hits FROM n JOIN st USING (case_id, test_id, session) WHERE kind = 'enter' AND (cs IS NULL OR seq < cs) AND ts <= coalesce(ended, lim) GROUP BY ALL)
SELECT st.case_id, st.test_id, st.session::INT AS session, CASE WHEN r2 <> 'finished' THEN 'ERROR' WHEN cf THEN 'FAIL' ELSE 'PASS' END AS outcome, r2 AS reason, coalesce(hits, 0) AS hits FROM st LEFT JOIN h2 USING (case_id, test_id, session)""".replace("LIMIT_S", str(_LIMIT_S)), **_L),
    "t7_late_events": with_views(f"WITH {_SES} SELECT se.case_id, se.test_id, se.session::BIGINT AS session, coalesce(hits, 0) AS hits FROM se LEFT JOIN hi USING (case_id, test_id, session)".replace("LIMIT_S", "1000000000"), **_L),
    "t8_timeouts": with_views(f"WITH {_SES} SELECT se.case_id, reason, count(*) AS sessions, sum(coalesce(hits, 0))::BIGINT AS hits, max(ended) AS last_end FROM se LEFT JOIN hi USING (case_id, test_id, session) GROUP BY ALL".replace("LIMIT_S", str(_LIMIT_S)), **_L),
    "t9_validation": with_views(f"""WITH {_REPORT} SELECT rep.case_id, rep.test_id, CASE WHEN outcome = 'PASS' THEN 'did not fail' WHEN test_id::INT % 7 = 0 THEN 'bad count' WHEN test_id::INT % 11 = 0 THEN 'call end not executed' WHEN counts = '' THEN 'no method' END AS problem FROM rep JOIN o USING (case_id, test_id)""", **_P),
    "t10_coverage": with_views(f"WITH {_COV} SELECT case_id, test_id, method_id, covered, CASE WHEN covered IS NOT NULL THEN coalesce(hits, 0) END AS calls FROM cov", **_P),
    "t11_observed_calls": with_views(f"WITH {_OBS} SELECT case_id, caller, callee, count(*) FILTER (observed) AS seen, count(*) FILTER (NOT observed) AS unseen, count(*) FILTER (observed IS NULL) AS unknown FROM ob GROUP BY case_id, caller, callee", **_P),
    "t12_trace_summary": with_views(f"""WITH {_STACK}, {_EDGES}, {_HITS}, {_OUT} SELECT o.case_id, o.test_id, CASE WHEN coalesce(m, 0) > 0 THEN 'success' ELSE 'failed' END AS status, outcome, coalesce(m, 0) AS methods, coalesce(c, 0) AS calls, round(seconds, 3) AS seconds
FROM o LEFT JOIN (SELECT case_id, test_id, count(*) AS m FROM h GROUP BY ALL) USING (case_id, test_id) LEFT JOIN (SELECT case_id, test_id, count(*) AS c FROM ed GROUP BY ALL) USING (case_id, test_id)""", **_P),
    "t13_open_frames": with_views("""
WITH r AS (SELECT *, sum(CASE WHEN kind = 'enter' THEN 1 ELSE -1 END) OVER (PARTITION BY case_id, test_id, method_id ORDER BY seq) AS s FROM probes),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY case_id, test_id, method_id ORDER BY seq)) AS depth FROM r),
l AS (SELECT *, min(depth) OVER (PARTITION BY case_id, test_id, method_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM d)
SELECT case_id, test_id, coalesce(arg_max(method_id, seq) FILTER (kind = 'enter' AND coalesce(later >= depth, true)), arg_max(method_id, seq)) AS method_id FROM l GROUP BY ALL""", **_P),
    "n3_neighbours_with_execution": with_views(f"WITH {_OBS} SELECT case_id, caller AS node, callee AS neighbour, max(covered) AS covered, max(observed) AS observed_call FROM ob GROUP BY case_id, caller, callee", **_P),
    "s3_read_trace_reports": with_views(f"""WITH {_REPORT}, t AS (SELECT case_id, test_id, outcome, round(seconds, 3) AS seconds FROM o), c AS (SELECT case_id, test_id, unnest(string_split(counts, ',')) AS p FROM rep WHERE counts <> '')
SELECT c.case_id, c.test_id, method_id, string_split(p, ':')[2]::BIGINT AS hits, outcome FROM c JOIN num ON num.case_id = c.case_id AND number = string_split(p, ':')[1]::INT JOIN t ON t.case_id = c.case_id AND t.test_id = c.test_id""", **_P),
    "s13_write_trace_reports": with_views(f"WITH {_REPORT} SELECT * FROM rep", **_P),
}
