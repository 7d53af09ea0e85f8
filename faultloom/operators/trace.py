"""Execution traces: counts, call edges, probe order, outcomes, coverage and open frames from enter and exit events.

Events: (case_id, test_id, thread, seq, kind, method_id). The call stack is never rebuilt in a loop: with +1 for an enter and -1 for an exit, the
depth is the running sum less the least of zero and its running minimum, so exits on an empty stack are ignored; the top of the stack at
some depth is the last enter that reached it. Both are windows of (test, thread), which shuffle once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

_CALL = ["case_id", "test_id", "thread"]


def stack_events(events: DataFrame) -> DataFrame:
    """Enters with their caller and exits with the method they pop: (…, kind, method_id, depth, caller, popped).

    A start or finish on a thread clears its stack.
    """
    run = Window.partitionBy(*_CALL).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    held = events.withColumn("part", F.sum(F.col("kind").isin("start", "finish").cast("int")).over(run)).where(F.col("kind").isin("enter", "exit"))
    own = Window.partitionBy(*_CALL, "part").orderBy("seq")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("sum", F.sum(F.when(F.col("kind") == "enter", 1).otherwise(-1)).over(upto))
    held = held.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto)))
    held = held.withColumn("before", F.coalesce(F.lag("depth").over(own), F.lit(0)))
    # An enter stands at its depth for those after it, and asks for the one below; an exit asks for its own.
    ask = F.when(F.col("kind") == "enter", F.col("depth") - 1).otherwise(F.col("before"))
    sides = F.array(F.struct(F.col("depth").alias("at"), F.when(F.col("kind") == "enter", F.col("method_id")).alias("stands"), F.lit(False).alias("asks")), F.struct(ask.alias("at"), F.lit(None).cast("string").alias("stands"), F.lit(True).alias("asks")))
    spread = held.select(*_CALL, "part", "seq", "kind", "method_id", "depth", F.explode(sides).alias("s")).select("*", "s.*").drop("s").where("at > 0 OR asks")
    top = F.last("stands", ignorenulls=True).over(Window.partitionBy(*_CALL, "part", "at").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    out = spread.withColumn("top", F.when(F.col("at") > 0, top)).where("asks")
    return out.select(*_CALL, "seq", "kind", "method_id", "depth", F.when(F.col("kind") == "enter", F.col("top")).alias("caller"), F.when(F.col("kind") == "exit", F.col("top")).alias("popped"))


def hit_counts(events: DataFrame) -> DataFrame:
    return events.where("kind = 'enter'").groupBy("case_id", "test_id", "method_id").agg(F.count("*").alias("hits"))


def call_edges(stack: DataFrame) -> DataFrame:
    """Distinct (case_id, test_id, caller, callee)."""
    return stack.where("caller IS NOT NULL").select("case_id", "test_id", "caller", F.col("method_id").alias("callee")).distinct()


def probe_order(stack: DataFrame) -> DataFrame:
    """(case_id, test_id, probes): each distinct enter and each distinct exit once, in order of first appearance."""
    named = stack.select("case_id", "test_id", "seq", F.when(F.col("kind") == "enter", F.concat(F.lit("e:"), "method_id")).otherwise(F.concat(F.lit("x:"), "popped")).alias("probe")).where("probe IS NOT NULL")
    first = named.groupBy("case_id", "test_id", "probe").agg(F.min("seq").alias("seq"))
    return first.groupBy("case_id", "test_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "probe"))), lambda x: x["probe"]).alias("probes"))


def method_numbers(events: DataFrame) -> DataFrame:
    """(case_id, method_id, number): dense numbers from 0 in order of first sighting; a case's methods are ranked in ranges."""
    first = events.where("kind = 'enter'").groupBy("case_id", "method_id").agg(F.min("seq").alias("seq"))
    return numbered(first, ["case_id"], ["seq", "method_id"], "place").select("case_id", "method_id", (F.col("place") - 1).cast("int").alias("number"))


def outcomes(runs: DataFrame) -> DataFrame:
    """runs: (case_id, test_id, failed, error, runtime_ms, started_ms, finished_ms) to (…, outcome, seconds)."""
    outcome = F.when(F.col("error"), "ERROR").when(F.col("failed"), "FAIL").otherwise("PASS")
    return runs.select("case_id", "test_id", outcome.alias("outcome"), (F.coalesce("runtime_ms", F.col("finished_ms") - F.col("started_ms")) / 1000).alias("seconds"))


def sessions(events: DataFrame, limit_s: float = 300.0) -> DataFrame:
    """Sessions of a log with kinds start, enter, exit, finish, reset: (case_id, test_id, session, started, ended, outcome, reason, hits).

    A second start closes the first as an error, so do a reset and the end of the log; a session open beyond the limit ends there as an
    error; events after its end are dropped, a second finish changes nothing. The streaming twin is streaming.sessions.
    """
    own = Window.partitionBy("case_id", "test_id").orderBy("seq")
    numbered = events.withColumn("session", F.sum((F.col("kind") == "start").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))).where("session > 0")
    opened = numbered.groupBy("case_id", "test_id", "session").agg(
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("started"),
        F.min(F.when(F.col("kind").isin("finish", "reset"), F.struct("seq", "ts", "kind", "failed"))).alias("closed"),
    )
    following = F.lead("started").over(Window.partitionBy("case_id", "test_id").orderBy("session"))
    ends = opened.withColumn("next", following).withColumn("limit", F.col("started") + F.make_dt_interval(secs=F.lit(limit_s)))
    at = F.coalesce("closed.ts", "next")
    reason = (
        F.when(at.isNull() | (at > F.col("limit")), F.when(at.isNull(), "still open").otherwise("timed out"))
        .when(F.col("closed").isNull(), "replaced").when(F.col("closed.kind") == "reset", "reset").otherwise("finished")
    )
    ends = ends.withColumns({"reason": reason, "ended": F.when(at <= F.col("limit"), at).when(at.isNotNull(), F.col("limit"))})
    outcome = F.when(F.col("reason") != "finished", "ERROR").when(F.col("closed.failed"), "FAIL").otherwise("PASS")
    ends = ends.withColumn("outcome", outcome).select("case_id", "test_id", "session", "started", "ended", "outcome", "reason", F.col("closed.seq").alias("closed_seq"))
    inside = numbered.where("kind = 'enter'").select("case_id", "test_id", "session", "seq", "ts").join(ends, ["case_id", "test_id", "session"])
    live = F.col("closed_seq").isNull() | (F.col("seq") < F.col("closed_seq"))
    hits = inside.where(live & (F.col("ended").isNull() | (F.col("ts") <= F.col("ended")))).groupBy("case_id", "test_id", "session").agg(F.count("*").alias("hits"))
    return ends.drop("closed_seq").join(hits, ["case_id", "test_id", "session"], "left").fillna(0, ["hits"])


def report_rows(hits: DataFrame, edges: DataFrame, probes: DataFrame, numbers: DataFrame, sign: DataFrame) -> DataFrame:
    """The five columns of a trace report for each test: (case_id, test_id, sign, events, counts, calls)."""
    number = numbers.select("case_id", "method_id", "number")
    counts = hits.join(number, ["case_id", "method_id"]).groupBy("case_id", "test_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "hits"))), lambda x: F.concat(x["number"].cast("string"), F.lit(":"), x["hits"].cast("string"))), ",").alias("counts"))
    pairs = edges.join(number.withColumnsRenamed({"method_id": "caller", "number": "from"}), ["case_id", "caller"]).join(number.withColumnsRenamed({"method_id": "callee", "number": "to"}), ["case_id", "callee"])
    calls = pairs.groupBy("case_id", "test_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("from", "to"))), lambda x: F.concat(x["from"].cast("string"), F.lit(">"), x["to"].cast("string"))), ",").alias("calls"))
    each = probes.select("case_id", "test_id", F.posexplode("probes").alias("pos", "probe")).withColumn("method_id", F.substr("probe", F.lit(3))).join(number, ["case_id", "method_id"])
    events = each.groupBy("case_id", "test_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.left("probe", F.lit(1)), F.col("number").cast("string")).alias("t")))), lambda x: x["t"]), ",").alias("events"))
    out = sign.join(events, ["case_id", "test_id"], "left").join(counts, ["case_id", "test_id"], "left").join(calls, ["case_id", "test_id"], "left")
    return out.select("case_id", "test_id", "sign", *(F.coalesce(c, F.lit("")).alias(c) for c in ("events", "counts", "calls")))


def parsed_report(rows: DataFrame) -> DataFrame:
    """(case_id, test_id, executed: map number to hits, calls: array of (caller, callee), problems) of report rows."""
    pairs = F.filter(F.split("counts", ","), lambda x: x != "")
    counts = F.transform(pairs, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).try_cast("int").alias("number"), F.split_part(x, F.lit(":"), F.lit(2)).try_cast("int").alias("hits")))
    calls = F.transform(F.filter(F.split("calls", ","), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(">"), F.lit(1)).try_cast("int").alias("caller"), F.split_part(x, F.lit(">"), F.lit(2)).try_cast("int").alias("callee")))
    return rows.select("*", counts.alias("count_pairs"), calls.alias("call_pairs"))


def validate_report(rows: DataFrame, outcome: DataFrame) -> DataFrame:
    """(case_id, test_id, problem): the first broken rule of each test's report, or null.

    One row a test; FAIL or ERROR; counts above zero; both ends of a call executed; some method executed.
    """
    once = rows.groupBy("case_id", "test_id").agg(F.count("*").alias("rows"))
    held = parsed_report(rows).dropDuplicates(["case_id", "test_id"]).join(once, ["case_id", "test_id"])
    executed = F.transform("count_pairs", lambda x: x["number"])
    loose = F.exists("call_pairs", lambda c: ~F.coalesce(F.array_contains(executed, c["caller"]) & F.array_contains(executed, c["callee"]), F.lit(False)))
    problem = (
        F.when(F.col("rows") != 1, "not one row").when(~F.col("outcome").isin("FAIL", "ERROR") | F.col("outcome").isNull(), "did not fail")
        .when(F.exists("count_pairs", lambda x: F.coalesce(x["hits"], F.lit(0)) <= 0), "bad count").when(loose, "call end not executed").when(F.size("count_pairs") == 0, "no method")
    )
    return held.join(outcome, ["case_id", "test_id"], "left").select("case_id", "test_id", problem.alias("problem"))


def coverage(asked: DataFrame, hits: DataFrame, prefixes: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(case_id, test_id, method_id, covered, calls): true if counted; false if the owner lies under an include prefix; null if neither or ambiguous.

    prefixes: (case_id, test_id, prefixes: array), one row a test.
    """
    held = asked.join(hits, ["case_id", "test_id", "method_id"], "left").join(prefixes, ["case_id", "test_id"], "left")
    held = held.join(ambiguous.select("case_id", "method_id", F.lit(True).alias("unclear")).distinct(), ["case_id", "method_id"], "left")
    owner = F.split_part("method_id", F.lit("#"), F.lit(1))
    within = F.exists("prefixes", lambda p: F.startswith(owner, p))
    covered = F.when(F.col("unclear") | F.contains("method_id", F.lit("@")), None).when(F.col("hits").isNotNull(), True).when(within, False)
    return held.withColumn("covered", covered).select("case_id", "test_id", "method_id", "covered", F.when(F.col("covered").isNotNull(), F.coalesce("hits", F.lit(0))).alias("calls"))


def observed_calls(static: DataFrame, covered: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, test_id, caller, callee, observed): null where the coverage of an end is unknown."""
    end = lambda side: covered.select("case_id", "test_id", F.col("method_id").alias(side), F.col("covered").alias(f"{side}_covered"))
    seen = edges.select("case_id", "test_id", "caller", "callee", F.lit(True).alias("seen"))
    held = static.join(end("caller"), ["case_id", "caller"]).join(end("callee"), ["case_id", "test_id", "callee"]).join(seen, ["case_id", "test_id", "caller", "callee"], "left")
    known = F.col("caller_covered").isNotNull() & F.col("callee_covered").isNotNull()
    return held.select("case_id", "test_id", "caller", "callee", F.when(known, F.coalesce("seen", F.lit(False))).alias("observed"))


def trace_summary(hits: DataFrame, edges: DataFrame, outcome: DataFrame) -> DataFrame:
    """(case_id, test_id, status, outcome, methods, calls, seconds)."""
    m = hits.groupBy("case_id", "test_id").agg(F.count("*").alias("methods"))
    c = edges.groupBy("case_id", "test_id").agg(F.count("*").alias("calls"))
    held = outcome.join(m, ["case_id", "test_id"], "left").join(c, ["case_id", "test_id"], "left").fillna(0, ["methods", "calls"])
    return held.select("case_id", "test_id", F.when(F.col("methods") > 0, "success").otherwise("failed").alias("status"), "outcome", "methods", "calls", F.round("seconds", 3).alias("seconds"))


def open_frames(events: DataFrame) -> DataFrame:
    """(case_id, test_id, method_id): the last enter without an exit of its method, else the method of the last event."""
    own = Window.partitionBy("case_id", "test_id", "method_id").orderBy("seq")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    held = events.where("kind IN ('enter', 'exit')").withColumn("sum", F.sum(F.when(F.col("kind") == "enter", 1).otherwise(-1)).over(upto))
    held = held.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto)))
    held = held.withColumn("later", F.min("depth").over(own.rowsBetween(1, Window.unboundedFollowing)))
    is_open = (F.col("kind") == "enter") & (F.col("later").isNull() | (F.col("later") >= F.col("depth")))
    return held.groupBy("case_id", "test_id").agg(F.coalesce(F.max_by("method_id", F.when(is_open, F.col("seq"))), F.max_by("method_id", "seq")).alias("method_id"))
