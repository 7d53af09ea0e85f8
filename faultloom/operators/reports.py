"""Failure reports: stack frames, kernel oopses, attribution to methods, run summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import numbered_lines
from .lineage import cut_lineage
from .spans import over_lines

#: Packages whose frames are skipped. A test runner's own package is a parameter of `skipped_frame`.
SKIPPED_PREFIXES = [
    "java.", "javax.", "jdk.", "sun.", "org.junit.", "junit.", "org.hamcrest.", "org.testng.", "com.sun.",
    "org.apache.maven.", "org.apache.tools.ant.",
]
#: Kernel functions whose frames are skipped.
SKIPPED_KERNEL = [
    "memcpy", "memcpy_orig", "memmove", "memset", "memcmp", "__memcpy", "__memmove", "__memset",
    "copy_user_generic_unrolled", "copy_user_enhanced_fast_string",
    "entry_SYSCALL_64", "entry_SYSCALL_64_after_hwframe", "do_syscall_64", "do_syscall_x64",
    "error_entry", "exc_page_fault", "asm_exc_page_fault", "page_fault_oops",
    "__die", "die", "oops_end", "kmem_cache_alloc", "kmem_cache_free",
    "dump_stack", "dump_stack_lvl", "__dump_stack", "__warn", "warn_slowpath_fmt", "warn_slowpath_null",
    "ubsan_epilogue", "__ubsan_handle_shift_out_of_bounds", "kasan_report", "__kasan_report", "print_report", "kasan_report_invalid_free",
    "_raw_spin_lock_irqsave", "_raw_spin_unlock_irqrestore", "write_comp_data", "__sanitizer_cov_trace_pc",
]
#: Fixed value: system call wrappers, whose frames are skipped as well.
SKIPPED_KERNEL_PREFIX = "__x64_sys_"

#: Fixed pattern: a frame of a Java stack trace.
_FRAME = r"^\s*at\s+([\w.$]+)\.([\w$<>]+)\(([^:)]+)(?::(\d+))?\)\s*$"


def java_frames(reports: DataFrame) -> DataFrame:
    """(case_id, report_id, pos, class_name, method, file, line) of "at class.method(file:line)" lines, positions among the frames."""
    lines = numbered_lines(reports, "case_id", "report_id").where(F.col("line").rlike(_FRAME))
    part = lambda i: F.regexp_extract("line", _FRAME, i)
    pos = F.row_number().over(Window.partitionBy("case_id", "report_id").orderBy("pos")) - 1
    return lines.select("case_id", "report_id", pos.alias("pos"), part(1).alias("class_name"), part(2).alias("method"), part(3).alias("file"), part(4).try_cast("int").alias("line"))


def skipped_frame(class_name: Column, runner: tuple[str, ...] = ()) -> Column:
    """Whether a frame is the platform's, a framework's or a test's; runner: further package prefixes."""
    simple = F.regexp_extract(class_name, r"([^.]*)$", 1)
    return F.exists(F.array(*map(F.lit, [*SKIPPED_PREFIXES, *runner])), lambda p: F.startswith(class_name, p)) | F.contains(simple, F.lit("Test"))


def qualification(method_id: Column) -> Column:
    """Orders ids by how much they say: slashes, dollars, length, then the id."""
    count = lambda c: F.length(method_id) - F.length(F.replace(method_id, F.lit(c), F.lit("")))
    return F.struct(count("/").alias("slashes"), count("$").alias("dollars"), F.length(method_id).alias("length"), method_id.alias("id"))


def attribute_java(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """(case_id, report_id, method_id, pos): of the first frame that is not skipped and has a candidate of its class and method.

    catalog: (case_id, method_id, class_name, method, start_line, end_line). A method named as its class is the constructor "<init>". Several candidates: those whose lines hold the frame's,
    the narrowest, then by id; else the most qualified.
    """
    simple = F.regexp_extract("class_name", r"([^.$]*)$", 1)
    own = frames.where(~skipped_frame(F.col("class_name"))).withColumn("method", F.when(F.col("method") == simple, "<init>").otherwise(F.col("method")))
    # Candidates of one range of lines, and of one name, keep the best of them; frames meet these by equality.
    key = ["case_id", "class_name", "method"]
    best = F.max(qualification(F.col("method_id"))).alias("most")
    ranges = cut_lineage(catalog.groupBy(*key, F.col("start_line").alias("lo"), F.col("end_line").alias("hi")).agg(F.min("method_id").alias("method_id"), best))
    named = cut_lineage(ranges.groupBy(*key).agg(F.max("most").alias("most")).select(*key, F.col("most.id").alias("plain")))
    known = own.join(named.select(*key), key, "left_semi")
    first = known.groupBy("case_id", "report_id").agg(F.min_by(F.struct("pos", "class_name", "method", "line"), "pos").alias("f"))
    first = cut_lineage(first.select("case_id", "report_id", "f.*"))
    width = F.struct((F.col("hi") - F.col("lo")).alias("width"), "method_id")
    narrow = over_lines(first.where("line IS NOT NULL"), ranges, key, [F.min(width).alias("narrow")], [F.min("narrow").alias("narrow")])
    narrow = cut_lineage(narrow.select(*key, "line", F.col("narrow.method_id").alias("narrow")))
    held = first.join(named, key).join(narrow, [*key, "line"], "left")
    return held.select("case_id", "report_id", "pos", F.coalesce("narrow", "plain").alias("method_id"))


#: Fixed patterns: a warning's site, an instruction pointer and a frame of a kernel report.
_WARNING = r"WARNING:.*?\bat\s+(\S+\.[cS]):(\d+)\s+([A-Za-z_][\w.]*)"
_RIP = r"^RIP:\s+\S+:([A-Za-z_][\w.]*)(?:\+0x[0-9a-fA-F]+/0x[0-9a-fA-F]+)?(?:\s+(\S+\.[cS])(?::(\d+))?)?"
_OOPS = r"^(?:\? )?([A-Za-z_][\w.]*)(?:\+0x[0-9a-fA-F]+/0x[0-9a-fA-F]+)?(?:\s+(\S+\.[chS])(?::(\d+))?)?"


def kernel_symbol(name: Column) -> Column:
    """A function without the compiler's .cold, .isra, .part, .constprop or .llvm parts."""
    return F.regexp_replace(name, r"\.(?:cold|isra|part|constprop|llvm)\b.*$", "")


def kernel_frames(reports: DataFrame) -> DataFrame:
    """(case_id, report_id, pos, function, file, line, inlined) of kernel reports.

    A warning's site comes first; RIP lines count until the trace ends; frames count between "Call Trace:" or "backtrace:" and "</TASK>".
    """
    run = Window.partitionBy("case_id", "report_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = numbered_lines(reports, "case_id", "report_id")
    bare = F.trim(F.regexp_replace("line", r"^\s*(?:\[[^\]]*\]\s*){1,2}(?!<)", ""))
    lines = lines.withColumn("bare", F.when(F.trim("line").startswith("[") & ~F.trim("line").startswith("[<"), bare).otherwise(F.trim("line")))
    opens = F.contains("bare", F.lit("Call Trace:")) | F.startswith(F.lower("bare"), F.lit("backtrace:"))
    lines = lines.withColumn("opened", F.max(opens.cast("int")).over(run))
    lines = lines.withColumn("closed", F.max(((F.col("opened") == 1) & (F.col("bare") == "</TASK>")).cast("int")).over(run)).withColumn("opens", opens)
    clean = F.regexp_replace("bare", r"^\s*(?:\[<[^>]+>\]\s*)+", "")
    rip = F.startswith("bare", F.lit("RIP:"))
    part = lambda i: F.when(F.col("rip"), F.regexp_extract("bare", _RIP, i)).otherwise(F.regexp_extract("clean", _OOPS, i))
    held = lines.withColumns({"rip": rip, "clean": clean}).where("closed = 0")
    inside = (F.col("opened") == 1) & ~F.col("opens") & ~F.col("bare").isin("<TASK>", "Modules linked in:", "") & ~F.startswith("bare", F.lit("---"))
    body = held.where(F.col("rip") | inside).select("case_id", "report_id", "pos", part(1).alias("function"), part(2).alias("file"), part(3).try_cast("int").alias("line"), (~F.col("rip") & F.contains("clean", F.lit("[inline]"))).alias("inlined")).where("function <> ''")
    head = reports.where(F.col("text").rlike(_WARNING)).select("case_id", "report_id", F.lit(-1).alias("pos"), F.regexp_extract("text", _WARNING, 3).alias("function"), F.regexp_extract("text", _WARNING, 1).alias("file"), F.regexp_extract("text", _WARNING, 2).try_cast("int").alias("line"), F.lit(False).alias("inlined"))
    both = head.unionByName(body)
    rank = F.row_number().over(Window.partitionBy("case_id", "report_id").orderBy("pos")) - 1
    symbol = F.when(F.col("pos") < 0, F.col("function")).otherwise(kernel_symbol(F.col("function")))
    return both.select("case_id", "report_id", rank.alias("pos"), symbol.alias("function"), F.when(F.col("file") != "", F.col("file")).alias("file"), "line", "inlined")


def kernel_location(reports: DataFrame) -> DataFrame:
    """(case_id, report_id, file, line) that a UBSAN, KASAN or BUG header names."""
    mark = r"(?:UBSAN|KASAN|BUG)[^\n]*?\bin\s+(\S+\.[cS]):(\d+)"
    return reports.where(F.col("text").rlike(mark)).select("case_id", "report_id", F.regexp_extract("text", mark, 1).alias("file"), F.regexp_extract("text", mark, 2).cast("int").alias("line"))


def attribute_kernel(frames: DataFrame, functions: DataFrame) -> DataFrame:
    """(case_id, report_id, method_id): of the first frame with a candidate, in its file if one is, else the lowest id.

    functions: (case_id, method_id, name, file).
    """
    own = frames.where(~F.col("function").isin(SKIPPED_KERNEL) & ~F.startswith("function", F.lit(SKIPPED_KERNEL_PREFIX)))
    # The lowest id of each name, and of each name in a file, are all that a frame can choose.
    here = cut_lineage(functions.groupBy("case_id", F.col("name").alias("function"), "file").agg(F.min("method_id").alias("here")))
    named = cut_lineage(here.groupBy("case_id", "function").agg(F.min("here").alias("lowest")))
    held = own.join(named, ["case_id", "function"]).join(here, ["case_id", "function", "file"], "left")
    first = F.min(F.struct("pos", F.col("here").isNull().alias("away"), F.coalesce("here", "lowest").alias("method_id")))
    return held.groupBy("case_id", "report_id").agg(first.alias("f")).select("case_id", "report_id", "f.method_id")


def failure_context(failing: DataFrame, tests: DataFrame, crash: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report entities and their edges: (case_id, entity_id, kind, content) and (case_id, source, kind, target).

    A report's text is its stack, else its message, else a constant; its test is the last one indexed under its id.
    """
    text = F.coalesce(F.nullif("stack", F.lit("")), F.nullif("message", F.lit("")), F.lit("no failure text"))
    entities = failing.select("case_id", F.concat(F.lit("report:"), "test_id").alias("entity_id"), F.lit("crash_report").alias("kind"), text.alias("content"))
    last = tests.groupBy("case_id", "test_id").agg(F.max_by("entity_id", F.col("indexed")).alias("entity_id"))
    report = F.concat(F.lit("report:"), "test_id")
    of = failing.join(last, ["case_id", "test_id"]).select("case_id", report.alias("source"), F.lit("failure_of").alias("kind"), F.col("entity_id").alias("target"))
    at = crash.select("case_id", F.concat(F.lit("report:"), "report_id").alias("source"), F.lit("reports_frame").alias("kind"), F.col("method_id").alias("target"))
    return entities, of.unionByName(at).distinct()


def reported_methods(frames: DataFrame, catalog: DataFrame, most_frames: int = 64, most: int = 12, most_named: int = 20) -> DataFrame:
    """(case_id, report_id, pos, method_id, line): the methods that hold a frame's line, by class, name and file.

    Of a report the first `most_frames` frames with a line in a .java file are looked up, in order, until `most` methods are found; those of the frame that reaches it all count. Of
    a class's methods of one name the first `most_named` by id are looked at, whatever their files.
    catalog: (case_id, method_id, class_name, method, file, start_line, end_line), file with its folders.
    """
    asked = frames.where(F.col("line").isNotNull() & F.endswith("file", F.lit(".java")))
    asked = asked.withColumn("n", F.row_number().over(Window.partitionBy("case_id", "report_id").orderBy("pos"))).where(F.col("n") <= most_frames).drop("n")
    named = catalog.withColumn("n", F.row_number().over(Window.partitionBy("case_id", "class_name", "method").orderBy("method_id"))).where(F.col("n") <= most_named)
    named = named.select("case_id", "class_name", "method", "method_id", F.regexp_extract("file", r"([^/]*)$", 1).alias("file"), "start_line", "end_line")
    held = asked.join(named, ["case_id", "class_name", "method", "file"]).where("start_line <= line AND line <= end_line").select("case_id", "report_id", "pos", "method_id", "line")
    before = F.count("*").over(Window.partitionBy("case_id", "report_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1))
    return held.withColumn("before", before).where(F.col("before") < most).drop("before")


def failing_assertions(reported: DataFrame, assertions: DataFrame, bin_width: int = 64) -> DataFrame:
    """(case_id, report_id, method_id, start_line, end_line, turn): of each reported method the first assertion that a reported line lies in, numbered in order of frames.

    assertions: (case_id, method_id, start_line, end_line) of assertion statements, listed in the bins of lines that they touch.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start_line") / bin_width), F.floor(F.col("end_line") / bin_width)))
    spans = assertions.where("start_line <= end_line").select("case_id", "method_id", "start_line", "end_line", bins.alias("bin"))
    hit = reported.withColumn("bin", F.floor(F.col("line") / bin_width)).join(spans, ["case_id", "method_id", "bin"]).where("start_line <= line AND line <= end_line")
    first = hit.groupBy("case_id", "report_id", "method_id").agg(F.min(F.struct("pos", "start_line", "end_line")).alias("f"))
    turn = F.row_number().over(Window.partitionBy("case_id", "report_id").orderBy("f.pos", "method_id"))
    return first.select("case_id", "report_id", "method_id", "f.start_line", "f.end_line", turn.alias("turn"))


def repair_context(failing: DataFrame, reported: DataFrame, texts: DataFrame, budget: int = 6000, clip: int = 2000, least: int = 800) -> DataFrame:
    """(case_id, report_id, chain, context): the failure's text, then the sources of the distinct reported methods from the outermost in.

    A source is cut to what is left of the budget, of which `least` characters are kept for the first one.
    """
    first = reported.groupBy("case_id", "report_id", "method_id").agg(F.min("pos").alias("pos"))
    held = first.join(texts, ["case_id", "method_id"], "left")
    chain = held.groupBy("case_id", "report_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("pos", "method_id", F.coalesce("text", F.lit("")).alias("text"))))).alias("chain"))
    out = failing.select("case_id", "report_id", F.left("text", F.lit(clip)).alias("head")).join(chain, ["case_id", "report_id"], "left")
    room = F.greatest(F.lit(budget) - F.length("head"), F.lit(least))
    start = F.struct(F.lit("").alias("doc"))
    step = lambda s, x: F.struct(F.when(F.length(s["doc"]) < room, F.concat(s["doc"], F.lit("\n"), F.left(F.concat(F.lit("// "), x["method_id"], F.lit("\n"), x["text"]), (room - F.length(s["doc"])).cast("int")))).otherwise(s["doc"]).alias("doc"))
    body = F.aggregate(F.coalesce("chain", F.array()), start, step)["doc"]
    return out.select("case_id", "report_id", F.array_join(F.transform(F.coalesce("chain", F.array()), lambda x: x["method_id"]), " > ").alias("chain"), F.concat("head", body).alias("context"))


def run_summary(suites: DataFrame, exits: DataFrame) -> DataFrame:
    """(case_id, total, failed, errors, skipped, passed, success); a bad exit code makes one error at least."""
    sums = suites.groupBy("case_id").agg(*(F.sum(c).alias(c) for c in ("total", "failures", "errors", "skipped"))).join(exits, "case_id", "left")
    errors = F.when(F.coalesce("exit_code", F.lit(0)) != 0, F.greatest("errors", F.lit(1) - F.least("failures", F.lit(1)))).otherwise(F.col("errors"))
    out = sums.withColumn("errors", errors)
    return out.select("case_id", "total", F.col("failures").alias("failed"), "errors", "skipped", F.greatest(F.col("total") - F.col("failures") - F.col("errors"), F.lit(0)).alias("passed"), ((F.col("failures") == 0) & (F.col("errors") == 0) & (F.coalesce("exit_code", F.lit(0)) == 0)).alias("success"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, test_id, state) of failing tests: fixed, introduced or remaining. One full outer join."""
    b = before.select("case_id", "test_id", F.lit(True).alias("b")).distinct()
    a = after.select("case_id", "test_id", F.lit(True).alias("a")).distinct()
    state = F.when(F.col("a").isNull(), "fixed").when(F.col("b").isNull(), "introduced").otherwise("remaining")
    return b.join(a, ["case_id", "test_id"], "full").select("case_id", "test_id", state.alias("state"))


def regression_gate(compared: DataFrame, runs: DataFrame) -> DataFrame:
    """(case_id, fixed, introduced, remaining, verdict): reject on an execution error or new failures, finish without any failure, else continue."""
    of = compared.groupBy("case_id").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("fixed", "introduced", "remaining")))
    held = runs.join(of, "case_id", "left").fillna(0, ["fixed", "introduced", "remaining"])
    verdict = F.when(F.col("execution_error") | (F.col("introduced") > 0), "reject").when(F.col("remaining") == 0, "finish").otherwise("continue")
    return held.select("case_id", "fixed", "introduced", "remaining", verdict.alias("verdict"))


def flag_triggers(tests: DataFrame, triggers: DataFrame) -> DataFrame:
    return tests.join(triggers.select("case_id", "test_id", F.lit(True).alias("trigger")).distinct(), ["case_id", "test_id"], "left").withColumn("trigger", F.coalesce("trigger", F.lit(False)))


def select_test(cases: DataFrame, failures: DataFrame) -> DataFrame:
    """(case_id, selected): the case's explicit test if it still fails, none if it does not; without one, the first failure."""
    first = failures.groupBy("case_id").agg(F.min_by("test_id", "pos").alias("first"), F.collect_set("test_id").alias("failing"))
    held = cases.join(first, "case_id", "left")
    return held.select("case_id", F.when(F.col("explicit").isNull(), F.col("first")).when(F.array_contains("failing", F.col("explicit")), F.col("explicit")).alias("selected"))


def failure_digest(reports: DataFrame, each: int = 2000, whole: int = 12_000, long: int = 100_000) -> DataFrame:
    """(case_id, digest): reports in order, each clipped, joined and clipped; of a long one, two thirds from its head and one from its tail."""
    cut = F.when(F.length("text") > long, F.concat(F.left("text", F.lit(each * 2 // 3)), F.right("text", F.lit(each - each * 2 // 3)))).otherwise(F.left("text", F.lit(each)))
    listed = F.array_sort(F.collect_list(F.struct("pos", cut.alias("text"))))
    return reports.groupBy("case_id").agg(F.left(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n"), F.lit(whole)).alias("digest"))
