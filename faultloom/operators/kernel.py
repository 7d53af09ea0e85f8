"""Kernel evidence: symbols, coverage, resources of programs, operations, and names that say nothing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .spans import over_lines


def resolve_symbols(symbols: DataFrame, functions: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, symbol, method_id, candidates): by alias, else by the name without compiler parts if it is unique."""
    held = symbols.select("case_id", "symbol").distinct().withColumn("name", F.regexp_replace("symbol", r"\.(?:isra|constprop|part)\.\d+.*$", ""))
    by_name = functions.groupBy("case_id", "name").agg(F.min("method_id").alias("only"), F.count("*").alias("candidates"))
    out = held.join(known.select("case_id", F.col("alias").alias("symbol"), F.col("method_id").alias("aliased")), ["case_id", "symbol"], "left").join(by_name, ["case_id", "name"], "left")
    return out.select("case_id", "symbol", F.coalesce("aliased", F.when(F.col("candidates") == 1, F.col("only"))).alias("method_id"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def merge_coverage(functions: DataFrame, covered: DataFrame, calls: DataFrame, complete: DataFrame) -> DataFrame:
    """(case_id, method_id, status, syscalls, unassigned): covered: (case_id, call, method_id), call null or "extra" without a program call.

    status: observed; not_observed only where the case's coverage is complete; else unavailable. syscalls: distinct indices of program calls.
    """
    known = calls.select("case_id", F.col("call_index").cast("string").alias("call"), "call_index")
    held = covered.join(known, ["case_id", "call"], "left")
    own = held.groupBy("case_id", "method_id").agg(F.array_sort(F.collect_set("call_index")).alias("syscalls"), F.max(F.coalesce(F.col("call") == "extra", F.lit(False))).alias("unassigned"))
    out = functions.join(own, ["case_id", "method_id"], "left").join(complete, "case_id", "left")
    status = F.when(F.col("syscalls").isNotNull(), "observed").when(F.col("coverage_complete"), "not_observed").otherwise("unavailable")
    return out.select("case_id", "method_id", status.alias("status"), F.array_join(F.transform(F.coalesce("syscalls", F.array().cast("array<int>")), lambda x: x.cast("string")), ",").alias("syscalls"), F.coalesce("unassigned", F.lit(False)).alias("unassigned"))


def unknown_calls(covered: DataFrame, calls: DataFrame) -> DataFrame:
    """(case_id, call, rows) of coverage of calls that the program does not have."""
    known = calls.select("case_id", F.col("call_index").cast("string").alias("call"))
    return covered.where("call <> 'extra'").join(known, ["case_id", "call"], "left_anti").groupBy("case_id", "call").agg(F.count("*").alias("rows"))


def observed_edges(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """(case_id, caller, callee, count) of (case_id, caller, callee, count) by symbols, where both resolve; a missing count is 1."""
    end = lambda side: resolved.where("method_id IS NOT NULL").select("case_id", F.col("symbol").alias(side), F.col("method_id").alias(f"{side}_id"))
    held = edges.join(end("caller"), ["case_id", "caller"]).join(end("callee"), ["case_id", "callee"])
    return held.groupBy("case_id", F.col("caller_id").alias("caller"), F.col("callee_id").alias("callee")).agg(F.sum(F.coalesce("count", F.lit(1))).alias("count"))


def provenance_problems(manifests: DataFrame) -> DataFrame:
    """(case_id, problem): manifests: (case_id, commit, executed_commit, sha, executed_sha, has_manifest). Commits agree if one begins with the other."""
    same = F.startswith("commit", "executed_commit") | F.startswith("executed_commit", "commit")
    problem = F.when(~F.col("has_manifest"), "manifest missing").when(~same, "other commit").when(F.col("sha") != F.col("executed_sha"), "other reproducer")
    return manifests.select("case_id", problem.alias("problem"))


def imported_matches_problems(imports: DataFrame, digests: DataFrame, roots: DataFrame, indexed: DataFrame, version: int = 1) -> DataFrame:
    """(case_id, import_id, problem, file): why imported matches can't be taken, null if they can.

    imports: (case_id, import_id, schema_version, source_root); digests: (case_id, import_id, file, sha256) of the files they were made from; roots: (case_id, indexed_root);
    indexed: (case_id, file, sha256). In this order: another schema, another source root (where one is indexed), the first file that is indexed with other content.
    """
    other = digests.alias("d").join(indexed.select("case_id", "file", F.col("sha256").alias("now")), ["case_id", "file"]).where("now <> d.sha256 OR d.sha256 IS NULL AND now IS NOT NULL")
    first = other.groupBy("case_id", "import_id").agg(F.min("file").alias("changed"))
    held = imports.join(roots, "case_id", "left").join(first, ["case_id", "import_id"], "left")
    moved = F.col("indexed_root").isNotNull() & ~F.col("source_root").eqNullSafe(F.col("indexed_root"))
    problem = F.when(~F.col("schema_version").eqNullSafe(F.lit(version)), "other schema").when(moved, "other source root").when(F.col("changed").isNotNull(), "other content")
    return held.select("case_id", "import_id", problem.alias("problem"), F.when(problem == "other content", F.col("changed")).alias("file"))


def definition_uses(definitions: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (case_id, reference, call, defined_by) of uses to the definition by an earlier call, null if there is none; references defined twice."""
    twice = definitions.groupBy("case_id", "reference").agg(F.count("*").alias("definitions")).where("definitions > 1")
    d = definitions.select("case_id", "reference", F.col("call").alias("defined"))
    held = uses.join(d, ["case_id", "reference"], "left")
    best = held.groupBy("case_id", "reference", "call").agg(F.max(F.when(F.col("defined") < F.col("call"), F.col("defined"))).alias("defined_by"))
    return best, twice


#: Characters of program texts that a worker scans before it gives out their calls.
_PIECE = 200_000
_SCANNED = "struct<calls:array<struct<call_index:int,name:string,arguments:string,definitions:array<struct<reference:string,position:string>>,uses:array<struct<reference:string,position:string>>>>,error:string>"


def scan_programs(programs: DataFrame) -> DataFrame:
    """(case_id, calls, error) of program texts (case_id, text), each scanned once as a whole.

    A call is "[rN = ]name(arguments)" and may go over several lines: a line ends it only where no bracket is open. Quotes and comments hide what is in them; what follows
    the closing bracket is no argument. "<rN=>" within arguments defines rN; positions are "return" or "arguments@offset" in characters. A program that can't be read to its end has
    no calls but an error, so that calls are never numbered anew: unclosed string, unbalanced brackets, no call, unclosed call. A null text has neither.
    """

    @F.pandas_udf(_SCANNED)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # Calls take many times their text's memory, so a batch is given out in pieces.
        for part in texts:
            for begin, end in _pieces(part, _PIECE):
                found = [_scan(t or "") for t in part.iloc[begin:end]]
                yield pd.DataFrame({"calls": [c for c, _ in found], "error": [e for _, e in found]}, dtype=object)

    return programs.select("case_id", scan("text").alias("s")).select("case_id", "s.*")


def _pieces(texts: pd.Series, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that end with the first text to bring them to `most` characters; an empty series is one run."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts) or not len(texts):
        yield begin, len(texts)


def program_calls(scanned: DataFrame) -> DataFrame:
    """(case_id, call_index, name, arguments, definitions, uses) of scanned programs without an error."""
    return scanned.where("error IS NULL").select("case_id", F.explode("calls").alias("c")).select("case_id", "c.*")


def program_errors(scanned: DataFrame) -> DataFrame:
    """(case_id, error) of scanned programs that are malformed."""
    return scanned.where("error IS NOT NULL").select("case_id", "error")


#: Strings and comments; a quote that nothing closes is left as the last kind.
_HIDDEN = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|#[^\n]*|(?P<loose>[\"'])", re.S)
_CALL_HEAD = re.compile(r"\s*(?:(r\d+)\s*=\s*)?([A-Za-z_][\w$]*)\s*\(")
_DEFINES = re.compile(r"<\s*(r\d+)\s*=>")


def _scan(text: str) -> tuple[list[dict], str | None]:
    """Calls of a program, or an error."""
    if any(m["loose"] for m in _HIDDEN.finditer(text)):
        return [], "unclosed string"
    plain = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text) + "\n"
    calls, begin, depth = [], 0, 0
    for mark in re.finditer(r"[\n()\[\]{}]", plain):
        depth += (mark[0] in "([{") - (mark[0] in ")]}")
        if depth < 0:
            return [], "unbalanced brackets"
        if mark[0] != "\n" or depth:
            continue
        segment, at, begin = plain[begin : mark.start()], begin, mark.end()
        if not segment.strip():
            continue
        head = _CALL_HEAD.match(segment)
        if head is None:
            return [], "no call"
        # The bracket that closes the call: where as many round ones are closed as opened.
        inner = 1
        close = next((m.start() for m in re.finditer(r"[()]", segment[head.end() :]) if not (inner := inner + (1 if m[0] == "(" else -1))), None)
        if close is None:
            return [], "unclosed call"
        body = segment[head.end() : head.end() + close]
        defined = [(m[1], m.start(), m.end()) for m in _DEFINES.finditer(body)]
        used = [(m[0], m.start()) for m in re.finditer(r"\br\d+\b", body) if not any(a <= m.start() < b for _, a, b in defined)]
        place = lambda r, i: {"reference": r, "position": f"arguments@{i}"}
        own = [{"reference": head[1], "position": "return"}] if head[1] else []
        calls.append({"call_index": len(calls), "name": head[2], "arguments": text[at + head.end() : at + head.end() + close], "definitions": [*own, *(place(r, a) for r, a, _ in defined)], "uses": [place(*u) for u in used]})
    return ([], "unbalanced brackets") if depth else (calls, None)


def reproducer_calls(calls: DataFrame, allowed: DataFrame) -> DataFrame:
    """(case_id, call_index, name): allowed calls of a C reproducer in order; an ioctl is named with its command."""
    named = F.when((F.col("name") == "ioctl") & F.col("command").isNotNull(), F.concat(F.lit("ioctl$"), "command")).otherwise(F.col("name"))
    kept = calls.join(allowed, "name", "left_semi")
    return kept.select("case_id", (F.row_number().over(Window.partitionBy("case_id").orderBy("pos")) - 1).alias("call_index"), named.alias("name"))


def containing_function(operations: DataFrame, functions: DataFrame) -> DataFrame:
    """Operations (case_id, operation_id, file, line) with method_id where exactly one function holds the line, and the number that do.

    Functions (case_id, file, method_id, start_line, end_line) are numbered, so that a block of lines keeps their count and one number.
    """
    own = functions.select("case_id", "file", "method_id", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    own = cut_lineage(own.withColumn("one", F.monotonically_increasing_id()))
    part, total = [F.count("*").alias("n"), F.min("one").alias("one")], [F.sum("n").alias("holders"), F.min("one").alias("one")]
    held = over_lines(operations, own.drop("method_id"), ["case_id", "file"], part, total)
    held = held.withColumn("one", F.when(F.col("holders") == 1, F.col("one"))).join(own.select("one", "method_id"), "one", "left")
    out = operations.select("case_id", "operation_id", "file", "line").distinct().join(held, ["case_id", "file", "line"], "left")
    return out.select("case_id", "operation_id", "file", "line", F.coalesce("holders", F.lit(0)).alias("holders"), "method_id")


def snippet(text: Column, line: Column, around: int = 2) -> Column:
    """Lines line - around .. line + around of a text, lines counted from 1."""
    first = F.greatest(line - around, F.lit(1))
    return F.array_join(F.slice(F.split(text, "\n"), first, line + around - first + 1), "\n")


def operation_pairs(pairs: DataFrame, located: DataFrame) -> DataFrame:
    """Pairs (case_id, from_file, from_line, to_file, to_line) both of whose sites are known and lie in one function."""
    known = cut_lineage(located.where("method_id IS NOT NULL").select("case_id", "file", "line", "method_id").distinct())
    end = lambda side: known.select("case_id", F.col("file").alias(f"{side}_file"), F.col("line").alias(f"{side}_line"), F.col("method_id").alias(f"{side}_method"))
    held = pairs.join(end("from"), ["case_id", "from_file", "from_line"]).join(end("to"), ["case_id", "to_file", "to_line"])
    return held.where("from_method = to_method").select("case_id", "from_file", "from_line", "to_file", "to_line", F.col("from_method").alias("method_id")).distinct()


#: Words that say nothing about a report's subject.
STOP_WORDS = [
    "address", "alloc", "allocated", "atomic", "cache", "call", "check", "close", "code", "cpu", "error", "file", "freed", "include", "index",
    "kernel", "memory", "object", "page", "path", "read", "report", "size", "source", "stack", "task", "trace", "value", "write",
]


#: Functions and macros that say nothing about where a failure lies.
GENERIC_FUNCTIONS = [
    "memcpy", "memcpy_orig", "memmove", "memset", "memcmp", "__memcpy", "__memmove", "__memset", "copy_user_generic_unrolled", "copy_user_enhanced_fast_string",
    "entry_SYSCALL_64", "entry_SYSCALL_64_after_hwframe", "do_syscall_64", "do_syscall_x64", "error_entry", "exc_page_fault", "asm_exc_page_fault", "page_fault_oops",
    "dump_stack", "dump_stack_lvl", "__dump_stack", "__warn", "ubsan_epilogue", "kasan_report", "__die", "die", "oops_end", "kmem_cache_alloc", "kmem_cache_free",
    "kmalloc", "kzalloc", "kfree", "kvfree", "printk", "printf", "snprintf", "sprintf", "strlen", "strcpy", "strcmp", "strncmp", "BUG", "WARN", "WARN_ON",
    "pr_err", "pr_warn", "pr_info", "pr_debug", "pr_emerg", "pr_warn_ratelimited", "IS_ERR", "PTR_ERR", "ERR_PTR", "WARN_ON_ONCE", "BUG_ON", "likely", "unlikely",
    "READ_ONCE", "WRITE_ONCE", "container_of", "ARRAY_SIZE", "offsetof", "min", "max", "min_t", "max_t",
]


def telling_name(name: Column, generic: list[str] | None = None) -> Column:
    """Whether a function's name says where a failure lies: four characters or more, not generic, not all capitals, no system call's entry and no builtin."""
    capitals = (F.upper(name) == name) & name.rlike("[A-Z]")
    return (F.char_length(name) >= 4) & ~name.isin(GENERIC_FUNCTIONS if generic is None else generic) & ~capitals & ~F.startswith(name, F.lit("__x64_sys_")) & ~F.startswith(name, F.lit("__builtin_"))


def report_names(reports: DataFrame, generic: list[str] | None = None) -> DataFrame:
    """(case_id, pos, name) of the functions that a report names as "name()", in order, each once; names that say nothing are passed over."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(\)")))
    return reports.select("case_id", F.posexplode(F.filter(names, lambda n: telling_name(n, generic))).alias("pos", "name"))
