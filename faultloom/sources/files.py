"""Source trees, test reports and tool output as tables, and the tables of a case on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of directories that hold no sources of their own.
BUILD_DIRS = [".git", ".gradle", ".idea", ".mvn", "target", "out", "node_modules", "VUL4J"]


def read_tree(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """(path, content) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "content")


def select_sources(files: DataFrame) -> DataFrame:
    """Files (…, path) outside hidden and build folders, with is_test; "build" is one only where no earlier part is src or source."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) & (F.length(p) > 1))
    built = F.exists(folders, lambda p: p.isin(BUILD_DIRS))
    at = F.array_position(folders, "build")
    before = F.slice(folders, 1, F.greatest(at - 1, F.lit(0)).cast("int"))
    loose = (at > 0) & ~F.exists(before, lambda p: p.isin("src", "source"))
    test = F.exists(folders, lambda p: p.isin("test", "tests")) | F.element_at(parts, -1).rlike(r"Tests?\.java$")
    return files.where(~hidden & ~built & ~loose).withColumn("is_test", test)


def fingerprint(files: DataFrame) -> DataFrame:
    """Files (…, content) with sha256, encoding (utf-8 if it decodes, else iso-8859-1) and text."""
    raw = F.col("content").cast("string")
    valid = F.is_valid_utf8(raw)
    return files.withColumns({"sha256": F.sha2("content", 256), "encoding": F.when(valid, "utf-8").otherwise("iso-8859-1"), "text": F.when(valid, raw).otherwise(F.decode("content", "ISO-8859-1"))})


def numbered_lines(texts: DataFrame, *keys: str) -> DataFrame:
    """(…keys, pos, line) of texts (…keys, text), positions from 0."""
    return texts.select(*keys, F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line"))


_BAD = "array<struct<_message:string,_VALUE:string>>"
_COUNTS = "_tests:string,_failures:string,_errors:string,_skipped:string"
_CORRUPT = "unreadable"
#: A test case's element, whatever stands in its strings, CDATA sections and comments.
_TEST_CASE = r"""(?s)(<testcase\b(?:[^>"']|"[^"]*"|'[^']*')*?(?:/>|>(?:<!\[CDATA\[.*?\]\]>|<!--.*?-->|[^<]++|<(?!/testcase\b|!\[CDATA\[|!--))*+</testcase\s*>))"""
_CDATA_OR_COMMENT = r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->"


def parse_junit(reports: DataFrame, modified_after: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Totals (case_id, report_id, total, failures, errors, skipped) and failing cases (case_id, report_id, pos, test_id, message, stack).

    Totals are the attributes of a <testsuite>, or sums of those right below <testsuites>, or if such a sum is nought the root's own; an attribute that is no number counts nought. Cases at any
    depth fail by their first <failure> or <error>; a case's class falls back to the root's name, then, as its own name does, to "unknown"; an empty message to the first line of the
    stack. A report that isn't well-formed, or is of another kind, has noughts and no cases. modified_after: of reports with a column `modified`, only those no older are read.
    """
    own = reports if modified_after is None else reports.where(F.col("modified") >= modified_after)
    keep = {"columnNameOfCorruptRecord": _CORRUPT, "mode": "PERMISSIVE"}
    root = F.from_xml("text", f"_name string, {_COUNTS.replace(':', ' ')}, testsuite array<struct<{_COUNTS}>>, {_CORRUPT} string", keep)
    tag = F.regexp_extract("text", r"(?s)^\ufeff?(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<([A-Za-z_][\w.-]*)", 1)
    held = own.select("case_id", "report_id", "text", root.alias("root"), tag.alias("tag"))
    sound = F.col("root").isNotNull() & F.col(f"root.{_CORRUPT}").isNull()
    number = lambda c: F.coalesce(F.trim(c).try_cast("long"), F.lit(0).cast("long"))

    def count(name: str) -> Column:
        top = number(F.col(f"root._{name}"))
        below = F.aggregate(F.coalesce("root.testsuite", F.array().cast(f"array<struct<{_COUNTS}>>")), F.lit(0).cast("long"), lambda n, s: n + number(s[f"_{name}"]))
        found = F.when(F.col("tag") == "testsuites", F.when(below > 0, below).otherwise(top)).otherwise(top)
        return F.coalesce(F.when(sound, found), F.lit(0).cast("long"))

    totals = held.select("case_id", "report_id", *(count(n).alias(out) for n, out in (("tests", "total"), ("failures", "failures"), ("errors", "errors"), ("skipped", "skipped"))))
    # Comments go first, as they may hold whole cases; in CDATA sections nothing is a comment.
    bare = F.regexp_replace("text", r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->", "$1")
    each = held.where(sound).select("case_id", "report_id", F.col("root._name").alias("root_name"), F.posexplode(F.regexp_extract_all(bare, F.lit(_TEST_CASE), 1)).alias("pos", "case"))
    kind = F.regexp_extract(F.regexp_replace("case", _CDATA_OR_COMMENT, ""), r"<(failure|error)[\s/>]", 1)
    parsed = each.withColumn("kind", kind).where("kind <> ''").withColumn("c", F.from_xml("case", f"_classname string, _name string, failure {_BAD}, error {_BAD}"))
    first = F.element_at(F.when(F.col("kind") == "failure", F.col("c.failure")).otherwise(F.col("c.error")), 1)
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    stack, message = trimmed(first["_VALUE"]), trimmed(first["_message"])
    unknown = F.lit("unknown")
    return totals, parsed.select(
        "case_id", "report_id", "pos", F.concat(F.coalesce("c._classname", "root_name", unknown), F.lit("::"), F.coalesce("c._name", unknown)).alias("test_id"),
        F.when(message != "", message).otherwise(trimmed(F.element_at(F.split(stack, r"\r\n|\r|\n"), 1))).alias("message"), stack.alias("stack"),
    )


def parse_failing_tests(reports: DataFrame) -> DataFrame:
    """(case_id, report_id, record, test_id, message, stack) of texts in which "--- id" opens a record; the message is its first line."""
    lines = numbered_lines(reports, "case_id", "report_id")
    run = Window.partitionBy("case_id", "report_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("record", F.sum(F.startswith("line", F.lit("--- ")).cast("int")).over(run)).where("record > 0")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.startswith("line", F.lit("--- ")), F.struct("pos", "line")))), lambda x: x["line"])
    head = F.max(F.when(F.startswith("line", F.lit("--- ")), F.trim(F.substr("line", F.lit(5)))))
    out = held.groupBy("case_id", "report_id", "record").agg(head.alias("test_id"), body.alias("body"))
    return out.select("case_id", "report_id", "record", "test_id", F.coalesce(F.get("body", F.lit(0)), F.lit("")).alias("message"), F.rtrim(F.array_join("body", "\n")).alias("stack"))


def parse_junitcore(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failures (case_id, report_id, record, test_id, stack) and totals (case_id, report_id, total, failures), the last summary holding."""
    lines = numbered_lines(reports, "case_id", "report_id")
    run = Window.partitionBy("case_id", "report_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    header = F.regexp_extract("line", r"^\d+\) (\S+)\((\S+)\)$", 1)
    held = lines.withColumns({"method": header, "cls": F.regexp_extract("line", r"^\d+\) (\S+)\((\S+)\)$", 2)})
    held = held.withColumn("record", F.sum((F.col("method") != "").cast("int")).over(run))
    own = Window.partitionBy("case_id", "report_id", "record").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("ended", F.max((F.trim("line") == "").cast("int")).over(own))
    stack = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("method") == "") & (F.col("ended") == 0), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    failures = held.where("record > 0").groupBy("case_id", "report_id", "record").agg(F.max(F.when(F.col("method") != "", F.concat("cls", F.lit("::"), "method"))).alias("test_id"), stack.alias("stack"))
    good, bad = F.regexp_extract("line", r"^OK \((\d+) tests?\)", 1), r"^Tests run: (\d+),\s+Failures: (\d+)"
    found = F.when(good != "", F.struct(good.cast("long").alias("total"), F.lit(0).cast("long").alias("failures"))).when(F.regexp_extract("line", bad, 1) != "", F.struct(F.regexp_extract("line", bad, 1).cast("long").alias("total"), F.regexp_extract("line", bad, 2).cast("long").alias("failures")))
    totals = lines.withColumn("s", found).groupBy("case_id", "report_id").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("pos"))).alias("s")).select("case_id", "report_id", "s.*")
    return failures, totals


def split_test_id(test_id: Column) -> Column:
    """(class, method) of Class::method or Class#method, else (id, "*")."""
    sep = F.when(F.contains(test_id, F.lit("::")), "::").when(F.contains(test_id, F.lit("#")), "#")
    cls = F.when(sep.isNull(), test_id).otherwise(F.split_part(test_id, F.coalesce(sep, F.lit("::")), F.lit(1)))
    return F.struct(cls.alias("class_name"), F.when(sep.isNull(), "*").otherwise(F.split_part(test_id, F.coalesce(sep, F.lit("::")), F.lit(2))).alias("method"))


def parse_listings(listings: DataFrame) -> DataFrame:
    """(case_id, report_id, pos, framework, class_name, method) of "FRAMEWORK,Class#method", "- test" and bare lines.

    Comments, banners and lines with inner white space go; the framework is JUNIT unless named.
    """
    line = F.trim("line")
    comma = F.contains(line, F.lit(","))
    test = F.when(comma, F.trim(F.split_part(line, F.lit(","), F.lit(2)))).when(F.startswith(line, F.lit("- ")), F.trim(F.substr(line, F.lit(3)))).otherwise(line)
    framework = F.when(comma & (F.trim(F.split_part(line, F.lit(","), F.lit(1))) != ""), F.upper(F.trim(F.split_part(line, F.lit(","), F.lit(1))))).otherwise("JUNIT")
    held = numbered_lines(listings, "case_id", "report_id").where((line != "") & ~F.startswith(line, F.lit("#")) & ~F.startswith(line, F.lit("[")))
    held = held.select("case_id", "report_id", "pos", framework.alias("framework"), test.alias("test")).where(~F.col("test").rlike(r"\s") & (F.col("test") != ""))
    return held.select("case_id", "report_id", "pos", "framework", split_test_id(F.col("test")).alias("t")).select("case_id", "report_id", "pos", "framework", "t.*")


def runner_outcomes(reports: DataFrame, tests: DataFrame) -> DataFrame:
    """(case_id, report_id, test_id, outcome): of lines "[…-runner] id PASS|FAIL|ERROR" the last whose id ends with the test's, else the last that holds its method."""
    lines = numbered_lines(reports, "case_id", "report_id")
    mark = r"^\[[^\]]*runner\]\s+(\S+)\s+(PASS|FAIL|ERROR)\b"
    seen = lines.select("case_id", "report_id", "pos", F.regexp_extract("line", mark, 1).alias("id"), F.regexp_extract("line", mark, 2).alias("outcome")).where("id <> ''")
    held = tests.select("case_id", "report_id", "test_id", split_test_id(F.col("test_id"))["method"].alias("method")).join(seen, ["case_id", "report_id"])
    exact, close = F.endswith("id", F.replace("test_id", F.lit("#"), F.lit("::"))), F.contains("id", "method")
    best = held.withColumn("rank", F.when(exact, 2).when(close, 1)).where("rank IS NOT NULL")
    found = best.groupBy("case_id", "report_id", "test_id").agg(F.max_by("outcome", F.struct("rank", "pos")).alias("outcome"))
    return tests.select("case_id", "report_id", "test_id").join(found, ["case_id", "report_id", "test_id"], "left")


def probe_observations(outputs: DataFrame, max_calls: int = 20) -> DataFrame:
    """(case_id, report_id, method, call, fields, total, truncated) of lines "MARK method call=N key=value".

    Of a call, the last value of each key holds; the lowest max_calls call numbers stay; "pkg.Class@hex" shows as "Class".
    """
    lines = numbered_lines(outputs, "case_id", "report_id")
    mark = r"^MARK (\S+) call=(\d+) ([^=\s]+)=(.*)$"
    seen = lines.select("case_id", "report_id", "pos", *(F.regexp_extract("line", mark, i).alias(n) for i, n in ((1, "method"), (2, "number"), (3, "key"), (4, "value")))).where("key <> ''")
    shown = F.regexp_replace("value", r"\b(?:[a-z_][\w]*\.)+([A-Z][\w$]*)@[0-9a-f]+", "$1")
    last = seen.groupBy("case_id", "report_id", "method", F.col("number").cast("long").alias("call"), "key").agg(F.max_by(shown, "pos").alias("value"))
    calls = last.groupBy("case_id", "report_id", "method", "call").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ").alias("fields"))
    own = Window.partitionBy("case_id", "report_id")
    ranked = calls.withColumns({"rank": F.dense_rank().over(own.orderBy("call")), "total": F.count("*").over(own)})
    return ranked.withColumn("truncated", F.max("rank").over(own) > max_calls).where(F.col("rank") <= max_calls).drop("rank")


def json_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Objects of JSON lines (…, line); lines that are no object are passed over."""
    kept = lines.where(F.trim("line").startswith("{"))
    parsed = kept.withColumn("o", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("o._bad IS NULL").select(*(c for c in lines.columns if c != "line"), "o.*").drop("_bad")


def match_records(output: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Static-analysis matches (case_id, file, line, api, sha256) of JSON lines, their paths relative to the root, with the digest of each touched file."""
    rows = json_rows(output, "record_type string, file string, line int, api string").where("record_type = 'operation'")
    prefix = F.lit(root.rstrip("/") + "/")
    rows = rows.withColumn("file", F.when(F.startswith("file", prefix), F.substr("file", F.length(prefix) + 1)).otherwise(F.col("file")))
    return rows.join(files.select("case_id", "file", "sha256"), ["case_id", "file"], "left").select("case_id", "file", "line", "api", "sha256")


def write_case_tables(folder: str, **tables: DataFrame) -> None:
    """One folder a table; entities are partitioned by kind."""
    for name, df in tables.items():
        writer = df.repartition("kind").write.partitionBy("kind") if name == "entities" and "kind" in df.columns else df.write
        writer.mode("overwrite").parquet(f"{folder}/{name}")
