"""Trace reports on disk: spectra.csv, tests.csv and trace.txt of each case, read and written by Spark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "emptyValue": ""}


def report_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/reports-{uuid.uuid4().hex}"


def write_reports(rows: DataFrame, numbers: DataFrame, outcomes: DataFrame, folder: str) -> None:
    """rows: report rows of operators.trace; numbers: (case_id, method_id, number); outcomes: (case_id, test_id, outcome, seconds)."""
    numbers.select("case_id", F.col("number").alias("id"), F.col("method_id").alias("name")).write.options(**_CSV).csv(f"{folder}/spectra")
    tests = outcomes.select("case_id", F.col("test_id").alias("id"), F.concat(F.lit("Test::t"), "test_id").alias("name"), "outcome", F.col("seconds").alias("runtime"), F.concat(F.lit('at "'), "test_id", F.lit('"\nat b, c')).alias("stacktrace"))
    tests.write.options(**_CSV).csv(f"{folder}/tests")
    rows.select("case_id", "test_id", "sign", "events", "counts", "calls").write.option("sep", "\t").option("emptyValue", "").csv(f"{folder}/trace")


def read_spectra(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, number, method_id); rows with a blank or non-integer id are dropped."""
    raw = spark.read.options(**_CSV).schema("case_id string, id string, name string").csv(f"{folder}/spectra")
    return raw.select("case_id", F.trim("id").try_cast("int").alias("number"), F.col("name").alias("method_id")).where("number IS NOT NULL")


def read_tests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.options(**_CSV).schema("case_id string, id string, name string, outcome string, runtime double, stacktrace string").csv(f"{folder}/tests")


def read_trace(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, test_id, method_id, hits, outcome) of the three reports."""
    schema = "case_id string, test_id string, sign string, events string, counts string, calls string"
    rows = spark.read.option("sep", "\t").schema(schema).csv(f"{folder}/trace").where("counts IS NOT NULL")
    each = rows.select("case_id", "test_id", F.explode(F.split("counts", ",")).alias("p"))
    each = each.select("case_id", "test_id", F.split_part("p", F.lit(":"), F.lit(1)).try_cast("int").alias("number"), F.split_part("p", F.lit(":"), F.lit(2)).try_cast("long").alias("hits"))
    tests = read_tests(spark, folder).select("case_id", F.col("id").alias("test_id"), "outcome")
    return each.join(read_spectra(spark, folder), ["case_id", "number"]).join(tests, ["case_id", "test_id"]).select("case_id", "test_id", "method_id", "hits", "outcome")
