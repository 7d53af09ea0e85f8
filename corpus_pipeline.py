"""A training corpus from raw documents, in five stages.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() applies them, each to the
written result of the one before. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultloom.llm import language_id, mixing, ngram_join, packing, substring_dedup
from faultloom.llm.common import checkpointed, row_key, shared_folder, small_batches

#: A document goes if no language has this share of it; clean texts in one language have nearly all.
LEAST_SHARE = 0.35
#: And if its n-grams are so many spreads of its languages' own less likely than these: gibberish and code are.
LEAST_FIT = -1.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled texts and rejects documents without a language: those without letters, a mixture without a leading one, or text unlike any."""
    small_batches(spark)
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model, ("pipeline_lang", "pipeline_share"))
    return found.where((F.col("pipeline_lang") != "und") & (F.col("pipeline_share") >= LEAST_SHARE) & (F.col("pipeline_lang_fit") >= LEAST_FIT)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document with the least id stays, of rows that repeat id and text one.

    Rows are told apart by id and text, so another text under the id of a copy stays. Documents without a word are classes of their
    own; documents without an id come last in theirs.
    """
    classes = checkpointed(ngram_join.similar_documents(docs))
    worded = classes.where("class IS NOT NULL")
    first = worded.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("first"))
    copies = worded.join(first, "class").where("key <> first").select(F.col("key").alias("pipeline_key")).distinct()
    kept = docs.withColumn("pipeline_key", row_key()).join(copies, "pipeline_key", "left_anti")
    twins = classes.groupBy(F.col("key").alias("pipeline_key")).count().where("count > 1").select("pipeline_key")
    if not twins.isEmpty():
        kept = kept.join(twins, "pipeline_key", "left_anti").unionByName(kept.join(twins, "pipeline_key", "left_semi").dropDuplicates(["pipeline_key"]))
    return kept.select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur anywhere else are cut; documents that nothing is left of go."""
    cut = substring_dedup.remove_repeats(docs)
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    rows = docs.select("doc_id", "source", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    mixed = mixing.mixed_documents(rows, mixing.words_in(F.col("text")))
    copies = F.when(F.col("mix_size") > 0, F.expr("taken div mix_size")).otherwise(0).cast("int")
    taken = mixed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return taken.select(*("text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, bucketed by length."""
    return packing.pack(docs, packing.word_bpe())


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: SQL cannot express the language stage; the tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
