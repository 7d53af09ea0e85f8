"""Search over entities and texts: substring and prefix search, BM25, paging, budgets.

Tables carry case_id. Postings are rows (case_id, term, doc_id, tf), never lists per term, so a very frequent term stays spread over
tasks; predicates on terms run over the distinct terms, by the indexes of `containment`, and reach the postings by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_tokens, search_terms
from .containment import prefix_pairs, substring_pairs
from .lineage import cut_lineage


def search_document(entity_id: Column, name: Column, content: Column) -> Column:
    return F.lower(F.concat_ws(" ", entity_id, name, content))


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """(case_id, term, doc_id, tf)."""
    return docs.select("case_id", "doc_id", F.explode(tokens).alias("term")).groupBy("case_id", "term", "doc_id").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame, tokens: Column) -> DataFrame:
    """(case_id, doc_id, length) and the case's n_docs and mean length. One row a case is summed and joined back."""
    own = docs.select("case_id", "doc_id", F.size(tokens).alias("length"))
    whole = own.groupBy("case_id").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
    return own.join(whole, "case_id")


def bm25_tables(docs: DataFrame, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """`postings` and `document_lengths` of texts that are cut into tokens once: the counted terms are written, with the length of their document."""
    own = docs.select("case_id", "doc_id", tokens.alias("tokens")).select("case_id", "doc_id", F.size("tokens").alias("length"), F.explode_outer("tokens").alias("term"))
    counted = cut_lineage(own.groupBy("case_id", "doc_id", "length", "term").agg(F.count("*").alias("tf")))
    sizes = counted.select("case_id", "doc_id", "length").distinct()
    whole = sizes.groupBy("case_id").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
    return counted.where("term IS NOT NULL").select("case_id", "term", "doc_id", "tf"), sizes.join(whole, "case_id")


def bm25_topk(index: DataFrame, lengths: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(case_id, query_id, doc_id, score, rank): best first, ties to the smaller id. queries: (case_id, query_id, query, top_k)."""
    terms = queries.where("top_k > 0").select("case_id", "query_id", "top_k", F.explode(F.array_distinct(code_tokens(F.col("query")))).alias("term"))
    wanted = index.join(terms.select("case_id", "term").distinct(), ["case_id", "term"], "left_semi")
    df = wanted.groupBy("case_id", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length"))
    weighed = wanted.join(df, ["case_id", "term"]).join(lengths, ["case_id", "doc_id"]).select("case_id", "term", "doc_id", (idf * F.col("tf") * (k1 + 1) / norm).alias("weight"))
    scores = weighed.join(terms, ["case_id", "term"]).groupBy("case_id", "query_id", "top_k", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("case_id", "query_id").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).where("rank <= top_k").drop("top_k")


def term_search(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """Entities with any term of the query as a substring: (case_id, query_id, entity_id, exact, matched, terms, rank).

    A term has only [a-z0-9_], so it lies within one run of these in the document: the terms are sought in the distinct runs, and the
    runs lead to the documents. Order: equal to id, name or method id first, then matched terms, then observed, then id.
    """
    doc = search_document(F.col("entity_id"), F.col("name"), F.col("content"))
    runs = entities.select("case_id", "entity_id", F.explode(F.array_distinct(F.regexp_extract_all(doc, F.lit("([a-z0-9_]+)")))).alias("run"))
    asked = queries.select("case_id", "query_id", F.explode(search_terms(F.col("query"))).alias("term"))
    hits = substring_pairs(runs.select("case_id", F.col("run").alias("text")), asked, ["case_id"]).withColumnRenamed("text", "run")
    found = runs.join(hits, ["case_id", "run"]).select("case_id", "entity_id", "term").distinct()
    scored = found.join(asked, ["case_id", "term"]).groupBy("case_id", "query_id", "entity_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    joined = scored.join(entities.select("case_id", "entity_id", "name", "method_id", "observed"), ["case_id", "entity_id"]).join(queries.select("case_id", "query_id", "query"), ["case_id", "query_id"])
    equal = lambda c: F.coalesce(F.lower(F.col(c)) == F.lower(F.trim("query")), F.lit(False))
    out = joined.select("case_id", "query_id", "entity_id", (equal("entity_id") | equal("name") | equal("method_id")).alias("exact"), F.size("terms").alias("matched"), F.array_join("terms", " ").alias("terms"), F.coalesce("observed", F.lit(False)).alias("seen"))
    order = Window.partitionBy("case_id", "query_id").orderBy(F.desc("exact"), F.desc("matched"), F.desc("seen"), "entity_id")
    return out.withColumn("rank", F.row_number().over(order)).drop("seen")


def prefix_search(entities: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Entities with any term of the query as a prefix of a token: (case_id, query_id, entity_id, exact, score, rank).

    A query term counts as one term, with the tokens that begin with it summed; order: exact, BM25, observed, id.
    """
    doc = search_document(F.col("entity_id"), F.col("name"), F.col("content"))
    tokens = F.regexp_extract_all(doc, F.lit("([a-z0-9_]+)"))
    docs = entities.withColumn("doc_id", F.col("entity_id"))
    index, lengths = cut_lineage(postings(docs, tokens)), document_lengths(docs, tokens)
    asked = queries.select("case_id", "query_id", F.explode(search_terms(F.col("query"))).alias("prefix"))
    hits = prefix_pairs(index.select("case_id", F.col("term").alias("text")), asked, ["case_id"]).withColumnRenamed("text", "term")
    summed = index.join(hits, ["case_id", "term"]).groupBy("case_id", "prefix", "doc_id").agg(F.sum("tf").alias("tf"))
    df = summed.groupBy("case_id", "prefix").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    weighed = summed.join(df, ["case_id", "prefix"]).join(lengths, ["case_id", "doc_id"]).select("case_id", "prefix", F.col("doc_id").alias("entity_id"), weight.alias("weight"))
    scores = weighed.join(asked, ["case_id", "prefix"]).groupBy("case_id", "query_id", "entity_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    joined = scores.join(entities.select("case_id", "entity_id", "name", "method_id", "observed"), ["case_id", "entity_id"]).join(queries.select("case_id", "query_id", "query"), ["case_id", "query_id"])
    equal = lambda c: F.coalesce(F.lower(F.col(c)) == F.lower(F.trim("query")), F.lit(False))
    out = joined.select("case_id", "query_id", "entity_id", (equal("entity_id") | equal("name") | equal("method_id")).alias("exact"), "score", F.coalesce("observed", F.lit(False)).alias("seen"))
    order = Window.partitionBy("case_id", "query_id").orderBy(F.desc("exact"), F.desc("score"), F.desc("seen"), "entity_id")
    return out.withColumn("rank", F.row_number().over(order)).drop("seen")


def cursor_of(scope: Column, offset: Column) -> Column:
    return F.concat(F.substring(F.sha2(scope, 256), 1, 12), F.lit(":"), offset.cast("string"))


def page(results: DataFrame, requests: DataFrame, by: list[str], order: list) -> DataFrame:
    """One page of each request's results: the rows, with total and next_cursor.

    requests: (…by, scope, limit, cursor); a limit lies in 1 .. 100; a cursor of another scope is refused: its page is empty and `valid` false.
    """
    rank = Window.partitionBy(*by).orderBy(*order)
    numbered = results.withColumn("position", F.row_number().over(rank) - 1).join(results.groupBy(*by).agg(F.count("*").alias("total")), by)
    given = requests.withColumns({
        "own": F.substring(F.sha2("scope", 256), 1, 12),
        "size": F.least(F.greatest("limit", F.lit(1)), F.lit(100)),
        "offset": F.coalesce(F.split_part("cursor", F.lit(":"), F.lit(2)).try_cast("int"), F.lit(0)),
    })
    given = given.withColumn("valid", F.col("cursor").isNull() | (F.split_part("cursor", F.lit(":"), F.lit(1)) == F.col("own")))
    out = numbered.join(given, by).where(F.col("valid") & (F.col("position") >= F.col("offset")) & (F.col("position") < F.col("offset") + F.col("size")))
    more = F.when(F.col("offset") + F.col("size") < F.col("total"), cursor_of(F.col("scope"), F.col("offset") + F.col("size")))
    return out.withColumn("next_cursor", more).drop("own", "size", "offset", "valid", "cursor", "limit", "scope")


def text_page(texts: DataFrame, limit: int = 12_000, most: int = 30_000) -> DataFrame:
    """Characters [offset, offset + limit) of each text (…, text, offset), with total and next_offset."""
    size = min(max(limit, 1), most)
    begin = F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0))
    total = F.length("text")
    return texts.select(*(c for c in texts.columns if c not in ("text", "offset")), F.substr("text", begin + 1, F.lit(size)).alias("part"), total.alias("total"), F.when(begin + size < total, begin + size).alias("next_offset"))


def greedy_budget(records: DataFrame, by: list[str], order: list[str], length: Column, budget: int) -> DataFrame:
    """Records taken in order while their length still fits into the budget: a long one is passed over, later ones may fit.

    Returns (…by, kept: positions, used, omitted). A group is one entity's records, and a fold over them is the rule itself.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    held = records.select(*by, rank.alias("position"), length.alias("size"))
    listed = F.array_sort(F.collect_list(F.struct("position", "size")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    step = lambda s, r: F.when(s["used"] + r["size"] <= budget, F.struct((s["used"] + r["size"]).alias("used"), F.array_append(s["kept"], r["position"]).alias("kept"))).otherwise(s)
    folded = held.groupBy(*by).agg(F.aggregate(listed, start, step).alias("s"), F.count("*").alias("n"))
    return folded.select(*by, F.array_join(F.transform("s.kept", lambda p: p.cast("string")), ",").alias("kept"), F.col("s.used").alias("used"), (F.col("n") - F.size("s.kept")).alias("omitted"))
