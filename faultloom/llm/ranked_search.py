"""Ranked lexical search without random access (NRA): reads in order of impact, with score intervals.

The documents' terms that any item asks for are counted in one pass over the whole texts and written as a table of postings, from
which the corpus' statistics are summed. A second pass reads that table in shards of at most `shard_postings` postings. In a shard
each term has a list of its documents, the highest impact first. For an item the lists of its terms are read from their heads, all down
to the same gain, which falls from round to round. A document's lower bound is the sum of the gains read; its upper bound adds the
heads of the lists that it was not met in. Once the sum of all heads is below the k-th lower bound no new document can enter; the
documents met whose upper bound reaches the k-th lower bound stay in the race, and reading goes on until each of them is exact, ties
included. A task carries each item's best over its shards, so later shards start from a high bound, and gives k rows an item at most; the
k best of all tasks are found by a window with a limit before its shuffle.

Postings are never shuffled: documents are divided, not terms, so a term that every document holds, a hot source or a group of
copies makes no task larger. The items are dealt into blocks whose terms, `block_terms` of them or so, are broadcast; each block is one pass.
A lost task is run again with the same result.

Edge cases: a null text has no terms; documents or items without terms give no rows; a null doc_id ranks after all others of the same
score; rows with the same id, documents or items, are kept apart; fewer than k rows where fewer documents score above 0; an empty table gives an
empty result; other columns are not read. Lengths times counts beyond 64 bits are computed exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_texts, checkpointed, give_back, table

#: Bytes outside terms become spaces, A-Z become a-z.
_TERMS = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: From one round of reading to the next the gain that lists are read down to falls by this factor.
_FALL = 3
_NO_ID = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    """The terms of a text: runs of ASCII letters, digits and characters beyond ASCII, with A-Z lowered."""
    return text.translate(_TERMS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Statistics:
    """Documents with a term, terms of all documents, and the weight of each of the block's terms."""

    documents: int
    length: int
    weights: np.ndarray

    def ratios(self, n: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What a term's weight is multiplied by, from the document's number of terms and the term's count in it; below 10**6."""
        if 75 * int(n.max(initial=0)) * self.documents < 1 << 62:
            spread = 75 * n * self.documents // self.length
        else:
            spread = np.array([75 * int(x) * self.documents // self.length for x in n], np.int64)
        return 1_000_000_000 * count // (1000 * count + 8 * (25 + spread))


class Shard:
    """Lists of documents by term, the highest impact first. posting i: document doc[i] holds the block's term term[i] count[i] times."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray, of: Statistics) -> None:
        ratio = of.ratios(n[doc], count)
        order = np.argsort(term.astype(np.int64) << 20 | (1 << 20) - 1 - ratio, kind="stable")
        self.ids, self.docs = ids, doc[order]
        held = term[order]
        self.impacts = of.weights[held] * ratio[order]
        known, start = np.unique(held, return_index=True)
        self.range = dict(zip(known.tolist(), zip(start.tolist(), np.append(start, len(held))[1:].tolist(), strict=True), strict=True))

    def lists(self, asked: dict[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, gains) of each asked term that can add to a score; asked: how often an item has each term."""
        found = ((self.range[t], times) for t, times in asked.items() if t in self.range)
        return [(self.docs[a:b], self.impacts[a:b] * times) for (a, b), times in found if self.impacts[a] > 0]

    def best(self, asked: dict[int, int], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the documents that can be among the k best, exact, of those that score `floor` or more."""
        lists = self.lists(asked)
        empty = np.empty(0, np.int64), np.empty(0, np.int64)
        if not lists:
            return empty
        place = [0] * len(lists)
        heads = np.array([gains[0] for _, gains in lists], np.int64)
        lower, met = np.zeros(len(self.ids), np.int64), np.zeros((len(lists), len(self.ids)), bool)
        racing, race = None, None  # documents still in the race, once no other can enter; as a mask and as places
        level = int(heads.max())
        while True:
            for i in np.flatnonzero(heads >= max(level, 1)):
                docs, gains = lists[i]
                to = len(gains) - int(np.searchsorted(gains[::-1], level, side="left"))
                seen, gained = docs[place[i] : to], gains[place[i] : to]
                if racing is not None:
                    mine = racing[seen]
                    seen, gained = seen[mine], gained[mine]
                lower[seen] += gained
                met[i, seen] = True
                place[i] = to
                heads[i] = gains[to] if to < len(gains) else 0
            rest = int(heads.sum())
            if race is None:
                least = max(floor, int(np.partition(lower, -k)[-k]) if len(lower) >= k else 0)
                if rest < least or rest == 0:
                    race = np.flatnonzero((lower + rest >= least) & (lower > 0))
            if race is not None:
                if len(race) >= k:
                    least = max(least, int(np.partition(lower[race], -k)[-k]))
                open_to = heads @ ~met[:, race] if rest else np.zeros(len(race), np.int64)
                stays = lower[race] + open_to >= least
                race, open_to = race[stays], open_to[stays]
                if not open_to.any():
                    return (self.ids[race], lower[race]) if len(race) else empty
                heads[met[:, race].all(axis=1)] = 0
                racing = np.zeros(len(self.ids), bool)
                racing[race] = True
            level = min(level, int(heads.max())) // _FALL


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n, terms, counts of every document with a term: how many terms it has, and which of the vocabulary how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            for at, texts in byte_texts(batch, most=1 << 21):
                row, size, bounds, held, counts = [], [], [0], [], []
                for i, text in enumerate(texts, at):
                    if own := terms(text):
                        found = Counter(map(place.get, own))
                        found.pop(None, None)
                        row.append(i)
                        size.append(len(own))
                        held.extend(found.keys())
                        counts.extend(found.values())
                        bounds.append(len(held))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (held, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(size, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def _shards(batches: Iterator[pa.RecordBatch], of: Statistics, most: int) -> Iterator[Shard]:
    held: list[tuple] = []

    def shard() -> Shard:
        ids, n, sizes, term, count = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return Shard(ids, n, np.repeat(np.arange(len(ids)), sizes), term, count, of)

    for batch in batches:
        ids, n = batch.column(0).fill_null(_NO_ID).to_numpy(), batch.column(1).to_numpy()
        lists, counts = batch.column(2), batch.column(3)
        held.append((ids, n, lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)))
        if sum(len(x[3]) for x in held) >= most or sum(len(x[0]) for x in held) >= most // 8:
            yield shard()
    if held:
        yield shard()


def _ranked(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(shared, most: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, of = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for shard in _shards(batches, of, most):
            for key, asked in items.items():
                ids, scores = best.get(key, (np.empty(0, np.int64), np.empty(0, np.int64)))
                more, high = shard.best(asked, k, int(scores[-1]) if len(scores) == k else 0)
                if len(more):
                    best[key] = _ranked(np.concatenate([ids, more]), np.concatenate([scores, high]), k)
            give_back()
        for key, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["item", "doc_id", "score"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in byte_texts(batch):
            rows = [(batch.column(0)[i].as_py(), t, c) for i, text in enumerate(texts, at) for t, c in Counter(terms(text)).items()]
            item, term, times = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.binary()), pa.array(times, pa.int64())], ["item", "term", "times"])


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 200_000, shard_postings: int = 2_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest for each item, equal scores by id."""
    numbered = checkpointed(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"))
    asked = checkpointed(numbered.select("item", "text").mapInArrow(_asked, "item long, term binary, times long"))
    blocks = max(1, -(-asked.count() // block_terms))
    found = None
    for block in range(blocks):
        part = _block(docs, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block), k, shard_postings)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, asked: DataFrame, k: int, shard_postings: int) -> DataFrame:
    """item, doc_id, score of each task's best; the items' terms are held by the driver and by every task."""
    items: dict[int, dict[int, int]] = {}
    place: dict[bytes, int] = {}
    for r in asked.toLocalIterator():
        items.setdefault(r["item"], {})[place.setdefault(bytes(r["term"]), len(place))] = r["times"]
    held = checkpointed(postings(docs, list(place)))
    total = held.select(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    holding = held.select(F.explode("terms").alias("term")).groupBy("term").count()
    weights = np.zeros(len(place), np.int64)
    for r in holding.toLocalIterator():
        weights[r["term"]] = weight(total["documents"], r["count"])
    of = Statistics(total["documents"], max(total["length"], 1), weights)
    shared = docs.sparkSession.sparkContext.broadcast((items, of))
    return held.mapInArrow(_search(shared, shard_postings, k), "item long, doc_id long, score long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), item AS (
  SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), long AS (SELECT row, doc_id, len(terms) AS n, terms FROM doc WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM long),
posting AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM long) GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM posting WHERE term IN (SELECT term FROM item) GROUP BY term), totals),
scored AS (
  SELECT item, item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length)))) AS BIGINT) AS score
  FROM (SELECT item, item_id, term, count(*) AS times FROM item GROUP BY ALL) JOIN weights USING (term) JOIN posting USING (term) JOIN long USING (row), totals GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

SQL: dict[str, str] = {"op13_ranked_search": _SQL}
