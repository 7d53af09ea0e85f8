"""Removal of word passages that occur anywhere else, by fixed-block anchors.

A window of `length` words holds at least one whole block of `(length + 1) // 2` words that starts at a
multiple of the block's width in its document (35 words: blocks of 18). So the index takes only those
non-overlapping blocks, every rolling block probes it, and a window can only repeat where its own
block is hit. The hits are then extended: the windows around hit blocks are counted themselves, and
runs of repeated windows join to the maximal exact repeats that are cut out.

How it is dealt out: block hashes go to groups by their upper bits, windows by the least hash of their runs of eight words, spread
again, so that neighbours mostly share a group and groups are even. They travel packed in columns of bytes, each distinct hash once
for a task's share of a quarter million, so a passage that a third of all documents holds arrives as one entry from each. Only blocks (later
windows) that want an answer carry their place; those that repeat within the share need none and go straight to a group of their document.
A probe is five bytes; a block is hit wrongly about once in 2**40 / (blocks of a group) and the second step corrects it. Windows are
compared by 64 bits of a hash of 64-bit word hashes within their group, whose choice is by another hash: at 10**13 windows in
10**7 groups a false repeat is expected about once in ten runs.

Edge cases: a null or empty text has no words and stays so; texts shorter than `length` words keep all
words; rows with the same id and text are separate places, so they repeat each other; a very long text is held whole with its word hashes
by one task, some ten times its size; an empty table gives an empty result; more columns than doc_id and text pass through `remove_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, give_back, groups_for, hashed_words, mixed, planes, route, row_key, table, unplanes, window_hashes

_FLUSH = 1 << 18
#: Windows go to groups by the least hash of their runs of so many words, which neighbours mostly share.
_GRAM = 8
_BLOCK = "part int, hashes binary, ask binary, ask_key binary, ask_start binary, known_key binary, known_start binary"
_LOW = np.uint64((1 << 40) - 1)


def _least(h: np.ndarray, k: int) -> np.ndarray:
    """The least of h[p:p+k] for each p."""
    width, out = 1, h
    while 2 * width <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(h) - k + 1], out[k - width :]) if width < k else out


def _packed(h: np.ndarray, ask: np.ndarray, key: np.ndarray, start: np.ndarray, by: np.ndarray, groups: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of _BLOCK for one task's share: distinct hashes; of places that ask, those already known to repeat apart."""
    order = np.argsort(h, kind="stable") if width == 5 else np.lexsort((h, by))
    ordered = h[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    unique, count = ordered[first], np.diff(np.append(first, len(ordered)))
    place = np.empty(len(h), np.int64)
    place[order] = np.repeat(np.arange(len(first)), count)
    part = route(by[order][first], groups)
    edges = np.searchsorted(part, np.arange(groups + 1))
    asking = np.flatnonzero(ask)
    known = asking[count[place[asking]] > 1]
    asking = asking[count[place[asking]] == 1]
    asking = asking[np.argsort(place[asking], kind="stable")]
    at = place[asking]
    bounds = np.searchsorted(at, edges)
    # Places that are already known to repeat need no answer: they go to a group of their document.
    home = route(mixed(key[known].view(np.uint64)), groups)
    order = np.lexsort((start[known], key[known], home))
    known, home = known[order], home[order]
    again = np.concatenate([[False], (key[known][1:] == key[known][:-1]) & (start[known][1:] == start[known][:-1])])
    known, home = known[~again[: len(known)]], home[~again[: len(home)]]
    told = np.searchsorted(home, np.arange(groups + 1))
    rows = []
    for g in np.flatnonzero(np.diff(edges) + np.diff(told)):
        mine, where = asking[bounds[g] : bounds[g + 1]], at[bounds[g] : bounds[g + 1]]
        own, other = unique[edges[g] : edges[g + 1]], known[told[g] : told[g + 1]]
        values = np.diff(np.sort(own & _LOW), prepend=np.uint64(0)) if width == 5 else own
        rank = where - edges[g]
        if width == 5:
            rank = np.argsort(np.argsort(own & _LOW, kind="stable"), kind="stable")[rank]
        rows.append((
            int(g), planes(values), planes(rank.astype(np.uint32)), key[mine].tobytes(), planes(start[mine].astype(np.uint32)),
            key[other].tobytes(), planes(start[other].astype(np.uint32)),
        ))
    for i in range(0, len(rows), 256):
        columns = list(zip(*rows[i : i + 256], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "hashes", "ask", "ask_key", "ask_start", "known_key", "known_start"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list | None]]:
    """(key, word hashes, starts of hit blocks) of each document; hashes are taken over many documents at a time."""
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("key")).to_numpy()
        has = batch.schema.get_field_index("hits")
        for at, texts in byte_texts(batch):
            h, sizes = hashed_words(texts)
            ends = np.cumsum(sizes)
            for i, (lo, hi) in enumerate(zip(ends - sizes, ends, strict=True)):
                yield keys[at + i], h[lo:hi], None if has < 0 else batch.column(has)[at + i].as_py()


def _emit(anchors: bool, length: int, groups: int):
    block = (length + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for key, words, hits in _documents(batches):
            if len(words) < length:
                continue
            if anchors:
                h = window_hashes(words, block)
                start = np.arange(len(h))
                ask, by = start % block == 0, h
            else:
                found = np.concatenate([unplanes(x, "<u4") for x in hits]).astype(np.int64)
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, np.maximum(found + block - length, 0), 1)
                np.add.at(mark, np.minimum(found, len(words) - length) + 1, -1)
                start = np.flatnonzero(np.cumsum(mark)[: len(words) - length + 1])
                h = window_hashes(words, length)[start]
                # Least hashes are small ones, so they are spread before they are dealt out.
                by = mixed(_least(window_hashes(words, _GRAM), length - _GRAM + 1))[start]
                ask = np.ones(len(h), bool)
            held.append((h, ask, np.full(len(h), key, np.int64), start, by))
            n += len(h)
            if n >= _FLUSH:
                yield from _packed(*map(np.concatenate, zip(*held, strict=True)), groups, 5 if anchors else 8)
                held, n = [], 0
        if n:
            yield from _packed(*map(np.concatenate, zip(*held, strict=True)), groups, 5 if anchors else 8)
        held.clear()
        give_back()

    return run


def _answers(width: int):
    """Of one group's blocks: (key, starts) of the places whose hash more than one block holds, or that were known."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        hashes = [np.cumsum(unplanes(x, "<u8"), dtype=np.uint64) if width == 5 else unplanes(x, "<u8") for x in rows["hashes"]]
        every = np.sort(np.concatenate(hashes))
        again = every[1:][every[1:] == every[:-1]]
        keys, starts = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for h, r in zip(hashes, rows.itertuples(), strict=True):
            wanted = h[unplanes(r.ask, "<u4")]
            at = np.searchsorted(again, wanted)
            hit = (at < len(again)) & (again[np.minimum(at, len(again) - 1)] == wanted) if len(again) else np.zeros(len(wanted), bool)
            keys += [np.frombuffer(r.ask_key, np.int64)[hit], np.frombuffer(r.known_key, np.int64)]
            starts += [unplanes(r.ask_start, "<u4")[hit], unplanes(r.known_start, "<u4")]
        key, start = np.concatenate(keys), np.concatenate(starts)
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        return pd.DataFrame({"key": key[first], "starts": [planes(x) for x in np.split(start, first[1:])] if len(first) else []})

    return run


def repeated_windows(docs: DataFrame, length: int = 35) -> DataFrame:
    """(key, hits: array of packed window starts) of documents with a window that starts anywhere else too. length: 16 words at least."""
    texts = docs.withColumn("key", row_key())
    # About 6 bytes a word: some 1.3 million probes, 10 MB, for each group.
    groups = groups_for(docs, F.octet_length("text"), 8 << 20)
    place = lambda df, width: df.groupBy("part").applyInPandas(_answers(width), "key long, starts binary").groupBy("key").agg(F.collect_list("starts").alias("hits"))
    anchors = place(texts.select("key", "text").mapInArrow(_emit(True, length, groups), _BLOCK), 5)
    # All columns stay, so that the texts are dealt out once, for this join and for the caller's.
    near = texts.join(anchors, "key")
    return place(near.mapInArrow(_emit(False, length, groups), _BLOCK), 8)


def _cut(length: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(batch.schema.get_field_index("hits"))
            n_words, n_removed, kept = [], [], []
            for at, texts in byte_texts(batch):
                for i, text in enumerate(texts):
                    words, starts = text.split(), hits[at + i].as_py()
                    n_words.append(len(words))
                    if starts:
                        mark = np.zeros(len(words) + 1, np.int64)
                        s = np.concatenate([unplanes(x, "<u4") for x in starts]).astype(np.int64)
                        np.add.at(mark, s, 1)
                        np.add.at(mark, s + length, -1)
                        stay = np.flatnonzero(np.cumsum(mark)[: len(words)] == 0)
                        n_removed.append(len(words) - len(stay))
                        words = [words[j] for j in stay]
                    else:
                        n_removed.append(0)
                    kept.append(hashlib.sha256(b" ".join(words)).hexdigest() if digest else b" ".join(words).decode() if starts else None)
            own = [batch.column(j) for j, f in enumerate(batch.schema.names) if f not in ("text", "key", "hits") or not digest and f == "text"]
            names = [f for f in batch.schema.names if f not in ("text", "key", "hits") or not digest and f == "text"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    return run


def _with_hits(docs: DataFrame, length: int) -> DataFrame:
    return docs.withColumn("key", row_key()).join(repeated_windows(docs, length), "key", "left")


def repeat_digest(docs: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    return _with_hits(docs.select("doc_id", "text"), length).mapInArrow(_cut(length, True), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """The documents, each with its repeated passages cut out.

    A text without one stays as it was; a cut text is its kept words joined by one space, and n_chars,
    if there is one, is its new length.
    """
    given = docs.schema
    cut = _with_hits(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c not in ("doc_id", "text")}), length)
    fields = ", ".join(f"`{'own_' if f.name not in ('doc_id', 'text') else ''}{f.name}` {f.dataType.simpleString()}" for f in given)
    out = cut.select(*(f"own_{c}" if c not in ("doc_id", "text") else c for c in docs.columns), "hits")
    out = out.mapInArrow(_cut(length, False), f"{fields}, n_words long, n_removed long, kept string")
    text = F.coalesce("kept", "text")
    own = {"text": text, "n_chars": F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(F.col("own_n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*((own.get(c) if own.get(c) is not None else F.col(c if c == "doc_id" else f"own_{c}")).alias(c) for c in docs.columns))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))


SQL = {
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
hashed AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM win),
rep AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM hashed SEMI JOIN rep USING (h)),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hit),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
}
