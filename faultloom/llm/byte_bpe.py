"""Byte-level BPE by a queue of merges over a linked list of symbols.

A text is cut at the special tokens of the file, then into words by the pattern of the byte-level pre-tokenizer, and each word's
bytes become symbols of a doubly linked list. A priority queue holds the possible merges by (rank, place). The least one
joins its two symbols, which makes up to two new merges with the neighbours; an entry whose symbols have been joined meanwhile no
longer spells its pair and is skipped. So a word of n bytes takes n log n steps, also where a text is one word.
Decoding concatenates the byte strings of the vocabulary; bytes that are no UTF-8 become U+FFFD.

Nothing is shuffled: each row is encoded alone, so a hot source or a group of copies changes nothing, and a lost task is run again
with the same result. A Python worker keeps the ids of at most twice `_STORE` distinct short words. A text is worked through in stretches of about
`_STRETCH` characters, whose digests are carried on, so memory beside the text itself is bounded but for a single word longer than that.

Edge cases: a null or empty text has no ids and decodes to the empty text; a null doc_id stays null; repeated rows are encoded
each on its own; an empty table gives no rows; other columns than doc_id and text are not read. Files with a normalizer, a post-processor that
adds to the ids, dropout, byte fallback or special tokens that strip white space are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

#: How the pre-tokenizer cuts a text into words (a fixed value of the format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a Python worker keeps, in each of two halves, none longer than _KEPT characters.
_STORE, _KEPT = 300_000, 64
_STRETCH = 1 << 17


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: visible Latin-1 for itself, the others from U+0100 on in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, others = [], 0
    for b in range(256):
        out.append(chr(b if b in own else 0x100 + others))
        others += b not in own
    return out


class ByteBpe:
    """Encoder and decoder of one tokenizer file (of the tokenizers library's format)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path}: not a byte-level BPE without a space in front")
        if spec["normalizer"] or (spec["post_processor"] or {}).get("type") not in (None, "ByteLevel") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path}: its normalizer, post-processor or model options are not supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take white space with them are not supported")
        vocabulary: dict[str, int] = model["vocab"]
        characters = byte_characters()
        to_byte = {c: b for b, c in enumerate(characters)}
        self.first = [vocabulary[c] for c in characters]
        known = {i: bytes(to_byte[c] for c in token) for token, i in vocabulary.items()}
        known.update((t["id"], t["content"].encode()) for t in spec["added_tokens"])
        #: The bytes of each id; ids that the file leaves out have none.
        self.strings = [known.get(i, b"") for i in range(max(known) + 1)]
        #: By left id and right id, the rank of their merge as the upper half of an entry of the queue; by rank, the pair and what it becomes.
        self.ranks: list[dict[int, int]] = [{} for _ in self.strings]
        self.pairs: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.append((vocabulary[left], vocabulary[right], vocabulary[left + right]))
            self.ranks[vocabulary[left]][vocabulary[right]] = rank << 32
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.edge = regex.compile(r"(?<=\S)(?=\s)")
        self.store = _Words(self)

    def merged(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        ids, ranks, pairs = [self.first[b] for b in word], self.ranks, self.pairs
        queue = [rank | i for i, (left, right) in enumerate(zip(ids, ids[1:])) if (rank := ranks[left].get(right)) is not None]
        if not queue:
            return tuple(ids)
        heapq.heapify(queue)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        after[-1] = -1
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            left, right, joined = pairs[entry >> 32]
            j = after[i]
            # Stale: the symbol went into its left neighbour (-1), or one of the two has grown since.
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = joined, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := ranks[joined].get(ids[k])) is not None:
                    heapq.heappush(queue, rank | i)
            h = before[i]
            if h >= 0 and (rank := ranks[ids[h]].get(joined)) is not None:
                heapq.heappush(queue, rank | h)
        return tuple([i for i in ids if i >= 0])

    def stretches(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, in lists that follow one another. A text may be cut before any white space after another character, as no word goes on there."""
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.special:
                yield [self.special[part]]
                continue
            at = 0
            while at < len(part):
                found = self.edge.search(part, at + _STRETCH) if len(part) - at > _STRETCH else None
                to = found.start() if found else len(part)
                yield list(chain.from_iterable(map(self.store.__getitem__, self.words.findall(part, at, to))))
                at = to

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stretches(text) for i in ids]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids that the file does not have are left out."""
        known = len(self.strings)
        return self.joined([i for i in ids if 0 <= i < known]).decode(errors="replace")


class _Words(dict):
    """Ids by word. When _STORE words are in it they become the older half, in which a word is still found, and the half before them goes."""

    def __init__(self, bpe: ByteBpe) -> None:
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word)
        if found is None:
            found = self.bpe.merged(word.encode())
        if len(word) <= _KEPT:
            if len(self) >= _STORE:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


_KNOWN: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One encoder, with its store of words, for all tasks of a Python worker."""
    if path not in _KNOWN:
        _KNOWN[path] = ByteBpe(path)
    return _KNOWN[path]


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for at, texts in sliced(batch, "own_text", 1 << 20):
                ids = [bpe.encode(t) if t else [] for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("own_text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """doc_id, text: the text that each row's ids spell; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("array<int>").alias("own_ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text: digests of the ids and of what they decode to, taken stretch by stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        decimal = [b"%d" % i for i in range(len(bpe.strings))]
        for batch in batches:
            for at, texts in sliced(batch, "text", 1 << 20):
                count, of_ids, of_text = [], [], []
                for text in texts.to_pylist():
                    n, spelt, back = 0, hashlib.sha256(), _Lossy()
                    for ids in bpe.stretches(text or ""):
                        if ids:
                            spelt.update((b"," if n else b"") + b",".join(map(decimal.__getitem__, ids)))
                            back.update(bpe.joined(ids))
                            n += len(ids)
                    count.append(n)
                    of_ids.append(spelt.hexdigest())
                    of_text.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(count)), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


class _Lossy:
    """SHA-256 of bytes that are read as UTF-8, whatever the stretches in which they come; the bytes of a text that is sound pass as they are.

    A stretch ends before white space, so it holds whole characters.
    """

    def __init__(self) -> None:
        self.sha = hashlib.sha256()

    def update(self, data: bytes) -> None:
        self.sha.update(data.decode(errors="replace").encode())

    def hexdigest(self) -> str:
        return self.sha.hexdigest()


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), byte_bpe())


SQL: dict[str, str] = {}
