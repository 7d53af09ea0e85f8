"""Packing of tokenised documents into sequences by power-of-two decomposition.

Each document is cut from its start into pieces whose lengths are powers of two, the longest first:
as many whole sequences as fit, then one piece for each set bit of what is left. A piece is a sequence
of its own, so no sequence crosses documents and none needs padding; sequences of equal length form the
buckets that a training batch draws from.

Each row is cut alone, so nothing is shuffled: a hot source, a group of copies or a very long text only
makes more rows. A lost task is run again with the same result, as the numbers of the sequences come from
the input's partition and the place in it.

Edge cases: a null or empty text is the end token alone, one piece of length 1; a null id stays null;
repeated rows are packed each on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

#: So many distinct words are kept with their ids in each Python worker; beyond it the store starts anew.
_STORE = 300_000


def piece_lengths(n: int, longest: int) -> list[int]:
    """The power-of-two lengths, longest first, that n tokens are cut into."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if (n % longest) >> b & 1]


class _Ids:
    """Token ids of texts, word by word.

    The tokenizer's pre-tokenizer never joins characters across white space and drops the white space
    itself, so a text's ids are its words' ids one after another. It also lowers letters and parts a letter from a mark after it, so
    ASCII capitals are lowered and a space is put between an ASCII letter and an ASCII mark before words are looked up,
    but in texts that may hold a special token.
    """

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.store: dict[bytes, bytes] = {b"": b""}

    def _encoded(self, lines: list[list[bytes]]) -> Iterator[bytes]:
        """Ids of each word. Every word has at least one token that ends a word, so a line with as many ends as words has one for each."""
        for i in range(0, len(lines), 4096):
            part = lines[i : i + 4096]
            found = self.tokenizer.encode_batch_fast([b" ".join(line).decode() for line in part], add_special_tokens=False)
            for line, e in zip(part, found, strict=True):
                ids = np.array(e.ids, "<u4")
                last = np.flatnonzero(self.ends[ids]) if len(line) > 1 else [len(ids) - 1]
                if len(last) != len(line):
                    yield from self._encoded([[w] for w in line])
                    continue
                data, to = ids.tobytes(), [4 * (k + 1) for k in last]
                yield from (data[x:y] for x, y in zip([0, *to[:-1]], to, strict=True))

    def _learn(self, fresh: list[bytes]) -> None:
        # Letters alone go in lines, as they have one end each.
        plain = [w for w in fresh if w.isalpha() or not w.isascii() and w.decode().isalpha()]
        other = list(set(fresh).difference(plain))
        self.store.update(zip(plain, self._encoded([plain[i : i + 256] for i in range(0, len(plain), 256)]), strict=True))
        self.store.update(zip(other, self._encoded([[w] for w in other]), strict=True))

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, as little-endian 32-bit numbers. Of equal words of a slice one is looked up."""
        texts = texts.fill_null("")
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([!-/:-@\[-`{-~])", r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, parted))
        words = lists.flatten().dictionary_encode()
        at, distinct = words.indices.to_numpy(), words.dictionary.cast(pa.binary()).to_pylist()
        if len(self.store) > _STORE:
            self.store = {b"": b""}
        if fresh := [w for w in distinct if w not in self.store]:
            self._learn(fresh)
        own = list(map(self.store.__getitem__, distinct))
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, begin = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            mine = at[lo:hi]
            n = size[mine]
            ends = np.cumsum(n)
            yield flat[np.repeat(begin[mine] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)].tobytes()


_KNOWN: dict[str, _Ids] = {}


def _ids(tokenizer: str) -> _Ids:
    """One store for all tasks of a Python worker."""
    if tokenizer not in _KNOWN:
        _KNOWN[tokenizer] = _Ids(tokenizer)
    return _KNOWN[tokenizer]


def _pack(tokenizer: str, end_id: int, longest: int, tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids, end = _ids(tokenizer), np.uint32(end_id).tobytes()
        for batch in batches:
            doc = batch.column(batch.schema.get_field_index("doc_id"))
            for at, texts in sliced(batch, most=1 << 21):
                rows, start, length, crc, total, own = [], [], [], [], [], []
                for i, data in enumerate(ids.of(texts)):
                    data += end
                    n, s = len(data) // 4, 0
                    for k in piece_lengths(n, longest):
                        piece = data[4 * s : 4 * (s + k)]
                        rows.append(at + i)
                        start.append(s)
                        length.append(k)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if tokens:
                            own.append(np.frombuffer(piece, "<u4"))
                        s += k
                columns = [doc.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if tokens:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(own) if own else [], pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = 2048, tokens: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with `tokens`, ids.

    `tokenizer` is the path of a tokenizers file on every machine; `longest` must be a power of two.
    Write the result partitioned by length to get one folder for each bucket.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * tokens
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer, end_id, longest, tokens), schema)
    return packed.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe(), tokens=False)


SQL: dict[str, str] = {}
