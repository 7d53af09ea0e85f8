"""Byte-level BPE against the tokenizers library."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from faultloom.llm import byte_bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = byte_bpe.byte_bpe()
PIECES = ["a", "the", "'s", "'S", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "1", "٣", "½", "é", "é", "ß", "漢字", "😀", "👩‍👩‍👧", ".", "--", "_", "\x00", "�", "<|endoftext|>", "<|endoftext", "|>", "Zürich", "don't", "'ll've", "​", "नमस्ते"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts() -> list[str]:
    dice = random.Random(5)
    out = ["", " ", "\n\n  x", "a" * 3000, "ab" * 2000, " " * 500 + "x", "x" + "　" * 300, "<|endoftext|>" * 3]
    out += ["".join(dice.choices(PIECES, k=dice.randint(1, 60))) for _ in range(800)]
    out += ["".join(chr(dice.choice([dice.randrange(0x80), dice.randrange(0x800), dice.randrange(0x3000), dice.randrange(0xE000, 0x11000)])) for _ in range(dice.randint(1, 80))) for _ in range(400)]
    return [t.encode(errors="ignore").decode() for t in out]


def test_ids_and_text_equal_the_library(library):
    bpe = byte_bpe.ByteBpe(PATH)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_decoding_any_ids(library):
    bpe, dice = byte_bpe.ByteBpe(PATH), random.Random(6)
    for _ in range(500):
        ids = [dice.randrange(50257) for _ in range(dice.randint(0, 30))]
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_stretches_and_a_small_store_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_STRETCH", 7)
    monkeypatch.setattr(byte_bpe, "_STORE", 3)
    bpe = byte_bpe.ByteBpe(PATH)
    for text in texts():
        parts = list(bpe.stretches(text))
        assert [i for p in parts for i in p] == library.encode(text, add_special_tokens=False).ids
        assert b"".join(bpe.joined(p).decode().encode() for p in parts).decode() == text
    assert len(bpe.store) <= 3 and len(bpe.store.older) <= 3


def test_merges_equal_the_naive_order():
    bpe, dice = byte_bpe.ByteBpe(PATH), random.Random(7)
    for _ in range(300):
        word = "".join(dice.choices("abcdefinorst ", k=dice.randint(1, 40))).encode()
        ids = [bpe.first[b] for b in word]
        while found := min(((bpe.ranks[a][b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if b in bpe.ranks[a]), default=None):
            ids[found[1] : found[1] + 2] = [bpe.pairs[found[0] >> 32][2]]
        assert list(bpe.merged(word)) == ids


def test_table(spark, library, tmp_path):
    rows = [(1, "Some text, some <|endoftext|> text"), (2, None), (3, ""), (None, "null id"), (1, "Some text, some <|endoftext|> text"), (4, "long " * 300_000), (5, "é" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(0), "n_tokens": F.lit("x"), "own_text": F.lit("y")})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in byte_bpe.op12_byte_bpe(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = byte_bpe.decode(byte_bpe.encode(df, PATH), PATH)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
    assert byte_bpe.digests(df.where("1 = 0"), PATH).count() == 0


def test_unsupported_files_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"dropout": 0.1}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            byte_bpe.ByteBpe(str(tmp_path / "t.json"))
