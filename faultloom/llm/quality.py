"""Quality rules with a language-model verdict: perplexity under modified Kneser-Ney n-grams, in bands of each language.

The model is of lower-case code points, order 3, each a class of its own, and every language has its own model, so it grows
with the corpus. Spark counts the n-grams of every whole text by language into a written table; continuation counts, the
three discounts of each order (modified Kneser-Ney) and the interpolated probabilities are DataFrame aggregations of it.
As every text is counted, each of its n-grams has a probability there and scoring needs no back-off.

A document passes if its surprise, the negative log probability of its text for each letter, lies within its language's band: the quartiles
over all documents of the language, widened by `spread` interquartile ranges to each side, more for short texts, which vary more.
Both sides reject: above lies noise, below lies repetition. Marks add to the sum and not to the letters, so litter counts in
full however regular it is.

How it is dealt out: counting adds up within tasks and then by (language, n-gram). N-grams that make up a millionth of the corpus
each, so at most a million, reach the tasks as sorted arrays; each document's other distinct n-grams, which are
rare, meet the table in a join by (language, n-gram). The quartiles come from mergeable sketches. Nothing grows with a hot key.

Edge cases: a null or empty text has no words and fails the base rules; a null language is one of its own; a text without
letters counts as one letter; repeated rows are scored each.

`character_classes`, `grams` and `Model` are a form of the model on 128 classes that fits in memory, with back-off; the query does not use it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_texts, checkpointed, hashed_words, mixed, table, window_hashes
from .language_id import letters

_V = 128
#: Above every code point.
_POINTS = 1 << 21
_SPACE = b" \t\n\r\x0b\x0c"


def character_classes() -> np.ndarray:
    """The class of each code point; classes 1 to 69 are ASCII's after lowering, 70 to 127 those of all others."""
    points = np.arange(0x110000, dtype=np.uint32)
    out = (70 + (mixed(points.astype(np.uint64)) >> np.uint64(32)) % np.uint64(58)).astype(np.uint8)
    low = np.arange(128)
    low[65:91] += 32
    # 33..64 and 91..126 are marks, digits and letters, each a class of its own; all white space is class 1.
    out[:128] = np.where((low <= 32) | (low == 127), 1, np.where(low <= 64, low - 31, low - 57))
    upper = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(128, 0x600)])
    out[128:0x600] = out[upper]
    out[[0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = 1
    return out


def grams(text: bytes, classes: np.ndarray) -> np.ndarray:
    """Codes of the three-class n-grams of a text that has two spaces before it and one after."""
    own = classes[np.frombuffer(text.decode().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    own = np.concatenate([[1, 1], own, [1]]).astype(np.int32)
    return (own[:-2] * _V + own[1:-1]) * _V + own[2:]


def lower_points() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower-case one, all white space being a space; and whether it is a letter."""
    letter = letters()
    out = np.where(letter != 32, letter, np.arange(0x110000, dtype=np.uint32))
    out[[c for c in range(0x3001) if chr(c).isspace()]] = 32
    return out, letter != 32


def point_grams(text: bytes, lower: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, int]:
    """Codes of the n-grams of three code points of a text that has two spaces before it and one after, and its number of letters."""
    own = np.frombuffer(text.decode().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.concatenate([[32, 32], lower[own], [32]]).astype(np.int64)
    return (points[:-2] * _POINTS + points[1:-1]) * _POINTS + points[2:], int(letter[own].sum())


def _index(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("lang_no")).to_numpy()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    points = lower_points()
    held: dict[int, list] = {}
    n = 0

    def added(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(back, np.concatenate([x for _, x in parts])).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        for no, parts in held.items():
            codes, times = added(parts)
            for i in range(0, len(codes), 1 << 16):
                j = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes[j]), no, np.int64)), pa.array(codes[j]), pa.array(times[j])], ["lang_no", "code", "n"])

    for batch in batches:
        numbers = _index(batch)
        for at, texts in byte_texts(batch):
            for no in np.unique(numbers[at : at + len(texts)]):
                own = [point_grams(t, *points)[0] for t, x in zip(texts, numbers[at : at + len(texts)], strict=True) if x == no and t]
                if own:
                    held.setdefault(int(no), []).append(np.unique(np.concatenate(own), return_counts=True))
                    n += len(held[int(no)][-1][0])
            if n > 1 << 20:
                # What many slices share adds up here; only if that is not enough is it handed on.
                held = {no: [added(parts)] for no, parts in held.items()}
                n = sum(len(parts[0][0]) for parts in held.values())
                if n > 1 << 19:
                    yield from flush()
                    held, n = {}, 0
    yield from flush()


def probabilities(counts: DataFrame, v: int) -> list[DataFrame]:
    """With n and the interpolated probability p of an n-gram's last class, (lang_no, code) of orders 3, 2 and 1, from counts (lang_no, code, n) on v classes."""

    def discounts(df: DataFrame) -> DataFrame:
        n = [F.count_if(F.col("n") == i).cast("double") for i in (1, 2, 3, 4)]
        sums = df.groupBy("lang_no").agg(*(x.alias(f"n{i + 1}") for i, x in enumerate(n)))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        part = lambda i: F.greatest(F.least(i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0)), F.lit(float(i))), F.lit(0.1 * i))
        return sums.select("lang_no", *(part(i).alias(f"d{i}") for i in (1, 2, 3)))

    def layer(df: DataFrame, lower: DataFrame, order: int) -> DataFrame:
        """With p: each n-gram's probability, interpolated with that of the n-gram without its first class."""
        own = df.withColumn("context", F.expr(f"code div {v}")).join(F.broadcast(discounts(df)), "lang_no")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = own.groupBy("lang_no", "context").agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("back"))
        own = own.join(context, ["lang_no", "context"]).withColumn("suffix", F.expr(f"code % {v ** (order - 1)}"))
        joined = own.join(lower.select("lang_no", F.col("code").alias("suffix"), F.col("p").alias("q")), ["lang_no", "suffix"])
        return joined.select("lang_no", "code", "n", "context", "back", ((F.col("n") - cut) / F.col("total") + F.col("back") * F.col("q")).alias("p"))

    two = counts.groupBy("lang_no", F.expr(f"code % {v**2}").alias("code")).agg(F.count("*").alias("n"))
    one = two.groupBy("lang_no", F.expr(f"code % {v}").alias("code")).agg(F.count("*").alias("n"))
    every = F.sum("n").over(Window.partitionBy("lang_no"))
    first = one.withColumn("p", 0.95 * F.col("n") / every + 0.05 / v)
    second = checkpointed(layer(two, first, 2))
    return [checkpointed(layer(counts, second, 3)), second, first]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang_no, ord, code, value) from n-gram counts (lang_no, code, n) on 128 classes.

    ord 3, 2, 1: the log of the interpolated probability of an n-gram's last class; 13, 12: the log of the back-off weight of its context.
    """
    third, second, first = probabilities(counts, _V)
    value = lambda df, order: df.select("lang_no", F.lit(order).alias("ord"), F.col("code").cast("long").alias("code"), F.log("p").alias("value"))
    back = lambda df, order: df.select("lang_no", F.lit(order).alias("ord"), F.col("context").cast("long").alias("code"), F.log("back").alias("value")).distinct()
    return value(third, 3).unionByName(value(second, 2)).unionByName(value(first, 1)).unionByName(back(third, 13)).unionByName(back(second, 12))


class Model:
    """Sorted hashes of (language, order, code) and their values."""

    def __init__(self, lang_no: np.ndarray, order: np.ndarray, code: np.ndarray, value: np.ndarray) -> None:
        keys = self.key(lang_no, order, code)
        at = np.argsort(keys)
        self.keys, self.values = keys[at], value[at].astype(np.float32)

    @staticmethod
    def key(lang_no, order, code) -> np.ndarray:
        return mixed((np.asarray(lang_no, np.uint64) << np.uint64(40)) + (np.asarray(order, np.uint64) << np.uint64(32)) + np.asarray(code, np.uint64))

    def get(self, no: int, order: int, code: np.ndarray, other: float) -> tuple[np.ndarray, np.ndarray]:
        key = self.key(no, order, code)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.values[at], np.float32(other)), found

    def log_p(self, no: int, code: np.ndarray) -> np.ndarray:
        """Of distinct codes: the log probability of the last class after the two before it."""
        p1, _ = self.get(no, 1, code % _V, np.log(0.05 / _V))
        p2, has2 = self.get(no, 2, code % _V**2, 0.0)
        b2, _ = self.get(no, 12, code // _V % _V, 0.0)
        p2 = np.where(has2, p2, b2 + p1)
        p3, has3 = self.get(no, 3, code, 0.0)
        b3, _ = self.get(no, 13, code // _V, 0.0)
        return np.where(has3, p3, b3 + p2)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    bare = text.translate(None, _SPACE)
    chars = len(bare) - int(((np.frombuffer(bare, np.uint8) & 0xC0) == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > 5:
        h = window_hashes(hashed_words([text])[0], 5)
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[back] > 1)
        if len(at):
            mark = np.zeros(len(words), bool)
            for k in range(5):
                mark[at + k] = True
            repeated = int(mark.sum())
    return len(words), chars, sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), len(lines) - len(set(lines)), repeated


def _key(no: int, code: np.ndarray) -> np.ndarray:
    return mixed(mixed(np.array([no], np.int64).view(np.uint64)) + code.view(np.uint64))


_SCORED = "doc_id long, lang_no long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, known double, letters long, n_bytes long, rare array<long>, times array<long>"


def _score(often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, (keys, values) = lower_points(), often.value
        for batch in batches:
            numbers = _index(batch)
            for at, texts in byte_texts(batch):
                own = numbers[at : at + len(texts)]
                known, letter, rare, times = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [[]] * len(texts), [[]] * len(texts)
                for no in np.unique(own):
                    mine = [i for i, t in enumerate(texts) if t and own[i] == no]
                    if not mine:
                        continue
                    codes, letter[mine] = zip(*(point_grams(texts[i], *points) for i in mine), strict=True)
                    sizes = np.array([len(c) for c in codes])
                    distinct, back = np.unique(np.concatenate(codes), return_inverse=True)
                    key = _key(int(no), distinct)
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    there = keys[place] == key if len(keys) else np.zeros(len(key), bool)
                    value = np.where(there, values[place], 0.0) if len(keys) else np.zeros(len(key))
                    known[mine] = np.add.reduceat(value[back], np.cumsum(sizes) - sizes)
                    # Of a document's other n-grams, each once with its count.
                    left = np.flatnonzero(~there[back])
                    pair, n = np.unique(np.repeat(np.arange(len(mine)), sizes)[left] * len(distinct) + back[left], return_counts=True)
                    which = pair // len(distinct)
                    for w in np.unique(which):
                        j = slice(*np.searchsorted(which, [w, w + 1]))
                        rare[mine[w]], times[mine[w]] = distinct[pair[j] % len(distinct)], n[j]
                rows = list(zip(*(base_counts(t) for t in texts), strict=True))
                columns = [*(pa.array(c, pa.int64()) for c in rows), pa.array(known), pa.array(letter), pa.array([len(t) for t in texts], pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), *columns], [f.split()[0] for f in _SCORED.split(", ")])

    return run


def score_quality(docs: DataFrame, spread: float = 3.0, sent: int = 1_000_000) -> DataFrame:
    """Counts, base_failed, surprise (negative log probability for each letter) and kept of every document.

    sent: the most n-grams that are broadcast; all others are joined.
    """
    texts = docs.select("doc_id", F.xxhash64("lang").alias("lang_no"), "text")
    counts = checkpointed(texts.mapInArrow(_count, "lang_no long, code long, n long").groupBy("lang_no", "code").agg(F.sum("n").alias("n")))
    model = probabilities(counts, _POINTS)[0].select("lang_no", "code", "n", (-F.log("p")).alias("cost"))
    total = counts.select(F.sum("n")).first()[0] or 0
    # At most `sent` n-grams have this share of all.
    share = F.col("n") * sent >= F.lit(total)
    rows = model.where(share).toPandas()
    keys = np.concatenate([_key(int(no), own["code"].to_numpy()) for no, own in rows.groupby("lang_no")]) if len(rows) else np.empty(0, np.uint64)
    values = np.concatenate([own["cost"].to_numpy() for _, own in rows.groupby("lang_no")]) if len(rows) else np.empty(0)
    order = np.argsort(keys)
    often = docs.sparkSession.sparkContext.broadcast((keys[order], values[order]))
    # Written, so the row numbers stay.
    scored = checkpointed(texts.mapInArrow(_score(often), _SCORED).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", "lang_no", F.explode(F.arrays_zip("rare", "times")).alias("e")).select("row", "lang_no", F.col("e.rare").alias("code"), "e.times")
    rest = rare.join(model.where(~share), ["lang_no", "code"]).groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("rest"))
    surprise = (F.col("known") + F.coalesce("rest", F.lit(0.0))) / F.greatest("letters", F.lit(1))
    scored = scored.drop("rare", "times").join(rest, "row", "left").withColumn("surprise", F.when(F.col("n_bytes") > 0, surprise)).drop("row", "rest", "known", "letters")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = checkpointed(scored.withColumn("base_failed", base))
    quartiles = scored.where("NOT base_failed").groupBy("lang_no").agg(F.percentile_approx("surprise", [0.25, 0.75], 10_000).alias("q"))
    near = F.col("q")[1] - F.col("q")[0] + 0.01
    room = spread * near * F.sqrt(1 + 400 / F.greatest(F.col("n_bytes"), F.lit(1)))
    inside = F.col("surprise").between(F.col("q")[0] - room, F.col("q")[1] + room)
    # One row a language.
    out = scored.join(F.broadcast(quartiles), "lang_no", "left")
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "surprise", "base_failed", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
