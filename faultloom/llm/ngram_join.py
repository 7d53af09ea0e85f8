"""Exact Jaccard join of documents on word n-grams, by partition of the universe and the pigeonhole.

Two sets with a similarity of t or more differ in at most H = (|R| + |S|) (1 - t) / (1 + t) elements. A hash cuts
the universe into m segments; if R and S differ in at most H elements, and the segments of R get allowances
v in {0, 1, 2} that sum to H + 1 or more, then some segment differs in at most v - 1 elements: it is equal (v = 1), or
equal after one deletion (v = 2). So equal signatures of segments, and of their one-deletion neighbourhoods,
find every pair; parities of the elements by class, which bound the difference from below, rule most others
out, and an exact count of the intersection verifies the rest.

Size bands: sizes fall into bands of ratio 1 / t, so a partner lies in the same band or the next one. Band k has its
own m, a quarter above the H of its largest sizes. A set sends its segments under its own band and under the one below.

Allocation by cost: what a signature costs is the number of sets that share it, which is counted in groups of signatures. A segment whose
signature more than `most` sets share, in several components still, costs too much and gets 0; so does an empty one, which is never sent. Each
other one gets 1. Sets whose sum falls short of H + 1 then send the one-deletion neighbourhoods of their segments as well (a pair
is lost only if both fall short), and segments whose neighbourhood no more than `most` share get 2. Sets of a signature that is too
common are linked to one pivot of theirs, so it never emits all its pairs; if after verification one component holds all of them, nothing is
missing and it is no longer too common.

What still falls short, sets that consist of common segments nearly whole, meets by elements in one order, rare ones first: only on an element so
early in both sets that what follows can still be similar enough, only across components, and after each set was
tried against one set of another component for several of its elements. This is exact for every size.

How it is dealt out: signatures travel as packed blocks, a task's share at a time, to groups by their upper bits; a signature that is
hot within a share keeps only `most` of its sets there. Equal sets are one class from the start, by 64 bits of the sums of their elements and of
the squares of these: at 10**10 different texts about three pairs are expected to be taken for equal. Elements are 64-bit hashes, n-grams of word hashes.

Edge cases: null and empty texts have no element and link with nothing; texts with fewer words than n are
one element, their whole sequence; a very long text is held whole by one task, some twenty times its size; repeated rows and ids are rows of
their own; an empty table gives an empty result; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SENT, byte_texts, checkpointed, components, dropped, give_back, groups_for, hashed_words, mixed, route, row_key, sent, table, window_hashes

_FLUSH = 1 << 18
_SETS = 60_000
_BLOCK = "part int, sigs binary, who binary, names binary, sizes binary, out binary"
_STATS = "doc_id long, key long, n_shingles long, name long, spare0 int, spare1 int, small array<long>, wide array<long>"
_OUT = "hot boolean, a long, b long"


class Bands:
    """Size bands of ratio 1 / t for a similarity of t = num / 100, and their numbers of segments."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, -(-low[-1] * 100 // percent)))
        self.low = np.array(low)
        self.segments = [int(self.apart(u - 1, (u - 1) * 100 // percent) * 1.25) + 4 for u in low[1:]]

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def apart(self, s: int, r: int) -> int:
        """The most elements in which sets of sizes s and r can differ."""
        return (s + r) * (100 - self.percent) // (100 + self.percent)

    def need(self, n: int, band: int) -> int:
        """H + 1 for a set of size n against the partners it meets under a band."""
        return 1 + (self.apart(n, n * 100 // self.percent) if self.of(n) == band else self.apart(int(self.low[band + 1]) - 1, n))


def elements(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-grams of word hashes; fewer words are one element."""
    if len(words) < n:
        return mixed(window_hashes(words, len(words)) + np.uint64(len(words))) if len(words) else words
    return _distinct(window_hashes(words, n))


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def name(own: np.ndarray) -> int:
    """64 bits that name a set: of the sums of its elements and of their squares, and of its size."""
    out = np.array([own.sum(), (own * own).sum(), len(own)], np.uint64)
    out = mixed(out)
    return int(mixed(out[:1] * np.uint64(3) + out[1:2] * np.uint64(5) + out[2:] * np.uint64(7))[0].astype(np.int64))


def sketch(own: np.ndarray, least: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Parities of a set's elements in 1024 classes, and in two to four classes an element: sets that differ in d elements differ in at most d bits.

    Classes are low bits of the element, so the second half of the wide parities folds onto the first to halve their number.
    """
    wide = max(least, 1 << (2 * len(own) - 1).bit_length())
    pack = lambda n: np.packbits((np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8)).view(np.int64)
    return pack(least), pack(wide)


def segments(own: np.ndarray, bands: Bands, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a set's segments that aren't empty: number, first element, size. Segments are ranges of elements, which are hashes and sorted."""
    at = route(own, bands.segments[band])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.diff(np.append(first, len(at)))


def _bands_of(own: np.ndarray, bands: Bands) -> tuple[int, ...]:
    k = bands.of(len(own))
    return (k, k - 1) if k else (0,)


def _marked(h: np.ndarray, band: int) -> np.ndarray:
    """Signatures whose last bit tells apart the two bands that a set sends under."""
    return h & ~np.uint64(1) | np.uint64(band & 1)


def _keys(at: np.ndarray, band: int) -> np.ndarray:
    return mixed(at.astype(np.uint64) + np.uint64((band << 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))


def signatures(own: np.ndarray, bands: Bands, band: int) -> np.ndarray:
    """One signature for each segment that isn't empty: two sets have the same if the segments are equal."""
    at, first, _ = segments(own, bands, band)
    return _marked(mixed(np.add.reduceat(own, first) + _keys(at, band)), band)


def neighbourhoods(own: np.ndarray, bands: Bands, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, segment of each): of every segment itself, in a space of their own, and of it without one of its elements.

    Two sets have one in common if the segments differ in one element at most, but that a segment of one element isn't emptied,
    as anyone has the empty one.
    """
    at, first, size = segments(own, bands, band)
    total, key = np.add.reduceat(own, first), mixed(_keys(at, band) + np.uint64(1))
    place = np.repeat(np.arange(len(at)), size)
    cut = size[place] > 1
    sums = np.concatenate([total, (total[place] - own)[cut]])
    which = np.concatenate([np.arange(len(at)), place[cut]])
    return _marked(mixed(sums + key[which]), band), which


def allowances(own: np.ndarray, bands: Bands, band: int, hot: np.ndarray, hot_near: np.ndarray) -> int:
    """The sum of a set's allowances: 0 for a segment whose signature is hot, 2 if its neighbourhood isn't hot either, else 1."""
    cold = ~np.isin(signatures(own, bands, band), hot)
    near, which = neighbourhoods(own, bands, band)
    far = cold & (segments(own, bands, band)[2] > 1)
    far[which[np.isin(near, hot_near)]] = False
    return int(cold.sum() + far.sum())


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of its batch, elements) of each text."""
    for batch in batches:
        for at, texts in byte_texts(batch):
            h, number = hashed_words(texts, lower=True)
            grams, end = window_hashes(h, n), np.cumsum(number)
            for i, (lo, hi) in enumerate(zip((end - number).tolist(), end.tolist(), strict=True)):
                yield at + i, _distinct(grams[lo : hi - n + 1]) if hi - lo >= n else elements(h[lo:hi], n)


def _statistics(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            rows = []
            for _, own in _sets(iter([batch]), n):
                if not len(own):
                    rows.append((0, None, None, None, None, None))
                    continue
                spare = [None, None]
                for band in _bands_of(own, bands):
                    spare[band & 1] = len(segments(own, bands, band)[0]) - bands.need(len(own), band)
                rows.append((len(own), name(own), *spare, *sketch(own)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [f.split()[0] for f in _STATS.split(", ")])

    return run


def _pairs(sigs: np.ndarray, names: np.ndarray, sizes: np.ndarray, most: int, percent: int, keep: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows of hot, a, b; which entries to keep): pairs of sets with equal signatures, or of a pivot with each if more than `most`.

    Entries must be distinct and sorted by signature, then name. keep: only hot signatures are answered, and all but
    `most` of their entries go.
    """
    first = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]]))
    count = np.diff(np.append(first, len(sigs)))
    rank = np.arange(len(sigs)) - np.repeat(first, count)
    group = np.repeat(count, count)
    out = []
    big = group > most
    if not keep:
        for d in range(1, most):
            i = np.flatnonzero((rank >= d) & ~big)
            out.append(np.stack([np.zeros(len(i), np.int64), i - d, i]))
    star = np.flatnonzero(big & (rank > 0))
    out.append(np.stack([np.zeros(len(star), np.int64), np.repeat(first, count)[star], star]))
    hit = np.concatenate(out, axis=1)
    small, large = np.minimum(sizes[hit[1]], sizes[hit[2]]), np.maximum(sizes[hit[1]], sizes[hit[2]])
    hit = hit[1:, 100 * small >= percent * large]
    pairs = np.unique(np.stack([np.minimum(names[hit[0]], names[hit[1]]), np.maximum(names[hit[0]], names[hit[1]])]), axis=1)
    hot = np.flatnonzero(big)
    rows = np.concatenate([np.concatenate([np.zeros((1, pairs.shape[1]), np.int64), pairs]), np.stack([np.ones(len(hot), np.int64), sigs[hot].view(np.int64), names[hot]])], axis=1)
    return rows, ~big | (rank < most)


def _ordered(sigs: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((names, sigs))
    sigs, names, sizes = sigs[order], names[order], sizes[order]
    new = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (names[1:] != names[:-1])])
    return sigs[new], names[new], sizes[new]


def _emit(n: int, percent: int, groups: int, most: int, near: bool = False):
    """Packed signatures of sets, or with `near` of their one-deletion neighbourhoods."""

    def flush(held: list[np.ndarray], who: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        counts = [len(x) for x in held]
        sigs, names, size = _ordered(np.concatenate(held), np.repeat(np.array(who, np.int64), counts), np.repeat(np.array(sizes, np.int64), counts))
        done, keep = _pairs(sigs, names, size, most, percent, True)
        sigs, names, size = sigs[keep], names[keep], size[keep]
        edges = np.searchsorted(route(sigs, groups), np.arange(groups + 1))
        rows = []
        for g in np.flatnonzero(np.diff(edges)):
            mine = slice(edges[g], edges[g + 1])
            table, at, which = np.unique(names[mine], return_index=True, return_inverse=True)
            rows.append((int(g), sigs[mine].tobytes(), which.astype(np.uint16).tobytes(), table.tobytes(), size[mine][at].astype(np.uint32).tobytes(), done.T.tobytes() if not rows else b""))
        for i in range(0, len(rows), 256):
            columns = list(zip(*rows[i : i + 256], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "sigs", "who", "names", "sizes", "out"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        held: dict[int, tuple[np.ndarray, int]] = {}
        total = 0
        for _, own in _sets(batches, n):
            if not len(own) or (own_name := name(own)) in held:
                continue
            parts = [neighbourhoods(own, bands, band)[0] if near else signatures(own, bands, band) for band in _bands_of(own, bands)]
            held[own_name] = (np.concatenate(parts), len(own))
            total += len(held[own_name][0])
            if total >= _FLUSH or len(held) >= _SETS:
                yield from flush([x for x, _ in held.values()], list(held), [s for _, s in held.values()])
                held, total = {}, 0
        if held:
            yield from flush([x for x, _ in held.values()], list(held), [s for _, s in held.values()])
        held.clear()
        give_back()

    return run


def _meet(percent: int, most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        sigs = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["sigs"]])
        names = np.concatenate([np.frombuffer(t, np.int64)[np.frombuffer(w, np.uint16)] for t, w in zip(rows["names"], rows["who"], strict=True)])
        sizes = np.concatenate([np.frombuffer(t, np.uint32)[np.frombuffer(w, np.uint16)] for t, w in zip(rows["sizes"], rows["who"], strict=True)]).astype(np.int64)
        # Most signatures are alone: sort them once, and go on with those that aren't.
        order = np.argsort(sigs)
        s = sigs[order]
        same = s[1:] == s[:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(s) else order
        found, _ = _pairs(*_ordered(sigs[order], names[order], sizes[order]), most, percent, False)
        found = np.concatenate([found, *(np.frombuffer(x, np.int64).reshape(-1, 3).T for x in rows["out"] if x)], axis=1)
        return pd.DataFrame({"hot": found[0].astype(bool), "a": found[1], "b": found[2]})

    return run


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x.tobytes() for _, x in _sets(iter([batch]), n)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("name")), pa.array(own, pa.binary())], ["name", "own"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= percent * (len(both) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _some(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of sets, one for each name, that pairs (a, b) name."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("name"))
    if 2 * pairs.count() <= SENT:
        # Repeated names do no harm here, so a short list needs no shuffle.
        return checkpointed(sets.join(F.broadcast(wanted), "name", "left_semi"))
    wanted = checkpointed(wanted.distinct())
    out = checkpointed(sets.join(sent(wanted), "name"))
    dropped(wanted)
    return out


def _near_pairs(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the parities do not rule out, before any text is read; a < b."""
    for column in ("small", "wide"):
        own = _some(sets.select("name", F.col("n_shingles").alias("size"), F.col(column).alias("bits")), pairs)
        of = lambda c: own.select(F.col("name").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}"))  # noqa: B023, E731
        half = F.least(F.size("bits_a"), F.size("bits_b"))
        # Sizes differ by a third at most, so one side may have twice the classes.
        fold = lambda c: F.when(F.size(c) > half, F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))  # noqa: B023, E731
        apart = F.aggregate(F.zip_with(fold("bits_a"), fold("bits_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        near = pairs.join(of("a"), "a").join(of("b"), "b").where(apart <= F.floor((F.col("size_a") + F.col("size_b")) * (100 - percent) / (100 + percent)))
        before, pairs = pairs, checkpointed(near.select("a", "b"))
        dropped(own, *([before] if column == "wide" else []))
    return pairs


def _links(texts: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of names whose sets are similar enough, counted exactly."""
    wanted = _some(sets.select("name", "key"), pairs)
    # 16 bytes each, counted just before; a longer list meets the texts in a shuffle.
    own = texts.join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, "key").select("key", "name", "text").mapInArrow(_set_rows(n), "name long, own binary")
    one = pairs.join(own.withColumnsRenamed({"name": "a", "own": "x"}), "a")
    both = one.join(own.withColumnsRenamed({"name": "b", "own": "y"}), "b").select("a", "b", "x", "y")
    out = checkpointed(both.mapInArrow(_verify(percent), "a long, b long"))
    dropped(wanted)
    return out


def _placed(rows: DataFrame, part: DataFrame, column: str) -> DataFrame:
    """The rows with `component` of the name in `column`; a set without links is its own."""
    return rows.join(part.withColumnRenamed("id", column), column, "left").withColumn("component", F.coalesce("component", column))


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """The pairs that lie in different components."""
    one = _placed(pairs, part, "a").withColumnRenamed("component", "part_a")
    return _placed(one, part, "b").where("part_a <> component").select("a", "b")


def _linked(texts: DataFrame, sets: DataFrame, pairs: DataFrame, part: DataFrame, n: int, percent: int, steps: int = 2) -> DataFrame:
    """The components (id, component) with links added that connect what any of the pairs connects.

    Sets are large and pairs many, so in the first of two steps each set is only counted against the least of its partners; then only
    the pairs that lie in different components still matter. Components before stand for all links that made them.
    """
    near = _near_pairs(sets, pairs, percent)
    for step in range(steps):
        if near.isEmpty():
            break
        some = checkpointed(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")) if step < steps - 1 else near
        found = _links(texts, sets, some, n, percent)
        if not found.isEmpty():
            part = sent(components(found.unionByName(part.select(F.col("id").alias("a"), F.col("component").alias("b")))))
        dropped(found)
        if step < steps - 1:
            before, near = near, checkpointed(_apart(near, part))
            dropped(before, some)
    dropped(near)
    return part


def _unclear(hot: DataFrame, part: DataFrame) -> DataFrame:
    """The rows (a: what sets share, b: name, ...) whose sets of one a are not all in one component by now, with `component`."""
    own = _placed(hot, part, "b")
    several = own.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("a")
    return checkpointed(own.join(several, "a"))


def _bridges(unclear: DataFrame, each: int = 8) -> DataFrame:
    """Pairs of every set of unclear rows with sets of other components, for `each` of its rows: what links them soon need not be paired with all.

    They only save work; whether a pair is found does not depend on them.
    """
    by = F.xxhash64("a", "b")
    some = unclear.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(by))).where(F.col("r") <= each).drop("r")
    one = unclear.groupBy("a").agg(F.min_by(F.struct("b", "component"), by).alias("p"))
    two = unclear.join(one, "a").where(F.col("p.component") != F.col("component")).groupBy("a").agg(F.min_by("b", by).alias("q"))
    held = some.join(one, "a").join(two, "a")
    other = F.when(F.col("p.component") != F.col("component"), F.col("p.b")).otherwise(F.col("q"))
    return checkpointed(held.select(F.least("b", other).alias("a"), F.greatest("b", other).alias("b")).distinct())


def _short(n: int, percent: int):
    """(name, size, element) of the sets whose allowances sum up to too little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            hot, near, names = (batch.column(batch.schema.get_field_index(c)) for c in ("hot", "hot_near", "name"))
            for i, own in _sets(iter([batch]), n):
                gone, gone_near = (np.array(x[i].as_py() or [], np.int64).view(np.uint64) for x in (hot, near))
                if any(allowances(own, bands, band, gone, gone_near) < bands.need(len(own), band) for band in _bands_of(own, bands)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), names[i].as_py())), pa.array(np.full(len(own), len(own))), pa.array(own.view(np.int64))], ["name", "size", "element"])

    return run


def _prefixes(held: DataFrame, percent: int) -> DataFrame:
    """Of sets (name, size, element) the elements (element, name, size, left) that a similar set may meet them on.

    Elements are put in one order, rare ones first; left is what follows one, itself included.
    """
    often = held.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    counted = held.join(often, "element", "left").fillna(1, ["n"])
    rank = F.row_number().over(Window.partitionBy("name").orderBy("n", "element"))
    counted = counted.withColumn("left", F.col("size") - rank + 1)
    return checkpointed(counted.where((100 * F.col("left") >= percent * F.col("size")) & (F.col("n") > 1)).select("element", "name", "size", "left"))


def _rest_pairs(prefixes: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that may be similar by the elements they share.

    Two similar sets share an element so early in both that what is left there can still fill the intersection they need: the
    first one they share. So they meet on it.
    """
    own = _unclear(prefixes.select(F.col("element").alias("a"), F.col("name").alias("b"), "size", "left"), part)
    x, y = own.alias("x"), own.alias("y")
    on = (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b")) & (F.col("x.component") != F.col("y.component"))
    on &= 100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size")
    on &= (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.size") + F.col("y.size"))
    return checkpointed(x.join(y, on).select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct())


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 75, most: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, class) of every document: the size of its set, the least id of its class under the links, its row key and a number of the class.

    The number is null without words; classes of rows with the same id differ in it.

    percent: the least similarity in hundredths; most: sets that may share a signature before a pivot stands for them.
    """
    texts = docs.select("doc_id", row_key().alias("key"), "text")
    stats = checkpointed(texts.mapInArrow(_statistics(n, percent), _STATS))
    # One row for each set.
    sets = checkpointed(stats.where("name IS NOT NULL").dropDuplicates(["name"]))
    groups = groups_for(sets, F.col("n_shingles"), 1_200_000)
    part = sets.select(F.col("name").alias("id"), F.col("name").alias("component")).limit(0)

    def linked(some: DataFrame, near: bool, groups: int) -> DataFrame:
        """Links what meets by signatures; (a: signature, b: name) of the hot ones."""
        nonlocal part
        met = checkpointed(some.mapInArrow(_emit(n, percent, groups, most, near), _BLOCK).groupBy("part").applyInPandas(_meet(percent, most), _OUT).distinct())
        part = _linked(texts, sets, met.where("NOT hot").select("a", "b"), part, n, percent)
        return met.where("hot").select("a", "b")

    unclear = _unclear(linked(texts, False, groups), part)
    # By the number of its signatures that got no allowance a set falls short or not; no text is read for that.
    gone = unclear.groupBy(F.col("b").alias("name")).agg(F.collect_list("a").alias("hot"), *(F.count_if(F.col("a") % 2 == 0 if i == 0 else F.col("a") % 2 != 0).alias(f"hot{i}") for i in (0, 1)))
    short = " OR ".join(f"coalesce(hot{i}, 0) > spare{i}" for i in (0, 1))
    some = checkpointed(sets.join(gone, "name", "left").where(short).select("key", "name", "hot"))
    weight = some.select(F.sum(2 + F.coalesce(F.size("hot"), F.lit(0)))).first()[0] or 0
    if weight:
        # 8 bytes each, counted just before; a longer list meets the texts in a shuffle. One row for each set.
        some = F.broadcast(some) if weight <= 2 * SENT else some
        short = checkpointed(texts.join(some, "key").select("name", "text", "hot").dropDuplicates(["name"]))
        near = linked(short, True, groups_for(short, F.octet_length("text"), 4 << 20))
        near = near.groupBy(F.col("b").alias("name")).agg(F.collect_list("a").alias("hot_near"))
        held = checkpointed(short.join(near, "name", "left").mapInArrow(_short(n, percent), "name long, size long, element long"))
        prefixes = _prefixes(held, percent)
        for pairs in (lambda: _bridges(_unclear(prefixes.select(F.col("element").alias("a"), F.col("name").alias("b")), part)), lambda: _rest_pairs(prefixes, part, percent)):
            part = _linked(texts, sets, pairs(), part, n, percent, 1)
    # Classes, not rows, meet here: the least id of each name, then of each component.
    least = stats.where("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("least"))
    known = _placed(least, part, "name")
    whole = known.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = known.join(whole, "component").select("name", "component", "component_id")
    return stats.join(classes, "name", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "key", F.col("component").alias("class"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).drop("key", "class")


SQL = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sha256(array_to_string(ws[i:i + 4], ' ')) AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS v, b AS u FROM edge UNION SELECT v, e.b FROM reach JOIN edge e ON e.a = u)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(u) AS m FROM reach GROUP BY v) ON v = w.doc_id""",
}
