"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of anything but ASCII white space. bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"

#: The most numbers, of 8 bytes each, that are broadcast.
SENT = 1_000_000

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_A = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def small_batches(spark: SparkSession) -> None:
    """From here on the session gives Python 1000 rows and about 4 MB at a time at most, not 10000 rows, as rows may be long texts."""
    if int(spark.conf.get(_BATCH, None) or 10_000) > 1000:
        spark.conf.set(_BATCH, "1000")
        spark.conf.set(_BATCH_BYTES, str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, in a session of small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names in spark.checkpoint.dir.

    Only a session without it, as in tests, gets a folder of this process.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


#: While a table is written its shuffle files go at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared folder; the shuffle files of its making go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    small_batches(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables that checkpointed() wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        paths = {f.rpartition("/")[0] for f in df.inputFiles()}
        for path in paths:
            if path.rpartition("/")[2].startswith("table-"):
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sent(df: DataFrame) -> DataFrame:
    """A table of numbers for a join: broadcast if they are few enough, counted here; a longer one meets the others in a shuffle."""
    return F.broadcast(df) if df.count() * len(df.columns) <= SENT else df


def groups_for(df: DataFrame, size: Column, per_group: int) -> int:
    """How many groups to deal work to, so that each stays near per_group units of size."""
    total = df.select(F.sum(size)).first()[0] or 0
    return int(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // per_group)))


def row_key() -> Column:
    """Names a document row by id and text, so that rows without id or with the same id stay apart."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def give_back() -> None:
    """Free memory of this Python worker returns to the machine, as one worker serves many stages, and idle ones wait for more."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19) -> Iterator[tuple[int, pa.Array]]:
    """(first row, the column's values) in slices of about `most` bytes."""
    texts = batch.column(batch.schema.get_field_index(column))
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :]) if len(texts) else []
    start, held = 0, 0
    for i, n in enumerate(size):
        held += int(n)
        if held >= most:
            yield start, texts.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts.slice(start)
    give_back()


def byte_texts(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) in slices of about `most` bytes; a null text is empty."""
    for start, texts in sliced(batch, column, most):
        yield start, [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_A))
_LOW_BYTES = _BYTES[np.where((np.arange(256) > 64) & (np.arange(256) < 91), np.arange(256) + 32, np.arange(256))]
#: Bytes that are hashed at once; a longer text is cut between words.
_STRETCH = 1 << 19
_LONG = 256
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """The powers of _A, and of its inverse, by position."""
    if not _POWERS:
        for base in (_A, pow(_A, -1, 1 << 64)):
            each = np.full(_STRETCH + 1, base, np.uint64)
            each[0] = 1
            _POWERS.append(np.multiply.accumulate(each))
    return _POWERS


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in order, number of words of each text). lower: A-Z count as a-z.

    A word's hash is a polynomial in its bytes' random values, taken from running sums of the whole stretch, and its length, mixed.
    Words of 256 bytes or more, for which polynomials have known collisions, are hashed by xxh3.
    """
    data = b"\n".join([b"", *texts, b""])
    raw = np.frombuffer(data, np.uint8)
    space = _SPACES[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size
    number = np.searchsorted(start, begin + size) - np.searchsorted(start, begin)
    power, inverse = _powers()
    values, out, at = _LOW_BYTES if lower else _BYTES, np.empty(len(start), np.uint64), 0
    while at < len(start):
        lo = int(start[at])
        to = max(int(np.searchsorted(end, lo + _STRETCH, side="right")), at + 1)
        s, e = start[at:to] - lo, np.minimum(end[at:to] - lo, _STRETCH)
        n = int(e[-1])
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[raw[lo : lo + n]] * power[:n], out=total[1:])
        out[at:to] = mixed((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    for i in np.flatnonzero(end - start >= _LONG):
        word = data[start[i] : end[i]]
        out[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return out, number


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[p:p+k] for each p; empty if h is shorter. Polynomials, doubled in width step by step."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, width, out, done = h, 1, None, 0
    while True:
        if k & width:
            part = power[done : done + n]
            out = part if out is None else out * np.uint64(pow(_A, width, 1 << 64)) + part
            done += width
        if 2 * width > k:
            return mixed(out)
        power = power[: len(power) - width] * np.uint64(pow(_A, width, 1 << 64)) + power[width:]
        width *= 2


def route(h: np.ndarray, groups: int) -> np.ndarray:
    """The group, of `groups`, that a hash belongs to: by its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """The bytes of an integer array, all first bytes, then all second bytes: high zero bytes meet and compress."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _raised(rows: DataFrame, up: DataFrame, column: str) -> DataFrame:
    """The rows with what stands above `column` in up (id, component) in its place; `column` must be an id of up."""
    above = up.select(F.col("id").alias(column), F.col("component").alias("above"))
    return rows.join(above, column).drop(column).withColumnRenamed("above", column)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long) as a written table (id, component), component being the least id reachable.

    In a round each vertex hangs on its least neighbour, if that is less than itself. Lookups of the table in itself, each of which goes three times as far,
    raise every vertex to the root of its tree, and the edges between different trees, as edges of roots, are what the next round starts from. A root of one round that
    has an edge left hangs on another or another hangs on it, so vertices halve at least. Where all edges are stars the first table is the answer.
    The only shuffle of a round is one by vertex for the least neighbour, partly aggregated before, so that a hub is no large group; tables of more
    than `SENT` numbers meet in shuffles too. Tables of earlier steps go as soon as the next ones are written.
    Vertices without edges are not returned; self-loops and repeated edges do not matter.
    """
    found = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    part = None
    while True:
        ends = found.unionByName(found.select(F.col("b").alias("a"), "b"))
        up = checkpointed(ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"), F.max("b").alias("other")))
        stars = up.where("component <> other").isEmpty()
        up, deeper = up.select("id", "component"), not stars
        while deeper:
            few = sent(up)
            higher = _raised(up, few, "component")
            # Two lookups in all; the second also tells whether one more would go on.
            after = checkpointed(higher.join(few.select(F.col("id").alias("component"), F.col("component").alias("above")), "component").select("id", F.col("above").alias("component"), (F.col("above") != F.col("component")).alias("more")))
            dropped(up)
            up, deeper = after.select("id", "component"), not after.where("more").isEmpty()
        few = sent(up)
        before, part = part, up if part is None else checkpointed(part.join(few.select(F.col("id").alias("component"), F.col("component").alias("above")), "component", "left").select("id", F.coalesce("above", "component").alias("component")))
        if before is not None:
            dropped(before)
        if stars:
            dropped(found, *([up] if before is not None else []))
            return part
        rest = _raised(_raised(found, few, "a"), few, "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        rest = checkpointed(rest)
        dropped(found, *([up] if before is not None else []))
        found = rest
        if found.isEmpty():
            dropped(found)
            return part
