"""Approximate nearest neighbours by learned partitions.

On a sample of at most `sample` vectors the graph of nearest neighbours is cut into balanced partitions (grown along the
graph, then refined by moves to the partition most neighbours are in, under a bound of its size). A small network with one hidden
layer learns, from a vector, the shares of its neighbours among the partitions. Every row is indexed under its most
probable partition. A query goes to its most probable partitions until their probabilities sum to `mass` and they hold k other rows, and what lies there is
reranked by the exact inner product in double precision. `mass` is the least that reaches the wanted recall on
queries of the sample that the network has not seen.

The index covers every row; the sample, the network (64 x 128 x partitions weights) and the partitions' sizes are all that the driver
holds. Partitions are dealt out in slices of `slice_rows` rows by a hash of the row's number, so a vector that a third of all rows equal
fills many slices and no task; the queries that visit a partition are dealt into blocks of `block_rows`, each of which meets every slice,
so a task holds one slice and one block however many rows there are, and each visit gives at most k rows.

Edge cases: vectors that are null, of another length than the most, all zero, or hold null or non-finite components take no part, as
queries or candidates; ties go to the smaller id; rows with the same id are queries and candidates of their own; with k candidates or fewer all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others by inner product of each row."""
    out = np.empty((len(x), k), np.int32)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """A partition of each vertex: grown along the graph to equal sizes, then refined without exceeding slack * mean."""
    n = len(graph)
    most, part, queue = -(-n // parts), np.full(n, -1), []
    order = np.random.default_rng(seed).permutation(n)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    at = 0
    for p in range(parts):
        size, queue = 0, []
        while size < most:
            while not queue and at < n:
                if part[order[at]] < 0:
                    queue = [int(order[at])]
                at += 1
            if not queue:
                break
            v = queue.pop(0)
            if part[v] >= 0:
                continue
            part[v] = p
            size += 1
            queue += [int(u) for u in graph[v] if part[u] < 0] + [u for u in back[v] if part[u] < 0]
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for v in range(n):
            near = np.concatenate([part[graph[v]], part[np.array(back[v], np.int64)]])
            count = np.bincount(near, minlength=parts)
            count[sizes >= slack * n / parts] = 0
            to = int(count.argmax())
            if count[to] > (near == part[v]).sum():
                sizes[part[v]] -= 1
                sizes[to] += 1
                part[v] = to
                moved += 1
        if moved < n / 200:
            break
    return part


class Router:
    """A network of one hidden layer from a vector to the probabilities of the partitions."""

    def __init__(self, width: int, hidden: int, parts: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.w = [(rng.standard_normal((width, hidden)) * np.sqrt(2)).astype(np.float32), np.zeros(hidden, np.float32), (rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden)).astype(np.float32), np.zeros(parts, np.float32)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                b = order[i : i + 256]
                a = np.maximum(x[b] @ self.w[0] + self.w[1], 0)
                z = a @ self.w[2] + self.w[3]
                z = np.exp(z - z.max(1, keepdims=True))
                d = (z / z.sum(1, keepdims=True) - target[b]) / len(b)
                h = (d @ self.w[2].T) * (a > 0)
                t += 1
                for j, g in enumerate((x[b].T @ h, h.sum(0), a.T @ d, d.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    self.w[j] -= (0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).astype(np.float32)


def train(x: np.ndarray, rows: int, k: int, recall: float, per_part: int, seed: int = 0) -> tuple[Router, float]:
    """The router and the mass that reaches the recall on every tenth vector of the sample, which it has not seen."""
    # Small tables are cut too, into up to 8 partitions of 120 rows and more.
    parts = int(np.clip(max(rows // per_part, min(rows // 120, 8)), 1, max(len(x) // 50, 1)))
    test, own = x[::10], np.delete(x, np.s_[::10], axis=0) if len(x) >= 20 else x
    near = min(k, len(own) - 1)
    router = Router(x.shape[1], 128, parts, seed)
    router.least, router.lies = k + 1, np.full(parts, len(x))
    if parts == 1 or near < 1:
        return router, 1.0
    graph = neighbour_graph(unit(own), near)
    part = balanced_partition(graph, parts, seed=seed)
    target = np.zeros((len(own), parts), np.float32)
    np.add.at(target, (np.arange(len(own))[:, None], part[graph]), 0.75 / near)
    target[np.arange(len(own)), part] += 0.25
    router.fit(unit(own), target, max(8, min(40, 400_000 // len(own))), seed)
    home = router.probabilities(unit(own)).argmax(1)
    # Rows of the sample are indexed like all others, so a partition holds these at least.
    router.lies = np.bincount(router.probabilities(unit(x)).argmax(1), minlength=parts)
    test = test[:1000]
    s = test.astype(np.float64) @ own.astype(np.float64).T
    best = np.argpartition(-s, near - 1, axis=1)[:, :near]
    p = router.probabilities(unit(test))
    order = np.argsort(-p, axis=1)
    rank = np.argsort(order, axis=1)
    before = np.take_along_axis(np.cumsum(np.take_along_axis(p, order, 1), 1), rank, 1) - p
    # The mass that a neighbour needs is what stands before its partition.
    needed = np.sort(np.take_along_axis(before, home[best], 1).ravel())
    return router, float(min(needed[min(int(len(needed) * recall), len(needed) - 1)] + 1e-6, 1.0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _visits(router: Router, mass: float, x: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each row's partition, row and partition of each visit): rows that ask go to their most probable partitions up to the mass, and on until these hold k others."""
    p = router.probabilities(unit(x))
    query = np.flatnonzero(asks)
    order = np.argsort(-p[query], axis=1)
    ordered = np.take_along_axis(p[query], order, 1)
    lies = router.lies[order]
    at, rank = np.nonzero((np.cumsum(ordered, 1) - ordered < mass) | (np.cumsum(lies, 1) - lies < router.least))
    return p.argmax(1), query[at], order[at, rank]


def _tally(model):
    """How many rows lie in each partition, and how many queries visit it."""

    def run(batches):
        router, mass, share = model.value
        lie, visit = (np.zeros(len(router.w[3]), np.int64) for _ in range(2))
        for batch in batches:
            if batch.num_rows:
                home, _, to = _visits(router, mass, _matrix(batch.column(2)), batch.column(1).to_numpy() % share == 0)
                lie += np.bincount(home, minlength=len(lie))
                visit += np.bincount(to, minlength=len(lie))
        some = np.flatnonzero(lie + visit)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(lie[some]), pa.array(visit[some])], ["part", "lie", "visit"])

    return run


def _copies(rows: np.ndarray, part: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every row once for each of the numbers below `each`: (row, partition, number)."""
    return np.repeat(rows, each), np.repeat(part, each), np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)


def _route(model):
    def run(batches):
        router, mass, slices, blocks, share = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            home, query, to = _visits(router, mass, _matrix(batch.column(2)), batch.column(1).to_numpy() % share == 0)
            spread = key * 2654435761 % (1 << 31)
            # A row lies in one slice of its partition, and meets every block of queries there; a query of one block visits every slice.
            lies, lies_part, lies_block = _copies(np.arange(len(key)), home, blocks[home])
            asks, asks_part, asks_slot = _copies(query, to, slices[to])
            slot = np.concatenate([(spread[lies] * slices[lies_part]) >> 31, asks_slot])
            block = np.concatenate([lies_block, (spread[asks] * blocks[asks_part]) >> 31])
            rows, part = np.concatenate([lies, asks]), np.concatenate([lies_part, asks_part])
            ask = np.repeat([False, True], [len(lies), len(asks)])
            for i in range(0, len(rows), 10_000):
                j = slice(i, i + 10_000)
                took = batch.take(pa.array(rows[j]))
                yield pa.RecordBatch.from_arrays([*(pa.array(c[j].astype(np.int32)) for c in (part, slot, block)), pa.array(ask[j]), *took.columns], ["part", "slot", "block", "asks", "key", "vec_id", "embedding"])

    return run


def rerank(query_keys: np.ndarray, queries: np.ndarray, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """(query, id, score) of the k best of each query among the vectors, its own row aside; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    keys, ids, vectors = keys[order], ids[order], vectors[order].astype(np.float64)
    for i in range(0, len(query_keys), 64):
        q, own = queries[i : i + 64].astype(np.float64), query_keys[i : i + 64]
        s = q @ vectors.T
        s[own[:, None] == keys[None, :]] = -np.inf
        n = min(k, len(ids))
        least = np.partition(s, len(ids) - n, axis=1)[:, len(ids) - n]
        for j in range(len(q)):
            at = np.flatnonzero((s[j] >= least[j] - 1e-9 * max(1.0, abs(least[j]) if np.isfinite(least[j]) else 1.0)) & np.isfinite(s[j]))
            # Summed again in one order for each, so that equal vectors score the same wherever they lie.
            score = (vectors[at] * q[j]).sum(1)
            best = np.lexsort((ids[at], -score))[:n]
            yield own[j], ids[at][best], score[best]


def _search(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        if not asks.any() or asks.all():
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("key", "query_id", "scores", "ids")})
        x = np.stack(rows["embedding"].to_numpy())
        keys, ids = rows["key"].to_numpy(), rows["vec_id"].to_numpy()
        named = dict(zip(keys[asks], ids[asks], strict=True))
        found = list(rerank(keys[asks], x[asks], keys[~asks], ids[~asks], x[~asks], k))
        return pd.DataFrame({"key": [q for q, _, _ in found], "query_id": [named[q] for q, _, _ in found], "scores": [s for _, _, s in found], "ids": [i for _, i, _ in found]})

    return run


def nearest(vectors: DataFrame, k: int = 20, share: int = 20, recall: float = 0.97, sample: int = 20_000, per_part: int = 2000, slice_rows: int = 20_000, block_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose vec_id is divisible by share."""
    good = F.size("embedding") > 0
    for test in (lambda e: e.isNotNull(), lambda e: ~F.isnan(e) & (F.abs(e) != float("inf"))):
        good &= F.forall("embedding", test)
    good &= F.exists("embedding", lambda e: e != 0)
    held = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("embedding"))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)
    widths = usable.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    spark = vectors.sparkSession
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = usable.where(F.size("embedding") == widths[0]["w"])
    rows = widths[0]["count"]
    # The rows with the least hashes of their ids, `sample` at most; the filter only keeps the sort small.
    by = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000))
    picked = usable.where(by < int(1_100_000 * min(1.0, sample / rows)) + 1).orderBy(by, "vec_id").limit(sample).toPandas()
    picked = picked.sort_values("vec_id")
    router, mass = train(np.stack(picked["embedding"].to_numpy()).astype(np.float32), rows, k, recall, per_part)
    context = spark.sparkContext
    parts = len(router.w[3])
    # Rows are told apart by a number, as ids may repeat. A row's own copies as candidate and as query leave one task together.
    numbered = usable.select(F.monotonically_increasing_id().alias("key"), "vec_id", "embedding")
    counts = numbered.mapInArrow(_tally(context.broadcast((router, mass, share))), "part int, lie long, visit long").groupBy("part").agg(F.sum("lie").alias("lie"), F.sum("visit").alias("visit")).collect()
    slices, blocks = np.ones(parts, np.int64), np.ones(parts, np.int64)
    for r in counts:
        slices[r["part"]], blocks[r["part"]] = max(-(-r["lie"] // slice_rows), 1), max(-(-r["visit"] // block_rows), 1)
    kind = usable.schema["embedding"].dataType.simpleString()
    dealt = numbered.mapInArrow(_route(context.broadcast((router, mass, slices, blocks, share))), f"part int, slot int, block int, asks boolean, key long, vec_id long, embedding {kind}")
    # One row for a query's visit to a slice; at most k neighbours of each visit meet at the query.
    found = dealt.groupBy("part", "slot", "block").applyInPandas(_search(k), "key long, query_id long, scores array<double>, ids array<long>")
    every = found.groupBy("key", "query_id").agg(F.flatten(F.collect_list(F.arrays_zip("scores", "ids"))).alias("all"))
    best = F.slice(F.array_sort(F.transform("all", lambda x: F.struct((-x["scores"]).alias("less"), x["ids"].alias("vec_id"), x["scores"].alias("score")))), 1, k)
    ranked = every.select("query_id", F.posexplode(best).alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), "b.vec_id", "b.score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


SQL: dict[str, str] = {}
