"""Mixing of overlapping sources to target weights by min-cost flow.

A document may belong to several sources. Documents are summed by their membership pattern, and the
patterns' capacity is routed to the sources' targets: each pattern has one arc for every further copy of its words,
the k-th at cost k, so the cheapest flow repeats as little as it can and spreads what must be repeated.
The flow then says how many words each pattern gives, and documents are selected in the order of a
seeded hash of their id.

How it is dealt out: patterns are summed map-side, and only their sums reach the driver; a table of more than
`most_patterns` patterns is refused, as the flow is for a designed mix of named sources. Selection never
sorts a pattern in one task. A pattern gives `whole` copies of all its documents and one more copy of those whose
place in the seeded order lies below a threshold; the place falls into one of 4096 buckets, the sums of the
buckets find the one that the threshold is in, and only that bucket (1 / 4096 of its pattern) is sorted. What the threshold leaves open, because
the next document is too long for it, goes to later documents that fit, by a further threshold among those, `turns` of them in all.

Edge cases: a null text counts no words and is never taken; a null source is a source of its own, last in
order; sources without words get the target 0; an empty table gives an empty result; repeated rows with
the same id have one place and are taken all or none, as are documents without an id; documents without sources are never taken; very long texts only
count more words. The documents' own columns travel in a struct, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, table


def water_targets(sizes: list[float], weights: list[float], share: float, most: float) -> list[float]:
    """Targets by weight that sum to share * all sizes, none above most * its size, the excess reshared by weight."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    rest = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    weight = float(sum(weights))
    for j, i in enumerate(rest):
        if most * sizes[i] * weight > left * weights[i]:
            for k in rest[j:]:
                out[k] = left * weights[k] / weight
            break
        out[i] = most * sizes[i]
        left -= out[i]
        weight -= weights[i]
    return out


def route_capacity(patterns: list[tuple[tuple[int, ...], int]], targets: list[float], copies: int) -> list[list[float]]:
    """Min-cost flow: words that each pattern gives to each source; out[pattern][source].

    Successive shortest paths from the source's quota to the pattern with the cheapest free copy, through
    residual arcs, by Bellman-Ford; the graph has a node for each pattern and source only.
    """
    given = [[0.0] * len(targets) for _ in patterns]
    used = [0.0] * len(patterns)
    for s, quota in sorted(enumerate(targets), key=lambda x: x[0]):
        need = quota
        while need > 1e-9:
            # From s: to a pattern that holds it, or by taking words from another source of that pattern onwards.
            reach: dict[int, tuple[int, int] | None] = {s: None}
            queue, best = [s], None
            for t in queue:
                for p, (members, size) in enumerate(patterns):
                    if t not in members or not size:
                        continue
                    free = min(copies * size, (int(used[p] / size + 1e-12) + 1) * size) - used[p]
                    if free > 1e-9 and (best is None or used[p] / size < best[2] - 1e-12):
                        best = (p, t, used[p] / size, free)
                    for u in members:
                        if u not in reach and given[p][u] > 1e-9:
                            reach[u] = (t, p)
                            queue.append(u)
            if best is None:
                break
            p, t, _, free = best
            path, u, amount = [], t, min(need, free)
            while reach[u] is not None:
                v, via = reach[u]
                path.append((u, v, via))
                amount = min(amount, given[via][u])
                u = v
            # Next copies of a pattern cost more, so no step goes beyond the end of the current one.
            used[p] += amount
            given[p][t] += amount
            for u, v, via in path:
                given[via][u] -= amount
                given[via][v] += amount
            need -= amount
    return given


def seeded_place(doc_id, seed: int):
    """A number in 0 .. 2**60 - 1 from the id and the seed; the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def _next_cut(narrow: DataFrame, asked: list[tuple[list, int, float, float]]) -> list:
    """For each pattern asked, how far its documents of a later place than `after` and of at most `most` words go into `rest` words: the place up to which, and their words."""
    spark = narrow.sparkSession
    pattern = narrow.schema["pattern"].dataType.simpleString()
    wanted = F.broadcast(spark.createDataFrame(asked, f"pattern {pattern}, after long, most double, rest double"))
    open_to = narrow.join(wanted, "pattern").where("place > after AND size <= most").withColumn("bucket", F.shiftright("place", 48).cast("int"))
    # Sums of at most 4096 buckets a pattern; the window runs over those sums only.
    buckets = open_to.groupBy("pattern", "bucket", "rest").agg(F.sum("size").alias("n"))
    before = buckets.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n"))
    over = F.col("before") + F.col("n") > F.col("rest")
    # Sums only grow, so the least bucket that goes over and the least sum before one belong together.
    split = before.groupBy("pattern").agg(F.sum("n").alias("total"), F.min(F.when(over, F.col("bucket"))).alias("bucket"), F.min(F.when(over, F.col("before"))).alias("before"))
    # Only the bucket of the threshold is sorted.
    near = open_to.join(F.broadcast(split.where("bucket IS NOT NULL").select("pattern", "bucket", "before")), ["pattern", "bucket"])
    fits = near.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("place"))).where("upto <= rest")
    last = fits.groupBy("pattern").agg(F.max("place").alias("place"), F.max("upto").alias("upto"))
    whole = F.col("bucket").isNull()
    place = F.when(whole, F.lit(2**60)).otherwise(F.coalesce("place", F.shiftleft(F.col("bucket").cast("long"), 48) - 1))
    used = F.when(whole, F.col("total")).otherwise(F.coalesce("upto", "before"))
    return split.join(last, "pattern", "left").select("pattern", place.alias("place"), used.alias("used")).collect()


def _routed(docs: DataFrame, size, sources, targets: dict[str | None, float], copies: int, seed: int, most_patterns: int, turns: int) -> DataFrame:
    """(row, size, pattern, taken): the documents' own columns in a struct, so that none can clash."""
    none = F.array().cast(docs.select(sources.alias("s")).schema["s"].dataType)
    parts = {"size": F.coalesce(size, F.lit(0)).cast("long"), "pattern": F.coalesce(F.array_sort(F.array_distinct(sources)), none), "place": seeded_place(F.col("doc_id"), seed)}
    own = [c.alias(k) for k, c in parts.items()]
    narrow = checkpointed(docs.select(*own))
    sums = narrow.groupBy("pattern").agg(F.sum("size").alias("n")).limit(most_patterns + 1).collect()
    if len(sums) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    names = list(targets)
    index = {name: i for i, name in enumerate(names)}
    patterns = [(tuple(index[x] for x in r["pattern"] if x in index), int(r["n"])) for r in sums]
    flow = route_capacity(patterns, [targets[x] for x in names], copies)
    whole, rest, cuts = {}, {}, {}
    for r, (_, n), row in zip(sums, patterns, flow, strict=True):
        key, total = tuple(r["pattern"]), float(sum(row))
        whole[key] = min(int(total / n + 1e-12), copies) if n else 0
        rest[key], cuts[key] = round(total - whole[key] * n, 6), []
    after, most = dict.fromkeys(rest, -1), dict.fromkeys(rest, float(2**62))
    for _ in range(turns):
        asked = [(list(k), after[k], most[k], v) for k, v in rest.items() if v >= 1]
        found = _next_cut(narrow, asked) if asked else []
        for r in found:
            key = tuple(r["pattern"])
            cuts[key].append((r["place"], most[key]))
            rest[key] = round(rest[key] - r["used"], 6)
            after[key], most[key] = r["place"], rest[key]
    plan = docs.sparkSession.createDataFrame([(list(k), whole[k], cuts[k]) for k in cuts], f"pattern {narrow.schema['pattern'].dataType.simpleString()}, whole int, cuts array<struct<place:long,most:double>>")
    joined = docs.select(F.struct("*").alias("row"), *own).join(F.broadcast(plan), "pattern")
    more = F.exists("cuts", lambda c: (F.col("place") <= c["place"]) & (F.col("size") <= c["most"])).cast("int")
    return joined.select("row", "size", "pattern", (F.least(F.col("whole") + more, F.lit(copies)) * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, size, sources, targets: dict[str | None, float], copies: int = 2, seed: int = 0, most_patterns: int = 10_000, turns: int = 4) -> DataFrame:
    """The documents with mix_size (words of one copy) and taken (words that the mix takes, repeats counted), in place of columns of these names.

    size: the words of a document; sources: an array of the sources that hold it; targets: words wanted of each
    source. No document is taken more than `copies` times.
    """
    out = _routed(docs, size, sources, targets, copies, seed, most_patterns, turns)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("mix_size", "taken")), F.col("size").alias("mix_size"), "taken")


def source_weights(docs: DataFrame, size, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, most_sources: int = 10_000) -> tuple[dict[str | None, int], dict[str | None, float]]:
    """Sizes and targets of the sources in order of code points, null last, weighed in turn; a table of more than `most_sources` is refused."""
    sums = docs.groupBy("source").agg(F.sum(size).alias("n")).limit(most_sources + 1).collect()
    if len(sums) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    order = sorted(sums, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["n"] or 0) for r in order]
    targets = water_targets(sizes, [weights[i % len(weights)] for i in range(len(order))], share, most)
    return {r["source"]: n for r, n in zip(order, sizes, strict=True)}, {r["source"]: t for r, t in zip(order, targets, strict=True)}


def words_in(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed_documents(docs: DataFrame, size, seed: int = 0) -> DataFrame:
    """The documents with mix_size, source_size, target and taken (in place of columns of these names), mixed by source under the default weights."""
    sizes, targets = source_weights(docs, size)
    out = _routed(docs, size, F.array("source"), targets, 2, seed, 10_000, 4)
    # One row a source, as many as the flow's patterns, which are bounded.
    known = F.broadcast(docs.sparkSession.createDataFrame([(k, n, targets[k]) for k, n in sizes.items()], "known string, source_size long, target double"))
    held = out.join(known, F.col("row")["source"].eqNullSafe(F.col("known")))
    new = ("mix_size", "source_size", "target", "taken")
    return held.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in new), F.col("size").alias("mix_size"), "source_size", "target", "taken")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are counted once; what follows reads three narrow columns.
    sized = checkpointed(table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("size")))
    return mixed_documents(sized, F.col("size")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")



def _turn(i: int) -> str:
    """SQL of one more threshold: of the documents that are not taken yet and fit, the first in order that fit together."""
    return f"""q{i} AS (SELECT *, NOT fits AND size <= gap AS open, sum(CASE WHEN NOT fits AND size <= gap THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place) AS upto FROM p{i}),
p{i + 1} AS (SELECT * EXCLUDE (open, upto, gap, fits), fits OR open AND upto <= gap AS fits, round(gap - coalesce(max(CASE WHEN open AND upto <= gap THEN upto END) OVER (PARTITION BY source), 0), 6) AS gap FROM q{i})"""


_TURNS = ",\n".join(_turn(i) for i in range(4))
SQL = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, sum(2 * n) OVER (ORDER BY 2 * n / w) - 2 * n AS before, sum(w) OVER (ORDER BY 2 * n / w DESC) AS weight,
    1.5 * (SELECT sum(n) FROM s) AS total FROM s),
level AS (SELECT arg_min({'left': total - before, 'weight': weight}, 2 * n / w) AS l FROM r WHERE 2 * n * weight > (total - before) * w),
t AS (SELECT source, n, least(2 * n, coalesce(l.left * w / l.weight, 2 * n)) AS target FROM s, level),
p0 AS (SELECT d.*, n, target, least(floor(target / greatest(n, 1)), 2) AS whole, round(target - least(floor(target / greatest(n, 1)), 2) * n, 6) AS gap, false AS fits FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
""" + _TURNS + """
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, round(target, 6) AS target, CAST(size * least(2, whole + CASE WHEN fits THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p4""",
}
