"""Spans of lines and the lines in them, by equality: a span is made up of a few aligned blocks of lines, and a line lies in one block of every size.

So neither a long span nor a file full of spans meets every line: what a block keeps of its spans is worked out once, and a line puts together what its blocks keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage


def _down(number: Column, size: Column) -> Column:
    """The block of 2**size lines that a line lies in."""
    return F.call_function("shiftright", number.cast("long"), size)


def blocks(first: Column, last: Column) -> Column:
    """(size, block): the fewest blocks of 2**size lines, each beginning at a multiple of that, which are the lines first .. last together; two of a size at most."""
    sizes = F.sequence(F.lit(0), F.length(F.bin(last.cast("long") - first.cast("long") + 1)) - 1)

    def of(size: Column) -> Column:
        low, high = -_down(-first.cast("long"), size), _down(last.cast("long") + 1, size)
        block = lambda at, odd: F.when((low < high) & (odd % 2 != 0), F.struct(size.alias("size"), at.alias("block")))
        return F.array(block(low, low), block(high - 1, high))

    return F.filter(F.flatten(F.transform(sizes, of)), lambda b: b.isNotNull())


def in_blocks(lines: DataFrame, line: str, kept: DataFrame) -> DataFrame:
    """Lines with the (size, block) that they lie in, for every size that the blocks of kept (…, size) have."""
    sizes = F.array(*(F.lit(r["size"]) for r in kept.select("size").distinct().collect())).cast("array<int>")
    each = F.explode(F.transform(sizes, lambda s: F.struct(s.alias("size"), _down(F.col(line), s).alias("block"))))
    return lines.withColumn("b", each).select(*lines.columns, "b.*")


def over_lines(lines: DataFrame, spans: DataFrame, by: list[str], part: list[Column], total: list[Column]) -> DataFrame:
    """(…by, line, …total) of every distinct line (…by, line) that a span (…by, lo, hi, …) holds, both ends included.

    part: aggregates of the spans that make up a block; total: aggregates of these over the blocks that a line lies in. Each span that holds a line counts once there.
    """
    spread = spans.where("lo <= hi").withColumn("b", F.explode(blocks(F.col("lo"), F.col("hi")))).withColumns({"size": F.col("b.size"), "block": F.col("b.block")})
    kept = cut_lineage(spread.groupBy(*by, "size", "block").agg(*part))
    at = in_blocks(lines.select(*by, "line").distinct(), "line", kept)
    return at.join(kept, [*by, "size", "block"]).groupBy(*by, "line").agg(*total)
