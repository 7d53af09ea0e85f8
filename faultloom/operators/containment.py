"""Which strings hold, or begin with, which terms: equi-joins over an index of grams or of prefixes, then an exact check.

Both sides are distinct strings within a key (`by`, which may be empty). Nothing is compared with everything of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage

#: Characters of a gram. A shorter term is a gram itself.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The runs of n characters of a text; none of a shorter one."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1))), lambda i: i <= F.char_length(text) - (n - 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def substring_pairs(texts: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """(…by, text, term) of every distinct text (…by, text) and distinct term (…by, term) that is part of it.

    An inverted table of grams is kept for those that terms have. A term of three characters or more is looked for in the texts of the rarest of its grams, if all its grams occur, and checked
    there; one of one or two characters is a gram itself and needs no check. The empty term is part of nothing. Null texts and terms take no part.
    """
    sought = terms.where("term <> ''").select(*by, "term").distinct()
    long = F.char_length("term") >= GRAM
    probes = cut_lineage(sought.select(*by, "term", F.explode(F.when(long, _grams(F.col("term"), GRAM)).otherwise(F.array("term"))).alias("gram")))
    sizes = [r["n"] for r in probes.select(F.char_length("gram").alias("n")).distinct().collect()]
    every = F.flatten(F.array(*(_grams(F.col("text"), n) for n in sorted(sizes)))) if sizes else F.array().cast("array<string>")
    known = texts.where("text IS NOT NULL").select(*by, "text").distinct().select(*by, "text", F.explode(every).alias("gram"))
    index = cut_lineage(known.join(probes.select(*by, "gram").distinct(), [*by, "gram"], "left_semi"))
    held = index.groupBy(*by, "gram").agg(F.count("*").alias("texts"))
    rare = probes.join(held, [*by, "gram"], "left").groupBy(*by, "term").agg(F.min_by("gram", "texts").alias("gram"), F.count_if(F.col("texts").isNull()).alias("missing")).where("missing = 0").drop("missing")
    return rare.join(index, [*by, "gram"]).where(F.contains("text", "term")).select(*by, "text", "term")


def prefix_pairs(texts: DataFrame, prefixes: DataFrame, by: list[str]) -> DataFrame:
    """(…by, text, prefix) of every distinct text and distinct prefix that it begins with; the empty prefix begins nothing.

    A text is listed under its beginnings, of the lengths that prefixes have, and meets them by equality.
    """
    sought = prefixes.where("prefix <> ''").select(*by, "prefix").distinct()
    lengths = sorted(r["n"] for r in sought.select(F.char_length("prefix").alias("n")).distinct().collect())
    fitting = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.char_length("text"))
    known = texts.where("text IS NOT NULL").select(*by, "text").distinct()
    return known.select(*by, "text", F.explode(F.transform(fitting, lambda n: F.substr(F.col("text"), F.lit(1), n))).alias("prefix")).join(sought, [*by, "prefix"]).select(*by, "text", "prefix")
