"""Column functions on code text and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern: runs of capitals that no lower-case letter follows, capitalised words, and lower-case words with digits.
_CODE_WORD = r"([A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+)"


def code_tokens(text: Column) -> Column:
    """Words of identifiers and prose in lower case: trimValue and TRIM_VALUE give [trim, value]."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CODE_WORD)), F.lower)


def search_terms(query: Column) -> Column:
    """Distinct [a-z0-9_]+ runs of the lowered query."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("([a-z0-9_]+)")))


def erased_type(declared: Column, passes: int = 6) -> Column:
    """A type without annotations, generics (nested up to `passes` deep) and white space; "..." is "[]"."""
    out = F.regexp_replace(declared, r"@[A-Za-z_.]+(\([^()]*\))?\s*", "")
    for _ in range(passes):
        out = F.regexp_replace(out, "<[^<>]*>", "")
    return F.replace(F.regexp_replace(out, r"\s+", ""), F.lit("..."), F.lit("[]"))


def descriptor_types(descriptor: Column) -> Column:
    """Parameter types of a JVM descriptor, as they are written in it."""
    inside = F.regexp_extract(descriptor, r"\(([^)]*)\)", 1)
    return F.regexp_extract_all(inside, F.lit(r"(\[*(?:[BCDFIJSZ]|L[^;()]+;))"))


#: The letters of the primitive types.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def java_name(descriptor: Column) -> Column:
    """A descriptor's type in Java source: [Ljava/lang/String; is java.lang.String[]."""
    bare = F.regexp_replace(descriptor, r"^\[+", "")
    dims = F.repeat(F.lit("[]"), F.length(descriptor) - F.length(bare))
    primitive = F.create_map(*(F.lit(x) for pair in PRIMITIVES.items() for x in pair))
    named = F.coalesce(F.element_at(primitive, bare), F.when(bare.startswith("L"), F.translate(F.substr(bare, F.lit(2)), "/$;", "..")))
    return F.concat(named, dims)


def simple_name(qualified: Column) -> Column:
    return F.regexp_extract(qualified, r"([^./$]*)$", 1)
