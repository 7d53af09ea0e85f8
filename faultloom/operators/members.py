"""Members that can be used from a method: variables in scope, visible fields, callable methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visibility(modifiers: Column, in_interface: Column) -> Column:
    """The first of public, protected and private among the modifiers; else package, and public in an interface."""
    named = F.get(F.filter(modifiers, lambda m: m.isin("public", "protected", "private")), F.lit(0))
    return F.coalesce(named, F.when(in_interface, "public").otherwise("package"))


def outermost(type_id: Column) -> Column:
    """The outermost class of a type: up to its first part that begins with a capital."""
    return F.regexp_extract(type_id, r"^((?:[a-z_][\w]*\.)*[A-Z][\w]*)", 1)


def visible(vis: Column, owner: Column, owner_package: Column, here: Column, here_package: Column, inherits: Column) -> Column:
    """Whether a member of `owner` can be used in `here`."""
    return (vis == "public") | (owner == here) | ((vis == "private") & (outermost(owner) == outermost(here))) | ((vis != "private") & (owner_package == here_package)) | ((vis == "protected") & inherits)


def accessible_types(types: DataFrame, enclosing: DataFrame) -> DataFrame:
    """(case_id, type_id, here, accessible): a nested type needs all its enclosing types to be visible. enclosing: (case_id, type_id, here, outer_visible)."""
    return enclosing.groupBy("case_id", "type_id", "here").agg(F.min("outer_visible").alias("accessible"))


def accessible_variables(methods: DataFrame, variables: DataFrame, fields: DataFrame, lineage: DataFrame) -> DataFrame:
    """(case_id, method_id, name, kind, type, receiver): locals whose lines hold the asked one, and visible fields of the lineage.

    methods: (case_id, method_id, owner_type, package, static, line); variables: (case_id, method_id, name, type, start_line, end_line); fields: (case_id,
    owner_type, name, type, static, visibility, package). The nearest field of a name hides the others even where it is not accessible itself.
    """
    local = methods.join(variables, ["case_id", "method_id"]).where("start_line <= line AND line <= end_line")
    latest = local.groupBy("case_id", "method_id", "name").agg(F.max_by("type", F.struct("start_line", "type")).alias("type"))
    locals_ = latest.select("case_id", "method_id", "name", F.lit("local").alias("kind"), "type", F.col("name").alias("receiver"))
    up = lineage.select("case_id", F.col("type_id").alias("owner_type"), "ancestor", "depth")
    own = fields.select("case_id", F.col("owner_type").alias("ancestor"), "name", "type", F.col("static").alias("field_static"), "visibility", F.col("package").alias("there"))
    held = methods.select("case_id", "method_id", "owner_type", "package", "static").join(up, ["case_id", "owner_type"]).join(own, ["case_id", "ancestor"])
    nearest = F.row_number().over(Window.partitionBy("case_id", "method_id", "name").orderBy("depth", "ancestor"))
    held = held.withColumn("nearest", nearest).where("nearest = 1")
    seen = visible(F.col("visibility"), F.col("ancestor"), F.col("there"), F.col("owner_type"), F.col("package"), F.lit(True))
    usable = held.where(seen & (~F.col("static") | F.col("field_static")))
    receiver = F.when(F.col("field_static"), F.concat("ancestor", F.lit("."), "name")).otherwise(F.concat(F.lit("this."), "name"))
    fields_ = usable.select("case_id", "method_id", "name", F.lit("field").alias("kind"), "type", receiver.alias("receiver")).join(locals_.select("case_id", "method_id", "name"), ["case_id", "method_id", "name"], "left_anti")
    return locals_.unionByName(fields_)


def callable_methods(asks: DataFrame, methods: DataFrame, lineage: DataFrame, types: DataFrame) -> DataFrame:
    """(case_id, ask_id, method_id, inherited, position, total, truncated): methods that can be called on a type.

    asks: (case_id, ask_id, type_id, is_class_name, here, here_package, query, limit). In lineage order, no constructors, statics only on class names, statics of
    interfaces not inherited, an overridden name(parameters once; the query is sought in name, return type and comment without case.
    """
    up = lineage.join(types.select("case_id", F.col("type_id").alias("ancestor"), "is_interface"), ["case_id", "ancestor"], "left")
    own = methods.where("NOT constructor").withColumnRenamed("owner_type", "ancestor")
    held = asks.join(up, ["case_id", "type_id"]).join(own, ["case_id", "ancestor"])
    held = held.where((~F.col("is_class_name") | F.col("static")) & ~(F.col("static") & F.coalesce("is_interface", F.lit(False)) & (F.col("depth") > 0)))
    held = held.where(~((F.col("depth") > 0) & (F.col("visibility") == "private")))
    held = held.where(visible(F.col("visibility"), F.col("ancestor"), F.col("package"), F.col("here"), F.col("here_package"), F.col("here") == F.col("type_id")))
    signature = F.concat("name", F.lit("("), F.array_join("parameter_types", ","))
    order = [F.coalesce("is_interface", F.lit(False)), F.col("depth"), F.col("ancestor"), F.col("method_id")]
    first = F.row_number().over(Window.partitionBy("case_id", "ask_id", signature).orderBy(*order))
    shown = held.withColumn("first", first).where("first = 1")
    text = F.lower(F.concat_ws(" ", "name", "return_type", "comment"))
    shown = shown.where(F.col("query").isNull() | F.contains(text, F.lower("query")))
    own_rank = Window.partitionBy("case_id", "ask_id")
    inherited = F.col("depth") > 0
    out = shown.withColumns({"inherited": inherited, "total": F.count("*").over(own_rank)})
    out = out.withColumn("position", F.row_number().over(own_rank.orderBy("inherited", "name", "method_id")))
    size = F.least(F.greatest("limit", F.lit(1)), F.lit(100))
    return out.where(F.col("position") <= size).select("case_id", "ask_id", "method_id", "inherited", "position", "total", (F.col("total") > size).alias("truncated"))


def ask_status(asks: DataFrame, types: DataFrame) -> DataFrame:
    """(case_id, ask_id, status) of names (case_id, ask_id, name): ok, ambiguous or unresolved, by the types of that simple name."""
    named = types.select("case_id", F.regexp_extract("type_id", r"([^.$]*)$", 1).alias("name"), "type_id")
    held = asks.join(named, ["case_id", "name"], "left").groupBy("case_id", "ask_id").agg(F.countDistinct("type_id").alias("n"))
    return held.select("case_id", "ask_id", F.when(F.col("n") == 0, "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("ok").alias("status"))
