"""The evidence graph: entities, relations, their keys and integrity, and walks over them.

Tables carry case_id, and every key includes it. Loops run a bounded number of rounds; each round's frontier is
checkpointed into the shared folder, and only a count comes back to end the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .spans import blocks, in_blocks


def edge_id(case_id: str = "case_id", source: str = "source", kind: str = "kind", target: str = "target", provenance: str = "provenance") -> Column:
    """Content address of a relation: "edge:" and 24 hex digits of the hash of its record with sorted keys."""
    record = F.struct(F.col(kind).alias("kind"), F.col(provenance).alias("provenance"), F.col(source).alias("source"), F.col(target).alias("target"))
    return F.concat(F.lit("edge:"), F.substring(F.sha2(F.to_json(record), 256), 1, 24))


def build_relations(relations: DataFrame) -> DataFrame:
    """Relations with edge_id; identical records collapse, those that differ in provenance stay apart."""
    return relations.select("case_id", "source", "kind", "target", "provenance").distinct().withColumn("edge_id", edge_id())


def duplicate_entities(entities: DataFrame) -> DataFrame:
    """(case_id, entity_id, copies) of ids that are not unique."""
    return entities.groupBy("case_id", "entity_id").agg(F.count("*").alias("copies")).where("copies > 1")


def aliases(entities: DataFrame) -> DataFrame:
    """(case_id, method_id, entity_id, ambiguous) of functions."""
    own = entities.where("kind = 'function' AND method_id IS NOT NULL")
    return own.groupBy("case_id", "method_id").agg(F.min("entity_id").alias("entity_id"), (F.count("*") > 1).alias("ambiguous"))


def dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(case_id, edge_id, side, endpoint) of endpoints that are no entity."""
    sides = F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("endpoint")), F.struct(F.lit("target").alias("side"), F.col("target").alias("endpoint"))))
    ends = relations.select("case_id", "edge_id", sides.alias("s")).select("case_id", "edge_id", "s.*")
    return ends.join(entities.select("case_id", F.col("entity_id").alias("endpoint")), ["case_id", "endpoint"], "left_anti").select("case_id", "edge_id", "side", "endpoint")


def disambiguate(methods: DataFrame, with_file: bool = True) -> DataFrame:
    """Repeated ids: the first keeps its id, later ones get "@file:line" (or "@line"); diagnostic says so."""
    order = Window.partitionBy("case_id", "method_id").orderBy("file", "line", "entity_id")
    later = F.row_number().over(order) > 1
    suffix = F.concat(F.lit("@"), F.col("file"), F.lit(":"), F.col("line").cast("string")) if with_file else F.concat(F.lit("@"), F.col("line").cast("string"))
    return methods.withColumn("later", later).select("*", F.when(F.col("later"), F.concat("method_id", suffix)).otherwise(F.col("method_id")).alias("unique_id"), F.when(F.col("later"), F.concat(F.lit("duplicate "), "method_id")).alias("diagnostic")).drop("later")


def compact(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with dense node ids, in the order of their ids, and relations with both ends rewritten to them.

    Ids are numbered within ranges of the id; one row a range says how many come before it, so no task sees all rows.
    """
    ranged = cut_lineage(entities.repartitionByRange("case_id", "entity_id").withColumn("range_no", F.spark_partition_id()))
    sizes = ranged.groupBy("range_no").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range_no")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("range_no").orderBy("case_id", "entity_id"))
    nodes = ranged.withColumn("rank", rank).join(before, "range_no").withColumn("node_id", F.col("before") + F.col("rank")).drop("rank", "before", "range_no")
    ids = nodes.select("case_id", "entity_id", "node_id")
    edges = relations.join(ids.withColumnsRenamed({"entity_id": "source", "node_id": "source_node"}), ["case_id", "source"])
    edges = edges.join(ids.withColumnsRenamed({"entity_id": "target", "node_id": "target_node"}), ["case_id", "target"])
    return nodes, edges.select("case_id", "edge_id", "source_node", "target_node", "kind", "provenance")


def innermost(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """The narrowest outer span of the same file that holds each inner one, not itself: (case_id, entity_id, outer_id).

    An outer span that holds an inner one holds its first line, so they meet in one aligned block. There, from the last lines up, an inner span sees the two best of those that
    end no earlier; two, as one of them may be itself. Outer spans that end before they begin hold nothing.
    """
    block, place = ["case_id", "file", "size", "block"], ["case_id", "file", "line", "end_line"]
    spans = outer.where("line <= end_line").select("case_id", "file", "end_line", F.struct((F.col("end_line") - F.col("line")).alias("width"), F.col("entity_id").alias("outer_id")).alias("best"), F.explode(blocks(F.col("line"), F.col("end_line"))).alias("b"))
    held = spans.select("case_id", "file", "b.*", F.lit(None).cast("int").alias("line"), "end_line", "best")
    asked = in_blocks(inner.select(*place).distinct(), "line", held).withColumn("best", F.lit(None).cast(held.schema["best"].dataType))
    both = held.unionByName(asked)
    so_far = Window.partitionBy(*block).orderBy(F.desc("end_line"), F.col("line").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumns({"first": F.min("best").over(so_far), "led": F.min("best").over(before)})
    seen = seen.withColumn("second", F.min(F.when(F.col("led").isNotNull() & F.col("best").isNotNull(), F.greatest("best", "led"))).over(so_far))
    pair = F.array_sort(F.array_compact(F.flatten(F.collect_list(F.array("first", "second")))))
    best = cut_lineage(seen.where("line IS NOT NULL").groupBy(*place).agg(F.slice(pair, 1, 2).alias("best")))
    found = inner.select(*place, "entity_id").join(best, place)
    other = F.filter("best", lambda b: b["outer_id"] != F.col("entity_id"))
    plain = found.select("case_id", "entity_id", F.get(other, F.lit(0)).alias("o"))
    # An entity whose two best spans are both its own looks at all others.
    rest = found.where((F.size("best") == 2) & (F.size(other) == 0)).select(*place, "entity_id")
    far = rest.join(outer.select("case_id", "file", F.col("line").alias("lo"), F.col("end_line").alias("hi"), F.col("entity_id").alias("outer_id")), ["case_id", "file"]).where("lo <= line AND end_line <= hi AND outer_id <> entity_id")
    found = plain.unionByName(far.select("case_id", "entity_id", F.struct((F.col("hi") - F.col("lo")).alias("width"), "outer_id").alias("o")))
    found = found.where("o IS NOT NULL").groupBy("case_id", "entity_id").agg(F.min("o").alias("o"))
    return inner.select("case_id", "entity_id").join(found, ["case_id", "entity_id"], "left").select("case_id", "entity_id", "o.outer_id")


def resolve_ids(asked: DataFrame, entities: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, asked, entity_id, status) of ids that are entity ids or aliases."""
    direct = entities.select("case_id", F.col("entity_id").alias("asked"), F.col("entity_id").alias("direct"))
    by_alias = known.where("NOT ambiguous").select("case_id", F.col("method_id").alias("asked"), F.col("entity_id").alias("aliased"))
    out = asked.join(direct, ["case_id", "asked"], "left").join(by_alias, ["case_id", "asked"], "left")
    return out.select("case_id", "asked", F.coalesce("direct", "aliased").alias("entity_id"), F.when(F.col("direct").isNotNull(), "id").when(F.col("aliased").isNotNull(), "alias").otherwise("unknown").alias("status"))


def cards(entities: DataFrame) -> DataFrame:
    """(case_id, entity_id, kind, name, method_id, location, operation_kind, coverage)."""
    location = F.when(F.col("file").isNotNull(), F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit("-"), F.col("end_line").cast("string")))
    coverage = F.when(F.col("observed"), "observed").when(~F.col("observed"), "not_observed").otherwise("unavailable")
    return entities.select("case_id", "entity_id", "kind", "name", F.coalesce("method_id", F.lit("")).alias("method_id"), location.alias("location"), F.coalesce("operation_kind", F.lit("")).alias("operation_kind"), coverage.alias("coverage"))


def summary(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts of each case: entities, functions, tests, files, relations."""
    of = entities.groupBy("case_id").agg(F.count("*").alias("entities"), F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "test_method").alias("tests"), F.countDistinct("file").alias("files"))
    return of.join(relations.groupBy("case_id").agg(F.count("*").alias("relations")), "case_id", "left").fillna(0, ["relations"])


def relation_counts(relations: DataFrame) -> DataFrame:
    """(case_id, node, kind, direction, n); a self-loop counts in both directions."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit("out").alias("direction")), F.struct(F.col("target").alias("node"), F.lit("in").alias("direction"))))
    return relations.select("case_id", "kind", ends.alias("e")).groupBy("case_id", "e.node", "kind", "e.direction").agg(F.count("*").alias("n"))


def neighbours(relations: DataFrame, entities: DataFrame, direction: str = "both") -> DataFrame:
    """(case_id, node, direction, edge_id, kind, neighbour, neighbour_name, position, total) in the order of edge ids."""
    parts = []
    if direction in ("out", "both"):
        parts.append(F.struct(F.lit("out").alias("direction"), F.col("source").alias("node"), F.col("target").alias("neighbour")))
    if direction in ("in", "both"):
        parts.append(F.struct(F.lit("in").alias("direction"), F.col("target").alias("node"), F.col("source").alias("neighbour")))
    steps = relations.select("case_id", "edge_id", "kind", F.explode(F.array(*parts)).alias("s")).select("case_id", "edge_id", "kind", "s.*")
    named = steps.join(entities.select("case_id", F.col("entity_id").alias("neighbour"), F.col("name").alias("neighbour_name")), ["case_id", "neighbour"])
    own = Window.partitionBy("case_id", "node", "direction")
    return named.withColumns({"position": F.row_number().over(own.orderBy("edge_id")), "total": F.count("*").over(own)})


def ranked_callers(calls: DataFrame, owners: DataFrame, anchors: DataFrame, most: int = 100) -> DataFrame:
    """(case_id, target, caller, position): distinct callers, anchors first, then those of the target's owner, then by id; at most `most`."""
    edges = calls.select("case_id", F.col("source").alias("caller"), "target").distinct()
    edges = edges.join(owners.select("case_id", F.col("entity_id").alias("caller"), F.col("owner").alias("caller_owner")), ["case_id", "caller"], "left")
    edges = edges.join(owners.select("case_id", F.col("entity_id").alias("target"), F.col("owner").alias("target_owner")), ["case_id", "target"], "left")
    edges = edges.join(anchors.select("case_id", F.col("entity_id").alias("caller"), F.lit(True).alias("anchor")), ["case_id", "caller"], "left")
    order = Window.partitionBy("case_id", "target").orderBy(F.coalesce("anchor", F.lit(False)).desc(), F.coalesce(F.col("caller_owner") == F.col("target_owner"), F.lit(False)).desc(), "caller")
    return edges.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("case_id", "target", "caller", "position")


def shortest_path(callers: DataFrame, targets: DataFrame, anchors: DataFrame, depth: int = 8, budget: int = 120) -> DataFrame:
    """(case_id, target, path): from an anchor down to each target, breadth first over callers, the first anchor that the queue reaches.

    callers: (case_id, target, caller, position), as `ranked_callers` gives them. All targets advance together, one level a round. A node's rank is its turn in its target's
    queue: the levels before it, then its place by the turn of the caller's callee and the position. Only the first `budget` turns of a target are taken, and nodes
    `depth` levels away are looked at but not followed; what a node leads to is bounded by `callers` alone.
    """
    anchor = anchors.select("case_id", F.col("entity_id").alias("node")).distinct()
    steps = callers.select("case_id", F.col("target").alias("node"), "caller", "position")
    front = targets.select("case_id", F.col("entity_id").alias("target"), F.col("entity_id").alias("node"), F.lit(1).alias("rank"), F.array("entity_id").alias("path")).distinct()
    front = cut_lineage(front.where(F.lit(budget) > 0))
    seen, found = front.select("case_id", "target", "node"), None
    own = Window.partitionBy("case_id", "target")
    for level in range(depth + 1):
        hit = front.join(anchor, ["case_id", "node"]).groupBy("case_id", "target").agg(F.min_by("path", "rank").alias("path"))
        found = cut_lineage(hit) if found is None else found.unionByName(cut_lineage(hit))
        if level == depth:
            break
        # The queue goes on behind the last turn of the level; those of equal rank and position are one node.
        open_to = front.join(found, ["case_id", "target"], "left_anti").withColumn("last", F.max("rank").over(own))
        reached = open_to.join(steps, ["case_id", "node"]).groupBy("case_id", "target", F.col("caller").alias("node")).agg(F.min_by(F.struct("path", "last"), F.struct("rank", "position")).alias("p"), F.min(F.struct("rank", "position")).alias("turn"))
        reached = reached.join(seen, ["case_id", "target", "node"], "left_anti")
        ranked = reached.withColumn("rank", F.col("p.last") + F.row_number().over(own.orderBy("turn"))).where(F.col("rank") <= budget)
        front = cut_lineage(ranked.select("case_id", "target", "node", "rank", F.concat(F.array("node"), "p.path").alias("path")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("case_id", "target", "node"))
    return found


def nearest_anchor_path(callers: DataFrame, targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """(case_id, target, path): as `shortest_path` without a bound of depth or turns, in rounds that double the length.

    Of each node the nearest anchor within less than `reach` steps is known, and of nodes without one where exactly `reach` steps lead; there the nearest anchor of such a place is
    theirs too. Ties go to the path whose positions come first, which is the queue's order; a path's parts are then the first of theirs. Walks are
    longer than any shortest path once `reach` passes the number of nodes.
    """
    steps = callers.select("case_id", F.col("target").alias("node"), F.col("caller").alias("to"), F.array("position").alias("order"), F.array("caller").alias("way")).where("node <> to")
    every = steps.select("case_id", "node").unionByName(steps.select("case_id", F.col("to").alias("node"))).distinct()
    most = every.groupBy("case_id").count().agg(F.max("count")).first()[0] or 0
    anchor = anchors.select("case_id", F.col("entity_id").alias("node")).distinct()
    none = F.array().cast("array<int>")
    # way: from the node's caller up to the anchor.
    near = cut_lineage(anchor.select("case_id", "node", none.alias("order"), F.array().cast("array<string>").alias("way")))
    first = steps.groupBy("case_id", "node", "to").agg(F.min_by("way", "order").alias("way"), F.min("order").alias("order"))
    walks, reach = cut_lineage(first.join(anchor, ["case_id", "node"], "left_anti")), 1
    beyond = lambda rows: rows.select("case_id", F.col("node").alias("to"), F.col("order").alias("next_order"), F.col("way").alias("next_way"), *(F.col(c).alias("next_to") for c in rows.columns if c == "to"))
    joined = [F.concat("order", "next_order").alias("order"), F.concat("way", "next_way").alias("way")]
    while reach <= most and not walks.isEmpty():
        hit = walks.join(beyond(near), ["case_id", "to"]).select("case_id", "node", *joined)
        hit = cut_lineage(hit.groupBy("case_id", "node").agg(F.min_by("way", F.struct(F.size("order"), "order")).alias("way"), F.min(F.struct(F.size("order").alias("n"), "order")).alias("o")).select("case_id", "node", F.col("o.order").alias("order"), "way"))
        near = near.unionByName(hit)
        left = walks.join(hit, ["case_id", "node"], "left_anti")
        longer = left.join(beyond(walks), ["case_id", "to"]).select("case_id", "node", F.col("next_to").alias("to"), *joined)
        walks = cut_lineage(longer.groupBy("case_id", "node", "to").agg(F.min_by("way", "order").alias("way"), F.min("order").alias("order")))
        reach *= 2
    wanted = targets.select("case_id", F.col("entity_id").alias("node")).distinct()
    return near.join(wanted, ["case_id", "node"], "left_semi").select("case_id", F.col("node").alias("target"), F.concat(F.reverse("way"), F.array("node")).alias("path"))


def lineage(types: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(case_id, type_id, ancestor, depth): ancestors with the type itself at depth 0, each at its least depth; cycles end.

    Each round doubles the depth that is known: what lies at exactly the last depth goes on by all that is known from there, so a chain of n takes log n rounds and
    each pair is made once.
    """
    up = inheritance.where("parent IS NOT NULL AND parent <> child").select("case_id", F.col("child").alias("type_id"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    every = types.select("case_id", "type_id").unionByName(up.select("case_id", "type_id")).distinct()
    known, reach = cut_lineage(every.select("case_id", "type_id", F.col("type_id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(up)), 1
    while True:
        on = known.where("depth > 0").select("case_id", F.col("type_id").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        longer = known.where(F.col("depth") == reach).join(on, ["case_id", "ancestor"]).groupBy("case_id", "type_id", F.col("further").alias("ancestor")).agg(F.min(F.col("depth") + F.col("more")).alias("depth"))
        longer = cut_lineage(longer.join(known, ["case_id", "type_id", "ancestor"], "left_anti"))
        if longer.isEmpty():
            return known.join(types.select("case_id", "type_id").distinct(), ["case_id", "type_id"], "left_semi")
        known, reach = known.unionByName(longer), 2 * reach


def prune(edges: DataFrame, covered: DataFrame) -> DataFrame:
    """(case_id, node, callees): edges between covered nodes as sorted lists; a covered node without any has an empty one."""
    own = edges.select("case_id", F.col("source").alias("node"), "target").join(covered, ["case_id", "node"], "left_semi")
    own = own.join(covered.select("case_id", F.col("node").alias("target")), ["case_id", "target"], "left_semi")
    lists = own.groupBy("case_id", "node").agg(F.array_sort(F.collect_set("target")).alias("callees"))
    return covered.select("case_id", "node").distinct().join(lists, ["case_id", "node"], "left").select("case_id", "node", F.coalesce("callees", F.array().cast("array<string>")).alias("callees"))


def adjacency(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """(case_id, node, others): sorted distinct callees of each caller, or callers of each callee."""
    node, other = ("target", "source") if incoming else ("source", "target")
    return edges.groupBy("case_id", F.col(node).alias("node")).agg(F.array_sort(F.collect_set(other)).alias("others"))


def span_text(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, entity_id, text, stale): bytes [start_byte, end_byte) decoded as recorded; null if the span is invalid or the file's digest differs."""
    held = entities.join(files, ["case_id", "file"], "left")
    fresh = F.sha2("content", 256) == F.col("sha256")
    good = fresh & (F.col("start_byte") >= 0) & (F.col("start_byte") <= F.col("end_byte")) & (F.col("end_byte") <= F.octet_length("content"))
    piece = F.substring(F.col("content"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    text = F.when(F.col("encoding") == "utf-8", F.make_valid_utf8(piece.cast("string"))).otherwise(F.decode(piece, "ISO-8859-1"))
    return held.select("case_id", "entity_id", F.when(good, text).alias("text"), F.coalesce(~fresh, F.lit(True)).alias("stale"))


def method_records(entities: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, method_id, class_name, name, file, line, end_line, source) of the aliased functions."""
    own = known.where("NOT ambiguous").join(entities.drop("method_id"), ["case_id", "entity_id"]).join(texts, ["case_id", "entity_id"], "left")
    return own.select("case_id", "method_id", F.split_part("method_id", F.lit("#"), F.lit(1)).alias("class_name"), "name", "file", "line", "end_line", F.col("text").alias("source"))


def test_records(tests: DataFrame, texts: DataFrame, reports: DataFrame) -> DataFrame:
    """(case_id, test_id, source_entity_id, source, failure_text) of failing tests, with the source of their method if it is known and their report's text or "".

    tests: (case_id, test_id, source_entity_id); texts: (case_id, entity_id, text); reports: entities (case_id, entity_id, content), of ids "report:<test_id>".
    """
    source = texts.select("case_id", F.col("entity_id").alias("source_entity_id"), F.col("text").alias("source"))
    told = reports.where(F.startswith("entity_id", F.lit("report:"))).select("case_id", F.substring("entity_id", 8, 2**31 - 1).alias("test_id"), F.col("content").alias("failure_text"))
    out = tests.join(source, ["case_id", "source_entity_id"], "left").join(told, ["case_id", "test_id"], "left")
    return out.select("case_id", "test_id", "source_entity_id", "source", F.coalesce("failure_text", F.lit("")).alias("failure_text"))


def record_entities(methods: DataFrame, tests: DataFrame) -> DataFrame:
    """(case_id, entity_id, kind, name, method_id, file, line, end_line, content): the inverse, entities of plain records; nothing is known of what ran.

    methods: (case_id, method_id, name, file, line, end_line, source), a missing name is the method's part of the id; tests: (case_id, failure_text), one a case.
    """
    name = F.coalesce(F.nullif("name", F.lit("")), F.regexp_extract("method_id", r"([^#]*)$", 1))
    own = methods.select("case_id", F.concat(F.lit("func:"), "method_id").alias("entity_id"), F.lit("function").alias("kind"), name.alias("name"), "method_id", "file", "line", "end_line", F.col("source").alias("content"))
    told = tests.select("case_id", F.lit("report").alias("entity_id"), F.lit("crash_report").alias("kind"), F.lit("crash report").alias("name"), F.coalesce("failure_text", F.lit("")).alias("content"))
    return own.unionByName(told, allowMissingColumns=True)
