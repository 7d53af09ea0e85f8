"""Refreshing an index of source evidence: one change set, carried through every table that depends on the changed files.

The index is eight tables; each row belongs to a bucket by a hash of its key, and is stored so. A fragment holds what the changed files yield now. From both, `changes` works out for each table
which keys go and which rows come. `apply` rewrites only the buckets that these are in, so the work grows with the change set, not with the index. All changes are written down before
the first table is touched, and rows that come replace any of their key, so an `apply` that was broken off is simply run again.

Rules: entities of changed files that are still there keep their node ids, new ones get ids above the case's largest, in the order of their ids. What the changed files' entities had of search
documents, postings, aliases and outgoing relations is replaced; relations into entities that vanished go, others into survivors stay. Catalog, diagnostics and digests go by file. Relations
of a fragment whose ends are in no table are refused and reported. Nulls in keys are not expected; a table without rows is fine.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import build_relations
from .lineage import cut_lineage
from .numbering import numbered
from .search import search_document

#: The key of each table; a change names whole keys, and a row's bucket is a hash of its key.
KEYS = {
    "files": ["case_id", "path"], "entities": ["case_id", "node_id"], "aliases": ["case_id", "method_id"], "documents": ["case_id", "node_id"], "postings": ["case_id", "node_id"],
    "relations": ["case_id", "edge_id"], "catalog": ["case_id", "file"], "diagnostics": ["case_id", "file"],
}


@dataclass
class Index:
    """files: (case_id, path, sha256); entities: (case_id, node_id, entity_id, kind, name, method_id, file, content); aliases: (case_id, method_id, entity_id);
    documents: (case_id, node_id, document); postings: (case_id, term, node_id, tf); relations: (case_id, edge_id, source_node, target_node, kind, provenance);
    catalog: (case_id, file, record, name, owner) of declarations; diagnostics: (case_id, file, message)."""

    files: DataFrame
    entities: DataFrame
    aliases: DataFrame
    documents: DataFrame
    postings: DataFrame
    relations: DataFrame
    catalog: DataFrame
    diagnostics: DataFrame


@dataclass
class Fragment:
    """What files yield: files: (case_id, path, sha256); entities without node_id; relations: (case_id, source, kind, target, provenance) by entity ids; catalog; diagnostics."""

    files: DataFrame
    entities: DataFrame
    relations: DataFrame
    catalog: DataFrame
    diagnostics: DataFrame


@dataclass
class Change:
    """Keys that go, and rows that come."""

    gone: DataFrame
    come: DataFrame


def _derived(entities: DataFrame) -> dict[str, DataFrame]:
    """Aliases, search documents and postings of numbered entities."""
    documents = entities.select("case_id", "node_id", search_document(F.col("entity_id"), F.col("name"), F.col("content")).alias("document"))
    terms = documents.select("case_id", "node_id", F.explode(F.regexp_extract_all("document", F.lit("([a-z0-9_]+)"))).alias("term"))
    aliases = entities.where("kind = 'function' AND method_id IS NOT NULL").groupBy("case_id", "method_id").agg(F.min("entity_id").alias("entity_id"))
    return {"aliases": aliases, "documents": documents, "postings": terms.groupBy("case_id", "term", "node_id").agg(F.count("*").alias("tf"))}


def _ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with edge_id, source_node and target_node, these null where no entity has the id."""
    ids = entities.select("case_id", F.col("entity_id"), "node_id")
    held = build_relations(relations).join(ids.withColumnsRenamed({"entity_id": "source", "node_id": "source_node"}), ["case_id", "source"], "left")
    return held.join(ids.withColumnsRenamed({"entity_id": "target", "node_id": "target_node"}), ["case_id", "target"], "left")


_ENTITY = ["case_id", "node_id", "entity_id", "kind", "name", "method_id", "file", "content"]
_RELATION = ["case_id", "edge_id", "source_node", "target_node", "kind", "provenance"]


def build(fragment: Fragment) -> tuple[Index, DataFrame]:
    """The index of all files, and the relations that it refuses."""
    entities = cut_lineage(numbered(fragment.entities, ["case_id"], ["entity_id"], "node_id").select(*_ENTITY))
    relations = cut_lineage(_ends(fragment.relations, entities))
    whole = "source_node IS NOT NULL AND target_node IS NOT NULL"
    out = Index(files=fragment.files, entities=entities, **_derived(entities), relations=relations.where(whole).select(*_RELATION), catalog=fragment.catalog, diagnostics=fragment.diagnostics)
    return out, relations.where(f"NOT ({whole})").select("case_id", "source", "kind", "target", "provenance")


def changes(index: Index, touched: DataFrame, fragment: Fragment) -> tuple[dict[str, Change], DataFrame]:
    """(the change of each table, refused relations) of the touched files (case_id, file), whose present contents are the fragment."""
    touched = touched.select("case_id", "file").distinct()
    previous = cut_lineage(index.entities.join(touched, ["case_id", "file"], "left_semi").select("case_id", "entity_id", "node_id"))
    matched = fragment.entities.join(previous, ["case_id", "entity_id"], "left")
    top = index.entities.groupBy("case_id").agg(F.max("node_id").alias("top"))
    fresh = numbered(matched.where("node_id IS NULL").drop("node_id"), ["case_id"], ["entity_id"], "n").join(top, "case_id", "left").withColumn("node_id", F.coalesce("top", F.lit(0)) + F.col("n"))
    come = cut_lineage(matched.where("node_id IS NOT NULL").select(*_ENTITY).unionByName(fresh.select(*_ENTITY)))
    vanished = previous.join(come.select("case_id", "entity_id"), ["case_id", "entity_id"], "left_anti")
    derived = _derived(come)
    nodes = previous.select("case_id", "node_id")
    # Ends of new relations: entities that come, else those that stay; only ids that are asked for are joined.
    asked = fragment.relations.select("case_id", F.explode(F.array("source", "target")).alias("entity_id")).distinct()
    staying = index.entities.join(asked, ["case_id", "entity_id"], "left_semi").join(previous, ["case_id", "entity_id"], "left_anti").select("case_id", "entity_id", "node_id")
    new = cut_lineage(_ends(fragment.relations, come.select("case_id", "entity_id", "node_id").unionByName(staying)))
    whole = "source_node IS NOT NULL AND target_node IS NOT NULL"
    out_of = index.relations.select("case_id", "edge_id", F.col("source_node").alias("node_id")).join(nodes, ["case_id", "node_id"], "left_semi")
    into = index.relations.select("case_id", "edge_id", F.col("target_node").alias("node_id")).join(vanished, ["case_id", "node_id"], "left_semi")
    by_file = touched.select("case_id", "file")
    found = {
        "files": Change(by_file.withColumnRenamed("file", "path"), fragment.files),
        "entities": Change(nodes, come),
        "aliases": Change(index.aliases.join(previous, ["case_id", "entity_id"], "left_semi").select("case_id", "method_id"), derived["aliases"]),
        "documents": Change(nodes, derived["documents"]), "postings": Change(nodes, derived["postings"]),
        "relations": Change(out_of.select("case_id", "edge_id").unionByName(into.select("case_id", "edge_id")), new.where(whole).select(*_RELATION)),
        "catalog": Change(by_file, fragment.catalog), "diagnostics": Change(by_file, fragment.diagnostics),
    }
    out = {}
    for name, change in found.items():
        key, rows = KEYS[name], cut_lineage(change.come.select(*getattr(index, name).columns))
        out[name] = Change(cut_lineage(change.gone.select(*key).unionByName(rows.select(*key)).distinct()), rows)
    return out, new.where(f"NOT ({whole})").select("case_id", "source", "kind", "target", "provenance")


def changed(index: Index, made: dict[str, Change]) -> Index:
    """The index after the changes, as a plan over the one before."""
    return Index(**{name: getattr(index, name).join(c.gone, KEYS[name], "left_anti").select(*c.come.columns).unionByName(c.come) for name, c in made.items()})


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS[name]), F.lit(buckets)).cast("int")


def store(index: Index, folder: str, buckets: int = 64) -> None:
    """Write the tables, each partitioned by bucket, one file a bucket and task."""
    for f in fields(Index):
        rows = getattr(index, f.name).withColumn("bucket", _bucket(f.name, buckets))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{f.name}")


def load(spark: SparkSession, folder: str, like: Index) -> Index:
    """The stored tables, with the schemas of an index."""
    read = lambda name: spark.read.schema(getattr(like, name).withColumn("bucket", F.lit(0)).schema).parquet(f"{folder}/{name}").drop("bucket")
    return Index(**{f.name: read(f.name) for f in fields(Index)})


def apply(folder: str, made: dict[str, Change], buckets: int = 64) -> dict[str, int]:
    """Carry the changes into the stored tables, and say how many buckets of each were written anew. At most `buckets` numbers come to the driver."""
    written = {}
    for name, change in made.items():
        spark, key = change.gone.sparkSession, KEYS[name]
        hit = sorted(r["bucket"] for r in change.gone.select(_bucket(name, buckets).alias("bucket")).distinct().collect())
        written[name] = len(hit)
        if not hit:
            continue
        schema = change.come.withColumn("bucket", F.lit(0)).schema
        before = spark.read.schema(schema).parquet(f"{folder}/{name}").where(F.col("bucket").isin(hit))
        after = before.join(change.gone, key, "left_anti").select(*change.come.columns).unionByName(change.come)
        after = cut_lineage(after.withColumn("bucket", _bucket(name, buckets)))
        after.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/{name}")
        # A bucket that nothing is left of is not overwritten; it goes.
        full = {r["bucket"] for r in after.select("bucket").distinct().collect()}
        for b in set(hit) - full:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/bucket={b}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return written
