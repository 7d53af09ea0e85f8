"""A refresh equals a rebuild, table by table, and leaves the other buckets' files alone."""

import os
import random

from faultloom.operators import numbering, refresh

ENTITIES = "case_id string, entity_id string, kind string, name string, method_id string, file string, content string"
RELATIONS = "case_id string, source string, kind string, target string, provenance string"


def source(dice, files):
    """Contents of files: entities, relations, declarations, messages."""
    out = {}
    for case, f in files:
        ids = [f"{f}.e{i}" for i in range(8) if dice.random() < 0.7]
        entities = [(case, e, dice.choice(["function", "field"]), f"name {dice.choice('pqr')}_{e}", dice.choice([f"{e}#m()", None]), f, dice.choice(["some text", "other Text text", ""])) for e in ids]
        out[case, f] = {"sha": f"{dice.random()}", "entities": entities, "catalog": [(case, f, "type", e, f) for e in ids[:2]], "diagnostics": [(case, f, "odd")] if dice.random() < 0.4 else []}
    return out


def relations_of(dice, world, files):
    out = []
    for case, f in files:
        targets = [e[1] for (c, _), v in world.items() if c == case for e in v["entities"]]
        for e in world[case, f]["entities"]:
            out += [(case, e[1], dice.choice(["calls", "covers"]), t, dice.choice("xy")) for t in dice.sample(targets, min(2, len(targets)))]
    return out


def fragment(spark, world, files, relations):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    each = lambda part: [r for k in files for r in world[k][part]]
    return refresh.Fragment(make([(c, f, world[c, f]["sha"]) for c, f in files], "case_id string, path string, sha256 string"), make(each("entities"), ENTITIES), make(relations, RELATIONS), make(each("catalog"), "case_id string, file string, record string, name string, owner string"), make(each("diagnostics"), "case_id string, file string, message string"))


def plain(index):
    """Every table's rows, nodes named by their entities."""
    name = {(r.case_id, r.node_id): r.entity_id for r in index.entities.collect()}
    rows = {t: sorted((tuple(r) for r in getattr(index, t).collect()), key=repr) for t in ("files", "aliases", "catalog", "diagnostics")}
    rows["entities"] = sorted(((r.case_id, r.entity_id, r.kind, r.name, r.method_id, r.file, r.content) for r in index.entities.collect()), key=repr)
    rows["documents"] = sorted((r.case_id, name[r.case_id, r.node_id], r.document) for r in index.documents.collect())
    rows["postings"] = sorted((r.case_id, name[r.case_id, r.node_id], r.term, r.tf) for r in index.postings.collect())
    rows["relations"] = sorted((r.case_id, r.edge_id, name[r.case_id, r.source_node], name[r.case_id, r.target_node], r.kind, r.provenance) for r in index.relations.collect())
    return rows


def test_refresh_equals_rebuild(spark, tmp_path):
    dice = random.Random(4)
    files = [(c, f"f{i}") for c in ("c", "d") for i in range(12)]
    world = source(dice, files)
    edges = relations_of(dice, world, files)
    index, refused = refresh.build(fragment(spark, world, files, edges))
    assert refused.count() == 0
    refresh.store(index, str(tmp_path / "index"), 16)
    stored = refresh.load(spark, str(tmp_path / "index"), index)
    assert plain(stored) == plain(index)
    touched = [("c", "f3"), ("c", "f7"), ("d", "f0")]
    after = world | source(dice, touched)
    after["d", "f0"] = {"sha": "empty", "entities": [], "catalog": [], "diagnostics": []}
    fresh = relations_of(dice, after, touched) + [("c", "nowhere", "calls", "f1.e1", "x")]
    made, refused = refresh.changes(stored, spark.createDataFrame(touched, "case_id string, file string"), fragment(spark, after, touched, fresh))
    assert [r.source for r in refused.collect()] == ["nowhere"]
    kept = [e for e in edges if not any(e[0] == c and e[1].startswith(f + ".") for c, f in touched)]
    want, dropped = refresh.build(fragment(spark, after, files, kept + fresh))
    assert dropped.count() > 1
    assert plain(refresh.changed(index, made)) == plain(want)
    old = {(r.case_id, r.entity_id): r.node_id for r in index.entities.collect()}
    names = {str(p): os.stat(p).st_ino for p in (tmp_path / "index").rglob("*.parquet")}
    for _ in range(2):  # the second time as after a break
        written = refresh.apply(str(tmp_path / "index"), made, 16)
        again = refresh.load(spark, str(tmp_path / "index"), index)
        assert plain(again) == plain(want)
    new = {(r.case_id, r.entity_id): r.node_id for r in again.entities.collect()}
    assert all(new[k] == old[k] for k in new.keys() & old.keys())
    for case in "cd":
        top = max(v for (c, _), v in old.items() if c == case)
        came = sorted((e, v) for (c, e), v in new.items() if c == case and (c, e) not in old)
        assert [v for _, v in came] == list(range(top + 1, top + 1 + len(came)))
    left = {str(p): os.stat(p).st_ino for p in (tmp_path / "index").rglob("*.parquet")}
    assert 0 < written["files"] <= 3 and sum(left.get(p) == i for p, i in names.items()) > len(names) / 3


def test_nothing_touched_changes_nothing(spark):
    dice = random.Random(5)
    world = source(dice, [("c", "f0")])
    index, _ = refresh.build(fragment(spark, world, [("c", "f0")], []))
    made, _ = refresh.changes(index, spark.createDataFrame([], "case_id string, file string"), fragment(spark, {}, [], []))
    assert plain(refresh.changed(index, made)) == plain(index)


def test_numbers_are_dense_whatever_the_ranges(spark):
    dice = random.Random(6)
    rows = [(dice.choice(["a", "a", "a", "b", None]), dice.randrange(10**6)) for _ in range(3000)]
    got = numbering.numbered(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"], "n").collect()
    for k in ("a", "b", None):
        mine = sorted((r.n, r.v) for r in got if r.k == k)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for q, v in rows if q == k)
    assert sorted(r.n for r in numbering.numbered(spark.createDataFrame(rows, "k string, v int"), [], ["v"], "n").collect()) == list(range(1, 3001))
