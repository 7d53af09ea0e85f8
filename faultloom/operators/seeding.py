"""The choice of a kernel case's files: its artifacts, terms and keyword files, defining files, and the seeds of its index.

The tree is one table of lines (path, line) that all cases share; what a rule can say about a file without a case (which names it mentions, the
shortest paths of a term, the first path of a folder with a name) is worked out once, before cases meet it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .containment import substring_pairs
from .kernel import GENERIC_FUNCTIONS, STOP_WORDS, report_names, telling_name
from .lineage import cut_lineage

#: Where a case's files lie, best first; "{case}" is its id. The last of a kind is the shared data set's, which may be empty.
REPRODUCERS = [
    "assets/repro.syz", "assets/logs/repro.syz", "assets/repro.prog", "assets/logs/repro.prog", "assets/repro.c", "assets/repro.cprog",
    "assets/logs/repro.c", "assets/repro.txt", "assets/logs/repro.txt", "datasets/testcases/{case}.syz",
]
REPORTS = ["results/console.log.reference", "assets/repro.report", "assets/logs/repro.report", "assets/logs/dmesg.txt", "datasets/bug_report/{case}.txt"]
#: Top folders whose files are never seeded.
UNSEEDED = ["scripts", "tools", "samples", "Documentation", "usr"]
#: Words before the type, and before the type's name, in the line that opens a definition.
STORAGE_WORDS = ["static", "inline", "__init", "__exit", "__always_inline", "asmlinkage", "__visible", "noinline", "__maybe_unused", "__cold", "__weak"]
TYPE_WORDS = ["const", "unsigned", "signed", "struct", "enum", "union", "volatile", "long", "short"]

_CALLED = r"(?<![A-Za-z0-9_])([A-Za-z_]\w*)\s*\("
_DEFINED = rf"^[ \t]*(?:(?:{'|'.join(STORAGE_WORDS)})[ \t]+)*(?:(?:{'|'.join(TYPE_WORDS)})[ \t]+)*\w+[ \t*]+([A-Za-z_]\w*)[ \t]*\("


def choose_artifacts(listing: DataFrame) -> DataFrame:
    """(case_id, kind, path, recipe): of each kind, reproducer and report, the first place that has a file; listing: (case_id, path, size), paths relative.

    A case's own report must not be empty. Recipe of a reproducer: "syz" or "gcc" by its suffix, whatever its case, null for others and for reports.
    """

    def places(kind: str, paths: list[str], filled: bool) -> list[Column]:
        out = []
        for i, p in enumerate(paths):
            own = F.col("path") == F.replace(F.lit(p), F.lit("{case}"), F.col("case_id"))
            rule = own & (F.col("size") > 0) if filled and i + 1 < len(paths) else own
            out.append(F.when(rule, F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("priority"))))
        return out

    place = F.coalesce(*places("reproducer", REPRODUCERS, False), *places("report", REPORTS, True))
    held = listing.withColumn("place", place).where("place IS NOT NULL")
    best = held.groupBy("case_id", "place.kind").agg(F.min_by("path", "place.priority").alias("path"))
    suffix = F.lower(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))
    recipe = F.when(suffix.isin(".syz", ".prog"), "syz").when(suffix.isin(".c", ".cprog"), "gcc")
    return best.withColumn("recipe", F.when(F.col("kind") == "reproducer", recipe))


def keyword_terms(programs: DataFrame, reports: DataFrame, most: int = 32) -> DataFrame:
    """(case_id, pos, term): the first `most` distinct terms of a case's program and of the frames ("name+0x1f") of its report, one text of each a case.

    A program's names count with what follows their "$"; a quoted name is one of them. Terms have four characters or more and are no stop words.
    """
    names = F.regexp_extract_all(F.lower("program"), F.lit(r"\b[a-z_][a-z0-9_]*(?:\$[a-z0-9_]+)?\b"), 0)
    parts = F.flatten(F.transform(names, lambda n: F.split(n, r"\$")))
    frames = F.regexp_extract_all(F.lower("report"), F.lit(r"\b([a-z_][a-z0-9_]{3,})\+0x[0-9a-f]+"), 1)
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(parts, none), F.coalesce(frames, none))
    fit = F.filter(both, lambda t: (F.char_length(t) >= 4) & ~t.isin(STOP_WORDS) & t.rlike("^[a-z_]"))
    texts = programs.select("case_id", F.col("text").alias("program")).join(reports.select("case_id", F.col("text").alias("report")), "case_id", "full")
    return texts.select("case_id", F.posexplode(F.slice(F.array_distinct(fit), 1, most)).alias("pos", "term"))


def _files_of_sets(terms: DataFrame, lines: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(case_id, set_no) of each case's set of terms, and (set_no, files) with the best files of each set: an array of (rank, path, score). Cases of equal terms have equal files."""
    sets = cut_lineage(terms.groupBy("case_id").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    known = cut_lineage(sets.select("terms").distinct().withColumn("set_no", F.monotonically_increasing_id()))
    asked = known.select("set_no", F.explode("terms").alias("term"))
    files = lines.where(F.col("path").rlike(r"\.[ch]$") & ~F.split_part("path", F.lit("/"), F.lit(1)).isin(UNSEEDED))
    words = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit("([a-z0-9_]+)")))).alias("text")).distinct()
    mentioned = cut_lineage(words.join(substring_pairs(words, asked, []), "text").select("path", "term").distinct())

    parts = mentioned.select("path").distinct().select("path", F.posexplode(F.split(F.lower("path"), "/")).alias("at", "text"), F.size(F.split("path", "/")).alias("n"))
    named = parts.join(substring_pairs(parts, asked, []), "text").groupBy("path", "term").agg(F.max((F.col("at") == F.col("n") - 1).cast("int")).alias("last"))
    scored = named.join(asked, "term").groupBy("set_no", "path").agg((100 * F.count("*") + 25 * F.sum("last")).alias("score"))
    told = scored.join(asked, "set_no").join(mentioned, ["path", "term"], "left_semi").select("set_no", "path", "score").distinct()

    shortest = Window.partitionBy("term").orderBy(F.length("path"), F.desc("path"))
    plain = mentioned.withColumn("r", F.row_number().over(shortest)).where(F.col("r") <= most).join(asked, "term").select("set_no", "path").distinct()
    both = told.unionByName(plain.join(told, ["set_no", "path"], "left_anti").withColumn("score", F.lit(0).cast("long")))
    rank = F.row_number().over(Window.partitionBy("set_no").orderBy(F.desc("score"), F.length("path"), F.desc("path")))
    best = both.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("set_no").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "score"))).alias("files"))
    return sets.join(known, "terms").select("case_id", "set_no"), cut_lineage(best)


def keyword_files(terms: DataFrame, lines: DataFrame, most: int = 40) -> DataFrame:
    """(case_id, path, score, rank): the best files (.c, .h) whose text holds a term of the case (case_id, term), letters' case aside.

    Score: 100 for each term in the path and 25 more in its last part. Order: score, then the shorter path, then the path backwards. Terms are sought in the
    distinct words of the tree, files for the distinct sets of terms that cases have. Files with a score are joined by the terms in their paths; of those without, a set's best are among the best
    of each of its terms, which are found once.
    """
    cases, best = _files_of_sets(terms, lines, most)
    return cases.join(best, "set_no").select("case_id", F.explode("files").alias("f")).select("case_id", "f.path", "f.score", "f.rank")


def function_hits(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(name, path): the .c files that define each name (name); where none does, those with "name(" in a line."""
    called = F.array_distinct(F.regexp_extract_all("line", F.lit(_CALLED), 1))
    each = lines.where(F.endswith("path", F.lit(".c"))).select("path", F.regexp_extract("line", _DEFINED, 1).alias("defined"), F.explode(called).alias("name"))
    held = each.join(names.select("name").distinct(), "name", "left_semi").groupBy("name", "path").agg(F.max(F.col("defined") == F.col("name")).alias("defines"))
    known = held.groupBy("name").agg(F.max("defines").alias("known"))
    return cut_lineage(held.join(known, "name").where("defines OR NOT known").select("name", "path"))


def _top(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def _place(path: Column) -> Column:
    """A path with what its nearness to others is judged by; a file in no folder has no top folder, and only files below arch/ have an architecture."""
    deep = F.contains(path, F.lit("/"))
    arch = F.when(F.startswith(path, F.lit("arch/")), F.split_part(path, F.lit("/"), F.lit(2)))
    return F.struct(path.alias("path"), F.regexp_extract(path, r"^(.*)/", 1).alias("folder"), F.when(deep, _top(path)).alias("top"), arch.alias("arch"))


def _nearness(c: Column, near: Column) -> Column:
    """0 one of the near files, 1 in a folder of theirs, 2 in a top folder of theirs, 20 elsewhere; 80 another architecture than theirs, 90 drivers while none of them is one."""
    some = lambda part: F.exists(near, lambda n: F.coalesce(n[part] == c[part], F.lit(False)))
    foreign = c["arch"].isNotNull() & F.exists(near, lambda n: n["arch"].isNotNull()) & ~some("arch")
    return F.when(some("path"), 0).when(some("folder"), 1).when(foreign, 80).when(some("top"), 2).when(F.coalesce(c["top"] == "drivers", F.lit(False)), 90).otherwise(20)


def _nearest(candidates: Column, near: Column) -> Column:
    """(rank, path) of the nearest of an array of places, ties by path."""
    return F.array_min(F.transform(candidates, lambda c: F.struct(_nearness(c, near).alias("rank"), c["path"].alias("path"))))


def _candidates(wanted: DataFrame, hits: DataFrame, near: DataFrame) -> DataFrame:
    """(case_id, name, path) that can be a wanted name's nearest file, for near files (case_id, path) and any that are chosen on the way.

    Of files in one folder that are not near themselves only the first can win. So each name keeps the first of each folder, once for all cases, and a case
    adds those files that are near or may become so: the first ones of its other names.
    """
    first = hits.groupBy("name", F.regexp_extract("path", r"^(.*)/", 1).alias("folder")).agg(F.min("path").alias("path"))
    common = wanted.join(first, "name").select("case_id", "name", "path")
    close = near.select("case_id", "path").unionByName(common.select("case_id", "path")).distinct()
    own = close.join(hits, "path").join(wanted.select("case_id", "name").distinct(), ["case_id", "name"], "left_semi")
    return common.unionByName(own.select("case_id", "name", "path")).distinct()


def defining_file(lines: DataFrame, wanted: DataFrame, near: DataFrame) -> DataFrame:
    """(case_id, name, path, rank): the file that defines each wanted function (case_id, name), nearest to the case's files near (case_id, path), some dozens at most.

    Files whose lines look like a definition go before those that only call it; among them the nearest, then the first path. A nearest file of
    rank 80 or more gives none. Names that say nothing and system calls' entries are not looked for.
    """
    entry = F.startswith("name", F.lit("__x64_sys_")) | F.startswith("name", F.lit("__builtin_"))
    sought = wanted.where(~F.col("name").isin(GENERIC_FUNCTIONS) & ~entry & (F.col("name") != "")).select("case_id", "name").distinct()
    by_case = near.groupBy("case_id").agg(F.collect_set("path").alias("near"))
    hits = function_hits(lines, sought)
    # A near file that has the name wins; of others in one folder only the first can, so each name keeps these, once for all cases.
    first = hits.groupBy("name", F.regexp_extract("path", r"^(.*)/", 1).alias("folder")).agg(F.min("path").alias("path"))
    first = cut_lineage(first.groupBy("name").agg(F.collect_list(_place(F.col("path"))).alias("c")))
    held = sought.join(by_case, "case_id", "left").select("case_id", "name", F.explode_outer("near").alias("path"))
    held = held.join(hits.withColumn("has", F.lit(True)), ["name", "path"], "left")
    held = held.groupBy("case_id", "name").agg(F.min(F.when(F.col("has"), F.col("path"))).alias("own"), F.collect_list("path").alias("near")).join(first, "name")
    # As _nearness, with what the near files lie in put together once a name.
    within = F.transform("near", _place)
    held = held.select("case_id", "name", "own", "c", *(F.array_distinct(F.array_compact(F.transform(within, lambda n: n[part]))).alias(part) for part in ("folder", "top", "arch")))  # noqa: B023
    has = lambda part, c: F.coalesce(F.array_contains(part, c[part]), F.lit(False))
    foreign = lambda c: c["arch"].isNotNull() & (F.size("arch") > 0) & ~has("arch", c)
    rank = lambda c: F.when(has("folder", c), 1).when(foreign(c), 80).when(has("top", c), 2).when(F.coalesce(c["top"] == "drivers", F.lit(False)), 90).otherwise(20)
    nearest = F.array_min(F.transform("c", lambda c: F.struct(rank(c).alias("rank"), c["path"].alias("path"))))
    best = held.select("case_id", "name", F.coalesce(F.when(F.col("own").isNotNull(), F.struct(F.lit(0).alias("rank"), F.col("own").alias("path"))), nearest).alias("b"))
    return best.select("case_id", "name", F.when(F.col("b.rank") < 80, F.col("b.path")).alias("path"), F.col("b.rank").alias("rank"))


def _seedable(path: Column, tops: Column) -> Column:
    """Sources in an allowed top folder; of architectures only what lies in a crypto folder."""
    suffix = path.rlike(r"\.(?:c|h|S)$")
    arch = F.array_contains(F.split(path, "/"), "crypto")
    return suffix & ~_top(path).isin(UNSEEDED) & F.when(_top(path) == "arch", arch).otherwise(F.array_contains(tops, _top(path)))


def seed_paths(frames: DataFrame, reports: DataFrame, programs: DataFrame, lines: DataFrame, calls: DataFrame, most: int = 40) -> DataFrame:
    """(case_id, path, position): the files to index for each case, in order, each once.

    frames: (case_id, pos, function, file); reports, programs: (case_id, text), one a case; calls: (path, pos, name) of the tree's files.
    First the files of frames, then those that define functions which the report names as "name()", both in allowed top folders: that of the first frame that says
    something, those of such definitions, and lib. Then keyword files, up to `most` in all. Last, up to `most`, the files that define what the first frame's file in an allowed folder calls, in order of
    calls, each nearest to all that the case has by then. Files of frames and definitions are never cut.
    """
    telling = frames.where(~F.coalesce(F.col("function").isin(GENERIC_FUNCTIONS), F.lit(False)) & F.col("file").isNotNull())
    own = telling.groupBy("case_id").agg(_top(F.min_by("file", "pos")).alias("top")).where("top <> 'arch'")
    named = report_names(reports)
    nowhere = reports.select("case_id", F.lit("").alias("path")).limit(0)
    places = cut_lineage(named.join(defining_file(lines, named, nowhere).where("path IS NOT NULL"), ["case_id", "name"]).select("case_id", "pos", "path"))
    cases = reduce(DataFrame.unionByName, [d.select("case_id") for d in (frames, reports, programs)]).distinct()
    every = reduce(DataFrame.unionByName, [own, places.select("case_id", _top(F.col("path")).alias("top")), cases.withColumn("top", F.lit("lib"))])
    tops = cut_lineage(every.groupBy("case_id").agg(F.collect_set("top").alias("tops")))

    sure = frames.select("case_id", F.lit(0).alias("source"), "pos", F.col("file").alias("path")).unionByName(places.withColumn("source", F.lit(1)))
    sure = sure.where("path IS NOT NULL").join(tops, "case_id").where(_seedable(F.col("path"), F.col("tops")))
    sure = sure.groupBy("case_id", "path").agg(F.min(F.struct("source", F.col("pos").cast("long").alias("pos"))).alias("at"))
    sure = sure.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda s: s["path"]).alias("sure"))
    sets, best = _files_of_sets(keyword_terms(programs, reports), lines, most)
    none = F.array().cast("array<string>")
    words = F.coalesce(F.transform("files", lambda f: f["path"]), none)
    held = tops.join(sure, "case_id", "left").join(sets, "case_id", "left").join(best, "set_no", "left").select("case_id", "tops", F.coalesce("sure", none).alias("sure"), words.alias("words"))
    more = F.slice(F.array_except("words", "sure"), F.lit(1), F.greatest(F.lit(most) - F.size("sure"), F.lit(0)))
    begun = cut_lineage(held.select("case_id", "tops", F.concat("sure", more).alias("seeds")).where(F.size("seeds") > 0))

    # A case that is full takes no more, so only others go on.
    room = cut_lineage(begun.where(F.size("seeds") < most))
    start = telling.join(room, "case_id").where(F.endswith("file", F.lit(".c")) & F.array_contains("tops", _top(F.col("file"))))
    start = start.groupBy("case_id").agg(F.min_by("file", "pos").alias("path")).join(room.select("case_id", F.explode("seeds").alias("path")), ["case_id", "path"], "left_semi")
    called = cut_lineage(start.join(calls, "path").where(telling_name(F.col("name"))).groupBy("case_id", "name").agg(F.min("pos").alias("pos")))
    hits = function_hits(lines, called)
    open_to = _candidates(called.select("case_id", "name"), hits, room.select("case_id", F.explode("seeds").alias("path"))).groupBy("case_id", "name").agg(F.collect_list(_place(F.col("path"))).alias("c"))
    turns = called.join(open_to, ["case_id", "name"]).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "c"))).alias("turns"))

    def hop(held: Column, turn: Column) -> Column:
        best = F.array(_nearest(turn["c"], held))
        fit = F.filter(best, lambda b: (F.size(held) < most) & (b["rank"] < 80) & ~F.exists(held, lambda h: h["path"] == b["path"]) & _seedable(b["path"], F.col("tops")))
        return F.concat(held, F.transform(fit, lambda b: _place(b["path"])))

    grown = F.aggregate("turns", F.transform("seeds", _place), hop, lambda held: F.transform(held, lambda h: h["path"]))
    grown = room.join(turns, "case_id", "left").select("case_id", F.when(F.col("turns").isNull(), F.col("seeds")).otherwise(grown).alias("seeds"))
    out = begun.where(F.size("seeds") >= most).select("case_id", "seeds").unionByName(grown).select("case_id", F.posexplode("seeds").alias("position", "path"))
    return out.select("case_id", "path", (F.col("position") + 1).alias("position"))
