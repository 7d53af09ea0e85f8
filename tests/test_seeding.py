"""The seeds of kernel cases against a plain rendering of the rules, on small random trees, and the rules' edges as literals."""

import random
import re

from faultloom.operators import seeding
from faultloom.operators.kernel import GENERIC_FUNCTIONS, STOP_WORDS

NAMES = ["alpha_run", "beta_get", "gamma", "delta_put", "kfree", "eps"]


def near_rank(path, near):
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    archs = {p.split("/")[1] for p in near if p.startswith("arch/")}
    if path in near:
        return 0
    if folder(path) in {folder(p) for p in near}:
        return 1
    if path.startswith("arch/") and archs and path.split("/")[1] not in archs:
        return 80
    if path.split("/")[0] in {p.split("/")[0] for p in near if "/" in p}:
        return 2
    return 90 if path.startswith("drivers/") else 20


def plain_hits(lines, name):
    words = "|".join(seeding.STORAGE_WORDS), "|".join(seeding.TYPE_WORDS)
    defines = re.compile(rf"[ \t]*(?:(?:{words[0]})[ \t]+)*(?:(?:{words[1]})[ \t]+)*\w+[ \t*]+{name}[ \t]*\(")
    hits = {(p, bool(defines.match(t))) for p, t in lines if p.endswith(".c") and re.search(rf"(^|[^A-Za-z0-9_]){name}\s*\(", t)}
    return {p for p, d in hits if d} or {p for p, _ in hits}


def plain_pick(lines, name, near):
    ranked = sorted((near_rank(p, near), p) for p in plain_hits(lines, name))
    return ranked[0][1] if ranked and ranked[0][0] < 80 else None


def says(name):
    return len(name) >= 4 and name not in GENERIC_FUNCTIONS and not name.isupper()


def plain_words(report, program, lines, most):
    terms = [t for m in re.finditer(r"\b([a-z_][a-z0-9_]*)(?:\$([a-z0-9_]+))?\b", program.lower()) for t in m.groups() if t]
    terms += re.findall(r"\b([a-z_][a-z0-9_]{3,})\+0x[0-9a-f]+", report.lower())
    terms = list(dict.fromkeys(t for t in terms if len(t) >= 4 and t not in STOP_WORDS and not t[0].isdigit()))[:32]
    paths = {p for p, t in lines if p[-2:] in (".c", ".h") and p.split("/")[0] not in seeding.UNSEEDED and any(x in t.lower() for x in terms)}
    score = lambda p: sum(100 * (t in p.lower()) + 25 * (t in p.lower().split("/")[-1]) for t in terms)
    return sorted(paths, key=lambda p: (score(p), -len(p), p), reverse=True)[:most]


def plain_seeds(frames, report, program, lines, calls, most):
    telling = [(f, p) for f, p in frames if f not in GENERIC_FUNCTIONS and p]
    tops = {telling[0][1].split("/")[0]} - {"arch"} if telling else set()
    found = [plain_pick(lines, n, []) for n in dict.fromkeys(re.findall(r"\b([A-Za-z_]\w*)\s*\(\)", report)) if says(n)]
    found = [p for p in found if p]
    tops |= {p.split("/")[0] for p in found} | {"lib"}
    out = []

    def fits(p):
        top = p.split("/")[0]
        return p.endswith((".c", ".h", ".S")) and top not in seeding.UNSEEDED and ("crypto" in p.split("/") if top == "arch" else top in tops)

    for p in [p for _, p in frames if p] + found:
        if p not in out and fits(p):
            out.append(p)
    for p in plain_words(report, program, lines, most):
        if len(out) < most and p not in out:
            out.append(p)
    start = next((p for f, p in telling if p.endswith(".c") and p.split("/")[0] in tops), None)
    for n in dict.fromkeys(n for p, n in calls if p == start and start in out and says(n)):
        if len(out) >= most:
            break
        p = plain_pick(lines, n, out)
        if p and p not in out and fits(p):
            out.append(p)
    return out


def test_seeds_equal_the_plain_rules(spark):
    pick = random.Random(3)
    folders = ["fs/a", "fs/b", "net", "drivers/usb", "arch/x86/crypto", "arch/arm/mm", "lib", "tools"]
    files = [f"{d}/{n}{e}" for d in folders for n in ("gamma", "z", "yy") for e in (".c", ".c", ".h")] + ["top.c"]
    shapes = ["static int {}(void)", "struct q *{} (int a)", "\tx = {}(1) + {}(2);", "  return {}(y);", "#define {}(x) x", "a9{}(1)", "/* {} */"]
    lines = [(pick.choice(files), pick.choice(shapes).replace("{}", pick.choice(NAMES), 1).replace("{}", pick.choice(NAMES))) for _ in range(90)]
    calls = [(p, n) for p in sorted(set(files)) for n in pick.sample(NAMES, 4)]
    frames, texts = {}, {}
    for c in map(str, range(25)):
        frames[c] = [(pick.choice([*NAMES, "dump_stack"]), pick.choice([None, *files])) for _ in range(pick.randrange(5))]
        texts[c] = (f"{pick.choice(NAMES)}() BUG() {pick.choice(NAMES)} () {pick.choice(NAMES)}+0x1/0x2", f"r0 = open${pick.choice(NAMES)}('{pick.choice(NAMES)}')\nnet$9a(r0)")
    tables = (
        spark.createDataFrame([(c, i, *f) for c, fs in frames.items() for i, f in enumerate(fs)], "case_id string, pos long, function string, file string"),
        spark.createDataFrame([(c, r) for c, (r, _) in texts.items()], "case_id string, text string"),
        spark.createDataFrame([(c, p) for c, (_, p) in texts.items()], "case_id string, text string"),
        spark.createDataFrame(lines, "path string, line string"),
        spark.createDataFrame([(p, i, n) for i, (p, n) in enumerate(calls)], "path string, pos long, name string"),
    )
    for most in (3, 12):
        got = {}
        for r in sorted(seeding.seed_paths(*tables, most=most).collect()):
            got.setdefault(r.case_id, {})[r.position] = r.path
        want = {c: plain_seeds(frames[c], *texts[c], lines, calls, most) for c in frames}
        assert {c: [v[i + 1] for i in range(len(v))] for c, v in got.items()} == {c: w for c, w in want.items() if w}


def test_artifacts_by_place(spark):
    rows = [("a", "assets/repro.c", 0), ("a", "assets/logs/repro.syz", 9), ("a", "x/assets/repro.syz", 9), ("a", "assets/repro.report", 0), ("a", "datasets/bug_report/a.txt", 0)]
    rows += [("b", "datasets/bug_report/a.txt", 5), ("b", "assets/repro.txt", 1), ("b", "assets/logs/dmesg.txt", 1), ("c", "other", 1)]
    got = seeding.choose_artifacts(spark.createDataFrame(rows, "case_id string, path string, size long")).collect()
    assert {tuple(r) for r in got} == {
        ("a", "reproducer", "assets/logs/repro.syz", "syz"), ("a", "report", "datasets/bug_report/a.txt", None),
        ("b", "reproducer", "assets/repro.txt", None), ("b", "report", "assets/logs/dmesg.txt", None),
    }
