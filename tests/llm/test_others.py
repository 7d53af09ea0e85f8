"""Chat, revisits, pages, vectors and the pipeline."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultloom.llm import ann, chat_format, html_text, revisit

TURNS = "conv_id long, turn long, role string, text string, seq int"


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "a ### b</turn>\n\\h \\b", 0), (1, 1, "user", None, 0), (1, 2, "assistant", "</turn>\n### user: x", 0), (1, 3, "assistant", "é😀\\", 0),
        (2, 0, None, "", 0), (2, 0, None, "", 0), (3, None, "a: b</turn>", "####</turn", 0), (None, 0, "assistant", "\\\\t\\c", 0),
    ]
    df = spark.createDataFrame(rows, TURNS)
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.render(df)).collect()}
    assert len(back) == 4
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in back[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert back[conv].loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert chat_format.render(df.where("1 = 0")).count() == 0


def test_events_fold_to_final_turns(spark):
    log = [
        (1, 1, 0, "user", "delta", "Hel"), (1, 2, 0, None, "delta", "lo"), (1, 3, 1, "assistant", "delta", "bad"), (1, 4, 1, None, "regenerate", None), (1, 6, 1, None, "delta", "!"), (1, 5, 1, None, "delta", "good"),
        (1, 7, 0, None, "edit", "Hi"), (1, 8, 2, "user", "delta", "gone"), (1, 9, 2, None, "delete", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, role string, kind string, text string")
    assert sorted(tuple(r) for r in chat_format.fold_events(df).collect()) == [(1, 0, "user", "Hi"), (1, 1, "assistant", "good!")]


def test_op10_takes_its_turns_from_the_fold(spark, tmp_path, monkeypatch):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} é {t}" * (t + 1)) for c in range(6) for t in range(4)]
    rows += [(1, 1, "assistant", "text 1 é 1" * 2), (1, 1, "tool", "ab"), (2, 2, None, None), (None, None, "user", ""), (9, 0, "user", "#")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat_format.logged_events(turns)
    kinds = {r["kind"] for r in log.select("kind").distinct().collect()}
    assert kinds == {"delta", "edit", "regenerate"} and log.count() >= 3 * len(rows)
    folded = chat_format.fold_events(log, ("row",)).collect()
    assert sorted(map(tuple, folded), key=repr) == sorted(((c, t, role, text or "") for c, t, role, text in rows), key=repr)
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    fold, seen = chat_format.fold_events, []
    monkeypatch.setattr(chat_format, "fold_events", lambda events, *a: seen.append(events.count()) or fold(events, *a))
    out = {r.conv_id: r.n_turns for r in chat_format.op10_chat_formatting(spark, str(tmp_path)).collect()}
    assert seen and seen[0] >= 3 * (len(rows) + 2) and out == {0: 4, 1: 6, 2: 5, 3: 4, 4: 4, 5: 4, None: 1, 9: 1, -7: 2}


def test_revisits(spark):
    rows = [
        (1, "http://WWW.a.com:80/x/?b=2&a=1#f", "2024-01-01 10:00:00", "response", "ETag: \"1\"\nServer: s\nDate: d1", "body1"), (2, "https://a.com/x?a=1&b=2", "2024-01-03 10:00:00", "revisit", "ETag: W/\"1\"\nServer: t\nDate: d2", None),
        (3, "a.com/x?a=1&b=2", "2024-01-04 10:00:00", "response", "ETag: \"2\"", "body2"), (4, "a.com/x?a=1&b=2", "2024-01-04 10:00:01", "revisit", "ETag: \"1\"", None), (5, "a.com/x?a=1&b=2", "2023-01-04 10:00:01", "revisit", "ETag: \"1\"", None),
        (6, None, "2024-01-05 10:00:00", "revisit", "", None), (7, "a.com/x?a=1&b=2", "2024-02-01 10:00:00", "revisit", "Vary: x", None), (8, "a.com/x?a=1&b=2", None, "revisit", "ETag: \"2\"", None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, captured string, kind string, h string, payload string").withColumns({"captured": F.col("captured").cast("timestamp"), "headers": revisit.header_map(F.col("h")), "status": F.lit("own"), "page": F.lit(1), "refers_to": F.lit("x"), "k": F.lit("v")}).drop("h")
    out = {r.record_id: r for r in revisit.resolve_revisits(df).collect()}
    assert {k: r.status for k, r in out.items()} == {1: "response", 2: "resolved", 3: "response", 4: "mismatch", 5: "orphan", 6: "orphan", 7: "unverified", 8: "orphan"}
    assert out[2].payload == "body1" and out[2].headers == {"etag": 'W/"1"', "server": "s", "date": "d2"} and out[7].payload == "body2" and out[4].payload is None
    found = revisit.resolve_revisits(df)
    assert len(set(found.columns)) == len(found.columns) and all(r.k == "v" for r in out.values())
    assert revisit.resolve_revisits(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), (None, ""), ("just text &amp; more", "just text & more"),
        ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head &eacute;</h1><p><b>One<br>two\n  three<p>Four</article><footer>foot</footer>", "Head é One two three Four"),
        ("<body><div class='sidebar'><p>" + "side " * 60 + "</p></div><main><p>" + "good " * 40 + "</p><div class=\"ad\">Buy</div><p>end.</p><section id=comments><p>I say " + "so " * 50 + "</section></main><script>var t='</p>';</script>", ("good " * 40 + "end.").strip()),
        ("<div><p>" + "word " * 50 + "</p><form><input><p>mail</p></form><!-- <p>no</p> --><p>last &#65;&nbsp;b", ("word " * 50 + "last A b").strip()),
        ("<div class='entry related-work'><p>" + "long " * 60 + "</p></div><p>outside " + "it " * 40 + "</p>", ("long " * 60 + "outside " + "it " * 40).strip()),
        ("<div class='post comments-area'><p>" + "long " * 60 + "</p></div><div class='entry sidebar'><p>" + "side " * 60 + "</p></div><p>" + "it " * 60 + "</p>", ("it " * 60).strip()),
        ("<article><p>" + "text " * 40 + "<math><mi>x</mi></math> " + "text " * 20 + "</p></article>", ("text " * 40 + "x " + "text " * 20).strip()),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page or "") == text


def test_broken_markup_is_read_in_one_pass():
    import time

    began = time.process_time()
    html_text.main_text('<div class="a" ' * 70_000 + '"')
    html_text.main_text('<div class="a ' * 70_000 + "<!--" * 10_000)
    assert time.process_time() - began < 20
    assert html_text.main_text('<p><a href="x >link</a> ' + "word " * 40 + "</p><p title='it>s'>" + "more " * 40) == ("link " + "word " * 40 + "more " * 40).strip()


def test_pages_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + "abc " * 30, "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert out[1].n_chars == len(out[1].text) == 119 and out[None].text == ""


def test_nearest_reaches_recall_and_orders_ties(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16))
    x = np.concatenate([centres[rng.integers(0, 20, 2500)] + 0.3 * rng.standard_normal((2500, 16)), np.tile(3 * centres[:1], (300, 1))]).astype(np.float32)
    rows = [(int(i), [float(v) for v in e], 0) for i, e in enumerate(x)]
    odd = [(20_000, None, 1), (20_020, [0.0] * 16, 1), (20_040, [float("nan")] * 16, 1), (20_060, [1.0, None] + [0.0] * 14, 1), (20_080, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, part int")
    out = ann.nearest(df, per_part=200, slice_rows=500).toPandas()
    s = x[::20].astype(float) @ x.astype(float).T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -np.inf
    got = out.groupby("query_id").vec_id.apply(list).to_dict()
    assert set(got) == set(range(0, len(x), 20)) and all(len(v) == 20 for v in got.values())
    recall = []
    for i, row in enumerate(s):
        floor = np.sort(row)[-20]
        recall.append(np.mean([row[j] >= floor - 1e-9 for j in got[i * 20]]))
    assert np.mean(recall) >= 0.9
    ordered = out.sort_values(["query_id", "rank"])
    tied = (ordered.query_id.diff() == 0) & (ordered.score.diff() == 0)
    assert tied.any() and (ordered.vec_id.diff()[tied] > 0).all()
    assert (ordered.groupby("query_id").score.diff().fillna(0) <= 0).all()
    few = ann.nearest(df.where("vec_id < 5"))
    assert sorted(r.vec_id for r in few.collect()) == [1, 2, 3, 4]
    assert ann.nearest(df.where("1 = 0")).count() == 0


def test_rows_with_one_id_are_rows_of_their_own_and_blocks_lose_none(spark):
    x = np.random.default_rng(1).standard_normal((400, 8)).astype(np.float32)
    x[41] = x[40]
    ids = np.array([i // 2 * 2 if i < 100 else i for i in range(400)])
    df = spark.createDataFrame([(int(i), [float(v) for v in e]) for i, e in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, k=5, per_part=1000, slice_rows=30, block_rows=3).toPandas()
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    want = [tuple(sorted(zip(-s[i], ids), key=lambda p: (round(p[0], 9), p[1]))[:5]) for i in np.flatnonzero(ids % 20 == 0)]
    assert len(got) == 5 * len(want)
    of = lambda rows: sorted((int(q), tuple(v)) for q, v in rows)
    # Rows of one id come out under it together, so their answers are compared as one list of neighbours.
    assert of((q, sorted(g.vec_id)) for q, g in got.groupby("query_id")) == of((q, sorted(int(v) for i, w in zip(ids[ids % 20 == 0], want, strict=True) if i == q for _, v in w)) for q in set(ids[ids % 20 == 0]))


def test_balanced_partition_is_balanced():
    rng = np.random.default_rng(0)
    x = ann.unit(rng.standard_normal((400, 8)))
    part = ann.balanced_partition(ann.neighbour_graph(x, 5), 8)
    assert part.min() == 0 and np.bincount(part, minlength=8).max() <= 56


def test_near_copies_keep_one_of_each_class_by_brute_force(spark):
    import corpus_pipeline
    from test_texts import corpus, shingles

    rows = [(i, t) for i, t in corpus(n=40) if i is not None]
    other = " ".join(f"z{k}" for k in range(30))
    rows += [(3, "a b c d e f g"), (5, "A b c d e f g"), (5, other), (7, "q r s t u v"), (900, ""), (900, None), (7, "q r s t u v"), (None, "Q r s t u v"), (None, "alone here and nowhere else")]
    sets = [shingles(t) for _, t in rows]
    least = list(range(len(rows)))
    same = lambda i, j: rows[i] == rows[j] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    for _ in rows:
        least = [min(least[j] for j in range(len(rows)) if same(i, j) or i == j) for i in range(len(rows))]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert len(kept) == len(set(kept)) == len(set(least)) and set(kept) <= set(rows)
    for c in set(least):
        own = [rows[i] for i in range(len(rows)) if least[i] == c]
        ids = [i for i, _ in own if i is not None]
        assert len([r for r in own if r in kept and (not ids or r[0] == min(ids))]) >= 1
    assert {(3, "a b c d e f g"), (5, other), (900, ""), (900, None)} <= set(kept) and (None, "Q r s t u v") not in kept


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline
    from test_texts import SCHEMA, corpus

    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "k", 1, "n", 0.5, 9, 2) for i, t in corpus(n=30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        counts.append(kept.count())
    assert counts[0] == sum(any(c.isalpha() for c in r[1] or "") for r in rows)
    assert counts[1] < counts[0] and counts[2] <= counts[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert packed.where("length > 2048 OR offset <> 0").count() == 0 and packed.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "text", "<div><p>t</p>" * 30_000, "<span>" + "<div>" * 30_000 + "</span>" * 30_000 + "x", "<p>a</div>" * 60_000, "<article>" * 50_000 + "</main>" * 50_000 + "end"])
def test_nested_and_unclosed_elements_take_linear_time(page):
    import time

    began = time.process_time()
    assert html_text.main_text(page)
    assert time.process_time() - began < 5


def test_revisits_keep_columns_of_any_name(spark):
    rows = [(1, "a.com/x", "2024-01-01 10:00:00", "response", {"etag": "1"}, "body"), (2, "a.com/x", "2024-01-02 10:00:00", "revisit", {"etag": "1"}, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, captured string, kind string, headers map<string,string>, payload string").withColumn("captured", F.col("captured").cast("timestamp"))
    names = ["merged", "wv_payload", "wv_block", "wv_others", "own", "inside", "carried", "ref", "a.b", "page", "status", "refers_to"]
    found = revisit.resolve_revisits(df.withColumns({n: F.lit(n) for n in names})).collect()
    assert {(r.record_id, r["status"], r.payload) for r in found} == {(1, "response", "body"), (2, "resolved", "body")}
    assert all(r[n] == n for r in found for n in names[:9])


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_vectors_of_any_number_type(spark, kind):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 8)) * (100 if kind == "int" else 1)
    x = x.astype({"float": np.float32, "double": np.float64, "int": np.int32}[kind])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").withColumns({"key": F.lit("k"), "part": F.lit("p"), "asks": F.lit("a")})
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(df, k=3).collect()}
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(exact, -np.inf)
    for q in (0, 20, 40):
        best = np.argsort(-exact[q])[:3]
        assert [got[q, i + 1][0] for i in range(3)] == best.tolist() and all(abs(got[q, i + 1][1] - exact[q, b]) < 1e-9 * max(1, abs(exact[q, b])) for i, b in enumerate(best))


W = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="related-articles content"><p>{W}</p></div>', W),
        (f'<div class="comments-page"><article><p>{W}</p></article></div><p>short</p>', W),
        (f'<div id="content"><div class="alert-level"><p>{W}</p></div></div>', W),
        (f"<nav><ul><li>a<li>b</ul><article><p>{W}</p></article>", W),
        (f"<nav><article>card</article></nav><article><p>{W}</p></article>", W),
        (f"<article><p>{W}</p><aside><p>a</p><p>b</p><p>c</p><p>d</p></aside><p>The end came.</p></article>", f"{W} The end came."),
        (f'<div id="content"><p>{W}</p><ul class="menu"><li>a<li>b<li>c<li>d</ul><p>Fin.</p></div><div>Copyright</div>', f"{W} Fin."),
        (f"<article>{W}<noscript>n</noscript><svg><text>s</text></svg><button>t</button></article><button>no</button>", f"{W} n s t"),
        (f'<p>{W}</p><div id="comments"><article>{W} {W}</article></div>', W),
        (f'<p>{W}</p><div style="display:none"><article>{W} {W}</article></div>', W),
        (f'<p>{W}</p><section class="related"><article>teaser</article></section>', W),
        ('<div class="cookie-notice">We use cookies</div>', ""),
        (f'<form><main>{W}<form>f</form> z</main></form>', f"{W} z"),
        (f'<article>{W}<div class="comment-list"><article>c</article></div></article>', W),
    ],
)
def test_articles_in_wrappers_and_short_runs_stay(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<div><p>t</p>" * 30_000, "<nav><article>" * 50_000 + W, "<nav>" * 50_000 + "<article>" * 50_000, "<span class=ad>" * 80_000])
def test_nested_markup_takes_linear_time(page):
    begun = time.monotonic()
    html_text.main_text(page)
    assert time.monotonic() - begun < 5


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_small_tables_are_partitioned_and_reach_the_recall(spark, sf, monkeypatch):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    df = spark.read.parquet(path)
    made, train = [], ann.train
    monkeypatch.setattr(ann, "train", lambda *a: made.append(train(*a)) or made[-1])
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    rows = {r.vec_id: r.embedding for r in df.collect() if r.embedding is not None and any(r.embedding) and np.isfinite(np.array(r.embedding, float)).all()}
    ids, x = np.array(list(rows)), np.array(list(rows.values()), float)
    hits = total = 0
    for q in (i for i in rows if i % 20 == 0):
        s = x @ np.array(rows[q], float)
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        assert sorted(r for r, _ in got[q]) == list(range(1, len(best) + 1))
        hits += len(set(best) & {i for _, i in got[q]})
        total += len(best)
    assert len(made[0][0].lies) == min(max(len(ids) // 120, 1), 8) and hits >= 0.9 * total
