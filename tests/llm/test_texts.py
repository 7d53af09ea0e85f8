"""Near copies, repeats, packing, mixing, language and quality, against brute force on small texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultloom.llm import language_id, mixing, ngram_join, packing, quality, substring_dedup
from faultloom.llm.common import window_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, hits int, name string, score double, taken int, part int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=3, n=60):
    """Random texts with near copies, exact copies, a passage that many share, nulls, empties and repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("a", "eé", "i", "o", "U")]
    fresh = lambda k: [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(k)]
    passage = fresh(45)
    rows = []
    for i in range(n):
        t = fresh(rng.choice([3, 6, 12, 40, 80, 200]))
        if i % 3 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        if i % 4 == 1 and rows:
            t = (rows[-1][1] or "").split()
            if t and i % 8 == 1:
                t[rng.randrange(len(t))] = "edited"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(t)))
    base = fresh(60)
    for i in range(n, n + 25):
        t = list(base)
        t[rng.randrange(len(t))] = f"v{i}"
        rows.append((i, " ".join(t)))
    rows += [(n + 30, None), (n + 31, ""), (n + 32, " \n "), (n + 33, "one two"), (n + 34, "ONE  two"), (n + 35, "x"), (None, "no id " + " ".join(passage)), (5, rows[5][1]), (5, rows[5][1])]
    rows.append((n + 40, " ".join(fresh(6000))))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), "k", 1, "n", 0.5, 9, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_window_hashes_depend_on_the_window_only():
    h = np.arange(50, dtype=np.uint64) * np.uint64(77)
    for k in (1, 2, 5, 18, 35):
        one = window_hashes(h, k)
        assert len(one) == 51 - k and one[7] == window_hashes(h[7 : 7 + k], k)[0]
    assert len(window_hashes(h[:3], 5)) == 0


@pytest.mark.parametrize("most", [2, 4, 32])
def test_jaccard_join_equals_brute_force(spark, docs, most):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    expected = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        expected.append((d, len(sets[i]), min(ids) if ids else None))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs, most=most).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_signatures_meet_whenever_sets_are_similar():
    """Of two similar sets with enough allowances under a band they share, a signature or a neighbourhood is common, whatever is hot."""
    rng = np.random.default_rng(1)
    bands, none, seen = ngram_join.Bands(75), np.empty(0, np.uint64), 0
    for _ in range(600):
        n = int(rng.integers(1, 120))
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, max(len(base) // 7, 1) + 1))
        other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64) * np.uint64(2)]))
        inter = len(np.intersect1d(base, other))
        if 100 * inter < 75 * (len(base) + len(other) - inter):
            continue
        shared = set(ngram_join._bands_of(base, bands)) & set(ngram_join._bands_of(other, bands))
        assert shared
        exact = [np.concatenate([ngram_join.signatures(s, bands, b) for b in shared]) for s in (base, other)]
        near = [np.concatenate([ngram_join.neighbourhoods(s, bands, b)[0] for b in shared]) for s in (base, other)]
        for share in (0.0, 0.3, 0.7):
            hot = exact[0][rng.random(len(exact[0])) < share]
            hot_near = near[0][rng.random(len(near[0])) < share / 3]
            for b in shared:
                if ngram_join.allowances(base, bands, b, hot, hot_near) >= bands.need(len(base), b):
                    met = set(exact[0].tolist()) & set(exact[1].tolist()) - set(hot.tolist())
                    met |= set(near[0].tolist()) & set(near[1].tolist()) - set(hot_near.tolist())
                    assert met
                    seen += share > 0
            assert ngram_join.allowances(base, bands, min(shared), none, none) >= len(ngram_join.segments(base, bands, min(shared))[0])
    assert seen > 50


def test_rest_pairs_keeps_every_similar_pair(spark):
    """Whatever is common or rare, similar sets meet on the first element they share; pairs of one component don't."""
    rng = np.random.default_rng(3)
    pool, sets = rng.integers(0, 1 << 62, 40), []
    for _ in range(60):
        own = set(rng.choice(pool, int(rng.integers(5, 38)), replace=False).tolist()) | set(rng.integers(0, 1 << 62, int(rng.integers(0, 5))).tolist())
        sets.append(own)
        if rng.random() < 0.5:
            sets.append(set(list(own)[1:]) | {int(rng.integers(0, 1 << 62))})
    rows = [(i, len(own), e) for i, own in enumerate(sets) for e in own]
    held = spark.createDataFrame(rows, "name long, size long, element long")
    part = spark.createDataFrame([(0, 0), (1, 0)], "id long, component long")
    found = {(r.a, r.b) for r in ngram_join._rest_pairs(ngram_join._prefixes(held, 75), part, 75).collect()}
    similar = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])} - {(0, 1)}
    assert len(similar) > 20 and similar <= found and (0, 1) not in found and len(found) < 60 * 59 / 2


def test_clouds_of_near_copies_equal_brute_force(spark):
    """Texts around common ones at every distance: most signatures are hot, and what is linked must not depend on it."""
    rng = random.Random(8)
    rows = []
    for c in range(3):
        base = [f"c{c}w{i}" for i in range(90)]
        for _ in range(60):
            own = list(base)
            for _ in range(rng.randint(0, 7)):
                own[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    passages = [[f"p{p}w{i}" for i in range(40)] for p in range(6)]
    for _ in range(120):
        rows.append((len(rows), " ".join(w for p in rng.sample(passages, rng.randint(1, 4)) for w in p)))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(rows))}


def test_parities_bound_the_difference():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    y = np.concatenate([x[40:], rng.integers(0, 1 << 63, 10).astype(np.uint64)])
    for a, b in zip(ngram_join.sketch(x), ngram_join.sketch(y), strict=True):
        assert sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(a.view(np.uint64), b.view(np.uint64), strict=True)) <= 50
    small, wide = ngram_join.sketch(np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64)))
    assert len(wide) == 2 * len(small) and (wide[: len(small)] ^ wide[len(small) :] == small).all()


def test_substring_dedup_equals_brute_force(docs):
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    seen = {}
    for _, w in rows:
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    expected = []
    for d, w in rows:
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        expected.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.repeat_digest(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns
    by = {r.doc_id: r for r in cut.collect()}
    assert by[90].text is None and by[90].key == "k"
    for d, w in rows:
        if d == 9:
            assert by[9].n_chars == len(by[9].text)


@pytest.mark.parametrize("length", [20, 21])
def test_repeats_are_found_at_every_offset(spark, length):
    rows, expected = [], []
    for at in range(length + 2):
        passage = [f"p{at}x{i}" for i in range(length)]
        for side, before in ((0, at), (1, 3)):
            own = [f"o{at}s{side}x{i}" for i in range(before + 4)]
            rows.append((2 * at + side, " ".join(own[:before] + passage + own[before:])))
            expected.append((2 * at + side, length))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.repeat_digest(df, length).collect()) == expected


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.word_bpe())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packing.pack(docs, packing.word_bpe()).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    by = {}
    for p in pieces:
        assert p.offset == 0 and p.length == len(p.ids) and p.length & (p.length - 1) == 0 and p.length <= 2048
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by.setdefault(p.doc_id, []).append(p)
    for d, text in rows:
        if d in (5, None):
            continue
        own = sorted(by[d], key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert all(p.doc_tokens == sum(q.length for q in own) for p in own)


def test_ids_equal_the_tokenizers():
    import pyarrow as pa

    ids = packing._Ids(packing.word_bpe())
    rng = random.Random(5)
    alphabet = "abcXYZéÉßİıŞΣσςЖ1٣.,;:!?'\"#|<>-_\u0301\u094d\u0915\u093cﬁǅ中\xa0\u2028\x85\x1c\x00😀 \t\n\x0b"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["KREDİ. ", "it's don't I'LL. x's.", "<|endoftext|> <|STARTOFTEXT|>. a<|endoftext|>b", "a.b.c. ..", "1.2,3!", "", None]
    for i in range(0, len(texts), 500):
        for text, data in zip(texts[i : i + 500], ids.of(pa.array(texts[i : i + 500], pa.string())), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == ids.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_windows_are_dealt_out_evenly():
    """No group of one share takes more than its part, and a repeat within the share asks nobody."""
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    by = substring_dedup.mixed(substring_dedup._least(h, 28))
    n = len(by)
    h = h[:n]
    rows = pd.concat(b.to_pandas() for b in substring_dedup._packed(h, np.ones(n, bool), np.zeros(n, np.int64), np.arange(n), by, 31, 8))
    assert rows.part.nunique() == 31 and rows.hashes.map(len).max() < 3 * 8 * n / 31
    twice = np.concatenate([h, h])
    key = np.repeat(np.arange(200), n // 100 + 1)[: 2 * n]
    rows = pd.concat(b.to_pandas() for b in substring_dedup._packed(twice, np.ones(2 * n, bool), key, np.arange(2 * n), np.concatenate([by, by]), 31, 8))
    assert rows.ask.map(len).sum() == 0 and rows.known_key.map(len).sum() == 8 * 2 * n and rows.known_key.map(len).max() < 4 * 8 * 2 * n / 31


def test_mixing_fills_up_and_takes_any_column(spark):
    """Against the rule itself: documents in order of place, each taken if it still fits; columns with the operator's own names pass through."""
    names = "mix_whole mix_at mix_pattern mix_source mix_place mix_bucket row pattern place whole cuts known n rest".split()
    sizes = [5000, 40, 1, 300, 77, 77, 9, 2500, 60, 13] * 12
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], s, *names) for i, s in enumerate(sizes)], ["doc_id", "source", "size", *names]).repartition(5)
    out = mixing.mixed_documents(df, F.col("size"), seed=4).collect()
    place = {r.doc_id: r.p for r in df.select("doc_id", mixing.seeded_place(F.col("doc_id"), 4).alias("p")).collect()}
    assert len(out) == len(sizes) and all(r[n] == n for r in out for n in names)
    for source in "ab":
        own = sorted((r for r in out if r.source == source), key=lambda r: place[r.doc_id])
        whole = min(int(own[0].target / own[0].source_size), 2)
        left, short = own[0].target - whole * own[0].source_size, []
        for r in own:
            fits = r["size"] <= left
            left -= r["size"] * fits
            short.append(r.taken != min(whole + fits, 2) * r["size"])
        assert own[0].target - sum(r.taken for r in own) <= left + 60 and (left > 1 or not any(short))
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.005 * own[0].target
    with pytest.raises(ValueError, match="sources"):
        mixing.source_weights(df, F.col("size"), most_sources=1)
    untold = mixing.mix(df, F.col("size"), F.when(F.col("doc_id") > 3, F.array("source")), {"a": 100.0, "b": 50.0}).collect()
    assert sum(r.taken for r in untold) <= 150 and all(r.taken == 0 for r in untold if r.doc_id <= 3)


def test_mixing_meets_targets(docs):
    size = mixing.words_in(F.col("text"))
    out = mixing.mixed_documents(docs, size, seed=1).collect()
    again = mixing.mixed_documents(docs.repartition(3), size, seed=1).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in out) == sorted((r.doc_id or -1, r.taken) for r in again)
    longest = max(r.mix_size for r in out)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= longest
        assert all(0 <= r.taken <= 2 * r.mix_size for r in own) and own[0].target <= 2 * own[0].source_size + 1e-6
    assert abs(sum({r.source: r.target for r in out}.values()) - 1.5 * sum(r.mix_size for r in out)) < 1e-3


def test_targets_are_capped_and_reshared():
    assert mixing.water_targets([10, 100, 100], [3, 1, 2], 1.5, 2.0) == pytest.approx([20, 295 / 3, 590 / 3])
    assert mixing.water_targets([10, 10], [1, 1], 2.0, 2.0) == [20, 20]
    assert mixing.water_targets([0, 0], [3, 1], 1.5, 2.0) == [0, 0]


def test_flow_routes_overlapping_sources():
    # Pattern b belongs to both sources; the second can only be met if the first leaves it.
    flow = mixing.route_capacity([((0,), 10), ((0, 1), 10)], [10.0, 10.0], 2)
    assert [sum(x) for x in flow] == [10, 10] and flow[1][1] == 10
    flow = mixing.route_capacity([((0,), 10), ((0, 1), 10)], [20.0, 10.0], 2)
    assert sorted(sum(x) for x in flow) == [pytest.approx(10), pytest.approx(20)] and sum(f[0] for f in flow) == pytest.approx(20)


def test_base_counts():
    text = "a b c d e x\n\na b c d e y\n a b\n a b\n# é$"
    n, chars, symbols, dup, repeat = quality.base_counts(text.encode())
    assert (n, symbols, dup) == (18, 2, 1) and chars == len(re.sub(r"\s", "", text))
    w, spans = words(text), {}
    for i in range(len(w) - 4):
        spans.setdefault(tuple(w[i : i + 5]), []).append(i)
    assert repeat == len({i + k for at in spans.values() if len(at) > 1 for i in at for k in range(5)})
    assert quality.base_counts(b"") == (0, 0, 0, 0, 0)


def test_perplexity_model_is_a_distribution_and_rejects_noise(spark):
    rng = random.Random(0)
    syllables = ["the", "ing", "and", "er", "on", "ti"]
    good = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(60)) for _ in range(200)]
    bad = ["".join(rng.choice("qxzjvkwQ%&5831 ") for _ in range(300)) for _ in range(3)]
    rows = [(i, t, "en" if i % 50 else None, "s", 0, "k", 1, "n", 0.5, 9, 2) for i, t in enumerate(good + bad)] + [(999, None, "en", "s", 0, "k", 1, "n", 0.5, 9, 2)]
    out = {r.doc_id: r for r in quality.score_quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == len(rows) and not out[999].kept and out[999].base_failed
    assert not any(out[200 + i].kept for i in range(3) if not out[200 + i].base_failed)
    assert sum(out[i].kept for i in range(200)) >= 198
    counts = spark.createDataFrame([(0, int(c), int(n)) for c, n in zip(*np.unique(np.concatenate([quality.grams(t.encode(), quality.character_classes()) for t in good]), return_counts=True), strict=True)], "lang_no int, code int, n long")
    rows = quality.kneser_ney(counts).toPandas()
    model = quality.Model(*(rows[c].to_numpy() for c in ("lang_no", "ord", "code", "value")))
    context = int(rows[rows.ord == 3].code.iloc[0]) // 128
    assert np.exp(model.log_p(0, context * 128 + np.arange(128)).astype(float)).sum() == pytest.approx(1, abs=0.02)


def litter_and_prose():
    """Clean texts of two languages, then as many words with marks after them or bars between them."""
    rng = random.Random(4)
    syllables = {"en": ["the", "ing", "and", "er", "on", "ti", "ea", "sh"], "xx": ["мы", "ого", "ни", "ста", "жё", "ра"]}
    prose = lambda lang: ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(60, 400))]
    langs = ["en", "xx"]
    rows = [(i, " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(prose(langs[i % 2]))), langs[i % 2]) for i in range(300)]
    for i in range(300, 324):
        words_ = prose(langs[i % 2])
        rows.append((i, " | ".join(words_) if i % 4 < 2 else " ".join(w + rng.choice(["***", "$$$", "&&&", "###", "%%%"]) for w in words_), langs[i % 2]))
    return rows


def test_littered_and_menu_like_texts_are_rejected(spark):
    classes = quality.character_classes()
    assert len(set(classes[33:65].tolist() + classes[91:127].tolist())) == 68
    df = spark.createDataFrame(litter_and_prose(), "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in quality.score_quality(df).collect()}
    assert not any(out[i].base_failed or out[i].kept for i in range(300, 324))
    assert sum(out[i].kept for i in range(300)) >= 294


def test_every_language_has_its_own_model_and_rare_grams_are_joined(spark):
    rng = random.Random(5)
    alphabets = ["".join(chr(0x400 + 24 * k + i) for i in range(24)) for k in range(40)]
    text = lambda k: " ".join("".join(rng.choice(alphabets[k][:6]) for _ in range(4)) for _ in range(40))
    rows = [(10 * k + i, text(k), f"l{k}") for k in range(40) for i in range(8)]
    # In the last language, a text in another one's letters.
    rows.append((1000, text(3), "l39"))
    df = spark.createDataFrame([*rows, (1000, text(3), "l39")], "doc_id long, text string, lang string")
    every, none = ({(r.doc_id, round(r.surprise, 6)): r for r in quality.score_quality(df, sent=sent).collect()} for sent in (1_000_000, 1))
    assert every.keys() == none.keys() and len(every) == 322
    assert sum(r.kept for r in every.values() if r.doc_id < 390) >= 290
    assert not any(r.kept for r in every.values() if r.doc_id == 1000)
    counts: dict = {}
    points = quality.lower_points()
    for _, t, _ in rows[:8]:
        for c in quality.point_grams(t.encode(), *points)[0].tolist():
            counts[c] = counts.get(c, 0) + 1
    third = quality.probabilities(spark.createDataFrame([(0, c, n) for c, n in counts.items()], "lang_no long, code long, n long"), 1 << 21)[0]
    p = {r.code: r.p for r in third.collect()}
    expected = -sum(np.log(p[c]) for c in quality.point_grams(rows[0][1].encode(), *points)[0].tolist()) / sum(c.isalpha() for c in rows[0][1])
    assert next(r.surprise for r in every.values() if r.doc_id == 0) == pytest.approx(expected, abs=1e-6)


def test_language_id_finds_held_out_languages_and_mixtures(spark):
    rng = random.Random(0)
    parts = {"en": ["the", "ing", "and", "er"], "fr": ["eau", "été", "que", "ion"], "de": ["sch", "ung", "über", "ein"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(n))
    rows = [(i, text(lang, rng.randint(5, 60)), lang) for i in range(300) for lang in [rng.choice(list(parts))]]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !?", "fr"), (902, text("fr", 10) + " " + text("en", 40), None), (903, "", None)], "doc_id long, text string, lang string")
    model = language_id.learn(df.where(~language_id.held_out(F.col("doc_id"))))
    out = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert sum(out[i].lang_pred == lang for i, _, lang in rows) >= 298
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 903))
    assert out[902].lang_pred == "en" and 0.6 < out[902].score < 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    none = language_id.predict(df, language_id.learn(df.where("1 = 0")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_mixtures_of_many_languages_and_gibberish_show(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    parts = {f"l{k}": ["".join(chr(0x430 + 5 * k + rng.randrange(5)) for _ in range(3)) for _ in range(6)] for k in range(6)}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(2)) for _ in range(n))
    rows = [(i, text(f"l{i % 6}", 60), f"l{i % 6}") for i in range(300)]
    rows.append((900, " ".join(text(f"l{k}", n) for k, n in enumerate((50, 40, 30, 20, 10))), None))
    rows.append((901, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(80)), None))
    rows.append((902, text("l1", 60) + " " + text("l2", 20), None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.predict(df, language_id.learn(df.where("doc_id < 900"))).collect()}
    assert out[900].lang_pred_set == ["l0", "l1", "l2", "l3", "l4"] and out[900].score < 0.4
    assert out[900].lang_pred_shares == pytest.approx([1 / 3, 4 / 15, 1 / 5, 2 / 15, 1 / 15], abs=0.05)
    assert out[902].lang_pred_set == ["l1", "l2"] and out[7].lang_pred_set == ["l1"]
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, df, str(tmp_path)).collect()}
    assert kept == {*range(300), 902}


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert ngram_join.similar_documents(empty).count() == 0
    assert substring_dedup.repeat_digest(empty).count() == 0
    assert packing.pack(empty, packing.word_bpe()).count() == 0
    assert mixing.mixed_documents(empty, mixing.words_in(F.col("text"))).count() == 0
    assert quality.score_quality(empty).count() == 0
    assert language_id.predict(empty, language_id.learn(empty)).count() == 0
