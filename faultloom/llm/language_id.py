"""Language identification as inference of a mixture of languages.

Spark counts hashed three-letter n-grams of the labelled texts by language. A document is then taken as a mixture: expectation-
maximisation estimates the share of each language from the likelihoods of the document's n-grams, and the set of languages
grows by the next leading one as long as the penalised likelihood (BIC) gains, up to all languages. The prediction is the language
with the largest share in that set and its score is the share; the set, its shares and the fit are columns of their own. The fit is the
document's log likelihood per n-gram, less what its languages' own n-grams have, in spreads of these, and drawn to 0 where n-grams are few.

The model has 2**18 n-gram classes for each of at most `most_langs` languages, whatever the corpus; it is
fitted on all labelled rows. Counting adds up within tasks and then by (language, class); prediction is a pass over rows, with the
documents of a slice of text inferred together. No key gathers rows.

Edge cases: a null text or one without letters is "und" with score 0; rows without a language teach nothing; with nothing learned
every prediction is "und"; repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, checkpointed, mixed, table

_BITS = 18
_ROUNDS = 6
#: So many n-grams count half as evidence of a bad fit.
_FEW = 40


def letters() -> np.ndarray:
    """Of each code point: its lower-case letter, or a space if it is none."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x32400):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(low) if len(low := x.lower()) == 1 else c
    return out


def grams(text: bytes, letter: np.ndarray) -> np.ndarray:
    """Classes of the three-character n-grams of a text's words, with one space before and after each; empty without letters."""
    own = letter[np.frombuffer(text.decode().encode("utf-32-le", "surrogatepass"), np.uint32)]
    own = np.concatenate([[32], own, [32]]).astype(np.uint64)
    own = own[np.concatenate([[True], (own[1:] != 32) | (own[:-1] != 32)])]
    if len(own) < 3:
        return np.empty(0, np.int64)
    return (mixed(own[:-2] + (own[1:-1] << np.uint64(21)) + (own[2:] << np.uint64(42))) >> np.uint64(64 - _BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letter, sums = letters(), {}
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        for at, texts in byte_texts(batch):
            own: dict[str, list] = {}
            for t, lang in zip(texts, langs[at : at + len(texts)], strict=True):
                own.setdefault(lang, []).append(grams(t, letter))
            for lang, parts in own.items():
                sums[lang] = sums.get(lang, 0) + np.bincount(np.concatenate(parts), minlength=1 << _BITS)
    for lang, n in sums.items():
        codes = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(n[codes].astype(np.int64))], ["lang", "code", "n"])


def learn(labelled: DataFrame, most_langs: int = 256) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their class probabilities, [class, language], and mean and spread of their n-grams' log probabilities, from labelled texts (text, lang)."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    langs = sorted(r["lang"] for r in labelled.select("lang").distinct().limit(most_langs + 1).collect())
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    # At most 2**18 counts a language.
    rows = labelled.mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << _BITS, len(langs)))
    if len(rows):
        counts[rows["code"].to_numpy(), np.searchsorted(np.array(langs, object), rows["lang"].to_numpy(object))] = rows["n"].to_numpy()
    p = (counts + 0.5) / (counts.sum(0) + 0.5 * (1 << _BITS))
    own, cost = counts / np.maximum(counts.sum(0), 1), np.log(p)
    mean = (own * cost).sum(0)
    spread = np.sqrt(np.maximum((own * cost**2).sum(0) - mean**2, 0))
    return langs, p.astype(np.float32), np.stack([mean, np.maximum(spread, 0.1)])


def infer(codes: np.ndarray, count: np.ndarray, first: np.ndarray, p: np.ndarray, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language, share, shares of all languages, fit) of documents whose distinct classes, with their counts, begin at `first`.

    Shares come from all languages at once; then the mixtures of the leading ones are fitted and compared, one more at a time until
    none gains. Three are always compared.
    """
    n = np.add.reduceat(count, first)
    every = np.diff(np.append(first, len(codes)))
    owner = np.repeat(np.arange(len(first)), every)
    likely = p[codes]
    share = np.full((len(first), p.shape[1]), 1 / p.shape[1], np.float32)
    for _ in range(_ROUNDS):
        r = likely * share[owner]
        r *= (count / r.sum(1))[:, None]
        share = np.add.reduceat(r, first, axis=0) / n[:, None]
    lead = np.argsort(-share, axis=1, kind="stable")
    best, score, lang, level = np.full(len(first), np.inf), np.zeros(len(first)), lead[:, 0].copy(), np.zeros(len(first))
    mix = np.zeros(share.shape)
    going = np.arange(len(first))
    for k in range(1, p.shape[1] + 1):
        on = np.zeros(len(first), bool)
        on[going] = True
        rows, sizes = np.flatnonzero(on[owner]), every[going]
        start, who, times = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(going)), sizes), count[rows]
        some = likely[rows[:, None], lead[going, :k][who]]
        own = np.full((len(going), k), 1 / k, np.float32)
        for _ in range(_ROUNDS if k > 1 else 0):
            r = some * own[who]
            r *= (times / r.sum(1))[:, None]
            own = np.add.reduceat(r, start, axis=0) / n[going][:, None]
        fit = np.add.reduceat(times * np.log((some * own[who]).sum(1)), start)
        cost = -2 * fit + (k - 1) * np.log(n[going])
        better = cost < best[going] - 1e-6
        got = going[better]
        best[got], level[got], score[got] = cost[better], fit[better] / n[got], own[better].max(1)
        # The leading language is the first; a later one may overtake it in a smaller set.
        lang[got] = lead[got, own[better].argmax(1)]
        mix[got] = 0
        mix[got[:, None], lead[got, :k]] = own[better]
        going = going[better | (k < 3)]
        if not len(going):
            break
    fit = (level - mix @ usual[0]) / (mix @ usual[1]) * n / (n + _FEW)
    return lang, np.clip(score, 0, 1), mix, fit


def _predict(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p, usual = model.value
        letter = letters()
        for batch in batches:
            pred, score, sets, shares, fits = [], [], [], [], []
            for _, texts in byte_texts(batch):
                own = [grams(t, letter) for t in texts]
                name, share, many, parts, fit = ["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts), [[]] * len(texts), [None] * len(texts)
                some = [i for i, g in enumerate(own) if len(g)]
                if some and langs:
                    key = np.concatenate([own[i] + (j << _BITS) for j, i in enumerate(some)])
                    key, count = np.unique(key, return_counts=True)
                    first = np.searchsorted(key >> _BITS, np.arange(len(some)))
                    which, much, mix, level = infer(key & ((1 << _BITS) - 1), count.astype(np.float32), first, p, usual)
                    for i, w, s, m, f in zip(some, which, much, mix, level, strict=True):
                        name[i], share[i], fit[i] = langs[w], float(s), float(f)
                        order = [x for x in np.argsort(-m, kind="stable") if m[x] > 0]
                        many[i], parts[i] = [langs[x] for x in order], m[order].tolist()
                pred += name
                score += share
                sets += many
                shares += parts
                fits += fit
            columns = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(fits, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents with the predicted language and its share, under the given names, which replace columns of these names.

    Three more columns have the first name with _set, _shares (both by falling share) and _fit after it.
    """
    names = [*names, *(f"{names[0]}_{x}" for x in ("set", "shares", "fit"))]
    docs = docs.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    model = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(model, names), f"{fields}, {names[0]} string, {names[1]} double, {names[2]} array<string>, {names[3]} array<double>, {names[4]} double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_pred_set", "lang_pred_shares", "lang_pred_fit")


SQL: dict[str, str] = {}
