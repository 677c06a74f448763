"""Quality and language: held-out accuracy, and texts of every kind."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from compare import SF
from speechframe.llm import langid, quality
from speechframe.llm.queries import QUERIES

ODD = [(1, None), (2, ""), (3, "123 !!! ½"), (4, "the and of " * 20_000), (None, "the of"), (4, "the and of " * 20_000)]


def test_language_held_out(spark):
    got = QUERIES["op5_language"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(truth, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_edges(spark, docs):
    train = spark.createDataFrame([("the and of with that", "en"), ("le la les des une", "fr"), (None, "en"), ("x", None)], "text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs(ODD), langid.fit(train, min_count=1)).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en", None: "en"}
    none = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(docs(ODD), none).collect()} == {"und"}
    assert langid.predict(docs([]), none).count() == 0


def test_backoff_takes_the_longest_gram():
    rows = lambda *x: np.array(x, float)
    s = langid.Scorer(langid.Model(["a", "b"], pa.array(["known"]), rows([-1, -2]), pa.array(["ab", "a", "b", "c"]), rows([-3, -1], [-9, -9], [-9, -9], [-1, -5])))
    assert s.vector("known").tolist() == [-1, -2] and s.vector("abc").tolist() == [-4, -6] and s.vector("zz").tolist() == [0, 0]


def test_sampled_fit_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.fit(docs, sample_rows=50)
    assert len(m.languages) >= 3 and len(m.words) < 4 * 15_000


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality"](spark, sf)
    held = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in held)


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, label int")
    train = docs([(k, "clean words here" if k % 2 else "j*** u### n%%%") for k in range(60)])
    m = quality.fit(train, labels)
    got = quality.score(docs([*ODD, (9, "clean words"), (10, "n%%% u###")]), m)
    by = {r.doc_id: r.score for r in got.collect()}
    assert by[9] > 0.5 > by[10] and all(0 <= x <= 1 for x in by.values()) and by[1] == by[2]
    assert quality.score(docs([(1, "a")]), quality.fit(train, labels.limit(0))).first().score == 0.5
    assert quality.score(docs([(1, "a")]), quality.fit(train, labels.withColumn("label", F.lit(1)))).first().score > 0.99
    assert quality.score(docs([]), m).count() == 0


@pytest.mark.parametrize("text", [None, "", "a", "ab", "é", "a a a a a a a a a a"])
def test_features_leave_the_flags_clear(text):
    flags = np.zeros(quality.SIZE, bool)
    f = quality.features(text, flags)
    assert not flags.any() and (np.diff(f) > 0).all()


def test_rare_languages_stay_in_the_sample(spark):
    rows = [(f"the and of with that n{'abcdefghij'[k % 10]}{k}", "en") for k in range(3000)] + [("le la les des une", "fr"), ("der die und das", "de")]
    m = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample_rows=100, min_count=1)
    assert m.languages == ["de", "en", "fr"] and {"der", "une", "with"} <= set(m.words.to_pylist())
    assert langid.even_shares({"a": 10**6, "b": 3, "c": 10**5}, 103) == {"b": 3, "c": 50, "a": 50}


def test_no_word_is_lost_at_ties(spark):
    words = [f"w{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "klm"]
    m = langid.fit(spark.createDataFrame([(" ".join(words * 2), "en"), ("le la " * 3, "fr")], "text string, lang string"))
    assert set(m.words.to_pylist()) == {*words, "le", "la"}


def brute_language(train, texts):
    """The method in plain Python: counts, frequencies, backoff and score, one text at a time."""
    words, grams = {}, {}
    for text, lang in train:
        if text is not None and lang is not None:
            words.setdefault(lang, Counter()).update(w for w in regex.split(r"[^\p{L}]+", text.lower()) if w)
    languages = sorted(words)
    for lang in languages:
        c = grams[lang] = Counter()
        for w, n in words[lang].items():
            p = f" {w} "
            for k in range(1, langid.ORDER + 1):
                for i in range(len(p) - k + 1):
                    c[p[i : i + k]] += n
    kept = lambda c: {w: n for w, n in c.items() if n >= langid.MIN_COUNT}
    known = {x: (kept(words[x]), kept(grams[x])) for x in languages}
    total = {x: sum(words[x].values()) for x in languages}
    long = {x: Counter() for x in languages}
    for x in languages:
        for g, n in known[x][1].items():
            long[x][len(g)] += n
    word = lambda w, x: math.log(0.5 + known[x][0].get(w, 0)) - math.log(total[x] + 1)
    gram = lambda g, x: math.log(0.5 + known[x][1].get(g, 0)) - math.log(long[x][len(g)] + 1)
    out = []
    for text in texts:
        found = regex.findall(r"\p{L}+", (text or "").lower())
        if not found or not languages:
            out.append(("und", 0.0))
            continue
        sums = dict.fromkeys(languages, 0.0)
        for w in found:
            if any(w in known[x][0] for x in languages):
                for x in languages:
                    sums[x] += word(w, x)
                continue
            p, at = f" {w} ", 0
            while at < len(p):
                g = next((p[at : at + k] for k in range(min(langid.ORDER, len(p) - at), 0, -1) if any(p[at : at + k] in known[x][1] for x in languages)), None)
                if g:
                    for x in languages:
                        sums[x] += gram(g, x)
                at += len(g) if g else 1
        best = max(languages, key=lambda x: sums[x])
        out.append((best, 1 / sum(math.exp((sums[x] - sums[best]) / math.sqrt(len(found))) for x in languages)))
    return out


def test_language_like_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    truth = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    want = dict(zip([i for i, _, _ in rows], brute_language([(t, x) for i, t, x in rows if not truth[i]], [t for _, t, _ in rows])))
    got = {r.doc_id: r for r in QUERIES["op5_language"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (lang, score) in want.items():
        assert (got[i].lang_pred, got[i].held_out) == (lang, truth[i]) and abs(got[i].score - score) < 1e-3


def test_features_like_brute_force():
    text = "the the cat the cat é 123"
    b, want = text.encode(), set()
    for n in range(1, 5):
        for i in range(len(b) - n + 1):
            g = int.from_bytes(b[i : i + n], "little") * quality.MULTIPLY[n - 1] % 2**32
            want.add((g ^ g >> 15) * quality.MULTIPLY[-n] % 2**32 >> 32 - quality.BITS)
    got = quality.features(text, np.zeros(quality.SIZE, bool))
    assert {int(x) for x in got if x < 1 << quality.BITS} == want
    assert [int(x) - (1 << quality.BITS) for x in got if x >= 1 << quality.BITS] == [0, len(quality.RUNS), len(quality.RUNS) + 1]  # one word in seven repeats the one before


def test_ratios_and_descent_like_a_slow_solver():
    """Log-count ratios by plain counting; the optimum of the same dual by projected gradients on the dense matrix."""
    rng = np.random.default_rng(1)
    y = np.where(np.arange(60) % 3 == 0, 1.0, -1.0)
    rows = [np.unique(np.concatenate([rng.integers(0, 40, 12), rng.integers(40, 60, 6) if t > 0 else rng.integers(50, 70, 6)])) for t in y]
    r = quality.ratios(rows, y)
    count = {t: Counter(int(f) for x, z in zip(rows, y) if z == t for f in x) for t in (1.0, -1.0)}
    total = {t: sum(count[t].values()) + quality.ALPHA * quality.SIZE for t in count}
    for f in range(80):
        assert abs(r[f] - (math.log((count[1.0][f] + quality.ALPHA) / total[1.0]) - math.log((count[-1.0][f] + quality.ALPHA) / total[-1.0]))) < 1e-9
    x = np.zeros((60, 71))
    for i, f in enumerate(rows):
        x[i, f] = r[f] / np.linalg.norm(r[f])
    x[:, 70] = 1
    cost = np.where(y > 0, 60 / (2 * 20), 60 / (2 * 40)) * quality.C
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, cost)
    best = alpha.sum() - alpha @ q @ alpha / 2
    w, bias = quality.dual_descent(rows, y, r, epochs=3000)
    v = np.concatenate([w[:70], [bias]])
    primal = v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert not w[80:].any() and -1e-6 < primal - best < 0.01 * best


def test_quality_clashing_columns_and_repeated_labels(spark):
    rows = [(k, "clean words here" if k % 2 else "j*** u### n%%%", "x", -1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(k, 0) for k in range(60)], "doc_id long, label int")
    got = quality.score(docs, quality.fit(docs, labels))
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) and 0 <= r.score <= 1 for r in got.collect())


def test_letters_beside_other_numerals(spark):
    """One class of letters in fitting and scoring: numerals that aren't decimal digits part words, and a text with any letter has a language."""
    assert langid.words_of("m² a½ H₂O Ⅷ x٣y 5 m² é́ _z_") == ["m", "a", "h", "o", "x", "y", "m", "é", "z"]
    rows = spark.createDataFrame([("m² the and of", "en")] * 3 + [("der die H₂O und", "de")] * 3, "text string, lang string")
    model = langid.fit(rows)
    assert {"m", "h", "o", "the"} <= set(model.words.to_pylist())
    texts = ["m²", "5 m²", "a½", "H₂", "42", "½ ² Ⅷ", "́̂", "_", "", None]
    got = {r.text: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    assert {t for t, (lang, _) in got.items() if lang == "und"} == {"42", "½ ² Ⅷ", "́̂", "_", "", None}
    assert all(v == ("und", 0.0) for v in got.values() if v[0] == "und") and got["m²"][0] == "en" and got["H₂"][0] == "de"


def test_quality_scores_like_a_slow_solver(spark, docs):
    """Whole scores, from texts to probabilities: ratios by counting, the optimum of the dual by projected gradients on the dense matrix, the logistic fit by small gradient steps."""
    rng = np.random.default_rng(3)
    good, bad = [f"fine{k}" for k in range(30)], [f"junk{k}" for k in range(30)]
    texts = [" ".join(rng.choice((good if k % 3 else bad) + ["the", "of", "and", "even"] * 6, 12)) for k in range(80)]
    label = [int(k % 3 > 0) if k % 13 else int(k % 3 == 0) for k in range(80)]
    flags = np.zeros(quality.SIZE, bool)
    found = sorted(zip(range(80), [quality.features(t, flags) for t in texts], label), key=lambda x: (x[0], len(x[1]), x[2]))
    used = np.unique(np.concatenate([f for _, f, _ in found]))
    hot = np.array([np.isin(used, f) for _, f, _ in found], float)
    y = np.array([1.0 if t else -1.0 for *_, t in found])
    apart = np.arange(80) % 5 == 4
    counts = {t: hot[~apart & (y == t)].sum(0) + quality.ALPHA for t in (1, -1)}
    total = {t: counts[t].sum() + quality.ALPHA * (quality.SIZE - len(used)) for t in (1, -1)}
    r = np.log(counts[1] / total[1]) - np.log(counts[-1] / total[-1])
    x = hot * r / np.sqrt(((hot * r) ** 2).sum(1, keepdims=True) + 1e-12)
    x1, t = np.c_[x, np.ones(80)][~apart], y[~apart]
    cost = np.where(t > 0, len(t) / (2 * (t > 0).sum()), len(t) / (2 * (t < 0).sum())) * quality.C
    gram, alpha = (x1 * t[:, None]) @ (x1 * t[:, None]).T, np.zeros(len(t))
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    margin = np.c_[x, np.ones(80)] @ ((alpha * t) @ x1)
    m, u = margin[apart], (y[apart] > 0).astype(float)
    u = np.where(u > 0, (u.sum() + 1) / (u.sum() + 2), 1 / ((1 - u).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200_000):
        p = 1 / (1 + np.exp(-(a * m + b)))
        a, b = a - 0.05 * (((p - u) * m).sum() + 1e-3 * (a - 1)), b - 0.05 * (p - u).sum()
    want = 1 / (1 + np.exp(-(a * margin + b)))
    model = quality.fit(docs(list(enumerate(texts))), spark.createDataFrame(list(enumerate(label)), "doc_id long, label int"))
    got = {r_.doc_id: r_ for r_ in quality.score(docs(list(enumerate(texts))), model).collect()}
    assert max(abs(got[k].score - want[k]) for k in range(80)) < 0.03
    assert all(got[k].predicted == int(got[k].score >= 0.3) for k in range(80)) and want.min() < 0.3 < want.max()
