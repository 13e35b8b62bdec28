"""Language and toxicity models: the forward algorithm against all segmentations, the risk estimator, held-out accuracy."""

import random
from collections import Counter

import numpy as np

from tallyloom.llm import language, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string, held_out int, lang_pred string"


def by_hand(word, pieces, prob):
    """Sum over every segmentation, and expected uses of each piece."""
    w = language.START + word
    ids = {}
    sp = pieces
    total, uses = 0.0, Counter()

    def walk(at, p, used):
        nonlocal total
        if at == len(w):
            total += p
            for u in used:
                uses[u] += p
            return
        for end in range(at + 1, len(w) + 1):
            i = lookup(w[at:end])
            if i >= 0:
                walk(end, p * prob[i], [*used, i])

    def lookup(s):
        if s not in ids:
            chars = np.array([[ord(c) for c in s]], np.uint64)
            ids[s] = int(sp.lattice(chars).get((0, len(s)), np.array([-1]))[0])
        return ids[s]

    walk(0, 1.0, [])
    return total, {u: n / total for u, n in uses.items()}


def test_forward_sums_all_segmentations():
    pieces = language.vocabulary(language.VOCABULARY)
    rng = np.random.default_rng(1)
    prob = rng.random(pieces.size) * 1e-2
    words = ["the", "theory", "naïve", "日本", "a", "x9!", "unbelievable"]
    got = language.log_scores(words, pieces, np.append(prob, 0.0)[:, None])[:, 0]
    for w, g in zip(words, got):
        total, uses = by_hand(w, pieces, prob)
        assert np.isclose(np.log(total), g)
        e = language.expected([w], np.array([2.0]), pieces, np.append(prob, 0.0))
        assert np.allclose([e[u] for u in uses], [2 * n for n in uses.values()]) and np.isclose(e.sum(), 2 * sum(uses.values()))


def test_long_words_do_not_underflow():
    pieces = language.vocabulary(language.VOCABULARY)
    prob = np.append(np.full(pieces.size, 1.0 / pieces.size), 0.0)[:, None]
    long, short = language.log_scores(["ab" * 5000, "ab" * 50], pieces, prob)[:, 0]
    assert np.isfinite(long) and 90 < long / short < 110


def test_long_rare_words_leave_the_model_finite(spark):
    pieces = language.vocabulary(language.VOCABULARY)
    rare = np.full(pieces.size, 1e-9)
    rare[0] = 1e-9
    got = language.expected(["語" * 63 + "qz" * 400, "ab"], np.array([2.0, 1.0]), pieces, np.append(rare / rare.sum(), 0.0))
    assert np.isfinite(got).all() and got.sum() > 400
    rng = random.Random(2)
    rows = [(i, made_up(rng, ["ba", "bo", "bi"] if i % 2 else ["sta", "ste", "sti"], 30), "xb" if i % 2 else "xs", None, None, 0, None) for i in range(60)]
    rows.append((1000, "語漢字假名混交文章" * 9, "xb", None, None, 0, None))
    model, _ = language.train(spark.createDataFrame(rows, DOCS))
    assert all(np.isfinite(v).all() and v.min() > 0 and abs(v.sum() - 1) < 1e-9 for v in model.values())


def made_up(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_of_a_small_corpus(spark):
    rng = random.Random(1)
    kinds = {"xx": ["tha", "ing", "wor"], "yy": ["öß", "schu", "gen"]}
    rows = [(i, made_up(rng, kinds[k], rng.choice([3, 40])), k, "s", "a", 1, "b") for i, k in enumerate(["xx", "yy"] * 60)]
    rows += [(500, None, "xx", "s", "", 0, ""), (501, "", "xx", "s", "", 0, ""), (502, "123 !!", None, "s", "", 0, ""), (None, made_up(rng, kinds["xx"], 30), None, None, "", 0, "")]
    rows += [(503, "thaing" * 4000, None, "s", "", 0, "")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0
    wrong = sum(got[i].lang_pred != k for i, _, k, *_ in rows[:120])
    assert wrong <= 2 and got[None].lang_pred == "xx" and got[503].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(spark.createDataFrame([], DOCS)).count() == 0
    unknown = spark.createDataFrame([(1, "some text", None, "s", "", 0, "")], DOCS)
    assert language.identify(unknown).first().lang_pred == "und"


def test_risk_separates_positives_hidden_among_unlabelled():
    rng = np.random.default_rng(0)
    rows, positive, truth = [], [], []
    for i in range(600):
        toxic = i < 200 or rng.random() < 0.2
        rows.append(np.unique(np.concatenate([rng.integers(5, 60, 8), rng.choice(5, 2) if toxic else []]).astype(np.int64)))
        positive.append(i < 200)
        truth.append(toxic)
    w = toxicity.fit(rows, np.array(positive), 60, 0.2)
    s = np.array([w[r].sum() + w[-1] for r in rows])
    truth = np.array(truth)
    assert (s[truth][:, None] > s[~truth][None, :]).mean() > 0.99
    hidden = truth & ~np.array(positive)
    assert (s[hidden] > -0.85).mean() > 0.9 and (s[~truth] > -0.85).mean() < 0.1


LABELS = "doc_id long, toxic int, score double"


def test_toxicity_of_a_small_corpus(spark):
    rng = random.Random(3)
    plain = ["tree", "house", "water", "green", "walk", "morning", "letter", "stone"]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(plain) + rng.choice("abc") for _ in range(30)]
        if i % 5 == 0:
            words[3] = words[17] = "vile" + rng.choice("abcdefgh")
            words[9] = "awful"
        rows.append((i, " ".join(words), "xx", "s", "", 0, ""))
        labels.append((i, int(i % 5 == 0), 0.0))
    rows += [(900, None, None, None, "", 0, ""), (901, "", "xx", "s", "", 0, ""), (902, "walk " * 50_000, "xx", "s", "", 0, "")]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(got) == len(rows) and got[900].score == got[901].score
    held = [got[i] for i in range(300) if got[i].held_out]
    assert held and all(r.predicted == int(r.score >= 0.3) == int(r.doc_id % 5 == 0) for r in held)
    none = toxicity.toxicity(spark.createDataFrame(rows[:3], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert all(r.predicted == 0 for r in none)
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
