"""Document statistics, histogram trees, and held-out accuracy."""

import math
import random

import numpy as np

from tallyloom.llm import quality
from tallyloom.llm.common import read

DOC = "doc_id long, text string, lang string, source string, score double, y double"
LABEL = "doc_id long, quality int, toxic int, text string"


def test_flat_arrays_equal_walks_down_the_trees():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(600, 5)), 1)  # ties between values and edges
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    f = quality.grow(x, y, trees=20, leaves=6)

    def walk(row):
        total = f.start
        for node in f.root:
            while f.left[node] != node:
                node = f.left[node] if row[f.feature[node]] <= f.threshold[node] else f.right[node]
            total += f.value[node]
        return total

    assert np.allclose(f.raw(x, block=7), [walk(r) for r in x])
    assert ((f.predict(x) >= 0.5) == y).mean() > 0.97
    assert (f.left != np.arange(len(f.left))).sum() <= 20 * 5  # at most six leaves a tree


def test_first_split_is_the_best_of_all_thresholds():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 12, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float)
    f = quality.grow(x, y, trees=1, leaves=2, least=10)
    p = y.mean()
    s, c = y - p, np.full(200, p * (1 - p))
    best = max((s[a].sum() ** 2 / (c[a].sum() + 1) + s[~a].sum() ** 2 / (c[~a].sum() + 1), -j, -t)
               for j in range(3) for t in range(12) if 10 <= (a := x[:, j] <= t).sum() <= 190)
    assert (f.feature[0], f.threshold[0]) == (-best[1], -best[2])


def test_statistics_are_finite_for_any_text():
    for t in ("", " ", "\n", "a", "!" * 500, "é\u0000퟿", "|" * 9 + "\n" * 9, "word " * 100_000):
        got = quality.statistics(t)
        assert len(got) == len(quality.NAMES) and all(map(math.isfinite, got))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.quality(read(spark, folder, "documents"), read(spark, folder, "labels"))
    rows = got.join(read(spark, folder, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 80 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert got.count() == read(spark, folder, "documents").count()


def test_edge_cases(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["ab", "cd", "ef"], k=30)) + ("!!" * 9 if i % 4 == 0 else "."), "en", "s", 0.0, 1.0) for i in range(200)]
    docs += [(7, docs[7][1], "en", "s", 0.0, 1.0)] * 50 + [(900, None, None, None, None, None), (901, "", "", "", 0.0, 0.0), (None, "x", "en", "s", 0.0, 0.0), (902, "word " * 200_000, "en", "s", 0.0, 0.0)]
    labels = [(i, int(i % 4 != 0), 0, "t") for i in range(200)] + [(1, 0, 0, ""), (3, None, 0, ""), (None, 1, 0, "")]
    df, lab = spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(labels, LABEL)
    got = quality.quality(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].score == by_id[901].score
    assert sum(by_id[i].predicted == (i % 4 != 0) for i in range(200)) > 190
    assert {r.score for r in quality.quality(df, lab.limit(0)).collect()} == {0.5}
    assert quality.quality(df.limit(0), lab).count() == 0
    assert min(r.score for r in quality.quality(df, lab.where("quality = 1")).collect()) > 0.999


def test_training_needs_held_out_rows_for_nothing(spark):
    """Labels of held-out rows do not matter."""
    docs = [(i, ("good text. " if i % 2 else "BAD!! ") * (3 + i % 5), "en", "s", 0.0, 0.0) for i in range(120)]
    df = spark.createDataFrame(docs, DOC)
    lab = spark.createDataFrame([(i, i % 2, 0, "") for i in range(120)], LABEL)
    a = quality.quality(df, lab)
    flipped = lab.join(a.select("doc_id", "held_out"), "doc_id").selectExpr("doc_id", "if(held_out, 1 - quality, quality) quality", "toxic", "text")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, quality.quality(df, flipped).collect()))
