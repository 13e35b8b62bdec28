"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else in the training rows counts as
unlabelled, labels hidden.  With class prior p, the risk of a classifier g is

    p E_pos[l(g, +1)]  +  max(0, E_unl[l(g, -1)] - p E_pos[l(g, -1)])

with the logistic loss; where the second term falls below zero its gradient is turned
round, so that the model cannot profit from fitting unlabelled positives as negatives.

Features are words and word beginnings, at levels of how often a text has them.  They are counted over the
sampled positives and unlabelled texts by Spark; the ones most typical of the positives
are kept.  Several classifiers, each on its own share of the sample, are trained in
parallel tasks and averaged.  ``positives`` and ``unlabelled`` bound the sample (chosen by
id hash); every text is scored whole.

Defined cases: a null text is empty and scores like one; without any positive all scores
are 0; rows may repeat; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import batches, id_crc, stored, strings

_WORD = re.compile(r"[^\W_]+")
_STARTS = (4, 5, 6)
_LEVELS = ((1, ""), (2, "+2"), (4, "+4"))


def word_features(word: str) -> list[str]:
    """The word and its beginnings; a beginning is marked so that it differs from a word."""
    return [word, *[word[:k] + "*" for k in _STARTS if len(word) >= k]]


def text_features(text: str) -> set[str]:
    """Words and beginnings of a text, each also with the repeat levels it reaches."""
    uses: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        for f in word_features(w):
            uses[f] += n
    return {f + mark for f, n in uses.items() for least, mark in _LEVELS if n >= least}


def _count_features(it):
    kinds = pa.schema([("feature", pa.string()), ("pos", pa.int64()), ("unl", pa.int64())])
    for b in it:
        seen = Counter(), Counter()
        for positive, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
            seen[0 if positive else 1].update(text_features(text))
        yield from batches(((f, seen[0][f], seen[1][f]) for f in seen[0].keys() | seen[1].keys()), kinds, 65536)


def _chosen(index: dict[str, int]):
    """text -> numbers of its chosen features, with a bounded memory of words already met."""
    levels: dict[str, list[tuple[int, int]]] = {}
    for f, i in index.items():
        for least, mark in _LEVELS:
            if f.endswith(mark) and (mark or "+" not in f):
                levels.setdefault(f.removesuffix(mark), []).append((least, i))
    memo: dict[str, tuple] = {}

    def of(text: str) -> list[int]:
        uses: dict[str, int] = {}
        for w, n in Counter(_WORD.findall(text.lower())).items():
            got = memo.get(w)
            if got is None:
                if len(memo) > 300_000:
                    memo.clear()
                got = memo[w] = tuple(f for f in word_features(w) if f in levels)
            for f in got:
                uses[f] = uses.get(f, 0) + n
        return sorted(i for f, n in uses.items() for least, i in levels[f] if n >= least)

    return of


def fit(rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float, rounds: int = 1500, rate: float = 0.05, ridge: float = 1e-5) -> np.ndarray:
    """Weights and bias (last) of one linear classifier under the non-negative risk, by full-batch Adam."""
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    for t in range(1, rounds + 1):
        g = np.bincount(doc, weights=w[col], minlength=len(rows)) + w[size]
        s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        down = np.logaddexp(0, g)  # loss of calling a text clean
        rest = down[~positive].mean() - prior * down[positive].mean()
        slope = np.zeros(len(rows))
        part = np.where(positive, -prior * s / n_pos, s / max(1, n_unl))  # gradient of the corrected negative risk
        if rest >= 0:
            slope = part + np.where(positive, prior * (s - 1) / n_pos, 0)
        else:
            slope = -part
        grad = np.append(np.bincount(col, weights=slope[doc], minlength=size), slope.sum()) + ridge * np.append(w[:size], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def train(docs: DataFrame, toxic: DataFrame, positives: int = 6000, unlabelled: int = 10_000, features: int = 4096, bags: int = 3,
          prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, int], np.ndarray]:
    """(feature numbers, averaged weights with bias last) from training texts and their labels.

    ``prior`` is the share of toxic texts; unless given it is their share among labelled rows.
    """
    known = toxic.groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    ids = docs.select(id_col).distinct().join(known, id_col, "left")
    sizes = ids.agg(F.count(F.lit(1)).alias("n"), F.count("_toxic").alias("labelled"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("pos")).first()
    n_pos = int(sizes["pos"])
    if not n_pos:
        return {}, np.array([-50.0])
    if prior is None:
        prior = min(0.9, max(1e-4, n_pos / sizes["labelled"]))
    h = F.pmod(F.xxhash64(id_col), F.lit(1 << 20))
    cut = lambda most, n: int((1 << 20) * min(1.0, most / max(1, n)))
    # a positive stands in the first sample; the unlabelled one draws from all texts
    picked = ids.select(F.col(id_col).alias("_id"), F.explode(F.filter(F.array(
        F.when((F.col("_toxic") == 1) & (h < cut(positives, n_pos)), F.lit(True)),
        F.when(F.pmod(F.xxhash64(id_col, F.lit("u")), F.lit(1 << 20)) < cut(unlabelled, sizes["n"]), F.lit(False))), lambda x: x.isNotNull())).alias("positive"))
    sample = stored(docs.join(picked, docs[id_col] == F.col("_id")).select(
        "positive", F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, F.lit("bag")), F.lit(bags)).alias("bag")), "sample")
    counts = sample.select("positive", "text").mapInArrow(_count_features, "feature string, pos long, unl long").groupBy("feature").agg(
        F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    totals = sample.groupBy("positive").count().collect()
    p_all = sum(r["count"] for r in totals if r["positive"]) or 1
    u_all = sum(r["count"] for r in totals if not r["positive"]) or 1
    p, u = F.col("pos") / F.lit(float(p_all)), (F.col("unl") + 1.0) / F.lit(float(u_all))
    # clearly more frequent among positives than chance lets a feature of the unlabelled texts be
    surplus = (F.col("pos") - u * p_all) / F.sqrt(u * p_all)
    best = counts.where(F.col("pos") >= max(3, p_all // 1000)).where((p > 1.5 * u) & (surplus >= 5)).orderBy(F.desc(p * F.log(p / u)), "feature").limit(features).collect()
    index = {r["feature"]: i for i, r in enumerate(best)}

    def vectors(it):
        of = _chosen(index)
        for b in it:
            yield from batches(((bag, positive, of(text)) for positive, text, bag in zip(b.column(0).to_pylist(), strings(b.column(1)), b.column(2).to_pylist())),
                               pa.schema([("bag", pa.int64()), ("positive", pa.bool_()), ("ids", pa.list_(pa.int32()))]))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        positive = part["positive"].to_numpy(bool)
        if not positive.any():
            return pd.DataFrame({"w": []})
        return pd.DataFrame({"w": [fit(list(part["ids"]), positive, len(index), prior)]})

    got = sample.mapInArrow(vectors, "bag long, positive boolean, ids array<int>").groupBy("bag").applyInPandas(one, "w array<double>").collect()
    return index, np.mean([r["w"] for r in got], axis=0)


def score(docs: DataFrame, index: dict[str, int], weights: np.ndarray, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns with score and predicted; the text is the only input."""

    def run(it):
        of = _chosen(index)
        for b in it:
            g = np.array([weights[f].sum() if (f := of(t)) else 0.0 for t in strings(b.column(len(keep)))]) + weights[-1]
            s = 1 / (1 + np.exp(-np.clip(g, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    src = docs.select(*keep, F.col(text_col).cast("string"))
    return src.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in src.dtypes[:-1]) + ", score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores of all texts, learned from rows whose id's crc32 modulo 4 is not 2: doc_id, held_out, score, predicted."""
    index, weights = train(docs.where(id_crc("doc_id", 4) != 2), labels.where(id_crc("doc_id", 4) != 2), **options)
    held = docs.select("doc_id", (id_crc("doc_id", 4) == 2).alias("held_out"), "text")
    return score(held, index, weights, keep=("doc_id", "held_out"))
