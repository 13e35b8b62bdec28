"""Quality scores from document statistics by histogram gradient-boosted trees.

Each whole text becomes some thirty numbers: lengths, shares of character classes, of
repeated words, triples and lines, and the shape of lines and sentences.  Features are cut into at
most 255 quantile bins; trees grow best leaf first on histograms of gradients per bin,
where the larger child's histogram is the parent's less the smaller child's.  The forest is
flattened into arrays (feature, threshold, children, value), all trees at once; leaves are
their own children, so that scoring is a fixed number of vectorised steps over rows x trees.

Labels come from a hash sample of at most ``sample`` labelled rows.  Their ids are chosen
from the label table alone and broadcast (their number is bounded), so that no text is
shuffled; the trees are fitted in one task that sees the sample's numbers only.

Defined cases: a null text is empty and scored like one; of repeated labels the largest
holds; repeated training rows count each, within the bound; without labels of both kinds
all scores are the share of label 1, or 0.5 without any label; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import id_crc, strings

_KIND = np.full(256, 9, np.uint8)  # control characters
for _i, _chars in enumerate((b" \t\n\r\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:'\"-?", b"!", b"#$%&*|", b"<>{}[]()/\\=_+~^@`")):
    _KIND[list(_chars)] = _i
_KIND[128:] = 8
_ENDS = (".", "!", "?", ":", '"', "'", ")")
_BULLETS = ("-", "*", "•", "|", "#", ">")
NAMES = ("chars", "words", "word_length", "word_spread", "longest_word", "distinct_words", "top_word", "same_as_last", "repeated_triples", "one_letter",
         "spaces", "lower", "upper", "digits", "points", "shouts", "symbols", "marks", "beyond_ascii", "controls",
         "entropy", "capital_words", "shouted_words", "marked_words", "lines", "line_length", "distinct_lines", "top_line", "ended_lines", "bullet_lines", "sentence_words")


def statistics(text: str) -> list[float]:
    """The numbers of one text, in the order of ``NAMES``."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size = max(1, len(raw))
    per_byte = np.bincount(raw, minlength=256)
    kind = np.bincount(_KIND, weights=per_byte, minlength=10) / size
    p = per_byte[per_byte > 0] / size
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    uses = Counter(words)
    low = [w.strip(".,;:!?").lower() for w in words]
    triples = set(zip(low, low[1:], low[2:]))
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    m = max(1, len(lines))
    same = Counter(lines)
    ends = sum(text.count(c) for c in ".!?")
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), np.log1p(int(lengths.max())),
        len(uses) / n, max(uses.values(), default=0) / n, sum(map(str.__eq__, low, low[1:])) / n,
        1 - len(triples) / max(1, len(low) - 2) if len(low) > 2 else 0.0, float((lengths == 1).sum()) / n,
        *kind.tolist(), float(-(p * np.log2(p)).sum()) + 0.0,
        sum(w[:1].isupper() for w in words) / n, sum(w.isupper() for w in words) / n, sum(w[-1] in "!#$%&*|" for w in words) / n,
        np.log1p(len(lines)), np.log1p(len(text) / m), len(same) / m, max(same.values(), default=0) / m,
        sum(s.endswith(_ENDS) for s in lines) / m, sum(s.startswith(_BULLETS) for s in lines) / m, np.log1p(len(words) / max(1, ends)),
    ]


class Forest:
    """Boosted trees in flat arrays; ``root`` holds the first node of each tree."""

    def __init__(self, start: float = 0.0):
        self.start, self.depth = start, 0
        self.root = np.zeros(0, np.int32)
        self.feature, self.left, self.right = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.threshold, self.value = np.zeros(0), np.zeros(0)

    def raw(self, x: np.ndarray, block: int = 1024) -> np.ndarray:
        out = np.full(len(x), self.start)
        if not len(self.root):
            return out
        for at in range(0, len(x), block):
            rows = x[at:at + block]
            line = np.arange(len(rows))[:, None]
            node = np.tile(self.root, (len(rows), 1))
            for _ in range(self.depth):
                node = np.where(rows[line, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at:at + block] += self.value[node].sum(axis=1)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -700, 700)))


def _best_split(hist: np.ndarray, width: np.ndarray, least: int, ridge: float) -> tuple[float, int, int]:
    """(gain, feature, last bin of the left side) of a histogram (feature, bin, [slope, curve, count])."""
    left = hist.cumsum(axis=1)
    whole = left[:, -1:]
    right = whole - left
    gain = left[..., 0] ** 2 / (left[..., 1] + ridge) + right[..., 0] ** 2 / (right[..., 1] + ridge) - whole[..., 0] ** 2 / (whole[..., 1] + ridge)
    barred = (left[..., 2] < least) | (right[..., 2] < least) | (np.arange(hist.shape[1]) >= width[:, None])
    gain = np.where(barred, -np.inf, gain)
    f, b = divmod(int(gain.argmax()), hist.shape[1])
    return float(gain[f, b]), f, b


def grow(x: np.ndarray, y: np.ndarray, trees: int = 150, leaves: int = 12, rate: float = 0.1, bins: int = 255, least: int = 15, ridge: float = 1.0) -> Forest:
    """Boosting with logistic loss; the trees grow leaf by leaf, always where the gain is largest."""
    n, k = x.shape
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    forest = Forest(float(np.log(share / (1 - share))))
    edges = []
    for j in range(k):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        edges.append(cuts[cuts < x[:, j].max()])
    width = np.array([len(e) for e in edges])
    stride = int(width.max(initial=0)) + 1
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = code + np.arange(k) * stride
    score = np.full(n, forest.start)
    feature, threshold, left, right, value, root = [], [], [], [], [], []

    def histogram(rows, slope, curve):
        at = flat[rows].ravel()
        sums = [np.bincount(at, np.repeat(v[rows], k), k * stride) for v in (slope, curve)] + [np.bincount(at, minlength=k * stride)]
        return np.stack(sums, axis=-1).reshape(k, stride, 3)

    def leaf(hist):
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        right.append(len(right))
        value.append(rate * hist[0, :, 0].sum() / (hist[0, :, 1].sum() + ridge))
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        hist = histogram(np.arange(n), slope, curve)
        node = leaf(hist)
        root.append(node)
        open_ = [(*_best_split(hist, width, least, ridge), node, np.arange(n), hist, 0)]
        closed = []
        while open_ and len(open_) + len(closed) < leaves:
            i = max(range(len(open_)), key=lambda i: open_[i][0])
            if not open_[i][0] > 1e-9:
                break
            _, f, b, at, rows, hist, deep = open_.pop(i)
            goes = code[rows, f] <= b
            small, large = (rows[goes], rows[~goes]) if goes.sum() <= len(rows) / 2 else (rows[~goes], rows[goes])
            part = histogram(small, slope, curve)
            other = hist - part
            h_left, h_right = (part, other) if goes.sum() <= len(rows) / 2 else (other, part)
            feature[at], threshold[at] = f, float(edges[f][b])
            left[at], right[at] = leaf(h_left), leaf(h_right)
            for node, mine, h in ((left[at], rows[goes], h_left), (right[at], rows[~goes], h_right)):
                (open_ if len(mine) >= 2 * least else closed).append((*_best_split(h, width, least, ridge), node, mine, h, deep + 1))
            forest.depth = max(forest.depth, deep + 1)
        for _, _, _, node, rows, _, _ in open_ + closed:
            score[rows] += value[node]
    forest.feature, forest.left, forest.right, forest.root = (np.array(v, np.int32) for v in (feature, left, right, root))
    forest.threshold, forest.value = np.array(threshold), np.array(value)
    return forest


_SHAPE = "start double, depth int, root array<int>, feature array<int>, left array<int>, right array<int>, threshold array<double>, value array<double>"


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> Forest:
    """The forest of the labelled rows among ``docs``."""
    spark = docs.sparkSession
    h = F.pmod(F.xxhash64(id_col, F.lit("quality")), F.lit(1 << 30))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) == 1).cast("double").alias("_y"))
    # the first ``sample`` ids in hash order; the second bound holds whatever the documents repeat
    chosen = spark.createDataFrame(known.orderBy(h, id_col).limit(sample).collect(), known.schema)
    plain = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def numbers(it):
        for b in it:
            got = [pa.array([statistics(t) for t in strings(b.slice(at, 128).column(2))], pa.list_(pa.float64())) for at in range(0, b.num_rows, 128)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.concat_arrays(got) if got else pa.array([], pa.list_(pa.float64()))], ["id", "y", "x"])

    id_kind = dict(plain.dtypes)[id_col]
    rows = plain.join(F.broadcast(chosen), id_col).select(id_col, "_y", "_text").mapInArrow(numbers, f"id {id_kind}, y double, x array<double>").orderBy(
        F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)), "id", "x").limit(sample).withColumn("all", F.lit(1))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(part["x"].tolist()), part["y"].to_numpy()
        f = grow(x, y, **options) if y.min() < y.max() else Forest(50.0 if y[0] else -50.0)
        return pd.DataFrame([{n: getattr(f, n) for n in ("start", "depth", "root", "feature", "left", "right", "threshold", "value")}])

    got = rows.groupBy("all").applyInPandas(fit, _SHAPE).first()
    forest = Forest(got["start"] if got else 0.0)
    if got:
        forest.depth = got["depth"]
        for n in ("root", "feature", "left", "right"):
            setattr(forest, n, np.array(got[n], np.int32))
        forest.threshold, forest.value = np.array(got["threshold"], float), np.array(got["value"], float)
    return forest


def score(docs: DataFrame, forest: Forest, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns with score and predicted; the text is the only input."""

    def run(it):
        for b in it:
            for at in range(0, b.num_rows, 128):
                cut = b.slice(at, 128)
                s = forest.predict(np.array([statistics(t) for t in strings(cut.column(len(keep)))]))
                yield pa.RecordBatch.from_arrays([*cut.columns[:len(keep)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    src = docs.select(*keep, F.col(text_col).cast("string"))
    return src.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in src.dtypes[:-1]) + ", score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores of all texts, learned from rows whose id's crc32 modulo 3 is not 1: doc_id, held_out, score, predicted."""
    forest = train(docs.where(id_crc("doc_id", 3) != 1), labels.where(id_crc("doc_id", 3) != 1), **options)
    return score(docs.select("doc_id", (id_crc("doc_id", 3) == 1).alias("held_out"), "text"), forest, keep=("doc_id", "held_out"))
