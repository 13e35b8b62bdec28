"""Personal data: base patterns plus candidates judged by gradient-boosted trees.

Base spans are found by fixed patterns and checks and always stay.  High-recall generators
then propose further, overlapping spans: written-out e-mail addresses, addresses of four
numbers with spaced or bracketed dots, bare numbers in phone and card shapes.  Boosted trees
judge each candidate by its format and its context.  They learn from the corpus itself, on
the forms that are proposed: spans that pass a base check are positive, e-mails and ips in
written-out form, phones without their plus.  Negative are spans of a base pattern that fail
it (in the same forms), numbers without any shape, four numbers of a list, and prose in the
form of an e-mail: sentences around 'at', and words before an e-mail joined as one.  A third of the examples calibrates: per kind, the threshold is
the middle of the gap below the smallest score that still gives the wanted precision, so a kind without proof of it
adds nothing.  Overlapping additions are resolved by score.

Training uses the examples of all texts: quantiles, the sums of every level of the trees and the
calibration are counted on Spark and are of fixed size.  Every text is searched whole.  Trees see numbers about a candidate, never ids, language or source.

Defined cases: null or empty texts have no spans (the digest is that of the empty text);
rows may repeat; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import batches, discard, stored, strings, text_slices

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns: they must find exactly the contracted spans.  The e-mail pattern is
# anchored at its @ (the part before it cannot hold one), numbers at the start of a run,
# so that long runs of letters or digits cost linear time.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# generators of further candidates
_SPOKEN = re.compile(r"(?i)[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,64}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{1,64}){1,4}")
_SPOKEN_SIGN = re.compile(r"(?i)\(at\)|\[at\]| at [A-Za-z0-9-]{1,64} dot ")
_SPLIT_IP = re.compile(r"(?i)(?<![0-9.])[0-9]{1,3}(?:(?: ?\. ?| ?\[\.\] ?| ?\(\.\) ?| ?\(dot\) ?| ?\[dot\] ?| dot )[0-9]{1,3}){3}(?![0-9])")
_SENTENCE = re.compile(r"(?i)[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,64}\. [A-Za-z0-9-]{1,64}")
_LIST = re.compile(r"(?<![0-9])[0-9]{1,4}(?:[,;] ?[0-9]{1,4}){3}(?![0-9])")
_WORDS = re.compile(r"[A-Za-z]{2,64}")
# forms of @ and dot in which base spans are written out for training
_AT_FORMS = (" (at) ", " [at] ", " at ", "(at)", "[at]")
_DOT_FORMS = (" dot ", " (dot) ", " [dot] ", ".", "(dot)", "[dot]")
_IP_FORMS = (" . ", "[.]", "(.)", " dot ", ". ", "[dot]")
_ENDS = frozenset("com org net edu gov mil int info io co de fr es it nl eu uk us ca ch at be pl pt se br mx ar jp cn in au ru example test invalid".split())  # fixed list
_NUMBER = re.compile(r"\(?[0-9][0-9 ().-]{5,30}[0-9]")
# words of contact that may stand before a span, in the corpus' usual languages (fixed list)
_CUES = re.compile(r"(?i)(call|phone|tel|fax|mobile|mail|contact|card|visa|account|credit|llam|tarjeta|correo|appel|carte|courriel|anruf|telefon|karte)\w{0,8}\W{0,3}$")
_OTHER = re.compile(r"(?i)(version|isbn|issn|order|invoice|no|nr|id|token|key|hash|serial|page|chapter|section)\W{0,3}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in s.split(".")))


def base_matches(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, passes the check) of every base pattern match, by start then kind."""
    out, last = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            at = m.start()
            lo = at
            while lo > last and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at:
                out.append((lo, m.end(), "email", True))
                last = m.end()
    for m in _IP.finditer(text):
        out.append((m.start(), m.end(), "ip", _octets(m.group())))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m.group())
            if 12 <= len(d):
                out.append((m.start(), m.end(), "card", len(d) <= 19 and luhn(d)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            out.append((m.start(), m.end(), "phone", 9 <= len(_digits(m.group())) <= 15))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def proposals(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Further candidates that overlap no base span; they may overlap each other."""
    out = []
    if _SPOKEN_SIGN.search(text):
        out += [(m.start(), m.end(), "email") for m in _SPOKEN.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in _SPLIT_IP.finditer(text) if not _IP.fullmatch(m.group())]
    for m in _NUMBER.finditer(text):
        n = len(_digits(m.group()))
        if 9 <= n <= 15:
            out.append((m.start(), m.end(), "phone"))
        if 12 <= n <= 19:
            out.append((m.start(), m.end(), "card"))
    if not taken:
        return out
    starts = [lo for lo, _ in taken]
    ends = np.maximum.accumulate([hi for _, hi in taken])
    at = np.searchsorted(starts, [hi for _, hi, _ in out]) - 1
    return [c for c, i in zip(out, at) if i < 0 or ends[i] <= c[0]]


def features(text: str, lo: int, hi: int, kind: str) -> list[float]:
    """Format and context of a candidate as numbers; nothing says whether a base check passed but its ingredients."""
    s, before, after = text[lo:hi], text[max(0, lo - 24):lo], text[hi:hi + 2]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    near = text[max(0, lo - 16):lo] + text[hi:hi + 16]
    return [
        float(KINDS.index(kind)), len(s), len(d), float(luhn(d)) if kind == "card" and d else -1.0, len(groups), max(map(len, groups), default=0),
        min(map(len, groups), default=0), s.count(" "), s.count("-"), s.count("."), float("(" in s and ")" in s),
        len(set(d)), float(len(d) - len(d.lstrip("0"))), float(bool(_CUES.search(before))), float(bool(_OTHER.search(before))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€£#=\"'"), float(after[:1] in "%\"'€$"),
        sum(c.isdigit() for c in near), float(lo == 0 or before[-1:] == "\n"),
        float(max((int(g[:4]) for g in groups), default=0) > 255), float(d[:1] in ("3", "4", "5", "6")),
        float(kind == "email" and bool(re.search(r"(?i)[(\[](?:at|dot)[)\]]", s))), float(kind == "email" and ". " in s), float(kind == "email" and s.replace(")", " ").replace("]", " ").replace(".", " ").split()[-1].lower() in _ENDS),
        float(kind == "ip" and re.search(r"[(\[]", s) is not None), float(kind == "ip" and ". " in s and " ." not in s),
    ]


class Trees:
    """Gradient-boosted regression trees of fixed depth on quantile bins, with logistic loss."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.start, self.parts = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
        g = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-g))
            slope, curve = y - p, p * (1 - p) + 1e-6
            node, splits = np.zeros(len(y), int), []
            for _ in range(self.depth):
                level = {}
                for k in np.unique(node):
                    mine = node == k
                    best = (1e-9, None)
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        a = np.bincount(code[mine, j], weights=slope[mine], minlength=len(e) + 1).cumsum()
                        b = np.bincount(code[mine, j], weights=curve[mine], minlength=len(e) + 1).cumsum()
                        n = np.bincount(code[mine, j], minlength=len(e) + 1).cumsum()
                        gain = a[:-1] ** 2 / (b[:-1] + 1) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + 1) - a[-1] ** 2 / (b[-1] + 1)
                        gain[(n[:-1] < self.least) | (n[-1] - n[:-1] < self.least)] = 0
                        if gain.max() > best[0]:
                            best = (gain.max(), (j, int(gain.argmax())))
                    level[int(k)] = best[1]
                splits.append({k: (s[0], float(edges[s[0]][s[1]])) for k, s in level.items() if s})
                right = np.zeros(len(y), int)
                for k, s in level.items():
                    if s:
                        right[(node == k) & (code[:, s[0]] > s[1])] = 1
                node = 2 * node + right
            total, weight = np.bincount(node, slope, 2 ** self.depth), np.bincount(node, curve, 2 ** self.depth)
            leaf = self.rate * total / (weight + 1)
            g += leaf[node]
            self.parts.append((splits, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        g = np.full(len(x), self.start)
        for splits, leaf in self.parts:
            g += leaf[self.nodes(splits, x)]
        return 1 / (1 + np.exp(-g))

    @staticmethod
    def nodes(splits: list[dict], x: np.ndarray) -> np.ndarray:
        """The node of each row after the levels of ``splits``."""
        node = np.zeros(len(x), int)
        for level in splits:
            right = np.zeros(len(x), int)
            for k, (j, edge) in level.items():
                right[(node == k) & (x[:, j] > edge)] = 1
            node = 2 * node + right
        return node


def training_spans(text: str):
    """(text, start, end, kind, label) of the examples in a text, in the forms in which they are proposed."""

    def recast(lo: int, hi: int, new: str):
        before = text[max(0, lo - 24):lo]
        return before + new + text[hi:hi + 24], len(before), len(before) + len(new)

    found = base_matches(text)
    for lo, hi, kind, ok in found:
        span, turn = text[lo:hi], zlib.crc32(text[lo:hi].encode("utf-8", "replace"))
        if kind == "email":
            name, host = span.split("@")
            sign, dot = _AT_FORMS[turn % len(_AT_FORMS)], _DOT_FORMS[turn // 8 % len(_DOT_FORMS)]
            for new, label in ((name + sign + host.replace(".", dot), 1), *_prose(text[max(0, lo - 80):lo], sign, dot)):
                if _SPOKEN.fullmatch(new):
                    yield *recast(lo, hi, new), kind, label
        elif kind == "ip":
            new = span.replace(".", _IP_FORMS[turn % len(_IP_FORMS)])
            if _SPLIT_IP.fullmatch(new):
                yield *recast(lo, hi, new), kind, int(ok)
        elif kind == "phone":
            if 9 <= len(_digits(span)) <= 15 and _NUMBER.fullmatch(span[1:]):
                yield *recast(lo, hi, span[1:]), kind, int(ok)
        else:
            yield text, lo, hi, kind, int(ok)
    for lo, hi, kind in proposals(text, [(lo, hi) for lo, hi, *_ in found]):
        if kind == "phone" and text[lo:hi].isdigit():  # a run of digits of no shape
            yield text, lo, hi, kind, 0
    for m in _SENTENCE.finditer(text):
        yield text, m.start(), m.end(), "email", 0
    for m in _LIST.finditer(text):
        new = re.sub("[,;] ?", _IP_FORMS[len(m.group()) % len(_IP_FORMS)], m.group())
        if _SPLIT_IP.fullmatch(new):
            yield *recast(m.start(), m.end(), new), "ip", 0


def _prose(before: str, sign: str, dot: str):
    """The last three words of a stretch of prose, written like an e-mail."""
    words = _WORDS.findall(before)[-3:]
    if len(words) == 3 and words[2].lower() not in _ENDS:
        yield words[0] + sign + words[1] + dot + words[2], 0


def _training_rows(it):
    kinds = pa.schema([("kind", pa.int32()), ("label", pa.int32()), ("fold", pa.int32()), ("x", pa.list_(pa.float64()))])

    def out():
        for b in it:
            for text in strings(b.column(0)):
                for t, lo, hi, kind, label in training_spans(text):
                    near = t[max(0, lo - 24):hi + 24]
                    yield KINDS.index(kind), label, zlib.crc32(near.encode("utf-8", "replace")) % 3, features(t, lo, hi, kind)

    yield from batches(out(), kinds, 4096)


def _table(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of a batch of examples (label, n, x)."""
    return b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1), b.column(0).to_numpy(), b.column(1).to_numpy().astype(float)


_SCALE = float(1 << 20)  # sums of whole numbers do not depend on the order of rows
_LONGEST = 1000.0  # features are told apart up to here


def _edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of every feature over all examples: the values are counts, so a table of values is small and exact."""
    value = F.least(F.col("v"), F.lit(_LONGEST))
    seen = rows.select("n", F.posexplode("x").alias("j", "v")).groupBy("j", value.alias("v")).agg(F.sum("n").alias("n")).orderBy("j", "v").toPandas()
    out = []
    for _, part in seen.groupby("j", sort=True):
        ends = part["n"].to_numpy().cumsum()
        at = np.linspace(0, 1, bins + 1)[1:-1] * (ends[-1] - 1)
        low, high = (part["v"].to_numpy()[np.searchsorted(ends, f(at), side="right")] for f in (np.floor, np.ceil))
        out.append(np.unique(low + (high - low) * (at - np.floor(at))))
    return out


def _sums(model: Trees, grown: list[dict], edges: list[np.ndarray]):
    """Slope, curve and number of the examples of a task by node, feature and bin, as one row."""
    bins, nodes = max(map(len, edges)) + 1, 2 ** len(grown)

    def run(it):
        total = np.zeros((nodes, len(edges), bins, 3))
        for b in it:
            if not len(b):
                continue
            x, y, n = _table(b)
            p = model.predict(x)
            parts = [np.rint((y - p) * _SCALE) * n, np.rint((p * (1 - p) + 1e-6) * _SCALE) * n, n]
            node = model.nodes(grown, x)
            for j, e in enumerate(edges):
                at = node * bins + np.searchsorted(e, x[:, j])
                for i, w in enumerate(parts):
                    total[:, j, :, i] += np.bincount(at, w, nodes * bins).reshape(nodes, bins)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def boosted(rows: DataFrame, trees: int = 40, bins: int = 32) -> Trees:
    """Trees over all ``rows`` (label, n, x): each level is a sum of fixed size over the table, whatever its length."""
    model, edges = Trees(trees, bins=bins), _edges(rows, bins)
    whole = rows.agg(F.sum(F.col("n") * F.col("label")), F.sum("n")).first()
    share = min(max(whole[0] / whole[1], 1e-3), 1 - 1e-3)
    model.start = float(np.log(share / (1 - share)))
    shape = (len(edges), max(map(len, edges)) + 1, 3)
    for _ in range(trees):
        grown: list[dict] = []
        for _ in range(model.depth):
            nodes = 2 ** len(grown)
            total = np.zeros((nodes, *shape))
            for r in rows.select("label", "n", "x").mapInArrow(_sums(model, grown, edges), "sums binary").toLocalIterator():
                total += np.frombuffer(r["sums"]).reshape(total.shape)
            total[..., :2] /= _SCALE
            level, leaves = {}, np.zeros((2 * nodes, 2))
            for k in range(nodes):
                best = (1e-9, None)
                for j, e in enumerate(edges):
                    a, b, n = total[k, j].cumsum(axis=0).T
                    gain = a[:-1] ** 2 / (b[:-1] + 1) + (a[-1] - a[:-1]) ** 2 / (b[-1] - b[:-1] + 1) - a[-1] ** 2 / (b[-1] + 1)
                    gain[(n[:-1] < model.least) | (n[-1] - n[:-1] < model.least)] = 0
                    if len(e) and gain[:len(e)].max() > best[0]:
                        best = (gain[:len(e)].max(), (j, int(gain[:len(e)].argmax())))
                here = total[k, 0].sum(axis=0)[:2]
                leaves[2 * k] = here
                if best[1]:
                    j, cut = best[1]
                    level[k] = (j, float(edges[j][cut]))
                    leaves[2 * k] = total[k, j, :cut + 1].sum(axis=0)[:2]
                    leaves[2 * k + 1] = here - leaves[2 * k]
            grown.append(level)
        model.parts.append((grown, model.rate * leaves[:, 0] / (leaves[:, 1] + 1)))
    return model


_GRID = 1 << 14  # cells of the scores from 0 to 1


def _scored(model: Trees):
    kinds = pa.schema([("kind", pa.int32()), ("label", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())])

    def run(it):
        for b in it:
            if len(b):
                x, *_ = _table(b)
                cell = np.minimum(model.predict(x) * _GRID, _GRID - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), pa.array(cell), b.column(1)], schema=kinds)

    return run


def train(docs: DataFrame, precision: float = 0.98, proof: int = 30, text_col: str = "text") -> tuple[Trees | None, dict[str, float]]:
    """Trees and the threshold of each kind, from the examples of all texts.

    Two thirds of the examples, by a hash of their surroundings, teach the trees; the others calibrate.
    Equal examples are one row with their number.  A kind needs ``proof`` calibration candidates above
    its threshold, else it adds nothing.
    """
    spark = docs.sparkSession
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(_training_rows, "kind int, label int, fold int, x array<double>")
    rows = stored(found.groupBy("kind", "label", "fold", "x").agg(F.count(F.lit(1)).alias("n")), "examples")
    try:
        taught = rows.where("fold <> 0")
        if taught.agg(F.count_distinct("label")).first()[0] < 2:
            return None, {}
        model, cut = boosted(taught), {}
        tested = rows.where("fold = 0").select("label", "n", "x", "kind").mapInArrow(_scored(model), "kind int, label int, cell int, n long")
        per = tested.groupBy("kind", "cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("ok")).toPandas()
    finally:
        discard(spark, rows)
    for k, name in enumerate(KINDS):
        mine = per[per["kind"] == k].sort_values("cell", ascending=False)
        n, ok = mine["n"].to_numpy().cumsum(), mine["ok"].to_numpy().cumsum()
        if not len(n) or ok[-1] == n[-1]:
            continue  # no counter-examples, no proof
        good = np.flatnonzero((ok >= precision * n) & (n >= proof))
        if len(good):
            below = np.append(mine["cell"].to_numpy()[1:] + 1, 0)
            cut[name] = float(mine["cell"].to_numpy()[good[-1]] + below[good[-1]]) / 2 / _GRID  # any score of this gap has the same proof
    return model, cut


def spans_of(texts: list[str], model: Trees | None, cut: dict[str, float]) -> list[list[dict]]:
    """All spans of each text as (start, end, kind, base), by start then kind."""
    spans, asked, x = [], [], []
    for i, text in enumerate(texts):
        base = [(lo, hi, kind) for lo, hi, kind, ok in base_matches(text) if ok]
        spans.append([{"start": lo, "end": hi, "kind": kind, "base": True} for lo, hi, kind in base])
        if cut:
            for lo, hi, kind in proposals(text, [(lo, hi) for lo, hi, _ in base]):
                if kind in cut:
                    asked.append((i, lo, hi, kind))
                    x.append(features(text, lo, hi, kind))
    if x:
        p = model.predict(np.array(x))
        added: dict[int, list[tuple[int, int]]] = {}
        for j in np.lexsort((np.arange(len(p)), -p)):
            i, lo, hi, kind = asked[j]
            if p[j] >= cut[kind] and all(hi <= a or lo >= z for a, z in added.get(i, ())):
                added.setdefault(i, []).append((lo, hi))
                spans[i].append({"start": lo, "end": hi, "kind": kind, "base": False})
    for s in spans:
        s.sort(key=lambda r: (r["start"], KINDS.index(r["kind"])))
    return spans


def find(docs: DataFrame, model: Trees | None, cut: dict[str, float], keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", into: str = "found") -> DataFrame:
    """``keep`` columns with ``found`` (or the name in ``into``): every span as (start, end, kind, base), by start then kind."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])

    def run(it):
        for b in it:
            spans = [s for _, _, texts in text_slices(b.column(len(keep))) for s in spans_of(texts, model, cut)]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(spans, pa.list_(span))], [*keep, into])

    src = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in src.dtypes[:-1]) + f", {into} array<struct<start:int,end:int,kind:string,base:boolean>>")


def joined(spans) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the digest of base spans, and all spans as text."""
    base = F.filter("found", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at, merged = [], 0, []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    for lo, hi, kind in merged:
        out += [text[at:lo], f"<{kind}>"]
        at = hi
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Trees | None, cut: dict[str, float], text_col: str = "text") -> DataFrame:
    """``docs`` with its personal data replaced by kinds.

    Spans are found and replaced in one pass: two Python steps in a row would hold two workers per task.
    """
    where = docs.columns.index(text_col)

    def run(it):
        for b in it:
            parts = []
            for lo, hi, texts in text_slices(b.column(where)):
                new = [redacted(t, s) if s else t for t, s in zip(texts, spans_of(texts, model, cut))]
                parts.append(pc.if_else(pc.is_null(b.column(where).slice(lo, hi - lo)), pa.scalar(None, pa.string()), pa.array(new, pa.string())))
            column = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([column if i == where else c for i, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def pii(docs: DataFrame, **options) -> DataFrame:
    """Personal data of every text: doc_id, counts per kind, base_sha256, spans."""
    model, cut = train(docs, **options)
    return summary(find(docs, model, cut))
