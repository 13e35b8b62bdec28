"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over six words that ignores at most one of them; its hash takes
the other five.  Seeds of all training positions meet the seeds of all benchmark
positions in a hash join, and each hit names a diagonal on which the two texts are
compared word by word.  The overlap reported for a document and an item is the longest
run on a diagonal with at least ``percent`` % equal words.  It counts from ``words`` words
on, or if that share of the whole item is there.

With 20 % of the words replaced, any overlap of 13 words or more has six words in a row
with at most one replaced, so one of the five masks hits it: nothing of that kind is
missed.  Items under five words have no seed and are not reported.

Training positions are screened by a bit table of fixed size built from the benchmark
before they are shuffled; the screen only saves work, the join decides.

Defined cases: null texts have no words; rows without doc_id or item_id are not reported;
repeated rows give one result per pair of ids; extra columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyloom.llm.common import batches, mix64, stored, text_slices, word_hashes

MASKS = ("11111", "101111", "110111", "111011", "111101")
_HIT = "id long, seed long, pos int"
_KINDS = pa.schema([("id", pa.int64()), ("seed", pa.int64()), ("pos", pa.int32())])


def seeds(h: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of every mask over the words of all texts; no seed crosses a text's end."""
    out = []
    for k, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        mult = mix64(np.arange(64 * k + 1, 64 * k + 1 + len(mask), dtype=np.uint64)) | np.uint64(1)
        s = np.full(n, np.uint64(k))
        for j, c in enumerate(mask):
            if c == "1":
                s += h[j:n + j] * mult[j]
        ok = np.ones(n, bool)
        for e in starts[1:-1].tolist():
            ok[max(0, e - len(mask) + 1):e] = False
        at = np.flatnonzero(ok)
        out.append((at, mix64(s[at])))
    return out


def _seed_rows(screen: np.ndarray | None, bits: int):
    def run(it):
        def out():
            for b in it:
                ids = b.column(0).to_pylist()
                for lo, _, texts in text_slices(b.column(1)):
                    h, starts, _ = word_hashes(texts)
                    for at, s in seeds(h, starts):
                        if screen is not None:
                            slot = s & np.uint64((1 << bits) - 1)
                            hit = (screen[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                            at, s = at[hit], s[hit]
                        doc = np.searchsorted(starts, at, side="right") - 1
                        pos = at - starts[doc]
                        yield from zip([ids[lo + d] for d in doc.tolist()], s.view(np.int64).tolist(), pos.tolist())

        yield from batches(out(), _KINDS, 65536)

    return run


def _tokens(it):
    for b in it:
        ids = b.column(0).to_pylist()
        slices = ((at, *word_hashes(texts)[:2]) for at, _, texts in text_slices(b.column(1)))
        rows = ((ids[at + i], h[lo:hi].tobytes()) for at, h, starts in slices for i, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())))
        yield from batches(rows, pa.schema([("item_id", pa.int64()), ("tokens", pa.binary())]))


def longest_run(equal: np.ndarray, percent: int) -> tuple[int, int]:
    """(start, length) of the longest stretch with at least ``percent`` % true that begins and ends with true."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    low = np.minimum.accumulate(sums[:-1][at])  # earliest start whose sum is low enough
    first = np.minimum(np.searchsorted(-low, -sums[at + 1]), np.arange(len(at)))
    sizes = np.where(low[first] <= sums[at + 1], at + 1 - at[first], 0)
    best = int(sizes.argmax())
    return int(at[first[best]]), int(sizes[best])


def _verify(percent: int, words: int):
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int32()), ("item_start", pa.int32()),
                       ("length", pa.int32()), ("matches", pa.int32())])

    def run(it):
        def out():
            for b in it:
                for doc_id, text, cases in zip(*(c.to_pylist() for c in b.columns)):
                    h, _, _ = word_hashes([text or ""])
                    for c in cases:
                        item = np.frombuffer(c["tokens"], np.uint64)
                        lo, hi = max(0, -c["diagonal"]), min(len(item), len(h) - c["diagonal"])
                        if hi <= lo:
                            continue
                        equal = item[lo:hi] == h[lo + c["diagonal"]:hi + c["diagonal"]]
                        at, n = longest_run(equal, percent)
                        if n >= min(words, len(item)) or 100 * int(equal.sum()) >= percent * len(item):
                            yield doc_id, c["item_id"], lo + at + c["diagonal"], lo + at, n, int(equal[at:at + n].sum())

        yield from batches(out(), kinds)

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, words: int = 13, percent: int = 80, bits: int = 26, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, doc_start, item_start, length, matches: the longest overlap of each pair, in words."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    test = stored(items.mapInArrow(_seed_rows(None, bits), _HIT).select(F.col("id").alias("item_id"), "seed", F.col("pos").alias("item_pos")).distinct(), "test")
    slot = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    lines = test.groupBy(F.shiftright(slot, 6).alias("line")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("set"))
    screen = np.zeros(1 << (bits - 6), np.uint64)
    for r in lines.collect():  # at most 2^(bits - 6) rows
        screen[r["line"]] = np.uint64(r["set"] & 0xFFFFFFFFFFFFFFFF)
    shared = docs.sparkSession.sparkContext.broadcast(screen)

    def train_seeds(it):
        yield from _seed_rows(shared.value, bits)(it)

    hits = texts.mapInArrow(train_seeds, _HIT).join(test, "seed").select(F.col("id").alias("doc_id"), "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    tokens = items.mapInArrow(_tokens, "item_id long, tokens binary").distinct()
    cases = stored(hits.join(tokens, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "tokens")).alias("cases")), "cases")
    found = texts.join(cases, "doc_id").select("doc_id", "text", "cases").mapInArrow(
        _verify(percent, words), "doc_id long, item_id long, doc_start int, item_start int, length int, matches int")
    best = W.partitionBy("doc_id", "item_id").orderBy(F.desc("length"), F.desc("matches"), "doc_start", "item_start")
    return found.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
