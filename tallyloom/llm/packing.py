"""Best-fit packing of tokenised documents with large-item matching.

The plan depends on lengths only, of which there are at most ``capacity``: a histogram of
lengths goes to the driver, never a document.  Pieces over a third of the capacity are
large: at most two share a sequence, each paired with the longest large piece that fits.
Smaller lengths, longest first, go where they leave the smallest gap.  A step of the plan
places a whole run of equal lengths in a run of equal gaps, so the plan is as short as
the histogram is.  Pieces then find their place by their rank among those of equal length;
ranks are counted per hash chunk of a length, so a length that a third of all pieces
share is not one task's work.

Defined cases: a null text is empty and holds only the end token; documents may repeat
(each row is packed); an empty table packs to nothing; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window as W, functions as F
from tokenizers import Tokenizer

from tallyloom.llm.common import batches, stored, strings

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 0


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            table[chr(256 + n)] = b
            n += 1
    return table


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids (unsigned 32 bit) of the tokenizer file.

    The vocabulary is run by the faster of the two public engines for byte-level BPE; a
    text that holds one of the file's added tokens goes to the engine of the file itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    added = [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in added):
            return np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return encode


def _pieces(path: str, capacity: int, with_ids: bool):
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        kinds.append(("ids", pa.list_(pa.int64())))

    def run(it):
        encode = encoder(path)

        def out():
            for b in it:
                for doc_id, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                    ids = np.append(encode(text), np.uint32(END)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    at = 0
                    for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                        part = ids[at:end]
                        row = (doc_id, piece, at, end - at, zlib.crc32(part.tobytes()))
                        yield (*row, part.astype(np.int64)) if with_ids else row
                        at = end

        yield from batches(out(), pa.schema(kinds), 4096)

    return run


def tokenise(docs: DataFrame, path: str = TOKENIZER, capacity: int = 2048, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pieces(path, capacity, with_ids), schema)


class _Gaps:
    """Runs of sequences by the room left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.runs: dict[int, list[list[int]]] = {}
        self.sizes: list[int] = []

    def open(self, n: int) -> None:
        self.put(self.capacity, self.made, n)
        self.made += n

    def put(self, gap: int, first: int, n: int) -> None:
        if gap not in self.runs:
            self.runs[gap] = []
            insort(self.sizes, gap)
        self.runs[gap].append([first, n])

    def take(self, gap: int, most: int) -> tuple[int, int]:
        """A run of at most ``most`` sequences with this gap."""
        run = self.runs[gap][-1]
        first, n = run[0], min(run[1], most)
        run[0] += n
        run[1] -= n
        if not run[1]:
            self.runs[gap].pop()
            if not self.runs[gap]:
                del self.runs[gap]
                self.sizes.remove(gap)
        return first, n

    def smallest(self, length: int) -> int | None:
        i = bisect_left(self.sizes, length)
        return self.sizes[i] if i < len(self.sizes) else None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, ranks, first sequence, offset): rank r of a length goes to sequence first + r - first rank."""
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    gaps, steps = _Gaps(capacity), []

    def place(length: int, first: int, n: int, gap: int) -> None:
        steps.append((length, used[length], n, first, capacity - gap))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    for k in reversed(large):
        while left[k]:
            i = bisect_left(large, capacity - k + 1) - 1
            while i >= 0 and not (left[large[i]] > (large[i] == k)):
                i -= 1
            mate = large[i] if i >= 0 else None
            n = left[k] if mate is None else left[k] // 2 if mate == k else min(left[k], left[mate])
            first = gaps.made
            gaps.made += n
            place(k, first, n, capacity)
            if mate is not None:
                place(mate, first, n, capacity - k)
            gaps.put(capacity - k - (mate or 0), first, n)
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[k]:
            gap = gaps.smallest(k)
            if gap is None:
                gap = capacity
                gaps.open(max(1, left[k] // (capacity // k)))
            each = gap // k
            first, n = gaps.take(gap, max(1, left[k] // each))
            each = min(each, left[k])
            for j in range(each):
                place(k, first, n, gap - j * k)
            gaps.put(gap - each * k, first, n)
    return steps


def _placer(steps: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(steps), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) | table[:, 1]

    def run(it):
        for b in it:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            kept = [i for i, n in enumerate(b.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in kept] + [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
                [b.schema.names[i] for i in kept] + ["sequence_id", "offset"])

    return run


def ranked(pieces: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    """Add ``_rank``, the place (from 0) of a piece among those of equal length."""
    n = pieces.count()
    chunks = 16 + n // chunk_rows
    src = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    per = src.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = per.select("length", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    return src.withColumn("_row", F.row_number().over(inside) - 1).join(starts, ["length", "_chunk"]).select(
        *pieces.columns, (F.col("_start") + F.col("_row")).cast("long").alias("_rank"))


def pack(docs: DataFrame, capacity: int = 2048, path: str = TOKENIZER, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their sequence and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked)."""
    pieces = stored(tokenise(docs, path, capacity, with_ids, id_col, text_col), "pieces")
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked(pieces).mapInArrow(_placer(plan(counts, capacity)), schema)
