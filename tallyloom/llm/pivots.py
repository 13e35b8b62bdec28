"""Product codes of vectors, with nearest entries found by fixed pivots (LAESA).

Components become integers floor(scale * x) and vectors are cut into equal parts, each
part position with its own codebook.  A few pivots per position are chosen once, as far
apart as possible among the first entries, and stay for all rounds.  The distance of
every part to its pivots is computed once and written beside the part.  In a round only
the distances of pivots to the current entries are new, and

    |d(part, pivot) - d(entry, pivot)|  <=  d(part, entry)

bounds the distance from below for each entry.  Entries are tried in the order of their
bounds with exact integer arithmetic, and an entry whose bound lies above the best
distance found is never tried.  Equal distances go to the lower index.

Rounds run map-side: tasks send sums and counts per entry, a table of fixed size.  What
passes the driver is codebooks and pivots only.

Defined cases: vectors that are null or empty, or hold null or non-finite components,
take no part, nor do vectors that cannot be cut (their length is no multiple of the number
of parts) or have not the length of the vector of smallest id; of repeated ids the
smallest vector starts the codebook, all rows are coded; rows without id are coded but
start no codebook unless no row has an id (then nothing is coded); components beyond 2**25
stand there; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import join_spread, stored

_MOST = 1 << 25
_SLICE = 2048


def integers(flat: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(scale * flat.astype(np.float64)), -_MOST, _MOST).astype(np.int64)


def choose_pivots(entries: np.ndarray, pivots: int) -> np.ndarray:
    """Entries far from each other: the one farthest from the mean, then each farthest from those chosen."""
    x = entries.astype(np.float64)
    gap = np.square(x - x.mean(axis=0)).sum(axis=1)
    chosen = [int(gap.argmax())]
    gap = np.square(x - x[chosen[0]]).sum(axis=1)
    while len(chosen) < min(pivots, len(x)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, np.square(x - x[chosen[-1]]).sum(axis=1))
    return entries[chosen]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, one column per pivot."""
    return np.sqrt(np.square(x[:, None, :] - pivots[None]).sum(axis=2).astype(np.float64))


def nearest(x: np.ndarray, near: np.ndarray, book: np.ndarray, reach: np.ndarray, tries: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of each row, and how many exact distances that took.

    ``near`` holds the rows' distances to the pivots, ``reach`` the entries'.  The first
    ``tries`` entries of each row go one by one in the order of their bounds; what is then
    left below the best distance is evaluated together.
    """
    # stored distances are single precision: the slack covers their rounding
    bound = np.zeros((len(x), len(book)))
    for p in range(near.shape[1]):
        d, r = near[:, p, None], reach[None, :, p]
        np.maximum(bound, np.abs(d - r) - 2e-7 * (d + r), out=bound)
    rows = np.arange(len(x))
    best, where = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(book))
    root, done, live = np.full(len(x), np.inf), 0, rows
    for _ in range(min(tries, len(book))):
        if not len(live):
            return where, best, done
        j = bound[live].argmin(axis=1)
        d = np.square(x[live] - book[j]).sum(axis=1)
        done += len(live)
        bound[live, j] = np.inf
        better = (d < best[live]) | ((d == best[live]) & (j < where[live]))
        best[live[better]], where[live[better]] = d[better], j[better]
        root[live] = np.sqrt(best[live].astype(np.float64)) * (1 + 1e-12)
        live = live[bound[live].min(axis=1) <= root[live]]
    if len(live):
        at, j = np.nonzero(bound[live] <= root[live][:, None])
        d = np.square(x[live[at]] - book[j]).sum(axis=1)
        done += len(d)
        order = np.lexsort((j, d, at))
        first = order[np.searchsorted(at[order], np.arange(len(live)))]
        d, j = d[first], j[first]
        better = (d < best[live]) | ((d == best[live]) & (j < where[live]))
        best[live[better]], where[live[better]] = d[better], j[better]
    return where, best, done


def _prepare(kept: DataFrame, pivots: np.ndarray, scale: float) -> DataFrame:
    """vec_id, label, integer components and distances to the pivots, both as bytes."""
    parts, _, d = pivots.shape

    def run(it):
        for b in it:
            x = integers(b.column(2).flatten().to_numpy(zero_copy_only=False), scale).reshape(b.num_rows, parts, d)
            comps, near = [], []
            for at in range(0, b.num_rows, _SLICE):
                block = x[at:at + _SLICE]
                far = np.stack([pivot_distances(block[:, p], pivots[p]) for p in range(parts)], axis=1).astype("<f4")
                comps += [r.tobytes() for r in block.astype("<i4")]
                near += [r.tobytes() for r in far]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(comps, pa.binary()), pa.array(near, pa.binary())], ["vec_id", "label", "x", "near"])

    kind = dict(kept.dtypes)["label"]
    return stored(kept.select("vec_id", "label", "vec").mapInArrow(run, f"vec_id long, label {kind}, x binary, near binary"), "parts")


def _blocks(b, parts: int, d: int, pivots: int):
    for at in range(0, b.num_rows, _SLICE):
        cut = b.slice(at, _SLICE)
        x = np.frombuffer(b"".join(cut.column("x").to_pylist()), "<i4").reshape(-1, parts, d).astype(np.int64)
        yield x, np.frombuffer(b"".join(cut.column("near").to_pylist()), "<f4").reshape(-1, parts, pivots).astype(np.float64)


def _reach(book: np.ndarray, pivots: np.ndarray) -> list[np.ndarray]:
    return [pivot_distances(book[p], pivots[p]) for p in range(len(book))]


def _round(table: DataFrame, book: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The next codebook: every entry the floored mean of its parts."""
    parts, entries, d = book.shape
    reach = _reach(book, pivots)

    def run(it):
        sums = np.zeros((parts, entries, d + 1), np.int64)  # the last position counts
        for b in it:
            for x, near in _blocks(b, parts, d, pivots.shape[1]):
                for p in range(parts):
                    at, _, _ = nearest(x[:, p], near[:, p], book[p], reach[p])
                    np.add.at(sums[p], at, np.concatenate([x[:, p], np.ones((len(x), 1), np.int64)], axis=1))
        flat = sums.ravel()
        slots = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(flat[slots], pa.int64())], ["slot", "v"])

    got = table.select("x", "near").mapInArrow(run, "slot int, v long").groupBy("slot").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(parts * entries * (d + 1), np.int64)
    flat[[r["slot"] for r in got]] = [r["v"] for r in got]
    sums = flat.reshape(parts, entries, d + 1)
    n = sums[:, :, d:]
    return np.where(n > 0, np.floor_divide(sums[:, :, :d], np.maximum(n, 1)), book)


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, pivots: int = 4,
        id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """The written parts, the codebooks (part, entry, position) and the pivots; None if no vector can be coded."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), x.cast("array<double>").alias("vec"))
    first = kept.where("vec_id is not null").groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy("vec_id").limit(entries).collect()
    if not first:
        return None
    dim = len(first[0]["vec"])
    start = np.array([r["vec"] for r in first if len(r["vec"]) == dim])
    book = integers(start, scale).reshape(len(start), parts, dim // parts).transpose(1, 0, 2)
    fixed = np.stack([choose_pivots(b, pivots) for b in book])
    table = _prepare(kept.where(F.size("vec") == dim), fixed, scale)
    for _ in range(rounds):
        book = _round(table, book, fixed)
    return table, book, fixed


def encode(table: DataFrame, book: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits per part) and error of every written vector."""
    parts, entries, d = book.shape
    if entries > 256:
        raise ValueError("a code has two hex digits per part, so at most 256 entries")
    reach = _reach(book, pivots)

    def run(it):
        for b in it:
            codes, errors = [], []
            for x, near in _blocks(b, parts, d, pivots.shape[1]):
                at, gap = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for p in range(parts):
                    j, dist, _ = nearest(x[:, p], near[:, p], book[p], reach[p])
                    at[:, p] = j
                    gap += dist
                codes += [r.tobytes().hex() for r in at]
                errors += gap.tolist()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                                             ["vec_id", "label", "code", "error"])

    return table.mapInArrow(run, f"vec_id long, label {dict(table.dtypes)['label']}, code string, error long")


def decode(codes: DataFrame, book: np.ndarray) -> DataFrame:
    """``codes`` with the vector of entries that each code stands for, as ``approx``."""
    parts, _, d = book.shape
    lists = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in p]) for p in book])
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approx", F.flatten(F.array(*[lists[p][index(p)] for p in range(parts)])))


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, **options) -> DataFrame:
    """Codes of all vectors: vec_id, code, error, label_error (the label's summed error), codebooks_sha256."""
    got = fit(vectors, **options)
    if got is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    table, book, fixed = got
    # in a struct, null is a key like any other
    coded = stored(encode(table, book, fixed), "codes").withColumn("label", F.struct("label"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    hot = sums.where(F.col("n") * 1000 > coded.count()).select("label")  # fewer than a thousand
    return join_spread(coded, sums.drop("n"), "label", hot).select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
