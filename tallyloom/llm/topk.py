"""Exact top-k inner-product search by columnar branch and bound.

Vectors lie in blocks in vertical layout (one row of the block per dimension).  For each
query the inner products grow dimension block by dimension block; what the remaining
dimensions can still add is at most the product of the two remaining norms
(Cauchy-Schwarz).  A candidate whose upper bound is below the k-th best lower bound is
dropped and the survivors are compacted, so later dimension blocks touch few columns.

Blocks meet by an equality join: candidate blocks are dealt to parts and query blocks are
sent to each part once.  No block is ever compared through the driver.

Defined cases: vectors that are null, hold null or non-finite components, or have no id
take no part; only vectors of equal length are compared; repeated candidate rows all
count; of repeated query ids the smallest vector is asked; a score beyond the range of
a long stands at its end; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyloom.llm.common import batches

_EXACT = float(1 << 52)
_BLOCK = "dim int, ids binary, data binary"
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, vec) with an id and finite components only."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("vec"))


def _quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * vectors)


def _pack(scale: float, rows: int):
    """Rows to blocks: ids and the vertical matrix of integer components, one block stream per length."""

    def flush(dim, ids, parts):
        m = _quantised(np.concatenate(parts).reshape(len(ids), dim), scale)
        return dim, np.asarray(ids, "<i8").tobytes(), np.ascontiguousarray(m.T.astype("<f4" if np.abs(m).max(initial=0) < 1 << 24 else "<f8")).tobytes()

    def run(it):
        def out():
            held: dict[int, tuple[list, list]] = {}
            for b in it:
                vec = b.column(1)
                flat, ends = vec.flatten().to_numpy(zero_copy_only=False), np.diff(vec.offsets.to_numpy())
                starts = np.concatenate([[0], np.cumsum(ends)])
                for i, (k, n) in enumerate(zip(b.column(0).to_pylist(), ends.tolist())):
                    ids, parts = held.setdefault(n, ([], []))
                    ids.append(k)
                    parts.append(flat[starts[i]:starts[i + 1]])
                    if len(ids) >= rows:
                        yield flush(n, ids, parts)
                        del held[n]
            for n, (ids, parts) in held.items():
                yield flush(n, ids, parts)

        yield from batches(out(), pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]), 4)

    return run


def _unpack(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, "<i8")
    kind = "<f4" if len(data) == 4 * dim * len(keys) else "<f8"
    return keys, np.frombuffer(data, kind).reshape(dim, len(keys)).astype(np.float64)


def _rest(m: np.ndarray, step: int) -> list[np.ndarray]:
    """Norms of the components from each block boundary on, rounded up."""
    return [np.sqrt(np.square(m[at:]).sum(axis=0)) * (1 + 1e-9) for at in range(0, m.shape[0] + step, step)]


def branch_and_bound(q: np.ndarray, own: int, floor: float, ids: np.ndarray, m: np.ndarray, q_rest: list[float], rest: list[np.ndarray],
                     k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of one block for one query: (ids, scores); ``floor`` is a proven lower bound of the k-th best score."""
    alive = np.flatnonzero(ids != own)
    acc = np.zeros(len(alive))
    dense = True
    for b, at in enumerate(range(0, m.shape[0], step), start=1):
        rows = m[at:at + step]
        acc += (q[at:at + step] @ rows)[alive] if dense else q[at:at + step] @ rows[:, alive]
        if b >= len(rest) - 1:
            break
        slack = q_rest[b] * rest[b][alive] + 1e-6
        least = floor
        if len(alive) > k:
            least = max(least, np.partition(acc - slack, len(alive) - k)[len(alive) - k])
        keep = acc + slack >= least
        if not keep.all():
            alive, acc = alive[keep], acc[keep]
        dense = 2 * len(alive) > len(ids)
    keep = acc >= floor
    alive, acc = alive[keep], acc[keep]
    if len(alive) > k:
        cut = np.partition(acc, len(alive) - k)[len(alive) - k]
        alive, acc = alive[acc >= cut], acc[acc >= cut]
    order = np.lexsort((ids[alive], -acc))[:k]
    return ids[alive[order]], acc[order]


def _exact(q: np.ndarray, own: int, ids: np.ndarray, m: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Whole-number scores of components too large for exact doubles."""
    whole = [int(x) for x in q]
    scores = [(-sum(a * int(b) for a, b in zip(whole, col)), int(i)) for i, col in zip(ids, m.T) if i != own]
    return [(i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in sorted(scores)[:k]]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, scale: float = 1024.0, step: int = 8, block: int = 4096, query_block: int = 512,
          part_rows: int = 262_144, seeds: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best candidates of each query by integer inner product: query_id, rank, vec_id, score.

    ``seeds`` bounds a hash sample of candidates whose k-th best score gives each query a
    first lower bound; it only saves work, results never depend on it.
    """
    spark = vectors.sparkSession
    base = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
    n = base.count()
    every = max(1, n // max(1, seeds))
    sample = base.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).limit(2 * seeds).collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["vec"]) for r in sample}:
        rows = [r for r in sample if len(r["vec"]) == d]
        by_dim[d] = np.array([r["id"] for r in rows], dtype=np.int64), _quantised(np.array([r["vec"] for r in rows], dtype=float).reshape(len(rows), d), scale)
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-n // part_rows))

    def search(it):
        def hits():
            for b in it:
                for dim, qid, qdata, ids, data in zip(*(c.to_pylist() for c in b.columns)):
                    qk, qm = _unpack(dim, qid, qdata)
                    ck, cm = _unpack(dim, ids, data)
                    large = dim * np.abs(qm).max(initial=0) * np.abs(cm).max(initial=0) >= _EXACT
                    q_rest, rest = _rest(qm, step), _rest(cm, step)
                    s_ids, s_vec = by_dim.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                    first = s_vec @ qm if len(s_ids) and not large else None
                    for j, own in enumerate(qk.tolist()):
                        if large:
                            yield from ((own, i, s) for i, s in _exact(qm[:, j], own, ck, cm, k))
                            continue
                        floor = -np.inf
                        if first is not None:
                            got = first[s_ids != own, j]
                            if len(got) >= k:
                                floor = np.partition(got, len(got) - k)[len(got) - k]
                        found, score = branch_and_bound(np.ascontiguousarray(qm[:, j]), own, floor, ck, cm, [float(r[j]) for r in q_rest], rest, k, step)
                        yield from zip([own] * len(found), found.tolist(), score.astype(np.int64).tolist())

        yield from batches(hits(), _HITS, 8192)

    cand = base.mapInArrow(_pack(scale, block), _BLOCK).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
    ask = asked.mapInArrow(_pack(scale, query_block), _BLOCK).select(
        F.col("dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    met = ask.join(cand, ["dim", "part"]).select("dim", "q_ids", "q_data", "ids", "data")
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
