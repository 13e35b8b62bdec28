"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.session import shared_folder


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """Write a step once and go on from the table, so that a lost executor costs no more than its tasks."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a stored step that nothing reads any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def id_crc(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def text_slices(column: pa.Array, rows: int = 256, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of an Arrow column, so many rows and about so many bytes at a time; one longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(column):
        before = int(ends[lo - 1]) if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield lo, hi, strings(column.slice(lo, hi - lo))
        lo = hi


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session hand Python at most ``rows`` rows at a time; whole texts in batches of ten thousand fill executors."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048, weigh=None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pack row tuples into Arrow batches of at most ``size`` rows, or about ``most`` weight if rows are weighed."""
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += weigh(r) if weigh else 0
        if len(held) >= size or weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (public splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, where each text's words start, and the words' byte bounds.

    A-Z are lower-cased; words are runs of anything but space and the characters 9 to 13.
    Returns (hashes, starts with the total as last entry, (first byte, end byte) per word in the joined texts).
    """
    parts = [t.encode().lower() for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    gap = _GAP[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    heads = np.cumsum([0, *[len(p) + 1 for p in parts]])
    starts = np.searchsorted(lo, heads)
    if not len(lo):
        return np.zeros(0, np.uint64), starts, np.stack([lo, hi])
    size = hi - lo
    inside = np.flatnonzero(~gap)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    power = np.full(int(size.max()), _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    summed = np.add.reduceat(_TABLE[buf[inside]] * power[place], np.cumsum(size) - size)
    return mix64(summed + size.astype(np.uint64)), starts, np.stack([lo, hi])


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable, for every id on an edge (a, b); edges are contracted until none is left."""
    spark = edges.sparkSession
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = stored(e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        near = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("up")), "near")
        # look further up twice, so that chains shrink to a quarter
        second, third = near.toDF("up", "u2"), near.toDF("u2", "u3")
        up = stored(near.join(second, "up").join(third, "u2").select("x", F.col("u3").alias("up")), "up")
        new = stored(labels.join(up, labels["comp"] == up["x"], "left").select("id", F.coalesce("up", "comp").alias("comp")), "labels")
        ua, ub = up.toDF("a", "ua"), up.toDF("b", "ub")
        rest = stored(e.join(ua, "a").join(ub, "b").where("ua <> ub").select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b")).distinct(), "edges")
        for old in (labels, e, near, up):
            discard(spark, old)
        labels, e = new, rest
    return labels


def hot_keys(df: DataFrame, key: str, rows: int, share: int = 1000) -> DataFrame:
    """Keys that hold more than 1/``share`` of ``rows`` rows; there are fewer than ``share`` of them, whatever the table."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * share > rows).select(key)


def join_spread(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join with a table of unique keys: rows of hot keys (``hot_keys``) stay where they are, the others shuffle."""
    few = F.broadcast(hot)
    stay = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key)
    return stay.unionByName(left.join(few, key, "left_anti").join(right, key))
