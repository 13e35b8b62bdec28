"""Live series: last values, append log, date buckets and running statistics.

State per series is small by construction: n last values and three totals.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def events_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


class LastN(StatefulProcessor):
    """The n newest rows of a series as list state, and its totals as value state."""

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "o double, v double", self.idle_ms)
        self.totals = handle.getValueState("totals", "lo double, hi double, c long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lo, hi, c = self.totals.get() if self.totals.exists() else (None, None, 0)
        kept = [tuple(map(_number, r)) for r in self.rows.get()] if self.rows.exists() else []
        rank = lambda r: (r[0] is not None, r[0] or 0.0)  # noqa: E731  a row without order is the oldest
        for pdf in rows:
            for o, v, a, z, m in zip(pdf["os"], pdf["vs"], pdf["lo"], pdf["hi"], pdf["c"]):
                kept = heapq.nlargest(self.n, kept + [(_number(x), _number(y)) for x, y in zip(o, v)], key=rank)
                lo = min((x for x in (lo, _number(a)) if x is not None), default=None)
                hi = max((x for x in (hi, _number(z)) if x is not None), default=None)
                c += int(m)
        kept.sort(key=rank)
        self.rows.put(kept)
        self.totals.update((lo, hi, c))
        yield pd.DataFrame({"series": [key[0]], "absent": [key[1]], "values": [[v for _, v in kept]], "newest": pd.array([kept[-1][1]], "Float64"),
                            "all_min": pd.array([lo], "Float64"), "all_max": pd.array([hi], "Float64"), "total": [c]})

    def close(self) -> None:
        pass


def stream_lastn(stream: DataFrame, key: str, order: str, value: str, n: int, idle_ms: int | None = None) -> DataFrame:
    """Per series: its last n values in order, newest value, and all-time min, max, count.

    Each micro-batch is cut to the n newest rows per (series, part) before the state
    shuffle; totals are combined the same way, so a hot series sends little.  Rows without a
    key are a series too; rows without a value count and take a place (NaN is such a row), rows without an order
    are the oldest.  ``idle_ms`` forgets a series that has had no row for so long.  The state
    store is RocksDB, which this kind of state needs; the session is set to it.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = dict(stream.dtypes)[key]
    shape = "k string, absent boolean, os array<double>, vs array<double>, lo double, hi double, c long"

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (k, absent), g in pdf.groupby(["k", "absent"]):
                tail = g.sort_values("o", na_position="first").tail(n)
                yield pd.DataFrame({"k": [k], "absent": [absent], "os": [list(map(_number, tail["o"]))], "vs": [list(map(_number, tail["v"]))],
                                    "lo": pd.array([_number(g["v"].min())], "Float64"), "hi": pd.array([_number(g["v"].max())], "Float64"), "c": [len(g)]})

    src = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(key).isNull().alias("absent"),
                        F.col(order).cast("double").alias("o"), F.col(value).cast("double").alias("v"))
    out = src.mapInPandas(thin, shape).groupBy("k", "absent").transformWithStateInPandas(
        LastN(n, idle_ms), "series string, absent boolean, values array<double>, newest double, all_min double, all_max double, total long", "Update",
        "None" if idle_ms is None else "ProcessingTime")
    return out.select(F.when(~F.col("absent"), F.col("series").cast(kind)).alias("series"), "values", "newest", "all_min", "all_max", "total")


def stream_log(stream: DataFrame, x: str, lo, hi) -> DataFrame:
    """Rows of an append-only log inside an x range."""
    return stream.where((F.col(x) >= lo) & (F.col(x) < hi))


def stream_buckets(stream: DataFrame, keys: list[str], ts: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per time bucket.

    In append mode a bucket is put out once, when the watermark has passed its end, and
    then forgotten, so the state holds the buckets of the last ``late`` only; rows later
    than that are dropped.  Complete mode keeps every bucket for ever.
    """
    at = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return at.groupBy(*keys, F.window("_ts", width).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        *keys, F.col("_w.start").alias("bucket"), "n", "total")


def stream_stats(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Group statistics kept up to date (complete or update mode)."""
    from tallyloom.operators.stats import group_stats
    return group_stats(stream, keys, value)


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drive a stream over all present input into a memory table, for tests and small reports."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
