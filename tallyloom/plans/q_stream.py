"""Queries over live series.

Each query replays the events table as a stream of several micro-batches (one file per
trigger) through the streaming operator and returns the sink; the SQL states the batch
result, so state carried from batch to batch is part of what is checked.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.operators import series as se
from tallyloom.plans.registry import query, sig, sqlsig
from tallyloom.session import shared_folder
from tallyloom.sources.tables import table
from tallyloom.streaming import live


def _events(spark, sf, files=4):
    """The events table as files that arrive one by one."""
    events = table(spark, sf, "events")
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    events.repartition(files).write.parquet(folder)
    return live.events_stream(spark, folder, events.schema, files_per_batch=1)


def _events_in_order(spark, sf, files=4):
    """The events table as files of ascending time, and at the end one row from the day after, which closes all buckets."""
    events = table(spark, sf, "events")
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    cuts = [*events.selectExpr(f"percentile_approx(unix_micros(cast(ts as timestamp)), array({', '.join(str(i / files) for i in range(1, files))}))").first()[0]]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = events.where((at >= lo if lo is not None else F.lit(True)) & (at < hi if hi is not None else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(folder)
    last = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 1 day")).alias("ts"))
    last.select(*[F.col(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes]).write.mode("append").parquet(folder)
    return live.events_stream(spark, folder, events.schema, files_per_batch=1)


def _sink(spark, stream, mode, keys=()):
    """Rows of the finished stream: the last batch (complete), the last row of each key (update) or all rows (append)."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch, number):
        # a batch that is run again replaces its own files only
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/*")
    if mode == "complete":
        return out.where(F.col("batch") == out.agg(F.max("batch")).scalar()).drop("batch")
    if mode == "update":
        return out.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_last")).select("_last.*")
    return out.drop("batch")


@query("stream_buckets", """select event_type, date_trunc('hour', ts) bucket, count(*) n, round(sum(value),4) total from events group by 1,2""")
def _(spark, sf):
    d = _sink(spark, live.stream_buckets(_events_in_order(spark, sf), ["event_type"], "ts", "value"), "append")
    return d.select("event_type", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n", F.round("total", 4).alias("total"))


@query("stream_stats", f"""select user_id, count(value) n, {sqlsig('avg(value)')} mean, {sqlsig('coalesce(stddev_samp(value),0)')} sd, min(value) min, max(value) max from events group by 1""")
def _(spark, sf):
    d = _sink(spark, live.stream_stats(_events(spark, sf), ["user_id"], "value"), "complete")
    return d.select("user_id", "n", sig("mean").alias("mean"), sig("sd").alias("sd"), "min", "max")


@query("stream_lastn_live", f"""select event_type series, {sqlsig('arg_max(value, event_id)')} newest, min(value) all_min, max(value) all_max, count(*) total,
 (select array_to_string(list_transform(list(e2.value order by e2.event_id), lambda v: printf('%.2f', v)), ',') from (select * from events e1 where e1.event_type=e.event_type order by event_id desc limit 20) e2) last_values from events e group by 1""")
def _(spark, sf):
    d = _sink(spark, live.stream_lastn(_events(spark, sf), "event_type", "event_id", "value", 20), "update", ["series"])
    shown = F.array_join(F.transform("values", lambda v: F.format_string("%.2f", v)), ",")
    return d.select("series", sig("newest").alias("newest"), "all_min", "all_max", "total", shown.alias("last_values"))


@query("stream_log_live", "select user_id, min(value) y_min, max(value) y_max, count(*) n from events where ts>=timestamp '2024-01-05' and ts<timestamp '2024-01-20' group by 1")
def _(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    lo, hi = at("2024-01-05 00:00:00"), at("2024-01-20 00:00:00")
    logged = _sink(spark, live.stream_log(_events(spark, sf), "ts", lo, hi), "append")
    return se.range_in(logged, ["user_id"], "ts", lo, hi, "value")
