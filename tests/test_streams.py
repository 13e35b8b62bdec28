"""State carried over batches: NULL series, late rows, and buckets that are forgotten."""

import json
from datetime import datetime, timedelta

from tallyloom.streaming import live


def arrive(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_last_n_keeps_null_series_values_and_orders(spark, tmp_path):
    schema = "k string, o double, v double"
    batches = [
        [("a", 1.0, 5.0), ("a", 2.0, None), (None, 1.0, 7.0), ("", 1.0, 1.0), ("n", 1.0, None)],
        [("a", 4.0, 9.0), (None, None, 3.0), (None, 3.0, float("nan")), ("", 0.5, 2.0)],
        [("a", 3.0, 1.0), (None, 2.0, 8.0), ("n", 2.0, None)],
    ]
    arrive(spark, str(tmp_path / "in"), batches, schema)
    out = live.run_to_table(live.stream_lastn(live.events_stream(spark, str(tmp_path / "in"), schema), "k", "o", "v", 3), "lastnull", "update", str(tmp_path / "c"))
    rows = [r for b in batches for r in b]
    got = {}
    for r in out.collect():
        if r["series"] not in got or r["total"] > got[r["series"]]["total"]:
            got[r["series"]] = r
    assert set(got) == {"a", "", "n", None}
    for k, r in got.items():
        mine = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0.0))
        vs = [None if x[2] is None or x[2] != x[2] else x[2] for x in mine]
        some = [v for v in vs if v is not None]
        assert (r["values"], r["newest"], r["total"]) == (vs[-3:], vs[-1], len(mine))
        assert (r["all_min"], r["all_max"]) == (min(some, default=None), max(some, default=None))


def test_buckets_close_and_are_forgotten(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "k string, ts timestamp, v double"
    days = [[("a" if m % 2 else None, start + timedelta(days=d, minutes=10 * m), 1.0) for m in range(144)] for d in range(5)]
    late = [("a", start + timedelta(days=1, minutes=5), 100.0)]  # days behind the watermark when it comes
    arrive(spark, str(tmp_path / "in"), [*days, late, [("end", start + timedelta(days=9), 0.0)]], schema)
    stream = live.stream_buckets(live.events_stream(spark, str(tmp_path / "in"), schema), ["k"], "ts", "v")
    q = stream.writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["k"], r["bucket"]): (r["n"], r["total"]) for r in spark.table("closed").collect()}
    assert len(got) == 2 * 24 * 5 and set(got.values()) == {(3, 3.0)}
    held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(held) <= 3 * 48 + 2 and held[-1] <= 2  # never all five days
