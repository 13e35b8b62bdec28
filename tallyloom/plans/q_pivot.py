"""Queries over pivots, lookups and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import lookups as lk, pivot as pv, series as se
from tallyloom.operators.ordering import Down, with_prefix
from tallyloom.plans.registry import query, sig, sqlsig
from tallyloom.sources.tables import table

_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_JOIN = "orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey"


def sales(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


@query("pivot", "select n_name, " + ", ".join(
    f"round(sum(o_totalprice) filter (c_mktsegment='{s}'), 2) {s}_sum, nullif(count(o_totalprice) filter (c_mktsegment='{s}'),0) {s}_count" for s in _SEG) +
    f" from {_JOIN} where o_orderstatus<>'P' group by 1")
def _(spark, sf):
    p = pv.pivot(sales(spark, sf), ["n_name"], "c_mktsegment", _SEG, [("o_totalprice", "sum"), ("o_totalprice", "count")], F.col("o_orderstatus") != "P")
    return p.select("n_name", *[c for s in _SEG for c in (F.round(f"{s}_sum_o_totalprice", 2).alias(f"{s}_sum"), F.col(f"{s}_count_o_totalprice").alias(f"{s}_count"))])


@query("pivot_functions", f"""select l_returnflag, l_linestatus, {sqlsig('sum(l_quantity)')} s, count(l_quantity) c, {sqlsig('avg(l_quantity)')} a, min(l_quantity) mn, max(l_quantity) mx,
 {sqlsig('product(1+(l_quantity-25.5)/100000)', 8)} p, count(l_quantity) cn, {sqlsig('stddev_samp(l_quantity)')} sd, {sqlsig('stddev_pop(l_quantity)')} sdp, {sqlsig('var_samp(l_quantity)')} v, {sqlsig('var_pop(l_quantity)')} vp
 from lineitem group by 1,2""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("f", 1 + (F.col("l_quantity") - 25.5) / 100000)
    q = "l_quantity"
    names = dict(s=(q, "sum"), a=(q, "average"), sd=(q, "stddev"), sdp=(q, "stddevp"), v=(q, "var"), vp=(q, "varp"))
    exact = dict(c=(q, "count"), mn=(q, "min"), mx=(q, "max"), cn=(q, "countNumbers"))
    out = pv.pivot(li, ["l_returnflag", "l_linestatus"], None, [], [*names.values(), *exact.values(), ("f", "product")])
    return out.select("l_returnflag", "l_linestatus", *[sig(f"{f}_{c}").alias(n) for n, (c, f) in names.items()],
                      *[F.col(f"{f}_{c}").alias(n) for n, (c, f) in exact.items()], sig("product_f", 8).alias("p"))


@query("pivot_totals", f"""select n_name, c_mktsegment, o_orderstatus, cast(grouping(n_name)*4+grouping(c_mktsegment)*2+grouping(o_orderstatus) as bigint) "grouping",
 grouping(n_name)+grouping(c_mktsegment)+grouping(o_orderstatus) "level", round(sum(o_totalprice), 2) total, count(*) n from {_JOIN} group by rollup(n_name, c_mktsegment, o_orderstatus)""")
def _(spark, sf):
    t = pv.pivot_totals(sales(spark, sf), ["n_name", "c_mktsegment", "o_orderstatus"], [("o_totalprice", "sum"), ("o_totalprice", "count")])
    return t.select("n_name", "c_mktsegment", "o_orderstatus", "grouping", F.col("level").cast("bigint").alias("level"), F.round("sum_o_totalprice", 2).alias("total"), F.col("count_o_totalprice").alias("n"))


@query("pivot_totals_cube", f"""select c_mktsegment, o_orderpriority, {sqlsig('avg(o_totalprice)', 12)} mean, cast(grouping(c_mktsegment)*2+grouping(o_orderpriority) as bigint) "grouping"
 from {_JOIN} group by cube(c_mktsegment, o_orderpriority)""")
def _(spark, sf):
    t = pv.pivot_totals(sales(spark, sf), ["c_mktsegment", "o_orderpriority"], [("o_totalprice", "average")], at_cube=True)
    return t.select("c_mktsegment", "o_orderpriority", sig("average_o_totalprice", 12).alias("mean"), "grouping")


_SHOW = {
    "normal": "v", "difference_prev": "v-lag(v) over w", "difference_next": "v-lead(v) over w",
    "difference_base": "v-max(case when o_orderpriority='1-URGENT' then v end) over (partition by n_name)",
    "percent_of_base": "v/max(case when o_orderpriority='1-URGENT' then v end) over (partition by n_name)",
    "percent_difference_prev": "(v-lag(v) over w)/lag(v) over w",
    "running_total": "sum(v) over (partition by n_name order by o_orderpriority rows unbounded preceding)",
    "percent_of_row": "v/sum(v) over (partition by n_name)", "percent_of_column": "v/sum(v) over (partition by o_orderpriority)",
    "percent_of_total": "v/sum(v) over ()", "index_value": "v*sum(v) over ()/(sum(v) over (partition by n_name)*sum(v) over (partition by o_orderpriority))",
}


_MONEY = ("normal", "difference_prev", "difference_next", "difference_base", "running_total")


@query("pivot_show_as", "select n_name, o_orderpriority, " + ", ".join(f"{f'round({s}, 2)' if k in _MONEY else sqlsig(s, 7)} {k}" for k, s in _SHOW.items()) +
       f" from (select n_name, o_orderpriority, sum(o_totalprice) v from {_JOIN} group by 1,2) window w as (partition by n_name order by o_orderpriority)")
def _(spark, sf):
    cells = sales(spark, sf).groupBy("n_name", "o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    t = pv.show_as(cells, "n_name", "o_orderpriority", "v", "1-URGENT")
    return t.select("n_name", "o_orderpriority", *[(F.round(c, 2) if c in _MONEY else sig(c, 7)).alias(c) for c in _SHOW])


# --- lookups ---------------------------------------------------------------------

@query("lookup_exact", """select l_orderkey, l_linenumber, l_partkey, l_quantity, p_partkey first_part, p_brand brand, p_partkey is not null found from
 (select *, case l_linenumber when 1 then 'SMALL Ring' when 2 then 'blue bolt' when 3 then 'no such part' else 'Red Widget' end k from lineitem)
 left join (select lower(p_name) pk, arg_min(p_brand, p_partkey) p_brand, min(p_partkey) p_partkey from part group by 1) on lower(k)=pk""")
def _(spark, sf):
    n = F.col("l_linenumber")
    li = table(spark, sf, "lineitem").withColumn("k", F.when(n == 1, "SMALL Ring").when(n == 2, "blue bolt").when(n == 3, "no such part").otherwise("Red Widget"))
    p = table(spark, sf, "part").select("p_name", "p_partkey", F.col("p_brand").alias("brand"), F.col("p_partkey").alias("first_part"))
    return lk.lookup_exact(li, p, "k", "p_name", "p_partkey", ["first_part", "brand"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "first_part", "brand", "found")


@query("lookup_asof", """with l as (select event_id, user_id, ts - interval 6 hour ts from events)
select l.event_id, l.user_id, arg_max(r.ts, struct_pack(a := r.ts, b := r.event_id)) matched_key, arg_max(r.value, struct_pack(a := r.ts, b := r.event_id)) old_value
 from l left join events r on l.user_id=r.user_id and r.ts<=l.ts group by 1,2""")
def _(spark, sf):
    """What each user's newest value was six hours before each of their events."""
    e = table(spark, sf, "events")
    left = e.select("event_id", "user_id", (F.col("ts") - F.expr("interval 6 hours")).alias("ts"))
    right = e.select("user_id", "ts", F.col("event_id").alias("p"), F.col("value").alias("old_value"))
    return lk.lookup_asof(left, right, ["user_id"], "ts", "ts", "p", ["old_value"]).select("event_id", "user_id", "matched_key", "old_value")


@query("lookup_asof_number", """select c_custkey, arg_max(s_acctbal, struct_pack(a := s_acctbal, b := s_suppkey)) matched_key, arg_max(s_name, struct_pack(a := s_acctbal, b := s_suppkey)) s_name
 from customer left join supplier on s_acctbal<=c_acctbal group by 1""")
def _(spark, sf):
    return lk.lookup_asof(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), table(spark, sf, "supplier"), [], "c_acctbal", "s_acctbal",
                          "s_suppkey", ["s_name"]).select("c_custkey", "matched_key", "s_name")


@query("match_first", """select t target, min(pos)+1 "position" from (values ('small ring'), ('*BOLT'), ('green w?dget'), ('zzz')) v(t) left join
 (select p_name, row_number() over (order by p_partkey)-1 pos from part) on case t when 'small ring' then lower(p_name)='small ring' when '*BOLT' then lower(p_name) like '%bolt'
 when 'green w?dget' then lower(p_name) like 'green w_dget' else false end group by 1""")
def _(spark, sf):
    p = with_prefix(table(spark, sf, "part"), [], [F.col("p_partkey")], F.floor(F.col("p_partkey") / 65536))
    return lk.match_first(p, "p_name", "pos", ["small ring", "*BOLT", "green w?dget", "zzz"])


@query("match_desc", """with r as (select floor(s_acctbal/50) v, row_number() over (order by floor(s_acctbal/50) desc, s_suppkey)-1 pos from supplier),
l as (select c_custkey, floor(c_acctbal/50) t from customer),
m as (select c_custkey, t, min(v) matched_key from l left join r on v>=t group by 1,2)
select c_custkey, matched_key, case when matched_key=t then min(pos) else max(pos) end + 1 "position" from m left join r on v=matched_key group by c_custkey, t, matched_key""")
def _(spark, sf):
    bal = lambda c: F.floor(F.col(c) / 50).cast("double")
    r = with_prefix(table(spark, sf, "supplier").withColumn("v", bal("s_acctbal")), [], [Down(F.col("v")), F.col("s_suppkey")])
    left = table(spark, sf, "customer").select("c_custkey", bal("c_acctbal").alias("t"))
    return lk.match_desc(left, r, "t", "v", "pos").select("c_custkey", "matched_key", "position")


@query("lookup_nearest", """select c_custkey, arg_min(s_acctbal, struct_pack(d := round(abs(s_acctbal-c_acctbal),6), k := s_acctbal)) matched_key from customer, supplier group by 1""")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return lk.lookup_nearest(c, table(spark, sf, "supplier"), [], "c_acctbal", "s_acctbal", "s_suppkey", ["s_suppkey"], ["c_custkey"], digits=6) \
        .select("c_custkey", "matched_key")


_PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("lookup_row", f"""select o_orderkey, {sqlsig('v')} "value" from orders o join customer c on o_custkey=c_custkey left join
 (select c_nationkey nk, o_orderpriority pr, avg(o_totalprice) v from orders join customer on o_custkey=c_custkey group by 1,2) on nk=c.c_nationkey and pr=o.o_orderpriority""")
def _(spark, sf):
    oc = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = oc.groupBy("c_nationkey").pivot("o_orderpriority", _PRI).agg(F.avg("o_totalprice"))
    return lk.lookup_row(m, "c_nationkey", [f"`{p}`" for p in _PRI], oc, "c_nationkey", "o_orderpriority").select("o_orderkey", sig("value").alias("value"))


@query("index_at", """select o_orderkey, case o_orderkey%3+1 when 1 then c_name when 2 then c_mktsegment else c_nationkey::varchar end "value" from orders left join
 (select *, row_number() over (order by c_custkey) r from customer) on r=o_custkey""")
def _(spark, sf):
    c = with_prefix(table(spark, sf, "customer"), [], [F.col("c_custkey")], F.floor(F.col("c_custkey") / 65536))
    req = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("r"), (F.col("o_orderkey") % 3 + 1).alias("c"))
    return lk.index_at(c, "pos", ["c_name", "c_mktsegment", "c_nationkey"], req, "r", "c").select("o_orderkey", "value")


# --- series ------------------------------------------------------------------------

_POS = "row_number() over (partition by event_type order by ts, event_id)-1"
_ROLL = f"""(select event_id, event_type, ts, value, {_POS} pos, avg(value) over w m, stddev_samp(value) over w s from events
 window w as (partition by event_type order by ts, event_id rows between 19 preceding and current row))"""


def _rolled(spark, sf, **kw):
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return se.rolling(e, ["event_type"], [F.col("ts"), F.col("event_id")], "value", 20, **kw)


@query("moving_average", f"select event_id, {sqlsig('m')} moving_average from {_ROLL} where pos>=20")
def _(spark, sf):
    return _rolled(spark, sf).select("event_id", sig("moving_average").alias("moving_average"))


@query("moving_stddev", f"select event_id, case when pos>=20 then {sqlsig('s', 8)} else 'nan'::double end moving_sd from {_ROLL}")
def _(spark, sf):
    d = _rolled(spark, sf, pad=True)
    return d.select("event_id", F.when(F.col("pos") >= 20, sig("moving_sd", 8)).otherwise(F.col("moving_sd")).alias("moving_sd"))


_BAR = """select event_type, date_trunc('hour', ts) bar, arg_min(value, struct_pack(a := ts, b := event_id)) open, max(value) high, min(value) low,
 arg_max(value, struct_pack(a := ts, b := event_id)) close, count(*) ticks from events group by 1,2"""


@query("ohlc_resample", _BAR)
def _(spark, sf):
    return se.ohlc_resample(table(spark, sf, "events"), ["event_type"], "ts", "event_id", "value", "hour")


def _bars(spark, sf, k=2.0):
    b = se.ohlc_resample(table(spark, sf, "events"), ["event_type"], "ts", "event_id", "value", "hour")
    return se.rolling(b, ["event_type"], [F.col("bar")], "close", 10, k=k)


_SMA = f"(select event_type, bar, close, row_number() over (partition by event_type order by bar)-1 pos, avg(close) over w m, stddev_samp(close) over w s from ({_BAR}) window w as (partition by event_type order by bar rows between 9 preceding and current row))"


@query("sma_ohlc", f"select event_type, bar, {sqlsig('m')} sma from {_SMA} where pos>=10")
def _(spark, sf):
    return _bars(spark, sf).select("event_type", "bar", sig("moving_average").alias("sma"))


@query("bollinger", f"select event_type, bar, {sqlsig('m')} mean, {sqlsig('m+1.5*s', 7)} upper, round(m-1.5*s, 6) lower from {_SMA} where pos>=10")
def _(spark, sf):
    return _bars(spark, sf, 1.5).select("event_type", "bar", sig("moving_average").alias("mean"), sig("upper", 7).alias("upper"), F.round("lower", 6).alias("lower"))


@query("running_total", f"select event_id, round(sum(value) over (partition by event_type order by ts, event_id rows unbounded preceding), 4) running_total from events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return se.running_total(e, ["event_type"], [F.col("ts"), F.col("event_id")], "value").select("event_id", F.round("running_total", 4).alias("running_total"))


@query("diff_prev", """select event_id, round(value-lag(value) over w, 6) diff_prev, round(value-lead(value) over w, 6) diff_next from events
 window w as (partition by user_id order by ts, event_id)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    d = se.diff_neighbours(e, ["user_id"], [F.col("ts"), F.col("event_id")], "value")
    return d.select("event_id", F.round("diff_prev", 6).alias("diff_prev"), F.round("diff_next", 6).alias("diff_next"))


@query("minmax_decimate", f"select event_type, cast(pos//100 as bigint) run, min(value) min, max(value) max, count(*) samples from (select *, {_POS} pos from events) group by 1,2")
def _(spark, sf):
    e = se.positioned(table(spark, sf, "events"), ["event_type"], [F.col("ts"), F.col("event_id")])
    return se.minmax_decimate(e, ["event_type"], "pos", "value", 100)


@query("stream_lastn", """select event_type, event_id, value, all_min, all_max, total, r=1 newest from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) r,
 min(value) over (partition by event_type) all_min, max(value) over (partition by event_type) all_max, count(*) over (partition by event_type) total from events) where r<=50""")
def _(spark, sf):
    d = se.last_n(table(spark, sf, "events"), ["event_type"], [F.col("ts"), F.col("event_id")], "value", 50)
    return d.select("event_type", "event_id", "value", "all_min", "all_max", "total", "newest")


@query("stream_log", "select user_id, min(value) y_min, max(value) y_max, count(*) n from events where ts>=timestamp '2024-01-05' and ts<timestamp '2024-01-20' group by 1")
def _(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return se.range_in(table(spark, sf, "events"), ["user_id"], "ts", at("2024-01-05 00:00:00"), at("2024-01-20 00:00:00"), "value")
