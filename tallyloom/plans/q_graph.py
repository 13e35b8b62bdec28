"""Queries over graphs and trees derived from orders, line items and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import graph as gr
from tallyloom.plans.registry import query, sig, sqlsig
from tallyloom.sources.tables import table


def trade(spark, sf):
    """Customer -> supplier edges (suppliers count on from one million), one per order line."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"), F.col("l_quantity").alias("weight"))


_TRADE = "tr as materialized (select o_custkey src, l_suppkey+1000000 dst, l_quantity weight from lineitem join orders on l_orderkey=o_orderkey)"


def _rank_sql(a, b):
    return f"""with recursive {_TRADE}, vt as materialized (select src id from tr union select dst from tr), n as materialized (select count(*)::double n from vt),
lk as materialized (select {a} u, {b} v, count(*)::double/any_value(d) share from tr join (select {a} k, count(*) d from tr group by 1) on k={a} group by 1,2),
pr as (select 0 r, id, 1/n p from vt, n union all select r+1, id, sum(p) from (select pr.r, lk.v id, 0.85*share*p p from pr join lk on u=pr.id union all select pr.r, pr.id, (0.15)/n from pr, n) group by r, id having r<50)
select id, {sqlsig('p', 8)} "rank" from pr where r=50"""


@query("pagerank", _rank_sql("src", "dst"))
def _(spark, sf):
    return gr.pagerank(trade(spark, sf)).withColumn("rank", sig("rank", 8))


@query("trustrank", _rank_sql("dst", "src"))
def _(spark, sf):
    return gr.pagerank(trade(spark, sf), inverse=True).withColumn("rank", sig("rank", 8))


# Region - nation - customer - order links: one component per region over the whole tables.
_LINKS = """lk as materialized (select n_nationkey+1000::bigint src, n_regionkey::bigint dst from nation union all select c_custkey+1000000, c_nationkey+1000 from customer
 union all select o_orderkey+1000000000, o_custkey+1000000 from orders)"""


def links(spark, sf):
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    c = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).alias("src"), (F.col("c_nationkey") + 1000).cast("long").alias("dst"))
    o = table(spark, sf, "orders").select((F.col("o_orderkey") + 1000000000).alias("src"), (F.col("o_custkey") + 1000000).alias("dst"))
    return n.union(c).union(o)


@query("connected_components", f"""with recursive {_LINKS}, e as materialized (select src, dst from lk union select dst, src from lk),
cc as (select 0 r, src id, src c from (select distinct src from e) union all select r+1, id, min(c) from (select r, dst id, c from cc join e on e.src=cc.id union all select r, id, c from cc) group by r, id having r<8)
select id, c component from cc where r=8""")
def _(spark, sf):
    return gr.connected_components(links(spark, sf))


# A DAG over the whole tables.
def chain(spark, sf):
    """nation -> customer -> order -> part."""
    c = table(spark, sf, "customer").select((-F.col("c_nationkey") - 1).cast("long").alias("src"), F.col("c_custkey").alias("dst"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 10000000).alias("dst"))
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") + 10000000).alias("src"), (F.col("l_partkey") + 1000000000).alias("dst"))
    return c.union(o).union(li)


_CHAIN = """ch as materialized (select distinct * from (select -c_nationkey-1::bigint src, c_custkey dst from customer union all select o_custkey, o_orderkey+10000000 from orders union all select l_orderkey+10000000, l_partkey+1000000000 from lineitem))"""


@query("topo_order", f"""with recursive {_CHAIN}, rt as (select src id from ch except select dst from ch), lv as (select id, 0 "level" from rt union select dst, lv."level"+1 from lv join ch on src=lv.id)
select id, cast(max("level") as int) "level" from lv group by 1""")
def _(spark, sf):
    return gr.topo_order(chain(spark, sf))


def loops(spark, sf):
    """Trade edges and, back from each supplier, an edge to the customer with its own number."""
    back = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("src"), F.col("s_suppkey").alias("dst"))
    return trade(spark, sf).select("src", "dst").union(back)


def _trimmed_sql(rounds: int) -> str:
    """Rounds of dropping edges whose start nothing enters or whose end nothing leaves."""
    out = ["c0 as materialized (select distinct src, dst from (select src, dst from tr union all select s_suppkey+1000000, s_suppkey from supplier))"]
    out += [f"c{k + 1} as materialized (select * from c{k} where src in (select dst from c{k}) and dst in (select src from c{k}))" for k in range(rounds)]
    return ", ".join(out)


# Twelve rounds leave the core here; a further one that changed it would show as a difference.
@query("feedback_edges", f"""with {_TRADE}, {_trimmed_sql(12)}, b as (select id, sum(d) d from (select src id, 1 d from c12 union all select dst, -1 from c12) group by 1)
select src, dst from c12 join b x on x.id=src join b y on y.id=dst where x.d<y.d or (x.d=y.d and src>=dst)""")
def _(spark, sf):
    return gr.feedback_edges(loops(spark, sf))


def _forest_sql(rounds: int, jumps: int) -> str:
    """Rounds of: the lightest edge of each component, components hooked along it, pointers jumped to the roots."""
    out = ["e as materialized (select least(src,dst) src, greatest(src,dst) dst, min(w) w from (select src, dst, round(avg(weight), 6) w from tr group by 1,2) where src<>dst group by 1,2)",
           "l0 as materialized (select src v, src c from e union select dst, dst from e)"]
    for r in range(rounds):
        out.append(f"""x{r} as materialized (select a.c, b.c o, e.src, e.dst, e.w from e join l{r} a on a.v=e.src join l{r} b on b.v=e.dst where a.c<>b.c
          union all select b.c, a.c, e.src, e.dst, e.w from e join l{r} a on a.v=e.src join l{r} b on b.v=e.dst where a.c<>b.c)""")
        out.append(f"""b{r} as materialized (select c, arg_min(struct_pack(o := o, src := src, dst := dst, w := w), struct_pack(w := w, s := src, d := dst)) k from x{r} group by 1)""")
        out.append(f"p{r}_0 as materialized (select b.c, case when t.k.o=b.c and b.c<b.k.o then b.c else b.k.o end p from b{r} b join b{r} t on t.c=b.k.o)")
        out += [f"p{r}_{j + 1} as materialized (select a.c, b.p from p{r}_{j} a join p{r}_{j} b on b.c=a.p)" for j in range(jumps)]
        out.append(f"l{r + 1} as materialized (select v, coalesce(p, l.c) c from l{r} l left join p{r}_{jumps} p on p.c=l.c)")
    return ", ".join(out) + " select distinct k.src src, k.dst dst, k.w weight from (" + " union all ".join(f"select k from b{r}" for r in range(rounds)) + ")"


# Eleven rounds and jumps do for two thousand vertices.
@query("mst", f"with {_TRADE}, {_forest_sql(11, 11)}")
def _(spark, sf):
    """Forest over trade edges weighted by mean quantity."""
    e = trade(spark, sf).groupBy("src", "dst").agg(F.round(F.avg("weight"), 6).alias("weight"))
    return gr.mst(e)


_DIST = f"""{_TRADE}, tw as materialized (select src, dst, min(weight) w from (select src, dst, weight from tr union all select dst, src, weight from tr) group by 1,2)"""


@query("sssp", f"""with recursive {_DIST}, vt as (select distinct src id from tw), bf as (select 0 r, 7::bigint id, 0.0::double d union all select r+1, dst, min(d+w) from bf join tw on src=bf.id where r<14 group by r, dst)
select vt.id, coalesce(min(d), 'inf'::double) distance from vt left join bf using (id) group by 1""")
def _(spark, sf):
    return gr.sssp(trade(spark, sf), 7)


# Nation trade graph: every pair of nations with its mean quantity as length.
def nations(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")) \
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.round(F.avg("l_quantity"), 4).alias("weight"))


_NAT = """nt as materialized (select c_nationkey src, s_nationkey dst, round(avg(l_quantity),4) weight from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join supplier on l_suppkey=s_suppkey group by 1,2),
nw as materialized (select src, dst, min(weight) w from (select src, dst, weight from nt union all select dst, src, weight from nt) group by 1,2)"""
_AP = "ap as (select 0 r, id s, id, 0.0::double d from (select distinct src id from nw) union all select r+1, s, dst, min(d+w) from ap join nw on src=ap.id where r<8 group by r, s, dst), pd as materialized (select s source, id, min(d) distance from ap group by 1,2)"


@query("all_pairs", f"with recursive {_NAT}, {_AP} select source, id, round(distance, 6) distance from pd")
def _(spark, sf):
    return gr.all_pairs(nations(spark, sf)).select("source", "id", F.round("distance", 6).alias("distance"))


@query("pivot_distances", f"""with recursive {_NAT}, {_AP}, p0 as (select 0 k, min(id) p from pd), p1 as (select 1 k, arg_max(id, struct_pack(d := distance, i := -id)) p from pd where source=(select p from p0)),
p2 as (select 2 k, arg_max(id, struct_pack(d := d, i := -id)) p from (select id, min(distance) d from pd where source in (select p from p0 union select p from p1) group by 1))
select cast(k as int) pivot_no, p "pivot", id, round(distance, 6) distance from (from p0 union all from p1 union all from p2) join pd on source=p""")
def _(spark, sf):
    return gr.pivot_distances(nations(spark, sf), 3).withColumn("distance", F.round("distance", 6))


@query("layout_stress", f"""with recursive {_NAT}, {_AP}, c as (select n_nationkey id, (n_nationkey%5)*30.0::double x, (n_nationkey//5)*30.0::double y from nation), l as (select avg(weight) l from nt)
select {sqlsig('sum(pow(l*distance-sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)),2)/pow(l*distance,2))', 8)} stress, count(*) pairs from pd, l, c a, c b where a.id=pd.source and b.id=pd.id and pd.source<>pd.id""")
def _(spark, sf):
    n = F.col("n_nationkey")
    at = table(spark, sf, "nation").select(n.alias("id"), (n % 5 * 30.0).alias("x"), (F.floor(n / 5) * 30.0).alias("y"))
    return gr.layout_stress(nations(spark, sf), at).withColumn("stress", sig("stress", 8))


# Region -> nation -> customer -> order.
_TREE = """te as materialized (select 'r'||n_regionkey parent, 'n'||n_nationkey child from nation union all select 'n'||c_nationkey, 'c'||c_custkey from customer union all select 'c'||o_custkey, 'o'||o_orderkey from orders)"""


@query("tree_metrics", f"""with recursive {_TREE}, up as (select child leaf, child id, 0 h from te where child not in (select parent from te) union all select leaf, parent, h+1 from up join te on child=id),
d as (select parent id, 0 depth from te where parent not in (select child from te) union select child, depth+1 from d join te on parent=d.id)
select id, cast(any_value(depth) as int) depth, cast(max(h) as int) height, count(*) leaves from up join d using (id) group by 1""")
def _(spark, sf):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = table(spark, sf, "nation").select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child")) \
        .union(table(spark, sf, "customer").select(key("n", "c_nationkey"), key("c", "c_custkey"))).union(table(spark, sf, "orders").select(key("c", "o_custkey"), key("o", "o_orderkey")))
    return gr.tree_metrics(t)
