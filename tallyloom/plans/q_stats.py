"""Queries over grouped statistics, histograms, densities and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import stats
from tallyloom.plans.registry import query, sig, sqlsig
from tallyloom.sources.tables import table

_GS = "count(v) n, avg(v) mean, coalesce(stddev_samp(v),0) sd, coalesce(stddev_samp(v),0)/sqrt(count(v)) sem"


@query("group_stats", f"""
select l_returnflag, count(l_extendedprice) n, {sqlsig('avg(l_extendedprice)')} mean,
 {sqlsig('coalesce(stddev_samp(l_extendedprice),0)')} sd,
 {sqlsig('coalesce(stddev_samp(l_extendedprice),0)/sqrt(count(l_extendedprice))')} sem,
 min(l_extendedprice) min, max(l_extendedprice) max from lineitem group by 1""")
def _(spark, sf):
    d = stats.group_stats(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return d.select("l_returnflag", "n", *[sig(c).alias(c) for c in ("mean", "sd", "sem")], "min", "max")


def _anova_sql(src, by, group, value):
    key = f"{by}, " if by else ""
    tie = f"p.{by}=m.{by}" if by else "true"
    grp = f"group by {by}" if by else ""
    return f"""
with p as (select {key}{group} g, count({value}) n, avg({value}) m, coalesce(var_samp({value}),0) s2 from {src} group by all),
m as (select {key}sum(n*m)/sum(n) gm from p {grp}),
a as (select {'p.' + by + ' ' + by + ',' if by else ''} count(*) k, sum(n) nt, sum((n-1)*s2) ssw, sum(n*(m-gm)*(m-gm)) ssb
 from p join m on {tie} {'group by p.' + by if by else ''})
select {key} cast(k as bigint) k, cast(nt as bigint) n_total, {sqlsig('ssb', 7)} ssb, {sqlsig('ssw')} ssw, {sqlsig('ssb+ssw')} sst,
 cast(k-1 as bigint) df_b, cast(nt-k as bigint) df_w, {sqlsig('ssb/(k-1)', 7)} msb, {sqlsig('ssw/(nt-k)')} msw,
 {sqlsig('(ssb/(k-1))/(ssw/(nt-k))', 7)} f from a"""


def _anova_cols(t, by=()):
    return t.select(*by, "k", "n_total", sig("ssb", 7).alias("ssb"), sig("ssw").alias("ssw"), sig("sst").alias("sst"),
                    "df_b", "df_w", sig("msb", 7).alias("msb"), sig("msw").alias("msw"), sig("f", 7).alias("f"))


@query("anova_oneway", _anova_sql("lineitem", "", "l_returnflag", "l_extendedprice"))
def _(spark, sf):
    return _anova_cols(stats.anova_oneway(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


_ON = "(select c_nationkey, o_orderpriority, o_totalprice from orders join customer on o_custkey=c_custkey)"


@query("anova_by", _anova_sql(_ON, "c_nationkey", "o_orderpriority", "o_totalprice"))
def _(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _anova_cols(stats.anova_oneway(o, "o_orderpriority", "o_totalprice", ["c_nationkey"]), ["c_nationkey"])


# With three groups the between degrees of freedom are 2 and the tail has the
# closed form x^(df_w/2), which SQL can state.
@query("anova_pvalue", f"""
with p as (select l_linestatus, l_returnflag g, count(*) n, avg(l_extendedprice) m, var_samp(l_extendedprice) s2 from lineitem group by all),
gm as (select l_linestatus, sum(n*m)/sum(n) gm from p group by 1),
a as (select p.l_linestatus, count(*) k, sum(n) nt, sum((n-1)*s2) ssw, sum(n*(m-gm)*(m-gm)) ssb from p join gm using (l_linestatus) group by 1)
select l_linestatus, {sqlsig('pow((nt-k)/((nt-k)+2*((ssb/2)/(ssw/(nt-k)))), (nt-k)/2)', 6)} p_value from a""")
def _(spark, sf):
    t = stats.anova_oneway(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", ["l_linestatus"])
    return stats.anova_pvalue(t).select("l_linestatus", sig("p_value", 6).alias("p_value"))


def _duncan_sql(src, group, value, cols):
    return f"""
with s as (select {group} g, count({value}) n, avg({value}) mean, coalesce(stddev_samp({value}),0) sd from {src} group by 1),
e as (select sum((n-1)*sd*sd)/(sum(n)-count(*)) msw, avg(n) nbar, sum(n)-count(*) dfw from s),
q as (select *, case when dfw>=120 then 2.77 else 2.77*(1+1.0/dfw) end*sqrt(msw/nbar) crit from e),
l as (select s.*, case when lag(mean) over (order by mean desc, g)-mean >= crit then 1 else 0 end st from s, q),
r as (select *, chr(97+cast(least(sum(st) over (order by mean desc, g rows unbounded preceding),25) as int)) letter from l)
select {cols} from r"""


@query("duncan", _duncan_sql("part", "p_brand", "p_retailprice",
                             f"g p_brand, n, {sqlsig('mean')} mean, {sqlsig('sd')} sd, {sqlsig('sd/sqrt(n)')} sem, letter"))
def _(spark, sf):
    d = stats.duncan(table(spark, sf, "part"), "p_brand", "p_retailprice")
    return d.select("p_brand", "n", *[sig(c).alias(c) for c in ("mean", "sd", "sem")], "letter")


@query("bar_summary", _duncan_sql("part", "p_type", "p_size", f"g p_type, {sqlsig('mean')} mean, {sqlsig('sd/sqrt(n)')} error, letter"))
def _(spark, sf):
    d = stats.bar_summary(table(spark, sf, "part"), "p_type", "p_size")
    return d.select("p_type", sig("mean").alias("mean"), sig("error").alias("error"), "letter")


@query("full_analysis", f"""
with p as (select l_returnflag g, count(*) n, avg(l_extendedprice) mean, stddev_samp(l_extendedprice) sd from lineitem group by 1),
gm as (select sum(n*mean)/sum(n) gm from p),
a as (select count(*) k, sum(n) nt, sum((n-1)*sd*sd) ssw, sum(n*(mean-gm)*(mean-gm)) ssb, avg(n) nbar from p, gm),
t as (select *, ssw/(nt-k) msw, (ssb/(k-1))/(ssw/(nt-k)) f, 2.77*sqrt(ssw/(nt-k)/nbar) crit from a),
l as (select p.*, t.*, case when lag(mean) over (order by mean desc, g)-mean >= crit then 1 else 0 end st from p, t)
select g l_returnflag, p.n, {sqlsig('mean')} mean, {sqlsig('sd')} sd,
 chr(97+cast(least(sum(st) over (order by mean desc, g rows unbounded preceding),25) as int)) letter,
 {sqlsig('f', 7)} f, cast(k-1 as bigint) df_b, cast(nt-k as bigint) df_w, {sqlsig('msw')} msw,
 {sqlsig('pow((nt-k)/((nt-k)+2*f), (nt-k)/2)', 6)} p_value from l p""")
def _(spark, sf):
    d = stats.full_analysis(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")
    return d.select("l_returnflag", "n", sig("mean").alias("mean"), sig("sd").alias("sd"), "letter", sig("f", 7).alias("f"),
                    "df_b", "df_w", sig("msw").alias("msw"), sig("p_value", 6).alias("p_value"))


@query("stats_preflight", """
select count(*) groups, min(n) min_n, cast(sum(odd) as bigint) not_finite, count(*)>=2 and min(n)>=2 and sum(odd)=0 ok from
 (select event_type, count(value) n, sum(case when isnan(value) or isinf(value) then 1 else 0 end) odd from events group by 1)""")
def _(spark, sf):
    return stats.stats_preflight(table(spark, sf, "events"), "event_type", "value")


_HIST = """
b as (select lo, hi, {k} k, {w} w from (select min({v}) lo, max({v}) hi from {t})),
e as (select lo, lo+k*w hi, k, ((lo+k*w)-lo)/k w from b),
c as (select cast(least(floor(({v}-lo)/w), k-1) as bigint) bin, count(*) c from {t}, e where {v}>=lo and {v}<=hi group by 1),
h as (select i bin, lo+i*w lft, coalesce(c,0) n from (select unnest(range(0, cast(k as bigint))) i, lo, w from e) left join c on c.bin=i)"""


@query("histogram_count", "with " + _HIST.format(v="o_totalprice", t="orders", k="20", w="(hi-lo)/20") +
       f" select bin, {sqlsig("lft", 12)} \"left\", n count from h")
def _(spark, sf):
    return stats.histogram_count(table(spark, sf, "orders"), "o_totalprice", 20).withColumn("left", sig("left", 12))


@query("histogram_size", "with " + _HIST.format(v="value", t="events", k="floor((hi-lo)/7.5)", w="7.5") +
       f" select bin, {sqlsig("lft", 12)} \"left\", n count from h")
def _(spark, sf):
    return stats.histogram_size(table(spark, sf, "events"), "value", 7.5).withColumn("left", sig("left", 12))


@query("histogram_norm", "with " + _HIST.format(v="l_extendedprice", t="lineitem", k="16", w="(hi-lo)/16") + f"""
select bin, n count, {sqlsig('n/sum(n) over ()')} probability, {sqlsig('n/max(n) over ()')} normalized,
 cast(sum(n) over (order by bin) as bigint) cumulative, {sqlsig('sum(n) over (order by bin)/sum(n) over ()')} cumulative_probability from h""")
def _(spark, sf):
    h = stats.histogram_norm(stats.histogram_count(table(spark, sf, "lineitem"), "l_extendedprice", 16))
    return h.select("bin", "count", "cumulative", *[sig(c).alias(c) for c in ("probability", "normalized", "cumulative_probability")])


@query("cumulative_hist", """
with c as (select event_type, cast(floor(value/10) as bigint) bin, count(*) n from events group by all)
select event_type, bin, n count, cast(sum(n) over (partition by event_type order by bin) as bigint) cumulative from c""")
def _(spark, sf):
    return stats.cumulative_hist(table(spark, sf, "events"), ["event_type"], "value", 10)


_RANKED = "(select {k}, {v} v, row_number() over (partition by {k} order by {v})-1 i, count(*) over (partition by {k}) n from {t})"


@query("percentile_lower", "select l_returnflag, n, " + ", ".join(
    f"max(case when i=greatest(0,least(n-1,cast(floor({p}.0*n/100) as bigint))) then v end) p{p}" for p in (0, 5, 50, 95, 100)) +
    " from " + _RANKED.format(k="l_returnflag", v="l_extendedprice", t="lineitem") + " group by 1,2")
def _(spark, sf):
    return stats.percentile_lower(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {f"p{p}": p for p in (0, 5, 50, 95, 100)})


@query("median", f"select o_orderpriority, count(*) n, {sqlsig('median(o_totalprice)')} median from orders group by 1")
def _(spark, sf):
    return stats.median(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice").withColumn("median", sig("median"))


@query("boxplot", "select event_type, n, min(v) whisker_min, max(case when i=n//4 then v end) q1, max(case when i=n//2 then v end) med,"
       " max(case when i=3*n//4 then v end) q3, max(v) whisker_max from " + _RANKED.format(k="event_type", v="value", t="events") + " group by 1,2")
def _(spark, sf):
    return stats.boxplot(table(spark, sf, "events"), ["event_type"], "value")


@query("population", f"""select c_mktsegment, count(*) count, min(c_acctbal) min, max(c_acctbal) max, {sqlsig('avg(c_acctbal)')} mean,
 {sqlsig('var_samp(c_acctbal)')} variance, {sqlsig('stddev_samp(c_acctbal)')} sd, {sqlsig('stddev_samp(c_acctbal)/sqrt(count(*))')} sem,
 {sqlsig('median(c_acctbal)')} median from customer group by 1""")
def _(spark, sf):
    p = stats.population(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal")
    return p.select("c_mktsegment", "count", "min", "max", *[sig(c).alias(c) for c in ("mean", "variance", "sd", "sem", "median")])


def _describe_sql(v):
    return (f"count({v}) n, {sqlsig(f'sum({v})')} sum, {sqlsig(f'avg({v})')} mean, {sqlsig(f'var_samp({v})')} variance, "
            f"{sqlsig(f'var_pop({v})')} variance_p, {sqlsig(f'stddev_samp({v})')} sd, {sqlsig(f'stddev_pop({v})')} sd_p, "
            f"{sqlsig(f'stddev_samp({v})/sqrt(count({v}))')} sem")


def _describe_cols(d, *keys):
    return d.select(*keys, "n", *[sig(c).alias(c) for c in ("sum", "mean", "variance", "variance_p", "sd", "sd_p", "sem")])


@query("describe", f"select {_describe_sql('l_extendedprice')} from lineitem")
def _(spark, sf):
    return _describe_cols(stats.describe(table(spark, sf, "lineitem"), "l_extendedprice"))


@query("describe_nan", f"select event_type, {_describe_sql('v')} from (select event_type, case when value<2 then null else value end v from events) group by 1")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.when(F.col("value") < 2, F.lit(float("nan"))).otherwise(F.col("value")))
    return _describe_cols(stats.describe(e, "value", ["event_type"], ignore_nan=True), "event_type")


_LONG = "(select unnest(range(0,len(embedding))) pos, unnest(embedding)::double v, label from embeddings)"


@query("vertical_stats", f"""select cast(pos as int) pos, count(v) n, round(avg(v),8) mean, round(stddev_samp(v),8) sd,
 round(stddev_samp(v)/sqrt(count(v)),8) sem from {_LONG} group by 1""")
def _(spark, sf):
    v = stats.vertical_stats(table(spark, sf, "embeddings"), "embedding")
    return v.select("pos", "n", *[F.round(c, 8).alias(c) for c in ("mean", "sd", "sem")])


@query("sum_vertically", f"select label, cast(pos as int) pos, round(sum(v),6) total from {_LONG} group by 1,2")
def _(spark, sf):
    return stats.sum_vertically(table(spark, sf, "embeddings"), "embedding", ["label"]).withColumn("total", F.round("total", 6))


@query("grid_halve", f"""
with c as (select vec_id r, unnest(range(0,len(embedding))) c, unnest(embedding)::double v from embeddings),
m as (select (max(r)+1)//2*2 mr, (max(c)+1)//2*2 mc from c)
select r//2 r, c//2 c, round(avg(v),8) v from c, m where r<mr and c<mc group by 1,2""")
def _(spark, sf):
    cells = table(spark, sf, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "v"))
    return stats.grid_halve(cells.withColumn("v", F.col("v").cast("double")), "r", "c", "v").withColumn("v", F.round("v", 8))


@query("linear_regression", f"""select l_returnflag, count(*) n, {sqlsig('regr_slope(l_extendedprice,l_quantity)')} slope,
 {sqlsig('regr_intercept(l_extendedprice,l_quantity)', 6)} offset_, {sqlsig('regr_r2(l_extendedprice,l_quantity)')} r_squared from lineitem group by 1""")
def _(spark, sf):
    r = stats.linear_regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return r.select("l_returnflag", "n", sig("slope").alias("slope"), sig("offset", 6).alias("offset_"), sig("r_squared").alias("r_squared"))


@query("regression_line", f"""select p_type, min(p_partkey) x0, max(p_partkey) x1,
 {sqlsig('regr_slope(p_retailprice,p_partkey)*min(p_partkey)+regr_intercept(p_retailprice,p_partkey)', 7)} y0,
 {sqlsig('regr_slope(p_retailprice,p_partkey)*max(p_partkey)+regr_intercept(p_retailprice,p_partkey)', 7)} y1 from part group by 1""")
def _(spark, sf):
    r = stats.linear_regression(table(spark, sf, "part"), "p_partkey", "p_retailprice", ["p_type"])
    return r.select("p_type", "x0", "x1", sig("y0", 7).alias("y0"), sig("y1", 7).alias("y1"))


_KDE_BASE = """with b as (select count(*) n, stddev_samp({v}) sd, min({v}) lo, max({v}) hi from {t}),
s as (select *, pow(24*sqrt(pi()),1/3)*sd*pow(n,-1/3) h from b),
g as (select i, lo+(hi-lo)*i/20 x, n, h from s, range(0,21) r(i))
select cast(i as int) i, {x} x, {d} density from (select i, x, n, h, sum({k}) total from g, (select {v} v from {t}) group by all)"""
_U = "((x-v)/h)"
_KERNELS = {
    "epanechnikov": f"case when abs({_U})<=1 then 0.75*(1-{_U}*{_U}) else 0 end",
    "gaussian": f"exp(-0.5*{_U}*{_U})/sqrt(2*pi())",
    "uniform": f"case when abs({_U})<=1 then 0.5 else 0 end",
    "triangular": f"case when abs({_U})<1 then 1-abs({_U}) else 0 end",
}


def _kde(name, kernel, t, v):
    sql = _KDE_BASE.format(v=v, t=t, k=_KERNELS[kernel], x=sqlsig("x", 12), d=sqlsig("total/(n*h)", 8))

    @query(name, sql)
    def _(spark, sf):
        d = stats.kde(table(spark, sf, t), v, 21, kernel)
        return d.select("i", sig("x", 12).alias("x"), sig("density", 8).alias("density"))


_kde("kde", "epanechnikov", "events", "value")
_kde("kde_gaussian", "gaussian", "orders", "o_totalprice")
_kde("kde_uniform", "uniform", "customer", "c_acctbal")
_kde("kde_triangular", "triangular", "events", "value")


@query("normal_density", f"""
with s as (select l_returnflag f, avg(l_quantity) m, stddev_samp(l_quantity) d from lineitem group by 1)
select l_returnflag, l_quantity, count(*) n, {sqlsig('exp(-0.5*pow((l_quantity-any_value(m))/any_value(d),2))/(any_value(d)*sqrt(2*pi()))')} density
 from lineitem join s on f=l_returnflag group by 1,2""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    s = stats.group_stats(li, ["l_returnflag"], "l_quantity").select("l_returnflag", "mean", "sd")
    per = li.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return per.join(s, "l_returnflag").select("l_returnflag", "l_quantity", "n",
                                              sig(stats.normal_density(F.col("l_quantity"), F.col("mean"), F.col("sd"))).alias("density"))


@query("share", f"""select o_orderpriority, round(sum(o_totalprice),2) "value", round(any_value(t),2) total,
 {sqlsig('sum(o_totalprice)/any_value(t)*100')} percent from orders, (select sum(o_totalprice) t from orders) group by 1""")
def _(spark, sf):
    s = stats.share(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return s.select("o_orderpriority", *[F.round(c, 2).alias(c) for c in ("value", "total")], sig("percent").alias("percent"))


_PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("heatmap_matrix", "select n_name, " + ", ".join(
    f"{sqlsig(f'''avg(o_totalprice) filter (o_orderpriority='{p}')''')} p{i}" for i, p in enumerate(_PRI)) +
    " from orders join customer on o_custkey=c_custkey join nation on n_nationkey=c_nationkey group by 1")
def _(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")) \
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = stats.matrix(o, "n_name", "o_orderpriority", _PRI, F.avg("o_totalprice"))
    return m.select("n_name", *[sig(F.col(f"`{p}`")).alias(f"p{i}") for i, p in enumerate(_PRI)])


@query("radar_matrix", "select event_type, " + ", ".join(
    f"{sqlsig(f'''avg(value) filter (extract(isodow from ts)={d})''')} d{d}" for d in range(1, 8)) + " from events group by 1")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("d", F.weekday("ts") + 1)
    m = stats.matrix(e, "event_type", "d", list(range(1, 8)), F.avg("value"))
    return m.select("event_type", *[sig(F.col(f"`{d}`")).alias(f"d{d}") for d in range(1, 8)])


@query("category_counts", "select source, count(*) entries from documents group by 1")
def _(spark, sf):
    return stats.category_counts(table(spark, sf, "documents"), "source")
