"""Queries over criteria, filters, rules, validation, criteria aggregates and sorts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyloom.functions.cells import ERRORS
from tallyloom.operators import filters as fl, sorting as so
from tallyloom.operators.ordering import time_chunk, with_prefix
from tallyloom.plans.registry import query, sig, sqlsig
from tallyloom.sources.tables import table


# A sheet column of mixed cells, derived from part: numbers, texts, booleans,
# errors and blanks by p_size.
CELL_SQL = """(select p_partkey, p_name, case when p_size%5=0 then 'blank' when p_size%7=0 then 'error' when p_size%3=0 then 'text'
 when p_size%4=0 then 'boolean' else 'number' end kind, p_retailprice, p_size from part)"""


def cells(spark, sf):
    s = F.col("p_size")
    kind = F.when(s % 5 == 0, "blank").when(s % 7 == 0, "error").when(s % 3 == 0, "text").when(s % 4 == 0, "boolean").otherwise("number")
    return table(spark, sf, "part").withColumn("kind", kind)


def sheet_text(c):
    """The text form of the mixed column (blank is NULL)."""
    return F.when(c == "number", F.format_string("%.2f", "p_retailprice")).when(c == "text", F.col("p_name")) \
        .when(c == "error", F.lit("#DIV/0!")).when(c == "boolean", F.when(F.col("p_size") > 25, "TRUE").otherwise("FALSE"))


SHEET_SQL = """(select p_partkey, p_brand, p_size, p_retailprice, case when p_size%5=0 then null when p_size%7=0 then '#DIV/0!' when p_size%3=0 then p_name
 when p_size%4=0 then case when p_size>25 then 'TRUE' else 'FALSE' end else printf('%.2f', p_retailprice) end v from part)"""


def sheet(spark, sf):
    return cells(spark, sf).withColumn("v", sheet_text(F.col("kind")))


_CRIT = {
    "gt": (">1000", "coalesce(try_cast(v as double)>1000, false)"),
    "eq_num": ("950.5", "coalesce(try_cast(v as double)=950.5, false)"),
    "ne_num": ("<>950.5", "coalesce(try_cast(v as double)<>950.5, true)"),
    "wild": ("*ring", "coalesce(regexp_matches(v, '(?is)^.*ring$'), false)"),
    "wild_one": ("=red ?o*", "coalesce(regexp_matches(v, '(?is)^red .o.*$'), false)"),
    "ne_text": ("<>small ring", "coalesce(lower(v)<>'small ring', true)"),
    "blank_or_empty": ("", "v is null or v=''"),
    "blank": ("=", "v is null"),
    "not_blank": ("<>", "v is not null"),
    "text_ge": (">=m", "coalesce(lower(v)>='m', false)"),
    "zero": (None, "coalesce(try_cast(v as double)=0, false)"),
}


@query("criteria_match", "select p_brand, " + ", ".join(f"count(*) filter ({sql}) {k}" for k, (_, sql) in _CRIT.items()) +
       f" from {SHEET_SQL} group by 1")
def _(spark, sf):
    d = sheet(spark, sf)
    return d.groupBy("p_brand").agg(*[F.count_if(fl.criteria_match(F.col("v"), c)).alias(k) for k, (c, _) in _CRIT.items()])


@query("wildcard_match", r"""select p_partkey, regexp_matches(p_name, '(?is)^b.*t$') whole, regexp_matches(p_name, '(?is)e.[rw]?') part_, p_name like '%*%' star
 from part where regexp_matches(p_name, '(?is)^b.*t$') or regexp_matches(p_name, '(?is)d w.d')""".replace("'(?is)e.[rw]?'", "'(?is)d w.d'"))
def _(spark, sf):
    n = F.col("p_name")
    whole, part, star = fl.wildcard_match(n, "b*t"), fl.wildcard_match(n, "d w?d", whole=False), fl.wildcard_match(n, "~*", whole=False)
    return table(spark, sf, "part").where(whole | part).select("p_partkey", whole.alias("whole"), part.alias("part_"), star.alias("star"))


@query("filter_values", "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus in ('F','P') and o_orderpriority in ('1-URGENT','5-LOW')")
def _(spark, sf):
    return fl.filter_values(table(spark, sf, "orders"), {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "5-LOW"]}) \
        .select("o_orderkey", "o_orderstatus", "o_orderpriority")


_ERRORS_SQL = ", ".join(f"'{e}'" for e in ERRORS)

_CUSTOM = [
    ("eq_pattern", ("p_name", ("eq", "*re?*")), "regexp_matches(p_name, '(?is)^.*re..*$')"),
    ("ne_pattern", ("p_type", ("ne", "s*")), "not regexp_matches(p_type, '(?is)^s.*$')"),
    ("eq", ("p_type", ("eq", "economy")), "lower(p_type)='economy'"),
    ("ne", ("p_type", ("ne", "economy")), "lower(p_type)<>'economy'"),
    ("gt_and_le", ("p_size", ("gt", 10), ("le", 20)), "p_size>10 and p_size<=20"),
    ("lt_or_ge", ("p_size", ("lt", 5), ("ge", 45), "or"), "p_size<5 or p_size>=45"),
    ("between", ("p_retailprice", ("between", 950, 1000)), "p_retailprice between 950 and 1000"),
    ("notBetween", ("p_retailprice", ("notBetween", 950, 1000)), "p_retailprice not between 950 and 1000"),
    ("begins", ("p_name", ("begins", "Red")), "starts_with(lower(p_name),'red')"),
    ("notBegins", ("p_name", ("notBegins", "Red")), "not starts_with(lower(p_name),'red')"),
    ("ends", ("p_name", ("ends", "BOLT")), "ends_with(lower(p_name),'bolt')"),
    ("notEnds", ("p_name", ("notEnds", "BOLT")), "not ends_with(lower(p_name),'bolt')"),
    ("contains_and", ("p_name", ("contains", "e"), ("notContains", "small")), "contains(lower(p_name),'e') and not contains(lower(p_name),'small')"),
]


@query("filter_custom", " union all ".join(f"select '{n}' rule, count(*) n, sum(p_partkey)::bigint keys from part where {s}" for n, _, s in _CUSTOM))
def _(spark, sf):
    p = table(spark, sf, "part")
    out = None
    for name, (column, *args), _ in _CUSTOM:
        hit = fl.filter_custom(p, column, *args).agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))
        out = hit if out is None else out.unionByName(hit)
    return out


_MOMENT = datetime(2024, 1, 15, 10, 30, 0)


@query("filter_date_group", " union all ".join(
    f"select '{u}' unit, count(*) n, min(event_id) first_id from events where date_trunc('{u}', ts)=date_trunc('{u}', timestamp '2024-01-15 10:30:00')"
    for u in ("year", "month", "day", "hour", "minute", "second")))
def _(spark, sf):
    e = table(spark, sf, "events")
    out = None
    for unit in ("year", "month", "day", "hour", "minute", "second"):
        hit = fl.filter_date_group(e, "ts", _MOMENT, unit).agg(F.lit(unit).alias("unit"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
        out = hit if out is None else out.unionByName(hit)
    return out


@query("range_slice", "select * from (select row_number() over (order by o_orderkey)-1 pos, o_custkey, o_totalprice from orders) where pos between 100 and 899")
def _(spark, sf):
    o = with_prefix(table(spark, sf, "orders"), [], [F.col("o_orderkey")], F.floor(F.col("o_orderkey") / 65536))
    return fl.range_slice(o, "pos", 100, 899, ["o_custkey", "o_totalprice"])


@query("search_text", """select p_partkey, 'p_name' "column", p_name "text" from part where contains(lower(p_name),'bolt') union all
 select p_partkey, 'p_brand', p_brand from part where contains(lower(p_brand),'bolt') union all select p_partkey, 'p_type', p_type from part where contains(lower(p_type),'bolt')""")
def _(spark, sf):
    return fl.search_text(table(spark, sf, "part"), "p_partkey", ["p_name", "p_brand", "p_type"], "Bolt")


@query("drop_unused", f"select p_partkey, v, q from (select p_partkey, p_brand, v, nullif(p_size, 10) q from {SHEET_SQL}) where (v is not null or q is not null) and p_brand<>'Brand#1'")
def _(spark, sf):
    d = sheet(spark, sf).withColumn("q", F.nullif("p_size", F.lit(10)))
    return fl.drop_unused(d, ["v", "q"], F.col("p_brand") != "Brand#1").select("p_partkey", "v", "q")


@query("is_ascending", """select event_type k, bool_and(coalesce(value>=p,true)) ascending from (select event_type, value, lag(value) over (partition by event_type order by event_id) p from events) group by 1
 union all select 'ids', bool_and(coalesce(event_id>=p,true)) from (select event_id, lag(event_id) over (order by ts, event_id) p from events)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    one = fl.is_ascending(e, ["event_type"], F.col("event_id"), "value", F.floor(F.col("event_id") / 65536)).withColumnRenamed("event_type", "k")
    two = fl.is_ascending(e.withColumn("k", F.lit("ids")), ["k"], F.struct("ts", "event_id"), "event_id", time_chunk(F.col("ts")))
    return one.unionByName(two)


@query("filter_top_n", """select 'items' part_, o_orderkey, o_totalprice from orders where o_totalprice >= (select min(o_totalprice) from (select o_totalprice from orders order by 1 desc limit 40))
 union all select 'percent', o_orderkey, o_totalprice from orders where o_totalprice >= (select min(o_totalprice) from (select o_totalprice, row_number() over (order by o_totalprice desc) r, count(*) over () n from orders) where r<=ceil(n*2/100))""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return fl.filter_top_n(o, "o_totalprice", 40).withColumn("part_", F.lit("items")).unionByName(
        fl.filter_top_n(o, "o_totalprice", 2, percent=True).withColumn("part_", F.lit("percent")))


@query("filter_bottom_n", """select 'items' part_, p_partkey, p_size from part where p_size <= (select max(p_size) from (select p_size from part order by 1 limit 45))
 union all select 'percent', p_partkey, p_size from part where p_size <= (select max(p_size) from (select p_size, row_number() over (order by p_size) r, count(*) over () n from part) where r<=ceil(n*3/100))""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return fl.filter_top_n(p, "p_size", 45, bottom=True).withColumn("part_", F.lit("items")).unionByName(
        fl.filter_top_n(p, "p_size", 3, percent=True, bottom=True).withColumn("part_", F.lit("percent")))


@query("filter_above_avg", "select c_custkey, c_acctbal from customer where c_acctbal > (select avg(c_acctbal) from customer)")
def _(spark, sf):
    return fl.filter_average(table(spark, sf, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query("filter_below_avg", "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_quantity < (select avg(l_quantity) from lineitem)")
def _(spark, sf):
    return fl.filter_average(table(spark, sf, "lineitem"), "l_quantity", above=False).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_RULES = {
    "eq": ("p_size", "eq", (10,), "p_size=10"), "ne": ("p_size", "ne", (10,), "p_size<>10"), "gt": ("p_size", "gt", (40,), "p_size>40"),
    "ge": ("p_size", "ge", (40,), "p_size>=40"), "lt": ("p_size", "lt", (5,), "p_size<5"), "le": ("p_size", "le", (5,), "p_size<=5"),
    "bt": ("p_size", "between", (10, 12), "p_size between 10 and 12"), "nbt": ("p_size", "notBetween", (10, 40), "p_size not between 10 and 40"),
    "has": ("v", "contains", ("ring",), "contains(lower(v),'ring')"), "hasnt": ("v", "notContains", ("ring",), "not contains(lower(v),'ring')"),
    "starts": ("v", "startsWith", ("b",), "starts_with(lower(v),'b')"), "ends": ("v", "endsWith", ("t",), "ends_with(lower(v),'t')"),
    "blank": ("v", "isBlank", (), "v is null or trim(v)=''"), "notblank": ("v", "notBlank", (), "v is not null and trim(v)<>''"),
    "err": ("v", "isError", (), f"v in ({_ERRORS_SQL})"), "noterr": ("v", "notError", (), f"v not in ({_ERRORS_SQL})"),
}


@query("flag_rules", "select p_partkey, " + ", ".join(f"coalesce({s}, false) {k}" for k, (_, _, _, s) in _RULES.items()) + f""",
 p_retailprice>p_size*25 expr, p_retailprice > (select avg(p_retailprice) from part) above, v is not null and count(v) over (partition by v)>1 is_duplicate,
 v is not null and count(v) over (partition by v)=1 is_unique,
 p_retailprice >= (select min(p_retailprice) from (select p_retailprice from part order by 1 desc limit 10)) top_ten from {SHEET_SQL}""")
def _(spark, sf):
    d = fl.flag_occurrence(sheet(spark, sf), "v")
    price = F.col("p_retailprice")
    top = d.select("p_retailprice").orderBy(price.desc()).limit(10).agg(F.min("p_retailprice")).scalar()
    return d.select(
        "p_partkey", *[fl.rule(F.col(c), kind, *args).alias(k) for k, (c, kind, args, _) in _RULES.items()],
        fl.rule(price, "expression", price > F.col("p_size") * 25).alias("expr"),
        (price > d.agg(F.avg("p_retailprice")).scalar()).alias("above"), "is_duplicate", "is_unique", (price >= top).alias("top_ten"))


_REF = "date '2024-01-17'"
_WK = f"({_REF} - cast(extract(dow from {_REF}) as int))"
_MO = f"date_trunc('month', {_REF})::date"
_PERIOD_SQL = {
    "yesterday": f"d={_REF}-1", "today": f"d={_REF}", "tomorrow": f"d={_REF}+1", "last7Days": f"d>{_REF}-7 and d<={_REF}",
    "lastWeek": f"d>={_WK}-7 and d<{_WK}", "thisWeek": f"d>={_WK} and d<{_WK}+7", "nextWeek": f"d>={_WK}+7 and d<{_WK}+14",
    "lastMonth": f"d>=({_MO} - interval 1 month) and d<{_MO}", "thisMonth": f"d>={_MO} and d<({_MO}+interval 1 month)",
    "nextMonth": f"d>=({_MO}+interval 1 month) and d<({_MO}+interval 2 month)",
}


@query("flag_time_period", "select event_type, " + ", ".join(f"count(*) filter ({s}) {p}" for p, s in _PERIOD_SQL.items()) +
       " from (select event_type, ts::date d from events) group by 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        *[F.count_if(fl.flag_time_period(F.col("ts"), "2024-01-17", p)).alias(p) for p in fl.PERIODS])


@query("scale_bucket", f"""with s as (select min(o_totalprice) lo, max(o_totalprice) hi from orders),
r as (select max(case when i=floor((n-1)*90/100) then v end) p90 from (select o_totalprice v, row_number() over (order by o_totalprice)-1 i, count(*) over () n from orders))
select o_orderkey, (o_totalprice>=lo)::int+(o_totalprice>=lo+(hi-lo)*33/100)::int+(o_totalprice>=300000)::int+(o_totalprice>=p90)::int+(o_totalprice>=hi)::int bucket,
 {sqlsig('(o_totalprice-lo)/(hi-lo)')} "position" from orders, s, r""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    d = fl.scale_bucket(o, "o_totalprice", [("min", 0), ("percent", 33), ("number", 300000), ("percentile", 90), ("max", 0)])
    return d.select("o_orderkey", "bucket", sig("position").alias("position"))


@query("validate_rules", """select o_orderkey, 'price' rule, printf('%.2f', o_totalprice) "value" from orders where not (o_totalprice between 2000 and 490000)
 union all select o_orderkey, 'status', o_orderstatus from orders where o_orderstatus not in ('F','O')
 union all select o_orderkey, 'day', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') from orders where not o_orderdate >= timestamp '1996-01-01'
 union all select o_orderkey, 'len', o_orderpriority from orders where length(o_orderpriority) > 8
 union all select o_orderkey, 'cust', o_custkey::varchar from orders where not (o_custkey < 700)""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    v = fl.validate_rules(o, "o_orderkey", [
        ("price", "o_totalprice", "decimal", "between", 2000.0, 490000.0), ("status", "o_orderstatus", "list", None, "F", "O"),
        ("day", "o_orderdate", "date", "ge", datetime(1996, 1, 1)), ("len", "o_orderpriority", "textLength", "le", 8),
        ("cust", "o_custkey", "whole", "lt", 700)])
    return v.withColumn("value", F.when(F.col("rule") == "price", F.format_string("%.2f", F.col("value").try_cast("double"))).otherwise(F.col("value")))


@query("column_profile", """
select 'o_totalprice' "column", count(*)>count(o_totalprice) has_blank, true has_number, bool_and(o_totalprice=floor(o_totalprice)) all_integer, false has_text, false long_text, false has_date,
 min(o_totalprice) min_value, max(o_totalprice) max_value, null::varchar min_date, null::varchar max_date from orders
union all select 'o_custkey', count(*)>count(o_custkey), true, true, false, false, false, min(o_custkey)::double, max(o_custkey)::double, null, null from orders
union all select 'o_orderpriority', count(*)>count(o_orderpriority), false, false, count(o_orderpriority)>0, max(length(o_orderpriority))>255, false, null, null, null, null from orders
union all select 'o_orderdate', count(*)>count(o_orderdate), false, false, false, false, true, null, null, strftime(min(o_orderdate),'%Y-%m-%d %H:%M:%S'), strftime(max(o_orderdate),'%Y-%m-%d %H:%M:%S') from orders""")
def _(spark, sf):
    return fl.column_profile(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], ["o_orderpriority"], ["o_orderdate"])


@query("count_if", "select o_orderpriority, count(*) filter (o_totalprice>250000) n from orders group by 1")
def _(spark, sf):
    return fl.count_ifs(table(spark, sf, "orders"), [fl.criteria_match(F.col("o_totalprice"), ">250000", "number")], ["o_orderpriority"])


@query("count_ifs", "select l_returnflag, count(*) filter (l_quantity<=10 and l_discount>0.05 and l_linestatus='O') n from lineitem group by 1")
def _(spark, sf):
    return fl.count_ifs(table(spark, sf, "lineitem"), [
        fl.criteria_match(F.col("l_quantity"), "<=10", "number"), fl.criteria_match(F.col("l_discount"), ">0.05", "number"),
        fl.criteria_match(F.col("l_linestatus"), "o")], ["l_returnflag"])


@query("tally_if", f"""select l_returnflag, {sqlsig('coalesce(sum(x),0)')} sum, {sqlsig('avg(x)')} average, min(x) min, max(x) max, count(x) count
 from (select l_returnflag, case when l_quantity>=25 and l_linestatus<>'F' then l_extendedprice end x from lineitem) group by 1""")
def _(spark, sf):
    t = fl.tally_if(table(spark, sf, "lineitem"), "l_extendedprice", [
        fl.criteria_match(F.col("l_quantity"), ">=25", "number"), fl.criteria_match(F.col("l_linestatus"), "<>F")], ["l_returnflag"])
    return t.withColumn("sum", sig("sum")).withColumn("average", sig("average"))


@query("agg_count_family", f"select p_brand, count(try_cast(v as double)) count_numbers, count(v) count_nonblank, count(*) filter (v is null or v='') count_blank from {SHEET_SQL} group by 1")
def _(spark, sf):
    return fl.count_family(sheet(spark, sf), "v", ["p_brand"])


def _family(v):
    return (f"{sqlsig(f'avg({v})')} average, max({v}) max, min({v}) min, {sqlsig(f'stddev_samp({v})')} stdev, {sqlsig(f'stddev_pop({v})')} stdevp, "
            f"{sqlsig(f'var_samp({v})')} var, {sqlsig(f'var_pop({v})')} varp")


def _family_cols(d, *keys):
    return d.select(*keys, "max", "min", *[sig(c).alias(c) for c in ("average", "stdev", "stdevp", "var", "varp")])


@query("agg_a_family", f"""select p_brand, {_family('x')} from (select p_brand, case kind when 'number' then p_retailprice when 'text' then 0.0::double
 when 'boolean' then (p_size>25)::int::double end x from (select *, {CELL_SQL[CELL_SQL.index('case'):CELL_SQL.index(' kind')]} kind from part)) group by 1""")
def _(spark, sf):
    d = cells(spark, sf)
    return _family_cols(fl.a_family(d, fl.cell_number(F.col("kind"), F.col("p_retailprice"), F.col("p_size") > 25), ["p_brand"]), "p_brand")


@query("agg_numeric", f"select c_mktsegment, {_family('c_acctbal')} , {sqlsig('median(c_acctbal)')} median from customer group by 1")
def _(spark, sf):
    from tallyloom.operators.stats import median
    c = table(spark, sf, "customer")
    m = median(c, ["c_mktsegment"], "c_acctbal").select("c_mktsegment", sig("median").alias("median"))
    return _family_cols(fl.a_family(c, F.col("c_acctbal"), ["c_mktsegment"]), "c_mktsegment").join(m, "c_mktsegment")


@query("dev_sq", f"select event_type, {sqlsig('var_pop(value)*count(value)')} dev_sq from events group by 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(sig(fl.dev_sq(F.col("value"))).alias("dev_sq"))


@query("geomean", f"""select p_type, {sqlsig('exp(avg(ln(p_retailprice)))')} geomean from part group by 1
 union all select c_mktsegment, case when min(c_acctbal)>0 then {sqlsig('exp(avg(case when c_acctbal>0 then ln(c_acctbal) end))')} end from customer group by 1""")
def _(spark, sf):
    a = table(spark, sf, "part").groupBy("p_type").agg(sig(fl.geomean(F.col("p_retailprice"))).alias("geomean"))
    return a.union(table(spark, sf, "customer").groupBy("c_mktsegment").agg(sig(fl.geomean(F.col("c_acctbal"))).alias("geomean")))


@query("totals_row", f"""select {sqlsig('sum(l_extendedprice)')} l_extendedprice, {sqlsig('avg(l_quantity)')} l_quantity, max(l_discount) l_discount, min(l_tax) l_tax,
 count(l_returnflag) l_returnflag, {sqlsig('stddev_samp(l_partkey)')} l_partkey, {sqlsig('var_samp(l_suppkey)')} l_suppkey, count(l_linenumber) l_linenumber, 'Total' "row" from lineitem""")
def _(spark, sf):
    t = fl.totals_row(table(spark, sf, "lineitem"), {
        "l_extendedprice": "sum", "l_quantity": "average", "l_discount": "max", "l_tax": "min", "l_returnflag": "count",
        "l_partkey": "stddev", "l_suppkey": "variance", "l_linenumber": "countNumbers"}, "Total")
    for c in ("l_extendedprice", "l_quantity", "l_partkey", "l_suppkey"):
        t = t.withColumn(c, sig(c))
    return t


@query("large_k", """select event_type, count(*) n, max(case when r=7 then value end) "value" from
 (select event_type, value, row_number() over (partition by event_type order by value desc) r from events) group by 1""")
def _(spark, sf):
    return fl.large_k(table(spark, sf, "events"), ["event_type"], "value", 7)


# --- sorts and limits -----------------------------------------------------------

@query("sort_typed", f"""select p_partkey, row_number() over (order by case kind when 'number' then 0 when 'text' then 1 when 'boolean' then 2 when 'error' then 3 else 4 end,
 case when kind='number' then p_retailprice end nulls last, case when kind='text' then lower(p_name) end nulls last, case when kind='boolean' then (p_size>25)::int end nulls last, p_partkey)-1 pos from {CELL_SQL}""")
def _(spark, sf):
    d = cells(spark, sf)
    k, num = F.col("kind"), F.when(F.col("kind") == "number", F.col("p_retailprice"))
    text, flag = F.when(k == "text", F.col("p_name")), F.when(k == "boolean", F.col("p_size") > 25)
    d = d.withColumn("cell", F.struct(k.alias("kind"), num.alias("num"), text.alias("text"), flag.alias("flag")))
    return so.sort_typed(d, "cell", "p_partkey", into="pos").select("p_partkey", "pos")


@query("sort_multi", """select o_orderkey, o_orderstatus, o_orderdate, o_totalprice,
 row_number() over (order by lower(o_orderstatus) nulls last, o_orderdate desc nulls last, o_totalprice nulls last, o_orderkey)-1 pos from orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    return so.sort_multi(o, [("o_orderstatus", True, True, False), ("o_orderdate", False, True, False), ("o_totalprice", True, True, False)], "o_orderkey", into="pos")


@query("limit_clamp", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 9000")
def _(spark, sf):
    return so.limit_clamp(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 9000)
