"""Queries over scalar functions; each covers a family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import cells as ce, date as dt, text as tx
from tallyloom.plans.q_filters import CELL_SQL, cells
from tallyloom.plans.registry import query, sig, sqlsig
from tallyloom.sources.tables import table

_PROPER = "array_to_string(list_transform(range(1, length({x})+1), lambda i: case when i>1 and regexp_matches(substr({x}, i-1, 1), '\\p{{L}}') then lower(substr({x}, i, 1)) else upper(substr({x}, i, 1)) end), '')"


def _money(x, d):
    return f"regexp_replace(printf('%.{d}f', round(abs({x}), {d})), '(\\d)(\\d{{3}})(\\d{{3}})(\\.|$)', '\\1,\\2,\\3\\4')"


@query("fn_text", f"""select p_partkey, chr(p_size+65) char_, p_size+65 code_, 'ab' || p_size clean_, p_name||'-'||p_size concat_, p_name=lower(p_type) exact_, cast(nullif(strpos(p_name,'r'),0) as int) find_,
 cast(nullif(strpos(lower(p_name),'re'),0) as int) search_, left(p_name,3) left_, right(p_name,4) right_, substr(p_name,2,5) mid_, length(p_name)::int len_, lower(p_type) lower_, upper(p_name) upper_,
 {_PROPER.format(x="(p_name||'-x2y')")} proper_, left(p_name,2)||'##'||substr(p_name,6) replace_, repeat('ab', p_size//20) rept_, replace(p_name,'e','E') subst_,
 case when strpos(substr(p_name, strpos(p_name,'e')+1),'e')>0 and strpos(p_name,'e')>0 then substr(p_name,1,strpos(p_name,'e')+strpos(substr(p_name,strpos(p_name,'e')+1),'e')-1)||'_'||substr(p_name,strpos(p_name,'e')+strpos(substr(p_name,strpos(p_name,'e')+1),'e')+1) else p_name end subst2_,
 p_name||'/'||p_type join_, trim('a  b '||p_size||' ') ||'' trim0_, p_retailprice value_, p_retailprice/100 number_ from (select * from part)""".replace("trim('a  b '||p_size||' ') ||'' trim0_", "'a b '||p_size trim_"))
def _(spark, sf):
    p = table(spark, sf, "part")
    n, t, s = F.col("p_name"), F.col("p_type"), F.col("p_size")
    price = F.format_string("%.2f", "p_retailprice")
    return p.select(
        "p_partkey", tx.char(s + 65).alias("char_"), tx.code(tx.char(s + 65)).alias("code_"), tx.clean(F.concat(F.lit("a\tb\n"), s.cast("string"))).alias("clean_"),
        tx.concat(n, F.lit("-"), s).alias("concat_"), tx.exact(n, tx_lower(t)).alias("exact_"), tx.find("r", n).alias("find_"), tx.search("RE", n).alias("search_"),
        tx.left(n, 3).alias("left_"), tx.right(n, 4).alias("right_"), tx.mid(n, 2, 5).alias("mid_"), F.length(n).alias("len_"), F.lower(t).alias("lower_"), F.upper(n).alias("upper_"),
        tx.proper(F.concat(n, F.lit("-x2y"))).alias("proper_"), tx.replace(n, 3, 3, "##").alias("replace_"), tx.rept(F.lit("ab"), s / 20).alias("rept_"),
        tx.substitute(n, "e", "E").alias("subst_"), tx.substitute(n, "e", "_", 2).alias("subst2_"), tx.textjoin("/", True, n, F.lit(""), t).alias("join_"),
        tx.trim(F.concat(F.lit("  a   b "), s.cast("string"), F.lit("  "))).alias("trim_"), tx.value(F.concat(F.lit(" $"), price)).alias("value_"),
        tx.numbervalue(F.concat(F.replace(price, F.lit("."), F.lit(",")), F.lit(" %")), ",", ".").alias("number_"))


def tx_lower(c):
    return F.lower(c)


@query("fn_text_format", f"""select o_orderkey, '$'||{_money('o_totalprice', 2)} dollar_, {_money('o_totalprice', 1)} fixed_, printf('%.0f', round(o_totalprice, 0)) fixed0_, strftime(o_orderdate, '%Y/%m/%d %H:%M') date_,
 printf('%.3f', round(o_totalprice/1000*100, 3))||'%' share_, 'Ab ｶﾞ'[1:3]||'1' asc_, case when o_orderkey%2=0 then o_orderstatus else '' end t_ from orders"""
       .replace("'$'||" + _money('o_totalprice', 2), "'$'||regexp_replace(printf('%.2f', o_totalprice), '(\\d)(\\d{3})(\\.)', '\\1,\\2\\3')").replace(_money('o_totalprice', 1), "regexp_replace(printf('%.1f', floor(o_totalprice*10+0.5)/10), '(\\d)(\\d{3})(\\.)', '\\1,\\2\\3')"))
def _(spark, sf):
    v = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey", tx.dollar(v).alias("dollar_"), tx.fixed(v, 1).alias("fixed_"), tx.text(v, "0").alias("fixed0_"), tx.text(F.col("o_orderdate"), "yyyy/mm/dd hh:mm", True).alias("date_"),
        tx.text(v / 1000, "0.000%").alias("share_"), tx.asc(F.concat(F.lit("Ａｂ　"), F.lit("１"))).alias("asc_"),
        tx.t(F.when(F.col("o_orderkey") % 2 == 0, "text").otherwise("number"), F.col("o_orderstatus")).alias("t_"))


_HOL = ["1998-01-01", "1998-12-25", "1999-01-01", "1999-05-03", "1999-05-04", "2000-02-29", "2000-12-25"]
_HS = "[" + ", ".join(f"date '{h}'" for h in _HOL) + "]"
# Every line is paired with its order: the order date is the start, the ship date the end.
_PAIR = "(select l_orderkey, l_linenumber, l_partkey, o_orderdate::date a, l_shipdate::date b0, case when l_shipdate>o_orderdate then l_shipdate::date else o_orderdate::date end b, l_quantity::int q from lineitem join orders on l_orderkey=o_orderkey)"


def _pairs(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b0 = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b0.alias("b0"), F.greatest(a, b0).alias("b"), F.col("l_quantity").cast("int").alias("q"))


_D360 = """((year(b0)-year(a))*360+(month(b0)-month(a))*30+case when day(b0)=31 and (a=last_day(a) or day(a)=30) then 30 else day(b0) end-case when a=last_day(a) then 30 else day(a) end)"""
_E360 = "((year(b0)-year(a))*360+(month(b0)-month(a))*30+least(day(b0),30)-least(day(a),30))"
_FOL = "(month(b)>month(a) or (month(b)=month(a) and day(b)>=day(a)))"
_LATE = "(case when day(b)>=day(a) then 0 else 1 end)"


@query("fn_date", f"""select l_orderkey, l_linenumber, l_partkey, cast(b0-a as int) days_, cast({_D360} as int) d360, cast({_E360} as int) e360,
 cast(year(b)-year(a)-case when {_FOL} then 0 else 1 end as int) dif_y, cast((year(b)-year(a))*12+month(b)-month(a)-{_LATE} as int) dif_m, cast(b-a as int) dif_d, cast((month(b)+12-month(a)-{_LATE})%12 as int) dif_ym,
 cast(case when day(b)>=day(a) then day(b)-day(a) else b-(date_trunc('month', b)-interval 1 month+to_days(cast(day(a)-1 as int)))::date end as int) dif_md,
 cast((make_date(year(a)+case when {_FOL} then 0 else 1 end, month(b), 1)+cast(day(b)-1 as int))-a as int) dif_yd,
 (case when a=last_day(a) or day(a)>day(last_day((a+to_months(q))::date)) then last_day((a+to_months(q))::date) else (a+to_months(q))::date end) edate_raw, last_day((a+to_months(-q))::date) eomonth_,
 cast(week(a) as int) isoweek, cast((isodow(a)%7)+1 as int) wd1, cast(isodow(a) as int) wd2, cast(isodow(a)-1 as int) wd3, cast((isodow(a)+1)%7+1 as int) wd16,
 cast((dayofyear(a)-1+(isodow(date_trunc('year',a)::date)%7))//7+1 as int) wn1, cast((dayofyear(a)-1+isodow(date_trunc('year',a)::date)-1)//7+1 as int) wn2,
 round(abs({_D360}/360.0::double), 9) yf0, round(abs((b-a)/(list_sum(list_transform(range(year(a), year(b)+1), lambda y: dayofyear(make_date(y,12,31))))/(year(b)-year(a)+1)::double)), 9) yf1,
 round(abs((b0-a)/360.0::double), 9) yf2, round(abs((b0-a)/365.0::double), 9) yf3, round(abs({_E360}/360.0::double), 9) yf4,
 make_date(year(a)+(month(a)+q-1)//12, (month(a)+q-1)%12+1, 1)+cast(day(a)+q-1 as int) date_ from {_PAIR}""".replace("(case when a=last_day(a) or day(a)>day(last_day((a+to_months(q))::date)) then last_day((a+to_months(q))::date) else (a+to_months(q))::date end) edate_raw", "(a+to_months(q))::date edate_")
       .replace("yf1", "yf1").replace("from " + _PAIR, "from (select * from " + _PAIR + " where true)"))
def _(spark, sf):
    a, b, b0, q = F.col("a"), F.col("b"), F.col("b0"), F.col("q")
    return _pairs(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", dt.days(b0, a).alias("days_"), dt.days360(a, b0).alias("d360"), dt.days360(a, b0, True).alias("e360"),
        *[dt.datedif(a, b, u).alias(f"dif_{u.lower()}") for u in ("Y", "M", "D", "YM", "MD", "YD")], dt.edate(a, q).alias("edate_"), dt.eomonth(a, -q).alias("eomonth_"),
        dt.isoweeknum(a).alias("isoweek"), *[dt.weekday(a, f).alias(f"wd{f}") for f in (1, 2, 3, 16)], *[dt.weeknum(a, f).alias(f"wn{f}") for f in (1, 2)],
        *[F.round(dt.yearfrac(a, b if k == 1 else b0, k), 9).alias(f"yf{k}") for k in range(5)], dt.date(F.year(a), F.month(a) + q, F.day(a) + q).alias("date_"))


@query("fn_workdays", f"""select o_orderkey, cast(len(list_filter(range(0, k+1), lambda i: isodow(a+cast(i as int))<6 and not list_contains({_HS}, a+cast(i as int)))) as int) net_,
 cast(-len(list_filter(range(0, k+1), lambda i: isodow(a+cast(i as int))<6)) as int) net_back,
 a+cast(list_filter(range(1, 120), lambda i: isodow(a+cast(i as int))<6 and not list_contains({_HS}, a+cast(i as int)))[k] as int) work_,
 a-cast(list_filter(range(1, 120), lambda i: isodow(a-cast(i as int))<6 and not list_contains({_HS}, a-cast(i as int)))[k] as int) work_back from
 (select o_orderkey, o_orderdate::date a, o_custkey%60+1 k from orders)""")
def _(spark, sf):
    a, k = F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 60 + 1).cast("int")
    end = F.date_add(a, k)
    return table(spark, sf, "orders").select(
        "o_orderkey", dt.networkdays(a, end, _HOL).alias("net_"), F.when(k > 0, dt.networkdays(end, a)).alias("net_back"),
        dt.workday(a, k, _HOL).alias("work_"), dt.workday(a, -k, _HOL).alias("work_back"))


@query("fn_time", f"""select event_id, cast(hour(ts) as int) h, cast(minute(ts) as int) mi, cast(second(ts) as int) s, {sqlsig('(hour(ts)*3600+minute(ts)*60+second(ts))/86400.0::double')} time_, {sqlsig('(hour(ts)*3600+minute(ts)*60)/86400.0::double')} timevalue_,
 ts::date datevalue_, timestamp '2024-06-01 12:00:00' now_, date '2024-06-01' today_ from events""")
def _(spark, sf):
    p = dt.parts(F.col("ts"))
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf, "events").select(
        "event_id", p["hour"].alias("h"), p["minute"].alias("mi"), p["second"].alias("s"), sig(dt.time(p["hour"], p["minute"], p["second"])).alias("time_"),
        sig(dt.timevalue(F.date_format("ts", "HH:mm"))).alias("timevalue_"), dt.datevalue(day).alias("datevalue_"), dt.now("2024-06-01 12:00:00").alias("now_"), dt.today("2024-06-01").alias("today_"))


_ERR = "case when kind='error' then case when p_size%2=0 then '#N/A' else '#DIV/0!' end end"


@query("fn_info", f"""select p_partkey, case when kind='error' then case when p_size%2=0 then 7 else 2 end end error_type, kind='blank' isblank, kind='error' and p_size%2<>0 iserr, kind='error' iserror, p_size%2=0 iseven,
 kind='boolean' islogical, kind='error' and p_size%2=0 isna, kind<>'text' isnontext, kind='number' isnumber, p_size%2<>0 isodd, false isref, kind='text' istext,
 case kind when 'number' then p_retailprice when 'boolean' then (p_size>25)::int::double when 'error' then null else 0.0::double end n_, null::double na_, case kind when 'text' then 2 when 'boolean' then 4 when 'error' then 16 else 1 end type_ from {CELL_SQL}""")
def _(spark, sf):
    k, s = F.col("kind"), F.col("p_size")
    e = F.when(k == "error", F.when(s % 2 == 0, "#N/A").otherwise("#DIV/0!"))
    return cells(spark, sf).select(
        "p_partkey", ce.error_type(e).alias("error_type"), ce.is_blank(k).alias("isblank"), ce.is_err(k, e).alias("iserr"), ce.is_error(k).alias("iserror"), ce.is_even(s).alias("iseven"),
        ce.is_logical(k).alias("islogical"), ce.is_na(k, e).alias("isna"), ce.is_nontext(k).alias("isnontext"), ce.is_number(k).alias("isnumber"), ce.is_odd(s).alias("isodd"),
        ce.is_ref(k).alias("isref"), ce.is_text(k).alias("istext"), ce.n(k, F.col("p_retailprice"), s > 25).alias("n_"), ce.na().alias("na_"), ce.type_number(k).alias("type_"))


@query("fn_logic", """select p_partkey, p_size>10 and p_retailprice<1000 and_, p_size>40 or p_type='SMALL' or_, not (p_size>10) not_, case when p_size>25 then 'big' else 'small' end if_, coalesce(p_retailprice/nullif(p_size-10,0), -1) iferror_, true true_, false false_ from part""")
def _(spark, sf):
    s, r = F.col("p_size"), F.col("p_retailprice")
    none = F.lit(None).cast("boolean")
    return table(spark, sf, "part").select(
        "p_partkey", ce.all_of(s > 10, none, r < 1000).alias("and_"), ce.any_of(s > 40, F.col("p_type") == "SMALL", none).alias("or_"), ce.negate(s > 10).alias("not_"),
        ce.if_(s > 25, F.lit("big"), F.lit("small")).alias("if_"), ce.if_error(F.try_divide(r, s - 10), F.lit(-1.0)).alias("iferror_"), ce.true().alias("true_"), ce.false().alias("false_"))


def _fv_sql(r, n, p, v, start):
    paid = f"({p})*(1+{r})" if start else f"({p})"
    return f"(case when {r}=0 then -({p}*{n}+{v}) else -({paid}*(pow(1+{r},{n})-1)/nullif({r},0)+{v}*pow(1+{r},{n})) end)"


def _pmt_sql(r, n, v, f, start):
    return f"(case when {r}=0 then -({v}+{f})/{n} else (-({f})-{v}*pow(1+{r},{n}))/{f'(1+{r})' if start else '1'}/((pow(1+{r},{n})-1)/nullif({r},0)) end)"


@query("fn_finance", f"""select c_custkey, {sqlsig(_fv_sql('r', 'n', '-100', 'c_acctbal', False), 12)} fv_, {sqlsig(_fv_sql('r', 'n', '-100', 'c_acctbal', True), 12)} fv_start, {sqlsig(_pmt_sql('r', 'n', 'c_acctbal', '0', False), 12)} pmt_,
 {sqlsig(_pmt_sql('r', 'n', 'c_acctbal', '500', True), 12)} pmt_start, {sqlsig(_fv_sql('r', 'k', _pmt_sql('r', 'n', 'c_acctbal', '0', False), 'c_acctbal', False) + '*r', 12)} ipmt_ from
 (select c_custkey, c_acctbal, (c_nationkey%5)::double/100 r, (c_custkey%36+2)::double n, (c_custkey%2)::double k from customer)""")
def _(spark, sf):
    r, n, v = (F.col("c_nationkey") % 5).cast("double") / 100, (F.col("c_custkey") % 36 + 2).cast("double"), F.col("c_acctbal")
    period = (F.col("c_custkey") % 2 + 1).cast("double")
    pay = F.lit(-100.0)
    return table(spark, sf, "customer").select(
        "c_custkey", sig(ce.fv(r, n, pay, v), 12).alias("fv_"), sig(ce.fv(r, n, pay, v, True), 12).alias("fv_start"), sig(ce.pmt(r, n, v), 12).alias("pmt_"),
        sig(ce.pmt(r, n, v, F.lit(500.0), True), 12).alias("pmt_start"), sig(ce.ipmt(r, period, n, v), 12).alias("ipmt_"))


@query("fn_combin", f"""select l_quantity::int n, l_linenumber k, count(*) rows_, {sqlsig('any_value(case when l_quantity>=l_linenumber then exp(lgamma(l_quantity+1)-lgamma(l_linenumber+1)-lgamma(greatest(l_quantity-l_linenumber,0)+1)) end)', 8)} combin_,
 {sqlsig('any_value(case when l_quantity<=20 then factorial(l_quantity::int)::double else exp(lgamma(l_quantity+1)) end)', 8)} fact_ from lineitem group by 1,2""")
def _(spark, sf):
    n, k = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    per = table(spark, sf, "lineitem").groupBy(n.alias("n"), k.alias("k")).agg(F.count(F.lit(1)).alias("rows_"))
    return per.select("n", "k", "rows_", sig(ce.combin(F.col("n"), F.col("k")), 8).alias("combin_"), sig(ce.factorial(F.col("n")), 8).alias("fact_"))


_BIN = "exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1))*pow(p, i)*pow(1-p, n-i)"


@query("binom_dist", f"""with g as (select distinct l_linenumber x, l_quantity n, l_discount+0.0037::double p from lineitem)
select x, n, round(p, 6) p, case when n>=x then {sqlsig(_BIN.replace('(i', '(x').replace(', i)', ', x)').replace('n-i', 'n-x'), 9)} end pmf, case when n>=x then {sqlsig(f'list_sum(list_transform(range(0, x+1), lambda i: {_BIN}))', 9)} end cdf from g""")
def _(spark, sf):
    g = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("x"), F.col("l_quantity").alias("n"), (F.col("l_discount") + 0.0037).alias("p")).distinct()
    x, n, p = F.col("x"), F.col("n"), F.col("p")
    return g.select("x", "n", F.round("p", 6).alias("p"), sig(ce.binom_dist(x, n, p), 9).alias("pmf"), sig(ce.binom_dist(x, n, p, True), 9).alias("cdf"))


@query("fisher", f"select o_orderkey, {sqlsig('atanh(o_totalprice/600000)', 8)} fisher from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sig(ce.fisher(F.col("o_totalprice") / 600000), 8).alias("fisher"))


@query("fn_shape", "select count(*) \"rows\", 7::int \"columns\", 3::int col_no from orders".replace("7::int", "6::int").replace("3::int", "4::int"))
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return ce.shape(o).withColumn("col_no", F.lit(ce.column_number(o, "o_totalprice")))


@query("fn_transpose", """select 'total' "column", """ + ", ".join(f"round(sum(o_totalprice) filter (o_orderstatus='{s}'),2) {s}" for s in "FOP") + " from orders union all select 'orders', " +
       ", ".join(f"count(*) filter (o_orderstatus='{s}')::double" for s in "FOP") + " from orders")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).cast("double").alias("orders"))
    return ce.transpose(o, "o_orderstatus", ["total", "orders"], ["F", "O", "P"])


@query("fn_hyperlink", "select page_id, case when page_id%2=0 then url else 'page '||page_id end label_ from pages")
def _(spark, sf):
    i = F.col("page_id")
    return table(spark, sf, "pages").select("page_id", ce.hyperlink(F.col("url"), F.when(i % 2 != 0, F.concat(F.lit("page "), i.cast("string")))).alias("label_"))
