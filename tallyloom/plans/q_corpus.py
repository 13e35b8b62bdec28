"""Queries over corpus diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import lexicon as lx
from tallyloom.functions.cells import ERRORS
from tallyloom.operators import corpus as co
from tallyloom.plans.derived import papers, papers_sql, quote
from tallyloom.plans.registry import query, sqlsig, sig
from tallyloom.sources.tables import table


def _strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _q(p):
    """A Java pattern as a DuckDB string literal."""
    return quote(p)


def _any(text, words):
    return "(" + " or ".join(f"contains(lower({text}), {quote(w.lower())})" for w in words) + ")"


def _canon(x):
    low = f"lower({_strip(x)})"
    return "case " + " ".join("when " + " or ".join(f"contains({low}, {quote(w.lower())})" for w in ws) + f" then '{n}'"
                              for n, ws in lx.SECTION_ALIASES.items()) + " else 'other' end"


_PAPER = papers_sql()
_NORM = _PAPER + f""",
norm as materialized (select doc_id, "text" raw, {_strip("regexp_replace(replace(regexp_replace(text, chr(13)||chr(10)||'?', chr(10), 'g'), '　', ' '), '[ \\t]+', ' ', 'g')")} t from paper),
ln as materialized (select doc_id, raw, t, string_split(t, chr(10)) l from norm)"""
_SECT = _NORM + f""",
li as (select doc_id, unnest(range(len(l))) i, {_strip('unnest(l)')} s from ln),
hd as (select doc_id, i, s, case when regexp_matches(s, {_q(lx.HEADING)}) then regexp_extract(s, {_q(lx.HEADING)}, 2) else {_strip("regexp_replace(s, '^#+', '')")} end h0 from li
 where length(s) between 1 and 80 and (regexp_matches(s, {_q(lx.HEADING)}) or (length(s)<=24 and {_canon('s')}<>'other'))),
h1 as (select doc_id, i, s, regexp_replace(h0, '^[ ：:]+|[ ：:]+$', '', 'g') title from hd),
h2 as (select h1.*, lead(i) over (partition by h1.doc_id order by i) nx, row_number() over (partition by h1.doc_id order by i)-1 rn from h1),
sec as materialized (
 select doc_id, cast(rn as int) section_no, title, cast(case when s[1]='#' then least(length(regexp_extract(s, '^#+')),3) when regexp_matches(s, '^\\d+\\.\\d+\\.\\d+') then 3 when regexp_matches(s, '^\\d+\\.\\d+') then 2 else 1 end as int) "level",
  {_canon('title')} canonical, cast(i+1 as int) start_line, cast(coalesce(nx, len(l)) as int) end_line, {_strip("array_to_string(l[i+2:coalesce(nx, len(l))], chr(10))")} body from h2 join ln using (doc_id)
 union all select doc_id, 0, '全文', 1, 'other', 1, cast(len(l) as int), t from ln where t<>'' and doc_id not in (select doc_id from h2))"""


@query("doc_sections", f"with {_SECT} select * from sec")
def _(spark, sf):
    return co.doc_sections(papers(spark, sf), "doc_id", "text")


@query("section_assign", f"""with {_SECT} select li.doc_id, cast(li.i+1 as int) line_no, l[li.i+1] line, arg_max(sec.title, sec.start_line) section
 from li join ln using (doc_id) left join sec on sec.doc_id=li.doc_id and sec.start_line<=li.i+1 group by li.doc_id, li.i, l[li.i+1]""")
def _(spark, sf):
    return co.section_assign(papers(spark, sf), "doc_id", "text")


_TITLE = f""",
tl as (select doc_id, list_filter(list_transform(l, lambda x: regexp_replace(x, '^[ #]+|[ #]+$', '', 'g')), lambda x: x<>'') b from ln),
ti as (select doc_id, b, coalesce(list_filter(b[1:8], lambda x: lower(x) not in ({', '.join(quote(w) for w in lx.TITLE_SKIP)}) and length(x)<=80)[1], b[1], '未识别标题') title from tl)"""


@query("doc_title_authors", f"with {_NORM}{_TITLE} select doc_id, title, array_to_string(list_filter(b[2:8], lambda x: regexp_matches(x, {_q(lx.AUTHOR_LINE)})), ' / ') authors from ti")
def _(spark, sf):
    return co.doc_title_authors(papers(spark, sf), "doc_id", "text").withColumn("authors", F.array_join("authors", " / "))


_ABS = f"""coalesce((select body from sec where sec.doc_id=ln.doc_id and canonical='abstract' order by start_line limit 1),
 {_strip(f"regexp_extract(t, {_q(lx.ABSTRACT_BODY)}, 1)")})"""


@query("doc_abstract", f"with {_SECT} select doc_id, {_ABS} abstract from ln")
def _(spark, sf):
    return co.doc_abstract(papers(spark, sf), "doc_id", "text")


_KW = f"list_filter(regexp_split_to_array(regexp_extract(t, {_q(lx.KEYWORD_BODY)}, 1), {_q(lx.KEYWORD_SPLIT)}), lambda x: x<>'')"


@query("doc_keywords", f"with {_NORM} select doc_id, cast(unnest(range(len(k))) as int) \"rank\", unnest(k) keyword from (select doc_id, {_KW} k from ln)")
def _(spark, sf):
    return co.doc_keywords(papers(spark, sf), "doc_id", "text")


@query("doc_tables", f"""with {_NORM},
li as (select doc_id, unnest(range(len(l))) i, {_strip('unnest(l)')} s from ln),
f as (select *, case when regexp_matches(s, {_q(lx.TABLE_CAPTION)}) then 1 else 0 end cap from li),
g as (select *, sum(cap) over (partition by doc_id order by i rows unbounded preceding) grp from f),
r as (select doc_id, grp, i, cap, s, list_transform(string_split(regexp_replace(s, '^\\|+|\\|+$', '', 'g'), '|'), lambda c: {_strip('c')}) cells,
 length(s)-length(replace(s,'|',''))>=2 and cap=0 isrow from g),
t as (select doc_id, grp, max(case when cap=1 then s end) cap, coalesce(max(case when cap=1 then i+1 end), 0) src,
 string_agg(array_to_string(cells, '¦'), '‖' order by i) filter (isrow and len(list_filter(cells, lambda c: not regexp_matches(c, {_q(lx.TABLE_RULE_CELL)})))>0) body from r group by 1,2),
k as (select *, row_number() over (partition by doc_id order by grp) n from t where cap is not null or body is not null)
select doc_id, cast(n as int) table_no, coalesce(cap, '表'||n) caption, cast(src as int) source_line, coalesce(body, '') body from k""")
def _(spark, sf):
    t = co.doc_tables(papers(spark, sf), "doc_id", "text")
    return t.select("doc_id", "table_no", "caption", "source_line", F.array_join(F.transform("rows", lambda r: F.array_join(r, "¦")), "‖").alias("body"))


# --- classification and diagnostics -------------------------------------------------

def _hits(words):
    return "list_filter([" + ", ".join(f"case when contains(lower(text), {quote(w.lower())}) then {quote(w)} end" for w in words) + "], lambda x: x is not null)"


_CLS = " union all ".join(f"select doc_id, {i} o, {quote(n)} \"label\", {len(w)} k, {_hits(w)} h from paper" for i, (n, w) in enumerate(lx.PAPER_CLASSES.items()))
_CLASSED = f"""cl as materialized (select doc_id, o, "label", cast(least(100, round_even(len(h)*100.0/k, 0)) as int) score, array_to_string(h, '、') hits from ({_CLS}))"""


@query("doc_classify", f"""with {_PAPER}, {_CLASSED} select doc_id, cast(row_number() over (partition by doc_id order by score desc, o) as int) "rank", "label", score, hits,
 case when score=0 then 'high' when score<50 then 'medium' else 'low' end risk from cl""")
def _(spark, sf):
    return co.doc_classify(papers(spark, sf), "doc_id", "text")


# Class words of the corpus language as a parameter, checked against the label table.
_EN = {"plain": ["the ", "that", "with"], "dense": ["tion", "ment", "ness", "able"], "link": ["http", "www", "@"], "code": ["{", "};", "def "]}


@query("classify_rank", f"""with s as (select d.doc_id, quality, o, "label", cast(least(100, round_even(len(h)*100.0/k, 0)) as int) score from labels join (""" +
       " union all ".join(f"select doc_id, {i} o, '{n}' \"label\", {len(w)} k, {_hits(w)} h from documents" for i, (n, w) in enumerate(_EN.items())) + """) d using (doc_id)),
r as (select *, row_number() over (partition by doc_id order by score desc, o) rk from s)
select quality, "label", count(*) n, sum(score)::bigint score from r where rk=1 group by 1,2""")
def _(spark, sf):
    best = co.doc_classify(table(spark, sf, "documents"), "doc_id", "text", _EN).where("rank = 1")
    return best.join(table(spark, sf, "labels"), "doc_id").groupBy("quality", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


def _check_sql():
    t, e, d = "text", lx.EVIDENCE_WORDS, lx.DATA_WORDS
    has = lambda n: f"list_contains(cs, '{n}')"
    design, claim = _any(t, lx.CAUSAL_DESIGN), _any(t, lx.CAUSAL_CLAIM)
    ev = {
        "question": _any(t, e["question"]), "object": _any(t, e["object"]), "concept": f"({has('theory')} or {_any(t, e['concept'])})",
        "hypothesis": _any(t, e["hypothesis"]), "variables": _any(t, e["variables"]), "causal_language": f"({design} or not {claim})",
        "material": f"({has('results')} and ({has('data')} or {_any(t, e['material'])}))", "no_overreach": f"not {_any(t, e['overreach'])}",
        "no_hype": f"not {_any(t, lx.NOVELTY)}", "theory_backed": f"not ({has('theory')} and not {has('data')} and not {has('results')})"}
    da = {n: _any(t, d[n]) for n in d}
    da["sample_size"] = f"regexp_matches(text, {_q(lx.SAMPLE_SIZE)})"
    da["qualitative"] = f"(not {_any(t, lx.QUALITATIVE)} and {_any(t, lx.MECHANISM_TALK)})"
    order = ["support", "source", "sample_size", "sampling", "operational", "instrument", "method", "robustness", "qualitative"]
    return ev, {n: da[n] for n in order}


_EV, _DA = _check_sql()
_FULL = f"""pc as materialized (select paper.*, coalesce(cs, []) cs from paper left join (select doc_id, list(canonical) cs from sec group by 1) using (doc_id))"""


def _rows_of(checks, src):
    return " union all ".join(f"select doc_id, '{n}' item, {c} ok, case when {c} then 'medium' else 'high' end priority from {src}" for n, c in checks.items())


@query("doc_evidence", f"with {_SECT}, {_FULL} {_rows_of(_EV, 'pc')}")
def _(spark, sf):
    return co.doc_evidence(papers(spark, sf), "doc_id", "text")


@query("doc_data_req", f"with {_PAPER} {_rows_of(_DA, 'paper')}")
def _(spark, sf):
    return co.doc_data_req(papers(spark, sf), "doc_id", "text")


_GAPS = "+".join(f"(case when {c} then 0 else 1 end)" for c in [*_EV.values(), *_DA.values()])
_GRADED = f"""gp as materialized (select doc_id, {_GAPS} gaps, top_match from pc join (select doc_id, max(score) top_match from cl group by 1) using (doc_id)),
gr as (select *, case when gaps<=2 and top_match>=50 then 'A' when gaps<=4 then 'B' when gaps<=7 then 'C' when top_match<20 then 'D' else 'E' end grade from gp)"""


@query("doc_gap_grade", f"with {_SECT}, {_FULL}, {_CLASSED}, {_GRADED} select doc_id, gaps, top_match, grade from gr")
def _(spark, sf):
    return co.doc_gap_grade(papers(spark, sf), "doc_id", "text")


@query("doc_charts_needed", f"with {_PAPER} " + " union all ".join(f"select doc_id, '{n}' item, {_any('text', w)} present from paper" for n, w in lx.CHART_WORDS.items()))
def _(spark, sf):
    return co.doc_charts_needed(papers(spark, sf), "doc_id", "text")


def _has(w):
    return f"contains(text, {quote(w)})"


_CLAIM, _DESIGN = _any("text", lx.CAUSAL_CLAIM), _any("text", lx.CAUSAL_DESIGN)
_SEM = [
    ("causal_without_design", "high", f"{_CLAIM} and not {_DESIGN}"), ("correlation_as_cause", "high", f"{_has('相关')} and {_CLAIM}"),
    ("mechanism_without_evidence", "medium", f"{_has('机制')} and not {_any('text', ['中介', '访谈', '过程追踪', '田野', '机制检验'])}"),
    ("mixed_methods_patchwork", "medium", f"source='src3' and not ({_has('问卷')} and ({_has('访谈')} or {_has('田野')} or {_has('编码')}))"),
    ("did_conditions", "high", f"({_has('DID')} or {_has('双重差分')}) and not {_any('text', ['平行趋势', '政策前', '政策后', '事件研究'])}"),
    ("psm_diagnostics", "medium", f"({_has('PSM')} or {_has('倾向得分')}) and not {_any('text', ['平衡性', 'common support', '匹配前后', '卡尺'])}"),
    ("empty_novelty", "medium", f"{_any('text', lx.NOVELTY)} and not {_any('text', ['不同于', '机制', '边界条件', '解释'])}"),
]


@query("doc_semantics", f"with {_PAPER}, h as (" + " union all ".join(f"select doc_id, '{n}' rule, '{r}' risk from paper where {c}" for n, r, c in _SEM) +
       ") select * from h union all select doc_id, 'none', 'low' from paper where doc_id not in (select doc_id from h)")
def _(spark, sf):
    return co.doc_semantics(papers(spark, sf), "doc_id", "text", F.when(F.col("source") == "src3", "混合方法研究").otherwise("其他"))


def _issues_sql():
    order = [("fatal", n, f"not {_EV[n]}") for n in ("causal_language", "material")]
    order += [("structural", n, f"not {c}") for n, c in _EV.items() if n not in ("causal_language", "material")]
    order += [("structural", f"data_{n}", f"not {c}") for n, c in _DA.items()]
    core = "[" + ", ".join(f"case when {c} then '{lv}:{n}' end" for lv, n, c in order) + "]"
    surf = (f"[case when {_any('text', ['具有重要意义', '填补空白', '重大理论价值', '创新性提出'])} then 'surface:novelty_claim' end, "
            "case when not list_contains(cs, 'results') or not regexp_matches(text, '(表|Table)\\s*\\d') then 'surface:few_tables' end]")
    return core, surf


_CORE, _SURF = _issues_sql()


@query("doc_quality", f"""with {_SECT}, {_FULL}, {_CLASSED}, {_GRADED},
qs as (select doc_id, list_filter({_CORE}, lambda x: x is not null) core, list_filter({_SURF}, lambda x: x is not null) surf from pc)
select doc_id, grade, case grade when 'A' then 'sound' when 'B' then 'strengthen' when 'C' then 'major revision' else 'redesign' end verdict,
 array_to_string(list_concat(core, surf), ',') issues, array_to_string(list_transform(core, lambda x: string_split(x, ':')[2]), ',') core_issues from qs join gr using (doc_id)""")
def _(spark, sf):
    d = co.doc_quality(papers(spark, sf), "doc_id", "text")
    return d.select("doc_id", "grade", "verdict", F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["level"], x["issue"])), ",").alias("issues"),
                    F.array_join("core_issues", ",").alias("core_issues"))


def _clean(x):
    a = f"regexp_replace({_strip(x)}, '[\"''“”‘’（）()]', '', 'g')"
    return f"regexp_replace(regexp_replace({a}, '^(本文|本研究|主要|核心)', ''), '^[ ：:，,。；;]+|[ ：:，,。；;]+$', '', 'g')"


_ROLE_SQL = ", ".join(
    "list_transform(flatten(list_transform(regexp_extract_all(t, " + _q(name + r"(?:为|是|包括|：|:)\s*([^。；;\n]+)") +
    f", 1), lambda b: regexp_split_to_array(b, {_q('[、，,及和与' + chr(92) + 's]+')}))), lambda x: struct_pack(l := {_clean('x')}, r := '{role}'))"
    for role, name in lx.VARIABLE_ROLES.items())
_PAIR_SQL = ", ".join(
    f"flatten(list_transform(list_zip(regexp_extract_all(t, {_q(p)}, 1), regexp_extract_all(t, {_q(p)}, 2)), "
    f"lambda z: [struct_pack(l := {_clean('z[1]')}, r := '自变量'), struct_pack(l := {_clean('z[2]')}, r := '因变量')]))" for p in (lx.EFFECT_OF, lx.AFFECTS))


@query("var_candidates", f"""with {_SECT}{_TITLE},
sc as (select ln.doc_id, concat_ws(chr(10), title, {_ABS}, array_to_string({_KW}, '、'), raw) t from ln join ti on ti.doc_id=ln.doc_id),
ca as (select doc_id, t, flatten([{_ROLE_SQL}, {_PAIR_SQL}]) c from sc),
cb as (select doc_id, case when (contains(t,'DID') or contains(t,'双重差分')) and len(list_filter(c, lambda x: x.r='处理组变量'))=0 then
 list_concat(c, [struct_pack(l := '处理组', r := '处理组变量'), struct_pack(l := '政策后时期', r := '时间变量'), struct_pack(l := '政策冲击', r := '政策冲击变量')]) else c end c from ca),
cc as (select doc_id, unnest(range(len(c))) i, unnest(c) v from cb),
cd as (select doc_id, v.l l, v.r r, min(i) i from cc where v.l<>'' and v.l not in ({', '.join(quote(w) for w in lx.VARIABLE_STOP)}) group by 1,2,3),
ce as (select *, row_number() over (partition by doc_id order by i) k from cd)
select doc_id, cast(k as int) "rank", l "label", r "role" from ce""")
def _(spark, sf):
    return co.var_candidates(papers(spark, sf), "doc_id", "text")


# --- references ------------------------------------------------------------------------

_REFS = f"""rb as (select doc_id, "text", regexp_extract(text, {_q(lx.REFERENCE_HEADING)}) m from paper),
rc as (select doc_id, case when m='' then '' else substr(text, strpos(text, m)+length(m)) end b from rb),
rd as (select doc_id, b, regexp_extract(b, {_q(lx.BACK_MATTER)}) m from rc),
re_ as (select doc_id, {_strip("case when m='' then b else substr(b, 1, strpos(b, m)-1) end")} b from rd),
rl as (select doc_id, unnest(range(len(string_split(b, chr(10))))) i, {_strip('unnest(string_split(b, chr(10)))')} s from re_),
rm as (select * from rl where s<>''),
rn as (select *, case when row_number() over (partition by doc_id order by i)=1 or regexp_matches(s, {_q(lx.ENTRY_START)}) then 1 else 0 end st from rm),
ro as (select *, sum(st) over (partition by doc_id order by i rows unbounded preceding) e from rn),
ent as materialized (select doc_id, cast(e as int) entry_no, string_agg(s, ' ' order by i) entry from ro group by 1,2)"""


@query("ref_extract", f"with {_PAPER}, {_REFS} select * from ent")
def _(spark, sf):
    return co.ref_extract(papers(spark, sf), "doc_id", "text")


def _edge(x, chars):
    return f"regexp_replace({x}, '^[{chars}]+|[{chars}]+$', '', 'g')"


_PARSED = f"""pa as (select *, {_strip(f"regexp_replace(entry, {_q(lx.ENTRY_NUMBER)}, '')")} body, regexp_extract(entry, '(?:19|20)\\d{{2}}') "year" from ent),
pb as (select *, case when body='' then '' when contains(body,'.') then {_strip("string_split(body,'.')[1]")} when contains(body,'，') then {_strip("string_split(body,'，')[1]")}
 when contains(body,',') then {_strip("string_split(body,',')[1]")} when regexp_matches(body, '(?:19|20)\\d{{2}}') then {_edge("regexp_split_to_array(body, '(?:19|20)[0-9]{2}')[1]", ' .，,()（）')}
 when length(body)<=60 then body else '' end author_hint from pa),
pc_ as (select *, {_strip("substr(body, length(regexp_split_to_array(body, '[.。]')[1])+2)")} sec_, regexp_replace(body, '[\\(（]?(?:19|20)\\d{{2}}[\\)）]?[.，, ]*', '', 'g') ny from pb),
pd_ as (select *, case when regexp_matches(body,'[.。]') and sec_<>'' then sec_ else {_edge("case when author_hint='' then ny else replace(ny, author_hint, '') end", ' .，,')} end title_hint from pc_),
prs as materialized (select doc_id, entry_no, entry, coalesce(nullif(regexp_extract(entry, {_q(lx.ENTRY_NUMBER)}, 1), ''), regexp_extract(entry, {_q(lx.ENTRY_NUMBER)}, 2)) "number", "year",
 regexp_extract(entry, {_q(lx.DOI_PATTERN)}) doi, author_hint, title_hint,
 array_to_string(list_filter([case when "year"='' then 'year missing' end, case when length(body)<12 then 'too short' end, case when author_hint='' then 'author unclear' end,
 case when title_hint='' then 'title unclear' end], lambda x: x is not null), '; ') risks from pd_)"""


@query("ref_parse", f"with {_PAPER}, {_REFS}, {_PARSED} select * from prs")
def _(spark, sf):
    return co.ref_parse(co.ref_extract(papers(spark, sf), "doc_id", "text"))


_LINES = "ls as (select doc_id, unnest(range(len(string_split(text, chr(10))))) i, unnest(string_split(text, chr(10))) line from paper)"


@query("cite_inline", f"with {_PAPER}, {_LINES} " + " union all ".join(
    f"select doc_id, cast(i+1 as int) line_no, {n} form, unnest(regexp_extract_all(line, {_q(p)})) citation from ls" for n, p in enumerate(lx.INLINE_CITATIONS, 1)))
def _(spark, sf):
    return co.cite_inline(papers(spark, sf), "doc_id", "text")


_CROSS = f"""cn as (select distinct doc_id, unnest(regexp_extract_all(text, '\\[(\\d+)\\]', 1)) n from paper),
en as (select distinct doc_id, "number" n from prs where "number"<>''),
cx as (select 'cited_not_listed' problem, doc_id, n::bigint n from cn where doc_id in (select doc_id from en) and not exists (select 1 from en where en.doc_id=cn.doc_id and en.n=cn.n)
 union all select 'listed_not_cited', doc_id, n::bigint from en where doc_id in (select doc_id from cn) and not exists (select 1 from cn where en.doc_id=cn.doc_id and en.n=cn.n)),
cy as (select * from cx)"""


@query("cite_crosscheck", f"with {_PAPER}, {_REFS}, {_PARSED}, {_CROSS} select doc_id, problem, n \"number\" from cy")
def _(spark, sf):
    return co.cite_crosscheck(papers(spark, sf), "doc_id", "text")


_INL = "(" + " or ".join(f"regexp_matches(text, {_q(p)})" for p in lx.INLINE_CITATIONS) + ")"


@query("ref_risks", f"""with {_PAPER}, {_REFS}, {_PARSED}, ca as (select doc_id, n from (select distinct doc_id, unnest(regexp_extract_all(text, '\\[(\\d+)\\]', 1)) n from paper where {_INL})),
ea as (select distinct doc_id, "number" n from prs where "number"<>''), both_ as (select doc_id from paper where {_INL} and doc_id in (select doc_id from ent)),
cx as (select 'cited_not_listed' risk, doc_id, n::bigint n from ca where doc_id in (from both_) and not exists (select 1 from ea where ea.doc_id=ca.doc_id and ea.n=ca.n)
 union all select 'listed_not_cited', doc_id, n::bigint from ea where doc_id in (from both_) and not exists (select 1 from ca where ea.doc_id=ca.doc_id and ea.n=ca.n))
select doc_id, 'no_list' risk, 'references' place from paper where doc_id not in (select doc_id from ent)
union all select doc_id, 'no_citations', 'text' from paper where not {_INL}
union all select doc_id, 'format', entry_no::varchar from prs where risks<>''
union all select doc_id, risk, n::varchar from cx
union all select doc_id, 'not_verified', 'all' from paper""")
def _(spark, sf):
    return co.ref_risks(papers(spark, sf), "doc_id", "text")


_KEYS = f"""kg as (select doc_id, regexp_extract_all(text, {_q(lx.CITE_GROUP)}, 1) g from paper),
kf as (select doc_id, flatten(list_transform(g, lambda x: list_transform(string_split(x, ';'), lambda k: regexp_replace({_strip('k')}, '^@', '')))) k from kg),
ku as materialized (select doc_id, k, min(i) i from (select doc_id, unnest(range(len(k))) i, unnest(k) k from kf) group by 1,2),
ko as materialized (select doc_id, k cite_key, cast(row_number() over (partition by doc_id order by i) as int) "number" from ku)"""


@query("cite_order", f"with {_PAPER}, {_KEYS} select * from ko")
def _(spark, sf):
    return co.cite_order(papers(spark, sf), "doc_id", "text")


# The corpus has three keys, so the numbers of a group can be stated by direct replacement.
@query("cite_resolve", f"""with {_PAPER}, {_KEYS}, m as (select doc_id, max(case when cite_key='k1' then "number" end) a, max(case when cite_key='k2' then "number" end) b, max(case when cite_key='k3' then "number" end) c from ko group by 1)
select doc_id, md5(case when m.doc_id is null then text else replace(replace(text, '[@k1; @k2]', '['||coalesce(a,0)||','||coalesce(b,0)||']'), '[@k3]', '['||coalesce(c,0)||']') end) digest from paper left join m using (doc_id)""")
def _(spark, sf):
    return papers(spark, sf).select("doc_id", F.md5(co.cite_resolve(F.col("text"))).alias("digest"))


@query("cite_missing", f"with {_PAPER}, {_KEYS} select doc_id, cite_key from ko where cite_key not in (select case when s_nationkey<18 then 'k' else 'old' end||s_suppkey from supplier)")
def _(spark, sf):
    refs = table(spark, sf, "supplier").select(F.concat(F.when(F.col("s_nationkey") < 18, "k").otherwise("old"), F.col("s_suppkey").cast("string")).alias("ref"))
    return co.cite_missing(papers(spark, sf), "doc_id", "text", refs, "ref")


@query("cite_uncited", f"with {_PAPER}, {_KEYS} select 'k'||s_suppkey \"ref\", s_name from supplier where 'k'||s_suppkey not in (select cite_key from ko)")
def _(spark, sf):
    refs = table(spark, sf, "supplier").select(F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("ref"), "s_name")
    return co.cite_uncited(papers(spark, sf), "text", refs, "ref")


@query("keys_except", "select distinct c_nationkey k from customer except select case when s_acctbal>5000 then s_nationkey end from supplier")
def _(spark, sf):
    return co.keys_except(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")),
                          table(spark, sf, "supplier").select(F.when(F.col("s_acctbal") > 5000, F.col("s_nationkey")).alias("k")), ["k"])


_HEADLINE, _QPAT = r"^(#|\d+\.|第)", r"\((\w+ et al)\.,"


@query("batch_queries", f"""with {_PAPER}, {_LINES}, h as (select *, case when regexp_matches(line, {_q(_HEADLINE)}) then line end hd from ls),
s as (select *, coalesce(last_value(hd ignore nulls) over (partition by doc_id order by i rows unbounded preceding), '') section from h)
select doc_id, section, q "query", count(*) uses from (select doc_id, section, unnest(regexp_extract_all(line, {_q(_QPAT)}, 1)) q from s where hd is null) group by all""")
def _(spark, sf):
    return co.batch_queries(papers(spark, sf), "doc_id", "text", _QPAT, _HEADLINE)


# --- scans -------------------------------------------------------------------------------

_FILES = _PAPER + """,
fl as materialized (select 'd'||doc_id f, 'txt' ext, source p, "text" from paper union all select 'p'||page_id, 'html', url, html from pages
 union all select 'c'||conv_id||'-'||turn, 'md', role, "text" from conversations),
fx as (select f, ext, p, unnest(range(len(string_split(text, chr(10))))) i, unnest(string_split(text, chr(10))) line from fl)"""
_GUARD = {"EMAIL_EXPOSED": f"not starts_with({_strip('line')}, '//')", "UNSAFE_INNERHTML": f"not regexp_matches(line, {_q(lx.INNERHTML_SAFE)})",
          "HTTP_URL": "not regexp_matches(regexp_extract(line, 'http://[^\\s\"''<>]+'), 'localhost|127\\.0\\.0\\.1')"}
_FOUND = " union all ".join(
    f"select f file, p, '{r}' rule, {s} severity, cast(i+1 as int) line_no from fx where regexp_matches(line, {_q(p)})" +
    (f" and ext in ({', '.join(quote(x) for x in k)})" if k else "") + (f" and {_GUARD[r]}" if r in _GUARD else "") for r, s, p, k in lx.SECRET_RULES)


def _files(spark, sf):
    d = papers(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.lit("txt").alias("ext"), F.col("source").alias("p"), "text")
    p = table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file"), F.lit("html").alias("ext"), F.col("url").alias("p"), F.col("html").alias("text"))
    c = table(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("file"),
                                                 F.lit("md").alias("ext"), F.col("role").alias("p"), "text")
    return d.unionByName(p).unionByName(c)


@query("secret_scan", f"with {_FILES} select file, rule, severity, line_no from ({_FOUND})")
def _(spark, sf):
    return co.secret_scan(_files(spark, sf), "file", "text", F.col("ext"))


@query("dedupe_findings", f"""with {_FILES}, a as ({_FOUND}), b as (select *, row_number() over (partition by file, rule order by severity desc, line_no) k from a)
select file, rule, severity, line_no from b where k=1""")
def _(spark, sf):
    return co.dedupe_findings(co.secret_scan(_files(spark, sf), "file", "text", F.col("ext")), "file")


@query("allowlist_filter", f"with {_FILES} select distinct file, rule from ({_FOUND}) where not (starts_with(lower(p),'src1') or starts_with(lower(p),'http://m.'))")
def _(spark, sf):
    kept = co.allowlist_filter(_files(spark, sf), "p", ["src1", "http://m."])
    return co.secret_scan(kept, "file", "text", F.col("ext")).select("file", "rule").distinct()


_LEAK_SRC = """(select event_id, case event_type when 'click' then 'A' when 'view' then 'Artifact-'||user_id when 'error' then 'Baseline '||user_id when 'signup' then 'output-'||user_id else 'new_skill_v2' end lab,
 '/runs/'||case when user_id%3=0 then 'control' when user_id%3=1 then 'arm' else 'With_Skill' end||'/'||event_type pth, '{"version":"'||user_id||'","k":"'||event_type||'"}' meta from events)"""


@query("label_leakage", f"""select event_id, coalesce(regexp_matches(lab,'^[A-Z]$') or starts_with(lower(lab),'artifact-') or starts_with(lower(lab),'output-'), false) anonymous,
 {_any('lab', lx.LEAK_FIELDS)} label_leaks, list_has_any(string_split(lower(pth),'/'), [{', '.join(quote(s) for s in lx.LEAK_SEGMENTS)}]) path_leaks, 1 leaking_keys,
 '{{"k":"'||(meta->>'k')||'","_blind_anonymized":"true"}}' clean_meta from {_LEAK_SRC}""")
def _(spark, sf):
    u, t = F.col("user_id"), F.col("event_type")
    us = u.cast("string")
    e = table(spark, sf, "events").select(
        "event_id", F.when(t == "click", "A").when(t == "view", F.concat(F.lit("Artifact-"), us)).when(t == "error", F.concat(F.lit("Baseline "), us))
        .when(t == "signup", F.concat(F.lit("output-"), us)).otherwise("new_skill_v2").alias("lab"),
        F.concat(F.lit("/runs/"), F.when(u % 3 == 0, "control").when(u % 3 == 1, "arm").otherwise("With_Skill"), F.lit("/"), t).alias("pth"),
        F.concat(F.lit('{"version":"'), us, F.lit('","k":"'), t, F.lit('"}')).alias("meta"))
    return co.label_leakage(e, "lab", "pth", "meta").select("event_id", "anonymous", "label_leaks", "path_leaks", "leaking_keys", "clean_meta")


@query("eval_readiness", """select conv_id, count(*) total, count(*) filter (not bad) ready, count(*) filter (bad) invalid, count(*) filter (not bad) needs_model, count(*) filter (e is null or trim(e)='') smoke_only
 from (select conv_id, lead(text) over (partition by conv_id order by turn) e, role<>'user' or "text" is null or trim("text")='' bad from conversations) group by 1""")
def _(spark, sf):
    from pyspark.sql import Window as W
    c = table(spark, sf, "conversations").select(
        "conv_id", F.when(F.col("role") == "user", F.col("text")).otherwise("  ").alias("p"), F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("e"))
    return co.eval_readiness(c, ["conv_id"], "p", "e")


_FORM = """(select l_orderkey, l_linenumber, l_partkey, case l_linenumber when 1 then '=A'||l_partkey||'/B2' when 2 then '=IFERROR(A1/B1,0)' when 3 then '=vlookup(A1,B:C,2)' else '=A1+B1' end fm,
 case when l_discount=0 then '#DIV/0!' else l_quantity::int::varchar end v from lineitem)"""


@query("formula_audit", f"""select l_orderkey, l_linenumber, l_partkey, 'unguarded' problem from {_FORM} where (contains(upper(fm),'/') or contains(upper(fm),'VLOOKUP')) and not contains(upper(fm),'IFERROR')
 union all select l_orderkey, l_linenumber, l_partkey, 'error_value' from {_FORM} where v in ({', '.join(quote(e) for e in ERRORS)})""")
def _(spark, sf):
    n = F.col("l_linenumber")
    f = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(n == 1, F.concat(F.lit("=A"), F.col("l_partkey").cast("string"), F.lit("/B2"))).when(n == 2, "=IFERROR(A1/B1,0)")
        .when(n == 3, "=vlookup(A1,B:C,2)").otherwise("=A1+B1").alias("fm"),
        F.when(F.col("l_discount") == 0, "#DIV/0!").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("v"))
    return co.formula_audit(f, ["l_orderkey", "l_linenumber", "l_partkey"], "fm", "v")


# --- text quality ---------------------------------------------------------------------------

_BAD = "[\\x{e000}-\\x{f8ff}\\x{fff0}-\\x{ffff}\\x{2400}-\\x{243f}\\x{2440}-\\x{245f}\\x{2800}-\\x{28ff}]"
_MARKED = "replace(replace(text, 'erst', chr(57345)||chr(65533)), 'onre', chr(10240))"


@query("text_quality", f"""with m as (select doc_id, {_MARKED} t from documents), n as (select doc_id, length(regexp_replace(t, '[\\s\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g')) c, length(t)-length(regexp_replace(t, '{_BAD}', '', 'g')) b from m)
select doc_id, cast(c as int) characters, cast(b as int) suspicious, {sqlsig('coalesce(b/nullif(c,0),0)')} ratio, {sqlsig('coalesce(least(1.0,b*1.5/nullif(c,0)),0)')} score from n""")
def _(spark, sf):
    t = F.replace(F.replace("text", F.lit("erst"), F.lit("\ue001\ufffd")), F.lit("onre"), F.lit("\u2800"))
    q = co.text_quality(table(spark, sf, "documents").withColumn("text", t), "doc_id", "text")
    return q.withColumn("ratio", sig("ratio")).withColumn("score", sig("score"))


_SRC_LINES = "sl as materialized (select source, doc_id, unnest(range(len(string_split(text, chr(10))))) i, len(string_split(text, chr(10))) n, unnest(string_split(text, chr(10))) line from documents)"
_BOIL = f"""{_SRC_LINES}, fp as (select source, doc_id, regexp_replace(lower({_strip('line')}), '\\s+', ' ', 'g') fp from sl),
pg as (select source, count(distinct doc_id) pages from sl group by 1),
bp as materialized (select source, fp, count(distinct doc_id) pages_with, any_value(pages) pages from fp join pg using (source) where length(fp) between 3 and 120 group by 1,2
 having any_value(pages)>=3 and count(distinct doc_id)>=greatest(2, any_value(pages)//{{d}}))"""


def _doc_lines(spark, sf):
    return table(spark, sf, "documents").select("source", "lang", "doc_id", F.size(F.split("text", "\n", -1)).alias("n"), F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


@query("boilerplate_lines", f"with {_BOIL.format(d=2)} select * from bp".replace("unnest(string_split(text, chr(10))) line from documents)",
       "unnest(list_transform(string_split(text, chr(10)), lambda x, k: case when k=1 and lang='en' then 'Running  HEAD '||source else x end)) line from documents)"))
def _(spark, sf):
    d = _doc_lines(spark, sf).withColumn("line", F.when((F.col("i") == 0) & (F.col("lang") == "en"), F.concat(F.lit("Running  HEAD "), F.col("source"))).otherwise(F.col("line")))
    return co.boilerplate_lines(d, "source", "doc_id", "line")


@query("boilerplate_drop", f"with {_BOIL.format(d=2)} select source, count(*) kept from sl where not (i<n*0.12 and exists (select 1 from bp where bp.source=sl.source and bp.fp=regexp_replace(lower({_strip('line')}), '\\s+', ' ', 'g'))) group by 1"
       .replace("unnest(string_split(text, chr(10))) line from documents)", "unnest(list_transform(string_split(text, chr(10)), lambda x, k: case when k=1 and lang='en' then 'Running  HEAD '||source else x end)) line from documents)"))
def _(spark, sf):
    d = _doc_lines(spark, sf).withColumn("line", F.when((F.col("i") == 0) & (F.col("lang") == "en"), F.concat(F.lit("Running  HEAD "), F.col("source"))).otherwise(F.col("line")))
    rep = co.boilerplate_lines(d, "source", "doc_id", "line")
    return co.drop_boilerplate(d, rep, "source", "line", F.col("i") < F.col("n") * 0.12).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
