"""Queries over bibliographic records, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import papers as pa
from tallyloom.plans.derived import papers, papers_sql
from tallyloom.plans.registry import query, sig, sqlsig
from tallyloom.sources import generate as ge, groups as gr, records as rc
from tallyloom.sources.tables import table

# Records of two providers over every document: pairs of documents share a DOI, the
# second provider writes DOIs and titles in another form.


def _title(c):
    return F.array_join(F.slice(F.split(F.get(F.split(c, "\n"), F.lit(0)), " "), 1, 6), " ")


_TITLE_SQL = "array_to_string((string_split(string_split(text, chr(10))[1], ' '))[1:6], ' ')"


def base(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    return d.select(
        i.alias("pos"), F.concat(F.lit("W"), s(i)).alias("id"), F.when(i % 3 != 0, F.concat(F.lit("10.1000/d"), s(F.floor(i / 2)))).alias("doi"),
        _title(F.col("text")).alias("title"), F.concat(F.lit("Author "), s(i % 97)).alias("first_author"),
        F.array(F.concat(F.lit("Author "), s(i % 97)), F.concat(F.lit("Co "), s(i % 13)), F.lit("Ed X"), F.lit("Ed Y")).alias("authors"),
        F.when(i % 11 != 0, (1990 + i % 35).cast("int")).alias("year"), (i * 7 % 400).cast("int").alias("citation_count"),
        F.concat(F.lit("Journal "), F.col("source")).alias("venue"), F.col("text").alias("abstract"), F.array("lang", "source").alias("keywords"),
        F.array(F.lit("openalex")).alias("retrieved_from"), (i % 2 == 0).alias("is_open_access"),
        F.create_map(F.lit("openalex"), F.concat(F.lit("W"), s(i))).alias("source_ids"), s(i % 50).alias("volume"), F.when(i % 4 == 0, s(i % 6)).alias("issue"))


_BASE = f"""b1 as materialized (select doc_id pos, 'W'||doc_id id, case when doc_id%3<>0 then '10.1000/d'||(doc_id//2) end doi, {_TITLE_SQL} title, 'Author '||(doc_id%97) first_author,
 ['Author '||(doc_id%97), 'Co '||(doc_id%13), 'Ed X', 'Ed Y'] authors, case when doc_id%11<>0 then cast(1990+doc_id%35 as int) end "year", cast(doc_id*7%400 as int) citation_count,
 'Journal '||source venue, text abstract, [lang, source] keywords, ['openalex'] retrieved_from, doc_id%2=0 is_open_access, map(['openalex'], ['W'||doc_id]) source_ids,
 cast(doc_id%50 as varchar) volume, case when doc_id%4=0 then cast(doc_id%6 as varchar) end issue from documents)"""


def both(spark, sf):
    one = pa.as_records(base(spark, sf))
    i = F.col("pos")
    s = lambda c: c.cast("string")
    two = base(spark, sf).select(
        (i + 1000000000).alias("pos"), F.concat(F.lit("C"), s(i)).alias("id"), F.when(i % 2 == 0, F.concat(F.lit("https://doi.org/10.1000/D"), s(F.floor(i / 2)), F.lit("."))).alias("doi"),
        F.concat(F.lit(" "), F.translate("title", "aest", "AEST")).alias("title"), "first_author", F.array("first_author", F.lit("ed x"), F.lit("Late Z")).alias("authors"), "year",
        F.when(i % 5 != 0, (i % 300).cast("int")).alias("citation_count"), F.array(F.lit("crossref")).alias("retrieved_from"), F.lit("Press").alias("publisher"),
        F.create_map(F.lit("crossref"), F.concat(F.lit("C"), s(i)), F.lit("openalex"), F.lit("x")).alias("source_ids"), F.lit("short").alias("abstract"))
    return pa.union_sources([one, pa.as_records(two)])


_BOTH = _BASE + """,
rec as materialized (select pos, id, doi, title, first_author, authors, "year", citation_count, venue, abstract, keywords, retrieved_from, is_open_access, source_ids, volume, issue, null::varchar publisher from b1
 union all select pos+1000000000, 'C'||pos, case when pos%2=0 then 'https://doi.org/10.1000/D'||(pos//2)||'.' end, ' '||translate(title,'aest','AEST'), first_author, [first_author, 'ed x', 'Late Z'], "year",
  case when pos%5<>0 then cast(pos%300 as int) end, null, 'short', [], ['crossref'], null, map(['crossref','openalex'], ['C'||pos, 'x']), null, null, 'Press' from b1)"""

_NT = lambda x: f"trim(regexp_replace(lower(regexp_replace(coalesce({x},''), '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g')), '\\s+', ' ', 'g'))"
_ND = lambda x: f"nullif(lower(regexp_replace(trim(regexp_replace(trim({x}), '(?i)^(https?://(dx\\.)?doi\\.org/|doi:)', '')), '[.,;]+$', '')), '')"
_CJK = lambda x: f"coalesce(regexp_matches({x}, '[\\x{{4e00}}-\\x{{9fff}}]'), false)"


@query("union_sources", f"with {_BOTH} select retrieved_from[1] provider, count(*) n, count(doi) dois, count(venue) venues, min(pos) first_pos from rec group by 1")
def _(spark, sf):
    return both(spark, sf).groupBy(F.get("retrieved_from", F.lit(0)).alias("provider")).agg(
        F.count(F.lit(1)).alias("n"), F.count("doi").alias("dois"), F.count("venue").alias("venues"), F.min("pos").alias("first_pos"))


@query("norm_text", f"select doc_id, md5({_NT('text')}) digest from (select doc_id, replace(text, ' ', chr(9)||' ') text from documents)")
def _(spark, sf):
    t = F.replace("text", F.lit(" "), F.lit("\t "))
    return table(spark, sf, "documents").select("doc_id", F.md5(pa.norm_text(t)).alias("digest"))


@query("norm_text_nfkc", f"select conv_id, turn, md5({_NT('text')}) digest from conversations")
def _(spark, sf):
    # the Arrow path on full-width letters must give what the plain letters give
    wide = F.translate("text", "abc", "ａｂｃ")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(pa.norm_text(wide)).alias("digest"))


@query("norm_doi", f"with {_BOTH} select pos, {_ND('doi')} doi from rec")
def _(spark, sf):
    return both(spark, sf).select("pos", pa.norm_doi(F.col("doi")).alias("doi"))


@query("has_cjk", f"with {papers_sql()} select doc_id, {_CJK('text')} cjk from paper")
def _(spark, sf):
    return papers(spark, sf).select("doc_id", pa.has_cjk(F.col("text")).alias("cjk"))


_EXPR = ("and", ("or", pa.term("SU", "Tion"), pa.term("TI", "the")), ("not", pa.term("KY", "de")), ("or", pa.between("YE", 2000, 2013), pa.term("CF", "350"), pa.term("DOI", "doi:10.1000/D7")))
_SU = _NT("concat_ws(' ', title, abstract, array_to_string(keywords,' '))")
_A, _B = f"contains({_SU}, 'tion')", f"contains({_NT('title')}, 'the')"
_K = f"contains({_NT(chr(39).join(['array_to_string(keywords,', ' ', ')']))}, 'de')"
_Y, _C, _D = '"year" between 2000 and 2013', "coalesce(citation_count,0)>=350", f"{_ND('doi')}='10.1000/d7'"
_COND = f"({_A} or {_B}) and not {_K} and (coalesce({_Y},false) or {_C} or coalesce({_D},false))"
_REASONS = f"""array_to_string(list_filter([case when {_A} then 'SU:Tion' end, case when not {_A} and {_B} then 'TI:the' end,
 case when not coalesce({_Y},false) and not {_C} and {_D} then 'DOI' end], lambda x: x is not null), '|')"""


@query("bool_filter", f"with {_BOTH} select pos from rec where {_COND}")
def _(spark, sf):
    return pa.bool_filter(both(spark, sf), _EXPR).select("pos")


@query("match_reasons", f"with {_BOTH} select pos, {_REASONS} reasons from rec where {_COND}")
def _(spark, sf):
    return pa.bool_filter(both(spark, sf), _EXPR).select("pos", F.array_join("match_reasons", "|").alias("reasons"))


_RECALL = ("and", ("or", pa.term("TI", "土壤"), pa.term("AB", "ment")), pa.term("FT", "anything"))


@query("bool_filter_recall", f"""with {_BOTH} select pos, 'TI:土壤(recall-cjk-mismatch)|FT unavailable; kept in recall mode for term ''anything''.' reasons from rec where not {_CJK('title')}""")
def _(spark, sf):
    return pa.bool_filter(both(spark, sf), _RECALL, recall=True).select("pos", F.array_join("match_reasons", "|").alias("reasons"))


_GROUPED = f"""tk as (select *, {_ND('doi')} nd, case when "year" is not null and {_NT('title')}<>'' and {_NT('first_author')}<>'' then concat_ws(chr(1), "year"::varchar, {_NT('title')}, {_NT('first_author')}, {_CJK('title')}) end k from rec),
ow as (select k, arg_min(nd, pos) o from tk where nd is not null and k is not null group by 1),
gp as materialized (select tk.*, coalesce('d:'||coalesce(nd, o), 't:'||tk.k, 'r:'||pos) gid from tk left join ow on ow.k=tk.k)"""


@query("dedupe_papers", f"with {_BOTH}, {_GROUPED} select pos, min(pos) over (partition by gid) leader, count(*) over (partition by gid) copies from gp")
def _(spark, sf):
    g = pa.dedupe_papers(both(spark, sf)).select("pos", "group_id")
    led = g.groupBy("group_id").agg(F.min("pos").alias("leader"), F.count(F.lit(1)).alias("copies"))
    return g.join(led, "group_id").select("pos", "leader", "copies")


def _union(col):
    return f"""(select string_agg(item, '|' order by p, i) from (select arg_min(item, struct_pack(p := pos, i := i)) item, min(pos) p, arg_min(i, struct_pack(p := pos, i := i)) i from
 (select pos, unnest({col}) item, unnest(range(len({col}))) i from gp g2 where g2.gid=m.gid) group by lower(item)))"""


def _first(c):
    return f"arg_min({c}, pos) filter (trim(coalesce({c},''))<>'') {c}"


_MERGED = f"""ml as (select gid, l, string_agg(item, '|' order by p, i) v from (select gid, l, lower(item) f, arg_min(item, struct_pack(p := pos, i := i)) item, min(pos) p, arg_min(i, struct_pack(p := pos, i := i)) i from
 (select gid, pos, 'a' l, unnest(authors) item, unnest(range(len(authors))) i from gp union all select gid, pos, 'k', unnest(keywords), unnest(range(len(keywords))) from gp
  union all select gid, pos, 'r', unnest(retrieved_from), unnest(range(len(retrieved_from))) from gp) group by gid, l, lower(item)) group by 1,2),
ms as (select gid, string_agg(k||'='||v, '|' order by k) ids from (select gid, k, arg_min(v, pos) v from (select gid, pos, unnest(map_keys(source_ids)) k, unnest(map_values(source_ids)) v from gp) group by 1,2) group by 1),
mg as materialized (select gp.gid, min(pos) pos, count(*) copies, {_first('doi')}, {_first('title')}, {_first('venue')}, {_first('publisher')}, {_first('volume')}, {_first('issue')}, {_first('first_author')},
 arg_max(abstract, struct_pack(l := length(abstract), p := -pos)) filter (trim(coalesce(abstract,''))<>'') abstract, arg_min("year", pos) filter ("year" is not null) "year",
 max(coalesce(citation_count,0)) citation_count, arg_max(is_open_access, pos) filter (is_open_access is not null) is_open_access from gp group by 1)"""


@query("merge_papers", f"""with {_BOTH}, {_GROUPED}, {_MERGED} select pos, copies, doi, title, venue, publisher, volume, issue, md5(abstract) abstract, "year", citation_count, is_open_access,
 coalesce(a.v,'') authors, coalesce(k.v,'') keywords, coalesce(r.v,'') retrieved_from, ids source_ids from mg left join ml a on a.gid=mg.gid and a.l='a' left join ml k on k.gid=mg.gid and k.l='k'
 left join ml r on r.gid=mg.gid and r.l='r' left join ms on ms.gid=mg.gid""")
def _(spark, sf):
    m = pa.merge_papers(pa.dedupe_papers(both(spark, sf)))
    ids = F.array_join(F.transform(F.array_sort(F.map_entries("source_ids")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return m.select("pos", "copies", "doi", "title", "venue", "publisher", "volume", "issue", F.md5("abstract").alias("abstract"), "year", "citation_count", "is_open_access",
                    *[F.array_join(c, "|").alias(c) for c in ("authors", "keywords", "retrieved_from")], ids.alias("source_ids"))


def _score_sql(concepts, reasons, weights, sources):
    cov = "(" + "+".join(f"contains(nt, '{c}')::int" for c in concepts) + f")/{len(concepts)}.0::double"
    w = weights
    return (f"least(1.0, greatest(0.0, {w[0]}*{cov} + {w[1]}*least(1.0,{reasons}/5.0::double) + {w[2]}*least(1.0,log10(coalesce(citation_count,0)+1)/3.0) + "
            f"{w[3]}*coalesce(least(1.0,greatest(0.0,1-greatest(0,2026-\"year\")/25.0::double)),0) + {w[4]}*least(1.0,{sources}/3.0::double)))")


@query("rank_papers", f"""with {_BOTH}, t as (select *, {_SU} nt from rec), s as (""" + " union all ".join(
    f"select '{p}' profile, pos, {_score_sql(['ment', 'tion', 'eux'], '0', w, 'len(retrieved_from)')} score, citation_count, \"year\", title from t" for p, w in pa.PROFILES.items()) + f""")
select profile, pos, {sqlsig('score', 8)} score, row_number() over (partition by profile order by round(score, 9) desc, coalesce(citation_count,0) desc, coalesce("year",0) desc, lower(coalesce(title,'')), pos) "rank" from s""")
def _(spark, sf):
    return pa.rank_positions(both(spark, sf), ["ment", "tion", "eux"]).select("profile", "pos", sig("relevance_score", 8).alias("score"), "rank")


@query("lit_search", f"""with {_BOTH}, fil as materialized (select *, {_REASONS} rs from rec where {_COND}), {_GROUPED.replace('from rec)', 'from fil)')},
rr as (select gid, count(distinct r) n from (select gid, unnest(string_split(rs,'|')) r from gp) where r<>'' group by 1), sr as (select gid, count(distinct s) n from (select gid, unnest(retrieved_from) s from gp) group by 1),
kw as (select gid, string_agg(i, ' ') v from (select distinct gid, unnest(keywords) i from gp) group by 1), {_MERGED[_MERGED.index('mg as'):]},
sc as (select mg.*, {_NT("concat_ws(' ', title, abstract, v)")} nt, coalesce(rr.n,0) rn, sr.n sn from mg left join rr using (gid) left join sr using (gid) left join kw using (gid)),
fs as (select *, {_score_sql(['the', 'tion'], 'rn', pa.PROFILES['balanced'], 'sn')} score from sc)
select pos, copies, {sqlsig('score', 8)} score from fs order by score desc, citation_count desc, coalesce("year",0) desc, lower(title), pos limit 40""")
def _(spark, sf):
    return pa.lit_search(both(spark, sf), _EXPR, limit=40).select("pos", "copies", sig("relevance_score", 8).alias("score"))


@query("concept_terms", f"with {_BOTH}, t as (select {_SU} nt from rec) select c concept, count(*) n from t, (values ('the'),('tion')) v(c) where contains(nt, c) group by 1")
def _(spark, sf):
    terms = pa.concept_terms(_EXPR)
    text = pa.norm_text(F.concat_ws(" ", "title", "abstract", F.array_join("keywords", " ")))
    hit = both(spark, sf).select(text.alias("t")).select(F.explode(F.array_compact(F.array(*[F.when(F.contains("t", F.lit(c)), F.lit(c)) for c in terms]))).alias("concept"))
    return hit.groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


# --- sinks -----------------------------------------------------------------------------

_VEN = "case when trim(coalesce(venue,''))<>'' then venue end"


@query("sink_citation", f"""with {_BOTH} select n "index", trim(n||'. '||array_to_string(authors[1:3], ', ')||case when len(authors)>3 then ', et al' else '' end||'. '||case when trim(title)='' then 'Untitled' else title end||'[J]. '||coalesce({_VEN}||', ','')||coalesce("year"::varchar,'')
 ||coalesce(', '||volume,'')||coalesce('('||issue||')','')||coalesce('. DOI: '||doi,'')) "value" from (select *, row_number() over (order by pos) n from rec)""")
def _(spark, sf):
    return pa.with_index(both(spark, sf)).select("index", pa.citation(F.col("index")).alias("value"))


@query("sink_bibtex", f"""with {_BOTH} select n "index", '@'||case when {_VEN} is not null and "year" is not null then 'article' else 'misc' end||'{{'||left(lower(regexp_replace(first_author,'[^\\p{{L}}\\p{{Nd}}]','','g')),16)||coalesce("year"::varchar,'nd')||'_'||n||','||chr(10)||
 array_to_string(list_filter(['  author = {{'||array_to_string(authors,' and ')||'}}', '  doi = {{'||doi||'}}', case when "year" is null then '  howpublished = {{'||{_VEN}||'}}' end, case when "year" is not null then '  journal = {{'||{_VEN}||'}}' end,
 '  number = {{'||issue||'}}', '  title = {{'||coalesce(nullif(trim(title),''),'Untitled')||'}}', '  volume = {{'||volume||'}}', '  year = {{'||"year"||'}}'], lambda x: x is not null), ','||chr(10))||chr(10)||'}}' "value" from (select *, row_number() over (order by pos) n from rec)""")
def _(spark, sf):
    return rc.to_bibtex(both(spark, sf))


_TYPES = ["article", "book", "thesis", "conference", "patent", "report", "standard", "online", "other"]


def _gbt_sql():
    who = "case when len(authors)<=3 then array_to_string(authors, ', ') else array_to_string(authors[1:3], ', ')||', 等' end"
    y = """coalesce("year"::varchar,'')"""
    return f"""case when pos%17=0 then 'RAW '||pos else case t when 'book' then {who}||'. '||title||'[M]. '||'Press, '||{y}||'.' when 'thesis' then {who}||'. '||title||'[D]. '||venue||'. Press, '||{y}||'.'
 when 'conference' then {who}||'. '||title||'[C]. '||venue||', '||{y}||'.' when 'patent' then authors[1]||'. '||title||'[P]: N'||pos||'. '||{y}||'.' when 'report' then {who}||'. '||title||'[R]. Press, '||{y}||'.'
 when 'standard' then 'N'||pos||', '||title||'[S]. Press, '||{y}||'.' when 'online' then {who}||'. '||title||'[EB/OL]. http://x/'||pos||'[引用日期 2024-01-01].'
 else {who}||'. '||title||'[J]. '||venue||', '||{y}||coalesce(', '||volume,'')||coalesce('('||issue||')','')||'.'||coalesce('. DOI: '||doi,'') end end"""


@query("sink_ref_gbt", f"with {_BASE} select pos, {_gbt_sql()} \"value\" from (select *, ['{chr(39).join(_TYPES).replace(chr(39), chr(39)+chr(44)+chr(39))}'][pos%9+1] t from b1)")
def _(spark, sf):
    i, s = F.col("pos"), lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    r = base(spark, sf).select(
        "pos", F.col("authors").alias("author"), "title", F.col("venue").alias("journal"), "year", "volume", "issue", none.alias("pages"), "doi", F.lit("Press").alias("publisher"),
        none.alias("degree"), F.concat(F.lit("N"), s(i)).alias("number"), F.concat(F.lit("http://x/"), s(i)).alias("url"), F.lit("2024-01-01").alias("access_date"),
        F.when(i % 17 == 0, F.concat(F.lit("RAW "), s(i))).alias("raw"))
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (i % 9 + 1).cast("int"))
    return r.select("pos", pa.ref_gbt(kind).alias("value"))


@query("sink_records_json", f"with {_BASE} select pos, doi, title, \"year\", cast(len(authors) as int) n_authors from b1")
def _(spark, sf):
    """Records written as JSON texts and read back with the record schema."""
    lines = rc.to_json_lines(pa.as_records(base(spark, sf)))
    back = rc.parse_papers(lines.select("pos", F.concat(F.lit("["), F.col("value"), F.lit("]")).alias("value")), keep=["pos"])
    return back.select("pos", "doi", "title", "year", F.size("authors").alias("n_authors"))


@query("sink_records_md", f"""with {_BASE} select n "index", n||'. '||array_to_string(authors[1:3], ', ')||', et al. '||case when trim(title)='' then 'Untitled' else title end||'[J]. '||venue||', '||coalesce("year"::varchar,'')||', '||volume||coalesce('('||issue||')','')||coalesce('. DOI: '||doi,'') "value"
 from (select *, row_number() over (order by pos) n from b1)""")
def _(spark, sf):
    return rc.to_markdown_lines(pa.as_records(base(spark, sf)))


# --- sources -------------------------------------------------------------------------------

@query("src_papers", f"with {_BASE} select pos, title, doi, \"year\", citation_count, array_to_string(authors,'|') authors from b1")
def _(spark, sf):
    b = base(spark, sf)
    rec = F.struct("title", "doi", "year", "citation_count", "authors")
    raw = b.select("pos", F.when(F.col("pos") % 2 == 0, F.to_json(F.array(rec))).otherwise(F.to_json(F.struct(F.array(rec).alias("records")))).alias("value"))
    return rc.parse_papers(raw, keep=["pos"]).select("pos", "title", "doi", "year", "citation_count", F.array_join("authors", "|").alias("authors"))


@query("norm_openalex", f"""with {_BASE} select pos, id, title, doi, "year", venue, citation_count, md5(abstract) abstract, is_open_access, first_author, array_to_string(authors,'|') authors, 'Inst' affiliations from b1""")
def _(spark, sf):
    b = base(spark, sf)
    raw = b.withColumn("idx", rc.invert_abstract(F.col("abstract"))).select("pos", F.to_json(F.struct(
        "id", F.col("title").alias("display_name"), F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), F.col("year").alias("publication_year"),
        F.col("citation_count").alias("cited_by_count"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"),
        F.col("idx").alias("abstract_inverted_index"), F.struct(F.col("is_open_access").alias("is_oa")).alias("open_access"),
        F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"), F.array(F.struct(F.lit("Inst").alias("display_name"))).alias("institutions"))).alias("authorships"))).alias("value"))
    return rc.norm_openalex(raw).select("pos", "id", "title", "doi", "year", "venue", "citation_count", F.md5("abstract").alias("abstract"), "is_open_access", "first_author",
                                        F.array_join("authors", "|").alias("authors"), F.array_join("affiliations", "|").alias("affiliations"))


@query("norm_crossref", f"""with {_BASE} select pos, title, doi, "year", venue, volume, issue, citation_count, first_author||' Fam' first_author, 'F1|F2' funders, coalesce('crossref='||doi,'') ids from b1""")
def _(spark, sf):
    raw = base(spark, sf).select("pos", F.to_json(F.struct(
        F.col("doi").alias("DOI"), F.array("title").alias("title"), F.array("venue").alias("container-title"), "volume", "issue", F.col("citation_count").alias("is-referenced-by-count"),
        F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"), F.transform("authors", lambda a: F.struct(a.alias("given"), F.lit("Fam").alias("family"))).alias("author"),
        F.array(F.struct(F.lit("F1").alias("name")), F.struct(F.lit(" ").alias("name")), F.struct(F.lit("F2").alias("name"))).alias("funder"))).alias("value"))
    ids = F.array_join(F.transform(F.map_entries("source_ids"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return rc.norm_crossref(raw).select("pos", "title", "doi", "year", "venue", "volume", "issue", "citation_count", "first_author", F.array_join("funders", "|").alias("funders"), ids.alias("ids"))


@query("norm_unpaywall", f"""with {_BASE} select pos, title, doi, "year", is_open_access, 'http://p/'||pos pdf_url, 'unpaywall_host_type=repository' reasons from b1""")
def _(spark, sf):
    raw = base(spark, sf).select("pos", F.to_json(F.struct(F.concat(F.lit("doi:"), F.col("doi")).alias("doi"), "title", F.col("is_open_access").alias("is_oa"), "year", F.struct(
        F.concat(F.lit("http://p/"), F.col("pos").cast("string")).alias("url_for_pdf"), F.lit("repository").alias("host_type")).alias("best_oa_location"))).alias("value"))
    return rc.norm_unpaywall(raw).select("pos", "title", "doi", "year", "is_open_access", "pdf_url", F.array_join("match_reasons", "|").alias("reasons"))


@query("norm_aminer", f"""with {_BASE} select pos, id, title, doi, "year", citation_count, array_to_string(authors,'|') authors, array_to_string(keywords,'|')||'|土壤' keywords, 'aminer='||coalesce(doi,id) ids from b1""")
def _(spark, sf):
    raw = base(spark, sf).select("pos", F.to_json(F.struct(
        "id", F.col("title").alias("title_zh"), "doi", "year", F.col("citation_count").alias("n_citation"), F.transform("authors", lambda a: F.struct(a.alias("name_zh"))).alias("authors"),
        "keywords", F.array(F.lit("土壤"), F.get("keywords", F.lit(0))).alias("keywords_zh"))).alias("value"))
    ids = F.array_join(F.transform(F.map_entries("source_ids"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return rc.norm_aminer(raw).select("pos", "id", "title", "doi", "year", "citation_count", F.array_join("authors", "|").alias("authors"), F.array_join("keywords", "|").alias("keywords"), ids.alias("ids"))


@query("norm_metaso", f"""with {_BASE} select pos, title, "year", 'http://m/'||pos id, md5(abstract) abstract, first_author from b1""")
def _(spark, sf):
    raw = base(spark, sf).select("pos", F.to_json(F.struct(
        "title", F.concat(F.lit("http://m/"), F.col("pos").cast("string")).alias("link"), F.col("abstract").alias("snippet"), F.concat(F.col("year").cast("string"), F.lit("-05-01")).alias("date"),
        "authors")).alias("value"))
    return rc.norm_metaso(raw).select("pos", "title", "year", "id", F.md5("abstract").alias("abstract"), "first_author")


# --- grouped samples --------------------------------------------------------------------------

@query("src_group_csv", """select trim(event_type) "label", count(*) n, round(sum(value), 4) total from events where event_id%7<>3 and event_type<>'error' group by 1""")
def _(spark, sf):
    i = F.col("event_id")
    lines = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", F.concat(F.lit(" ,"), F.col("value").cast("string"))).when(
        i % 7 == 3, F.concat("event_type", F.lit(",n/a"))).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" , "), F.col("value").cast("string"), F.lit(",extra"))).alias("value"))
    return gr.parse_group_lines(lines).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("src_group_json", """select event_type||user_id "label", count(*) n, round(sum(value), 4) total from events group by 1""")
def _(spark, sf):
    per = table(spark, sf, "events").groupBy("user_id", "event_type", F.floor(F.col("event_id") / 1000)).agg(F.collect_list("value").alias("v"))
    docs = per.select(F.to_json(F.create_map(F.concat("event_type", F.col("user_id").cast("string")), F.col("v"))).alias("value"))
    return gr.parse_group_json(docs).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("to_groups", """select trim(p_brand) "label", p_retailprice "value" from part where p_size%5<>0 and trim(p_brand)<>'Brand#3'""")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_brand") == "Brand#3", "  ").otherwise(F.concat(F.lit(" "), F.col("p_brand"))).alias("g"),
                                        F.when(F.col("p_size") % 5 == 0, "missing").otherwise(F.col("p_retailprice").cast("string")).alias("v"))
    return gr.to_groups(p, "g", "v")


@query("to_groups_multi", f"""select l_returnflag "label", {sqlsig("case when l_linenumber=1 then (l_quantity+l_tax)/2 when l_linenumber=2 then l_tax else (l_quantity+l_discount+l_tax)/3 end")} "value" from lineitem where l_linenumber<>3""")
def _(spark, sf):
    n = F.col("l_linenumber")
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", F.when(~n.isin(2, 3), F.col("l_quantity").cast("string")).otherwise("").alias("a"), F.when(n.isin(1, 2, 3), "x").otherwise(F.col("l_discount").cast("string")).alias("b"),
        F.when(n != 3, F.col("l_tax").cast("string")).alias("c"))
    return gr.to_groups_multi(li, "l_returnflag", ["a", "b", "c"]).withColumn("value", sig("value"))


@query("append_rows", """select c_custkey k, c_name "name", c_acctbal bal, c_acctbal*2 twice from customer union all select s_suppkey+1000000, s_name, s_acctbal, s_acctbal*2 from supplier""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), (F.col("c_acctbal") * 2).alias("twice"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return gr.append_rows(c, s, {"twice": F.col("bal") * 2})


@query("replace_rows", """select s_suppkey k, s_name "name", s_acctbal bal, null::varchar seg from supplier""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return gr.replace_rows(c, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")))


# Generators run along the orders table: row i of n gets the i-th sample.
@query("gen_series", f"""with o as (select o_orderkey i, o_custkey k, (select count(*) from orders) n from orders)
select i, round(5+i*0.5::double, 6) cons, {sqlsig('-1+i*(2.0::double/(n-1))', 8)} rng, round(sin(i*(2*pi()*3/(n-1))+0.5*pi())*2+1, 6) sn, case when (i//100)%2=0 then -1.0::double else 1.0::double end sq,
 cast(sum(i%3-1) over (partition by k order by i rows unbounded preceding) as double) walk from o""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    o = orders.select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("k"), orders.agg(F.count(F.lit(1))).scalar().alias("n"))
    i, n = F.col("i"), F.col("n")
    w = ge.random_walk(o, ["k"], "i", (i % 3 - 1).cast("double"))
    return w.select("i", F.round(ge.consecutive(i, 5, 0.5), 6).alias("cons"), sig(ge.linear_range(i, n, -1, 1), 8).alias("rng"),
                    F.round(ge.sin(i, n, 2, 1, 3, 0.25), 6).alias("sn"), ge.square(i, 100, -1, 1).alias("sq"), "walk")


def _unit_sql(seed, draw=0):
    return f"(('0x' || substr(md5('{seed}-' || o_orderkey || '-{draw}'), 1, 13))::bigint::double / {1 << 52}::double)"


@query("gen_noise", f"""select o_orderkey i, {_unit_sql(1)} uniform, {sqlsig(f"sqrt(-2*ln(1-{_unit_sql(2)}))*cos(2*pi()*{_unit_sql(2, 1)})", 8)} normal,
 {sqlsig(f"o_totalprice+({_unit_sql(3)}-0.5)*10")} noisy from orders""")
def _(spark, sf):
    """Seeded random, normal and noisy values beside each order."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), "o_totalprice")
    i = F.col("i")
    return o.select("i", ge.random_sample(i, 1).alias("uniform"), sig(ge.random_normal(i, 2), 8).alias("normal"), sig(ge.add_noise(F.col("o_totalprice"), i, 10, 3)).alias("noisy"))
