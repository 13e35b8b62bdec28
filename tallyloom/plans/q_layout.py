"""Queries over page geometry and block packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import corpus as co, layout as ly, packages as pk
from tallyloom.plans.derived import PAGE_WORDS_SQL as WD, page_words, papers, papers_sql
from tallyloom.plans.registry import query, sig, sqlsig
from tallyloom.session import cut_lineage
from tallyloom.sources import blocks as bl
from tallyloom.sources.tables import table

_P = "partition by doc_id, page"
_LN = WD + f""",
a1 as (select *, lag(y0) over ({_P} order by y0 desc, x0, word_id) py from wd),
a2 as (select *, sum(case when py is null or py-y0>greatest(2, sz*0.45) then 1 else 0 end) over ({_P} order by y0 desc, x0, word_id rows unbounded preceding) base from a1),
a3 as (select *, lag(x1) over (partition by doc_id, page, base order by x0, word_id) px, list_sort(list(sz) over (partition by doc_id, page, base)) ss from a2),
wl as materialized (select *, sum(case when px is null or x0-px>greatest(ss[len(ss)//2+1]*3, 60) then 1 else 0 end) over ({_P} order by base, x0, word_id rows unbounded preceding)-1 line_no from a3)"""


@query("line_build", f"with {_LN} select doc_id, page, word_id, cast(line_no as int) line_no from wl")
def _(spark, sf):
    return ly.line_build(page_words(spark, sf)).select("doc_id", "page", "word_id", "line_no")


_LF = _LN + f""",
fc as (select doc_id, page, line_no, font, count(*) c, min(struct_pack(a := x0, b := word_id)) f from wl group by all),
fm as (select doc_id, page, line_no, arg_max(font, struct_pack(c := c, x := -f.a, w := -f.b)) font from fc group by 1,2,3),
lf as materialized (select wl.doc_id, wl.page, cast(wl.line_no as int) line_no, min(x0) "left", min(y0) bottom, max(x1) "right", max(y1) top, string_agg("text", ' ' order by x0, word_id) "text",
 list_sort(list(sz))[len(list(sz))//2+1] "size", bool_or(contains(lower(wl.font),'bold')) bold, bool_or(regexp_matches(lower(wl.font),'italic|oblique')) italic, any_value(fm.font) font
 from wl join fm on fm.doc_id=wl.doc_id and fm.page=wl.page and fm.line_no=wl.line_no group by 1,2,3)"""


def _lines(spark, sf):
    return ly.line_features(ly.line_build(page_words(spark, sf)))


@query("line_features", f"with {_LF} select doc_id, page, line_no, \"left\", bottom, \"right\", top, md5(\"text\") digest, \"size\", bold, italic, font, false gibberish from lf")
def _(spark, sf):
    return _lines(spark, sf).select("doc_id", "page", "line_no", "left", "bottom", "right", "top", F.md5("text").alias("digest"), "size", "bold", "italic", "font", "gibberish")


@query("suspect_fonts", """with w as (select doc_id, case when n%7=0 then 'ABCDEF+Odd' else 'Plain' end font, t from (select doc_id, unnest(string_split(replace(text, 'e', chr(57345)), ' ')) t, 0 z from documents), (select 1) _(q), lateral (select length(t) n)),
a as (select doc_id, font, cast(sum(length(regexp_replace(t, '[\\s\\x00-\\x1f\\x7f-\\x{9f}]', '', 'g'))) as bigint) characters, cast(sum(length(t)-length(regexp_replace(t, '[\\x{e000}-\\x{f8ff}]', '', 'g'))) as bigint) suspicious from w group by 1,2)
select doc_id, font, characters, suspicious from a where characters>=3 and (suspicious::double/characters>0.30 or (font='ABCDEF+Odd' and suspicious::double/characters>0.05))""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.translate("text", "e", "\ue001"), " ", -1)).alias("t"))
    w = d.withColumn("font", F.when(F.length("t") % 7 == 0, "ABCDEF+Odd").otherwise("Plain"))
    return co.suspect_fonts(w, ["doc_id"], "font", "t").select("doc_id", "font", "characters", "suspicious")


_SPLIT = _LF + f""",
nr as (select doc_id, page, line_no, "left", ("left"+"right")/2 mid, count(*) over ({_P}) n from lf where "right"-"left"<600*0.62),
e1 as (select *, lag("left") over ({_P} order by "left", line_no) pl from nr where n>=6),
e2 as (select *, sum(case when pl is null or "left"-pl>24 then 1 else 0 end) over ({_P} order by "left", line_no rows unbounded preceding) c from e1),
e3 as (select doc_id, page, c, avg("left") x, count(*) k from e2 group by 1,2,3 having count(*)>=3),
e4 as (select doc_id, page, (min(x)+max(x))/2 edge from e3 group by 1,2 having count(*)>=2 and max(x)-min(x)>=600*0.18),
g1 as (select *, lag(mid) over ({_P} order by mid, line_no) pm, row_number() over ({_P} order by mid, line_no)-1 i from nr where n>=6),
g2 as (select doc_id, page, arg_max((pm+mid)/2, struct_pack(g := mid-pm, i := -i)) gap from g1 where mid-pm>60 and i>=3 and n-i>=3 group by 1,2),
sp as materialized (select lf.*, coalesce(edge, gap) sx from lf left join e4 using (doc_id, page) left join g2 using (doc_id, page))"""


@query("reading_order", f"""with {_SPLIT},
o1 as (select *, sx is not null and (("left"<sx-4 and "right">sx+4) or "right"-"left">360 or (abs(("left"+"right")/2-sx)<48 and "right"-"left">150)) fu from sp),
o2 as (select *, case when fu then sum(fu::int) over ({_P} order by top desc, "left", line_no rows unbounded preceding) else sum(fu::int) over ({_P} order by top desc range unbounded preceding) end band,
 case when fu or sx is null or ("left"+"right")/2<=sx then 0 else 1 end side from o1)
select doc_id, page, line_no, {sqlsig('sx')} split_x, cast(row_number() over ({_P} order by band, case when fu then 0 else 1 end, side, top desc, "left", line_no)-1 as int) "position" from o2""")
def _(spark, sf):
    return ly.reading_order(ly.line_boxes(ly.line_build(page_words(spark, sf)))).select("doc_id", "page", "line_no", sig("split_x").alias("split_x"), "position")


@query("table_regions", f"""with {_SPLIT},
t1 as (select *, lag(bottom) over ({_P} order by bottom desc, "left", line_no) pb, lag(top-bottom) over ({_P} order by bottom desc, "left", line_no) ph from sp),
t2 as (select *, sum(case when pb is null or pb-bottom>greatest(3, greatest(top-bottom, ph)*0.45) then 1 else 0 end) over ({_P} order by bottom desc, "left", line_no rows unbounded preceding)-1 r from t1),
t3 as (select doc_id, page, r, count(*) k, any_value(sx) sx, min(("left"+"right")/2) m0, max(("left"+"right")/2) m1, min("left") l, min(bottom) b, max("right") rt, max(top) t from t2 group by 1,2,3),
t4 as (select *, r-row_number() over ({_P} order by r) g from t3 where k>=2 and not coalesce(k=2 and m0<sx and m1>sx, false)),
t5 as (select doc_id, page, g, count(*) n, min(r) r0, max(r) r9, min(l) l, min(b) b, max(rt) rt, max(t) t from t4 group by 1,2,3 having count(*)>=4),
x1 as (select t5.doc_id, t5.page, t5.g, t2.r, t2."left" x from t5 join t4 on t4.doc_id=t5.doc_id and t4.page=t5.page and t4.g=t5.g join t2 on t2.doc_id=t4.doc_id and t2.page=t4.page and t2.r=t4.r),
x2 as (select *, lag(x) over (partition by doc_id, page, g order by x) px from x1),
x3 as (select *, sum(case when px is null or x-px>12 then 1 else 0 end) over (partition by doc_id, page, g order by x rows unbounded preceding) c from x2),
x4 as (select doc_id, page, g, c, avg(x) m from x3 group by 1,2,3,4 having count(*)>=2),
x5 as (select *, (m+lead(m) over (partition by doc_id, page, g order by m))/2 e from x4),
x6 as (select doc_id, page, g, count(*) cols from x4 group by 1,2,3 having count(*) between 2 and 12),
x7 as (select x1.doc_id, x1.page, x1.g, x1.r, x1.x, count(x5.e) slot from x1 left join x5 on x5.doc_id=x1.doc_id and x5.page=x1.page and x5.g=x1.g and x5.e<=x1.x group by all),
x8 as (select doc_id, page, g, count(*) ar from (select doc_id, page, g, r from x7 group by 1,2,3,4 having count(distinct slot)>=2) group by 1,2,3 having count(*)>=3)
select doc_id, page, cast(r0 as int) first_row, n "rows", cast(cols as int) "columns", cast(ar as int) aligned_rows, l "left", b bottom, rt "right", t top from t5 join x6 using (doc_id, page, g) join x8 using (doc_id, page, g)""")
def _(spark, sf):
    return ly.table_regions(ly.line_boxes(ly.line_build(page_words(spark, sf))))


@query("heading_infer", f"""with {_LF},
q as (select *, row_number() over (partition by doc_id order by "size") k, count(*) over (partition by doc_id) n from lf),
m as (select doc_id, max(case when k=n//2+1 then "size" end) med, max(case when k=cast(floor((n-1)*0.95) as int)+1 then "size" end) p95 from q group by 1),
h as (select lf.*, med, p95, row_number() over (partition by lf.doc_id order by page, line_no)=1 fst from lf join m using (doc_id))
select doc_id, page, line_no, case when (fst and length("text")<=100) or (length("text")<=120 and ("size">=p95*0.97 or "size">med*1.25 or (bold and "size">med*1.05))) then 'heading' else 'paragraph' end kind from h""")
def _(spark, sf):
    return ly.heading_infer(_lines(spark, sf)).select("doc_id", "page", "line_no", "kind")


@query("page_block_order", f"with {WD} select doc_id, page, string_agg('w'||word_id, ',' order by y0 desc, x0, word_id) ids from wd group by 1,2")
def _(spark, sf):
    w = page_words(spark, sf).select("doc_id", "page", F.struct(-F.col("y0"), F.col("x0"), F.col("word_id")).alias("idx"), F.concat(F.lit("w"), F.col("word_id").cast("string")).alias("block"))
    return ly.page_block_order(w, "page", "idx", "block").select("doc_id", "page", F.array_join("block_ids", ",").alias("ids"))


@query("page_layout_class", f"""with p as (select source, coalesce(length(text), 0) c, case when doc_id%20<5 then 0.7 when doc_id%20<9 then 0.3 else 0.05 end::double r from documents)
select source, pages, chars, class from (select source, count(*) pages, cast(sum(c) as bigint) chars, case when sum(c)*1.0/count(*)>=80 and avg(r)<0.55 then case when avg(r)>=0.20 then 'hybrid' else 'text' end when sum(c)=0 or (sum(c)*1.0/count(*)<20 and avg(r)>=0.55) then 'scan' else 'hybrid' end class from p group by 1)""")
def _(spark, sf):
    m = F.col("doc_id") % 20
    d = table(spark, sf, "documents").select("source", F.coalesce(F.length("text"), F.lit(0)).alias("c"),
                                             F.when(m < 5, 0.7).when(m < 9, 0.3).otherwise(0.05).alias("r"))
    return ly.page_layout_class(d, "source", "c", "r").select("source", "pages", "chars", "class")


@query("font_counts", f"with {WD}, f as (select 'ascii' r, font f from wd union all select 'any', font from wd union all select 'eastAsia', case when n>5 then 'Song' end from wd union all select 'any', case when n>5 then 'Song' end from wd) select r \"role\", f font, count(*) uses from f where f is not null group by 1,2")
def _(spark, sf):
    w = page_words(spark, sf).withColumn("ea", F.when(F.length("text") > 5, "Song"))
    return pk.font_counts(w, {"ascii": "font", "eastAsia": "ea"})


# --- blocks and packages ------------------------------------------------------------------

_NL = papers_sql() + """,
nm as (select doc_id, string_split(regexp_replace(regexp_replace(replace("text", '　', ' '), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), chr(10)) l from paper),
bl0 as (select doc_id, unnest(range(len(l))) i, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') s from nm),
bl1 as (select *, case when s='' then 'blank' when regexp_matches(s, '^#{1,6}\\s') then 'heading' when length(s)-length(replace(s,'|',''))>=2 then 'table' else 'paragraph' end k from bl0),
bl2 as (select *, lag(k) over (partition by doc_id order by i) pk from bl1),
bl3 as (select *, sum(case when k<>'table' or pk is null or pk<>'table' then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding)-1 g from bl2 where k<>'blank'),
bk as materialized (select doc_id, cast(g as int) idx, 'b'||g block_id, any_value(k) kind, max(case when k='heading' then length(regexp_extract(s,'^#+')) else 0 end)::int "level",
 any_value(case when k='heading' then regexp_replace(regexp_replace(s,'^#+',''), '^\\s+|\\s+$', '', 'g') when k='paragraph' then s end) "text",
 string_agg(s, '‖' order by i) filter (k='table' and not regexp_matches(s, '^\\|?[\\s:|-]+\\|?$')) "rows" from bl3 group by 1,2,3)"""


def _blocks(spark, sf):
    return bl.src_md_blocks(papers(spark, sf), "doc_id", "text")


@query("src_md_blocks", f"with {_NL} select doc_id, idx, block_id, kind, \"level\", md5(coalesce(\"text\",'')) digest, coalesce(\"rows\",'') \"rows\" from bk")
def _(spark, sf):
    return _blocks(spark, sf).select("doc_id", "idx", "block_id", "kind", "level", F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
                                     F.coalesce(F.array_join("rows", "‖"), F.lit("")).alias("rows"))


def _written_blocks(spark, sf):
    """The blocks as a written table, for queries that take content, structure and assets from them."""
    return cut_lineage(_blocks(spark, sf).select("doc_id", "idx", "block_id", "kind", "level", "text"))


def _content(blocks):
    """Block rows written as JSON lines and read back."""
    raw = blocks.select("doc_id", F.to_json(F.struct(F.upper("block_id").alias("blockId"), F.col("idx").alias("index"), "kind", "level", "text")).alias("value"))
    return bl.parse_content(raw, "doc_id", "value")


def _structure(blocks):
    i = F.col("idx")
    prov = F.struct(F.when(i % 7 != 3, F.when(i % 5 == 4, "docx").otherwise("pdf")).alias("format"), F.when(i % 6 != 5, i.cast("string")).alias("position"),
                    F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source"), F.when(i % 4 != 1, i).alias("page"), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0), i.cast("double")).alias("bbox"))
    entry = F.struct(F.when(i % 9 != 8, prov).alias("provenance"))
    per = blocks.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("block_id", entry.alias("e")))).alias("blockIndex"))
    return bl.parse_structure(per.select("doc_id", F.to_json(F.struct("blockIndex")).alias("value")), "doc_id", "value")


def _assets(blocks):
    b = blocks.select("doc_id", F.struct(
        F.concat(F.lit("img"), F.col("idx").cast("string")).alias("id"), F.col("block_id").alias("name"), F.array(F.concat(F.lit("B"), (F.col("idx") + 1).cast("string"))).alias("usedBy")).alias("a"))
    per = b.groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list("a").alias("items"))).alias("value"))
    return bl.parse_assets(per, "doc_id", "value")


_STR = """st as (select doc_id, block_id, idx, case when idx%9<>8 then 1 end has, case when idx%7<>3 then case when idx%5=4 then 'docx' else 'pdf' end end fmt, case when idx%6<>5 then idx end pos_, case when idx%4<>1 then idx end page from bk)"""


@query("src_blocks", f"with {_NL}, {_STR} select bk.doc_id, upper(bk.block_id) block_id, bk.idx, kind, fmt, cast(case when has=1 then page end as int) page from bk join st on st.doc_id=bk.doc_id and st.idx=bk.idx".replace("kind, fmt", "kind, case when has=1 then fmt end fmt"))
def _(spark, sf):
    b = _written_blocks(spark, sf)
    s = _structure(b).select("doc_id", F.upper("block_id").alias("block_id"), F.col("provenance.format").alias("fmt"), F.col("provenance.page").alias("page"))
    return _content(b).select("doc_id", "block_id", "idx", "kind").join(s, ["doc_id", "block_id"])


@query("block_view", f"""with {_NL}, {_STR}, us as (select distinct doc_id, 'img'||idx a, unnest(['img'||idx, block_id, 'b'||(idx+1)]) b from bk)
select bk.doc_id, upper(bk.block_id) block_id, kind, case when has=1 then fmt end fmt, coalesce((select string_agg(a, ',' order by a) from us where us.doc_id=bk.doc_id and us.b=bk.block_id), '') assets from bk join st on st.doc_id=bk.doc_id and st.idx=bk.idx""")
def _(spark, sf):
    b = _written_blocks(spark, sf)
    v = pk.block_view(_content(b), _structure(b), _assets(b))
    return v.select("doc_id", "block_id", "kind", F.col("provenance.format").alias("fmt"), F.array_join("asset_ids", ",").alias("assets"))


@query("package_metrics", f"""with {_NL} select doc_id, count(*) blocks, count(*) filter (kind='paragraph') paragraphs, count(*) filter (kind='heading') headings, count(*) filter (kind='table') tables, 0::bigint figures, 0::bigint images, 0::bigint "references", 0::bigint warnings from bk group by 1""")
def _(spark, sf):
    return pk.package_metrics(_blocks(spark, sf))


@query("corpus_stats", f"""with {_NL} select doc_id, count(*) filter (kind='paragraph') paragraphs, count(*) filter (kind='table') tables, cast(sum(case when kind='paragraph' then length("text") else 0 end) as bigint) characters,
 cast(sum(case when kind='paragraph' then length("text") else 0 end)//2 as bigint) words from bk group by 1""")
def _(spark, sf):
    return co.corpus_stats(_blocks(spark, sf), "doc_id", "kind", "text")


@query("package_check", f"""with {_NL}, {_STR} select doc_id, block_id, 'error' severity, p problem from (
 select doc_id, block_id, 'provenance missing' p from st where has is null union all select doc_id, block_id, 'format missing' from st where has=1 and fmt is null
 union all select doc_id, block_id, 'format differs' from st where has=1 and fmt='docx' union all select doc_id, block_id, 'position missing' from st where has=1 and pos_ is null
 union all select doc_id, block_id, 'page missing' from st where has=1 and page is null)""")
def _(spark, sf):
    return pk.package_check(_structure(_blocks(spark, sf)), F.lit("PDF"))
