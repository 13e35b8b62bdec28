"""The registered queries of this subpackage, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.llm import decontam, interaction, language, minmax, packing, pii, pivots, quality, suffix, topk, toxicity, warc, windows
from tallyloom.llm.common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op3_exact_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 10""")
def _(spark, sf):
    vectors = read(spark, sf, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors, k=10)


_BASE32 = """array_to_string(list_transform(range(0, 8), lambda i:
    list_aggregate(list_transform(range(0, 4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(sha, (5 * i + 1)::int, 5))::bigint) >> (15 - 5 * j)::int) & 31)::int + 1, 1)), 'string_agg', '')), '')"""


@query("op5_warc_round_trip", f"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) sha from pages),
g as (select *, max(page_id) over (partition by sha) head from p)
select page_id, strlen(html)::bigint payload_bytes, {_BASE32} payload_digest,
  case when page_id = head then 'response' else 'revisit' end record_type, case when page_id <> head then head end refers_to from g""")
def _(spark, sf):
    return warc.round_trip(read(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_best_fit_packing")
def _(spark, sf):
    return packing.pack(read(spark, sf, "documents"))


@query("op1_language_id")
def _(spark, sf):
    return language.identify(read(spark, sf, "documents"))


@query("op2_toxicity")
def _(spark, sf):
    return toxicity.toxicity(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("op6_pii")
def _(spark, sf):
    return pii.pii(read(spark, sf, "documents"))


@query("op9_minmax_near_dedup", r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
  lambda x: x <> '') w from documents),
s as materialized (select doc_id, unnest(case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end) s from d),
n as materialized (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)),
e as materialized (select x a, y b from l union all select y, x from l),
r(id, c) as (select doc_id, doc_id from d union select e.b, r.c from r join e on e.a = r.id),
m as (select id, min(c) component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) n_shingles, m.component_id, d.doc_id = m.component_id kept from d join m on m.id = d.doc_id left join n on n.doc_id = d.doc_id""")
def _(spark, sf):
    return minmax.near_duplicates(read(spark, sf, "documents"))


@query("op7_benchmark_decontamination")
def _(spark, sf):
    return decontam.overlaps(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op4_run_length_dedup")
def _(spark, sf):
    return suffix.dedup(read(spark, sf, "documents")).drop("spans")


@query("op10_compact_windows")
def _(spark, sf):
    return windows.passages(read(spark, sf, "documents"))


def _code_sql(rounds: int) -> str:
    """Product codes in SQL: ``rounds`` times assign and average, then assign again."""
    assign = """a{i} as materialized (select id, part, unnest(arg_min({{'e': e, 'd': d}}, {{'d': d, 'e': e}})) from (
        select p.id, p.part, b.e, list_sum(list_transform(range(1, len(p.x) + 1), lambda j: (p.x[j] - b.x[j]) * (p.x[j] - b.x[j])))::bigint d
        from p join b{i} b using (part)) group by id, part)"""
    average = """b{k} as materialized (select b.part, b.e, coalesce(m.x, b.x) x from b{i} b left join (
        select part, e, list(s order by j) x from (select a.part, a.e, j, floor(sum(p.x[j]) / count(*))::bigint s
          from a{i} a join p using (id, part), unnest(range(1, len(p.x) + 1)) t(j) group by all) group by part, e) m on m.part = b.part and m.e = b.e)"""
    steps = [assign.format(i=0)]
    for r in range(rounds):
        steps += [average.format(i=r, k=r + 1), assign.format(i=r + 1)]
    return f"""
with k as materialized (select vec_id id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select id, t.part, v[t.part * (len(v) // 16) + 1 : (t.part + 1) * (len(v) // 16)] x from k, unnest(range(16)) t(part)),
b0 as materialized (select part, row_number() over (partition by part order by id) - 1 e, x from p where id in (select id from k order by id limit 64)),
{", ".join(steps)},
h as (select sha256(string_agg(u.v::varchar, ',' order by part, e, u.j)) sha from b{rounds}, unnest(x) with ordinality u(v, j)),
c as (select id, string_agg(printf('%02x', e), '' order by part) code, sum(d)::bigint error from a{rounds} group by id)
select id vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, (select sha from h) codebooks_sha256 from c join k using (id)"""


@query("op11_pivot_codes", _code_sql(2))
def _(spark, sf):
    return pivots.compress(read(spark, sf, "embeddings"))


@query("op12_quality")
def _(spark, sf):
    return quality.quality(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("op13_filter_interaction", r"""
with w as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
f as materialized (select doc_id, part, len(w) < 200 a, 100 * len(list_distinct(w)) < 50 * len(w) b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) c,
  regexp_matches(t, '[#$%&*|]') d, coalesce(doc_id > min(doc_id) over (partition by t), false) e from w),
g as (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int mask, coalesce(l.good, false) good, coalesce(l.toxic, false) toxic
  from f left join (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by 1) l using (doc_id)),
n as materialized (select part, mask, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from g group by 1, 2),
o as (select string_agg(c, '') filter_order from (select r.i, s.j, substr('ABCDE', s.x::int, 1) c from
  (select row_number() over () i, [a, b, c, d, e] o from range(1, 6) t1(a), range(1, 6) t2(b), range(1, 6) t3(c), range(1, 6) t4(d), range(1, 6) t5(e)
   where len(list_distinct([a, b, c, d, e])) = 5) r, unnest(r.o) with ordinality s(x, j) order by i, j) group by i),
s as (select filter_order, step::int step, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::int, 1)) - 65)))::int prior_,
  1 << (ascii(substr(filter_order, step::int, 1)) - 65) bit from o, range(1, 6) t(step)),
r as materialized (select n.part, s.filter_order, s.step, s.bit, coalesce(sum(n) filter (mask & (coalesce(prior_, 0) | bit) = 0), 0)::bigint kept,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & coalesce(prior_, 0) = 0), 0)::bigint removed,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & coalesce(prior_, 0) <> 0), 0)::bigint redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint unique_fails,
  coalesce(sum(good) filter (mask & bit <> 0 and mask & coalesce(prior_, 0) = 0), 0)::bigint good_lost,
  coalesce(sum(toxic) filter (mask & bit <> 0 and mask & coalesce(prior_, 0) = 0), 0)::bigint toxic_lost from n, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint shapley from r""")
def _(spark, sf):
    return interaction.audit(read(spark, sf, "documents"), read(spark, sf, "labels"))
