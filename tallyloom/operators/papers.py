"""Bibliographic records: Boolean field filter, duplicate merging, ranking, citations."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from tallyloom.operators.corpus import let
from tallyloom.operators.ordering import Down, with_prefix

# The record's text fields, list fields and other fields.
TEXTS = ["id", "doi", "title", "first_author", "venue", "journal", "publisher", "abstract", "issn", "cn", "isbn", "clc", "volume", "issue",
         "pages", "oa_status", "license", "pdf_url", "landing_page_url", "full_text"]
LISTS = ["authors", "keywords", "concepts", "topics", "affiliations", "funders", "references", "retrieved_from", "match_reasons"]
SCHEMA = (", ".join(f"{c} string" for c in TEXTS) + ", " + ", ".join(f"`{c}` array<string>" for c in LISTS) +
          ", year int, citation_count int, is_open_access boolean, source_ids map<string,string>")


def as_records(df: DataFrame) -> DataFrame:
    """The full record shape: missing fields become NULL or empty lists."""
    have = set(df.columns)
    cols = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in TEXTS]
    cols += [(F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")).alias(c) for c in LISTS]
    cols += [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("year", "int"), ("citation_count", "int"), ("is_open_access", "boolean"))]
    cols.append((F.col("source_ids") if "source_ids" in have else F.create_map().cast("map<string,string>")).alias("source_ids"))
    return df.select(*[F.col(c) for c in df.columns if c == "pos"], *cols)


# --- normalisation ---------------------------------------------------------------

# Characters that compatibility composition leaves alone wherever they stand: ASCII, Latin-1
# letters and signs, Cyrillic letters, common punctuation, CJK ideographs.  A text of only
# these needs no composition; tests hold the class against Unicode data.
STABLE = r"\x00-\x7f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\xff\u0400-\u0482\u2010\u2012-\u2016\u2018-\u201f\u3001-\u3029\u4e00-\u9fff"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Full compatibility composition in Arrow batches."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def norm_text(col: Column) -> Column:
    """Compatibility composition, no control characters, lower case, single spaces.

    Only texts with a character outside ``STABLE`` go to Python; for all others a NULL goes
    there.  ASCII texts are told by their length, and the ASCII characters of others by one
    comparison, before the many ranges of the class are tried.
    """
    c = F.coalesce(col, F.lit(""))
    c = F.coalesce(nfkc(F.when((F.octet_length(c) != F.length(c)) & c.rlike(f"[[^\\x00-\\x7f]&&[^{STABLE}]]"), c)), c)
    c = F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", "")
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))


def norm_doi(col: Column) -> Column:
    bare = F.regexp_replace(F.trim(col), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", "")
    return F.nullif(F.lower(F.regexp_replace(F.trim(bare), r"[.,;]+$", "")), F.lit(""))


def has_cjk(col: Column) -> Column:
    return F.coalesce(col.rlike("[\\x{4e00}-\\x{9fff}]"), F.lit(False))


# --- Boolean filter ----------------------------------------------------------------

def _join(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.when(F.trim(p) != "", p) for p in parts])


def _list(name: str) -> Column:
    return F.array_join(F.col(name), " ")


def _first_author() -> Column:
    return F.coalesce(F.col("first_author"), F.get("authors", F.lit(0)), F.lit(""))


# Field codes and the record fields they search.
FIELDS = {
    "SU": lambda: _join(F.col("title"), F.col("abstract"), _list("keywords"), _list("concepts"), _list("topics")),
    "TI": lambda: F.col("title"), "KY": lambda: _list("keywords"), "AB": lambda: F.col("abstract"), "AU": lambda: _list("authors"),
    "FI": _first_author, "F": _first_author, "AF": lambda: _list("affiliations"), "JN": lambda: _join(F.col("venue"), F.col("journal")),
    "RF": lambda: _list("references"), "FU": lambda: _list("funders"), "CLC": lambda: F.col("clc"), "SN": lambda: F.col("issn"),
    "CN": lambda: F.col("cn"), "IB": lambda: F.col("isbn"), "FT": lambda: F.col("full_text"),
}


def term(field: str, value: str) -> tuple:
    return ("term", field or "SU", value)


def between(field: str, low: int, high: int) -> tuple:
    return ("between", field, low, high)


def _fields_used(node: tuple) -> set[str]:
    if node[0] == "term":
        return {node[1].upper()} - {"CF", "YE", "DOI"}
    if node[0] == "between":
        return set()
    return set().union(*[_fields_used(n) for n in node[1:]])


def _terms(node: tuple, positive: bool = True) -> list[tuple]:
    if node[0] == "term":
        return [node] if positive else []
    if node[0] == "between":
        return []
    return [t for n in node[1:] for t in _terms(n, positive != (node[0] == "not"))]


def norm_term(value: str) -> str:
    """:func:`norm_text` of a search term, worked out while planning."""
    bare = re.sub(r"[\x00-\x1f\x7f-\x9f]", "", unicodedata.normalize("NFKC", value))
    return " ".join(bare.lower().split())


def concept_terms(node: tuple) -> list[str]:
    """Distinct normalised positive text terms of an expression, sorted (computed while planning)."""
    skip = {"CF", "YE", "DOI"}
    return sorted({norm_term(t[2]) for t in _terms(node) if t[1].upper() not in skip} - {""})


def _evaluate(node: tuple, recall: bool, fields: Column) -> tuple[Column, Column]:
    """(match, reasons) of a node; reasons follow short-circuit evaluation from left to right.

    ``fields`` is a struct of the normalised field texts.
    """
    empty = F.array().cast("array<string>")
    kind = node[0]
    if kind == "between":
        c = F.col("year" if node[1].upper() == "YE" else "citation_count")
        return F.coalesce(c.between(node[2], node[3]), F.lit(False)), empty
    if kind == "not":
        m, r = _evaluate(node[1], recall, fields)
        return ~m, r
    if kind in ("and", "or"):
        m, r = _evaluate(node[1], recall, fields)
        for child in node[2:]:
            m2, r2 = _evaluate(child, recall, fields)
            go = m if kind == "and" else ~m
            r = F.concat(r, F.when(go, r2).otherwise(empty))
            m = (m & m2) if kind == "and" else (m | m2)
        return m, r
    field, value = node[1].upper(), node[2]
    if field == "CF":
        return F.coalesce(F.col("citation_count"), F.lit(0)) >= int(value), empty
    if field == "YE":
        return F.coalesce(F.col("year"), F.lit(0)) == int(value), empty
    if field == "DOI":
        hit = F.coalesce(norm_doi(F.col("doi")) == norm_doi(F.lit(value)), F.lit(False))
        return hit, F.when(hit, F.array(F.lit("DOI"))).otherwise(empty)
    needle = norm_term(value)
    text = fields[field]
    hit = F.contains(text, F.lit(needle)) if needle else F.lit(False)
    said = F.when(hit, F.array(F.lit(f"{field}:{value}"))).otherwise(empty)
    if recall and any("\u4e00" <= ch <= "\u9fff" for ch in needle):
        odd = ~hit & ~has_cjk(text)
        hit, said = hit | odd, F.when(odd, F.array(F.lit(f"{field}:{value}(recall-cjk-mismatch)"))).otherwise(said)
    if field == "FT":
        blank = text == ""
        if recall:
            return blank | hit, F.when(blank, F.array(F.lit(f"FT unavailable; kept in recall mode for term '{value}'."))).otherwise(said)
        return ~blank & hit, F.when(~blank, said).otherwise(empty)
    return hit, said


def bool_filter(records: DataFrame, node: tuple, recall: bool = False) -> DataFrame:
    """Records satisfying a Boolean field expression, with the reasons in ``match_reasons``.

    Every searched field is normalised once: match and reasons come from one expression,
    which the outer explode keeps the optimizer from copying into the filter.
    """
    names = sorted(_fields_used(node)) or ["SU"]
    default = lambda: _join(F.col("title"), F.col("abstract"), _list("keywords"))
    texts = F.struct(*[norm_text(FIELDS.get(f, default)()).alias(f) for f in names])
    judged = let(texts, lambda f: F.struct(*[c.alias(n) for n, c in zip(("match", "reasons"), _evaluate(node, recall, f))]))
    kept = records.select("*", F.explode_outer(F.array(judged)).alias("_j")).where("_j.match")
    return kept.withColumn("match_reasons", F.concat("match_reasons", "_j.reasons")).drop("_j")


# --- duplicates -----------------------------------------------------------------------

def dedupe_papers(records: DataFrame) -> DataFrame:
    """Adds ``group_id``: records of one paper share it.

    Exact DOI groups first; a record without DOI joins the DOI group with the smallest
    position that shares (year, title, first author, script); the rest group by that key.
    The source toolkit compares record by record in input order, which is not transitive;
    results are equal where its order does not matter.
    """
    title, author = norm_text(F.col("title")), norm_text(_first_author())
    tkey = F.when(F.col("year").isNotNull() & (title != "") & (author != ""),
                  F.sha2(F.concat_ws("\u0001", F.col("year").cast("string"), title, author, has_cjk(F.col("title")).cast("string")), 256))
    base = records.withColumn("_doi", norm_doi(F.col("doi"))).withColumn("_tk", tkey)
    owners = base.where(F.col("_doi").isNotNull() & F.col("_tk").isNotNull()).groupBy("_tk").agg(F.min_by("_doi", "pos").alias("_owner"))
    named = base.join(owners, "_tk", "left")
    group = F.coalesce(F.concat(F.lit("d:"), F.coalesce("_doi", "_owner")), F.concat(F.lit("t:"), F.col("_tk")), F.concat(F.lit("r:"), F.col("pos").cast("string")))
    return named.withColumn("group_id", group).drop("_doi", "_tk", "_owner")


def merge_papers(grouped: DataFrame) -> DataFrame:
    """One record per ``group_id``.

    Scalars are map-side combined aggregates.  List items are deduplicated per (group,
    list, folded item) before anything is gathered, so copies of one paper shrink to
    their distinct items ahead of the shuffle.
    """
    pos = F.col("pos")
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    first = lambda c: F.min_by(F.col(c), F.when(filled(c), pos)).alias(c)
    scalars = [first(c) for c in TEXTS if c not in ("id", "abstract", "issn", "cn", "isbn", "clc", "full_text")]
    keep = [F.min_by(F.col(c), pos).alias(c) for c in ("id", "issn", "cn", "isbn", "clc", "full_text")]
    out = grouped.groupBy("group_id").agg(
        F.min(pos).alias("pos"), F.count(F.lit(1)).alias("copies"), *keep, *scalars,
        F.max_by(F.col("abstract"), F.when(filled("abstract"), F.struct(F.length("abstract"), -pos))).alias("abstract"),
        F.min_by(F.col("year"), F.when(F.col("year").isNotNull(), pos)).alias("year"),
        F.max(F.coalesce(F.col("citation_count"), F.lit(0))).alias("citation_count"),
        F.max_by(F.col("is_open_access"), F.when(F.col("is_open_access").isNotNull(), pos)).alias("is_open_access"))
    tagged = [F.transform(F.filter(F.col(c), lambda x: F.trim(x) != ""), _tag(c)) for c in LISTS]
    ids = F.transform(F.map_entries("source_ids"), lambda e: F.struct(
        F.lit("source_ids").alias("list"), e["key"].alias("fold"), F.lit(0).alias("i"), e["value"].alias("item")))
    items = grouped.select("group_id", "pos", F.explode_outer(F.concat(*tagged, ids)).alias("_x")).where("_x is not null").groupBy(
        "group_id", "_x.list", "_x.fold").agg(F.min(F.struct("pos", F.col("_x.i").alias("i"), F.col("_x.item").alias("item"))).alias("_first"))
    one = lambda name: F.array_sort(F.collect_list(F.when(F.col("list") == name, F.col("_first"))))
    lists = items.groupBy("group_id").agg(
        *[F.transform(one(c), lambda x: x["item"]).alias(c) for c in LISTS],
        F.map_from_entries(F.collect_list(F.when(F.col("list") == "source_ids", F.struct("fold", "_first.item")))).alias("source_ids"))
    merged = out.join(lists, "group_id", "left")
    for c in LISTS:
        merged = merged.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return merged.withColumn("source_ids", F.coalesce("source_ids", F.create_map().cast("map<string,string>")))


def _tag(name: str):
    def tag(x, i):
        return F.struct(F.lit(name).alias("list"), F.lower(x).alias("fold"), i.alias("i"), x.alias("item"))
    return tag


# --- ranking ------------------------------------------------------------------------------

# Weights of coverage, reasons, citations, recency, sources per profile.
PROFILES = {"balanced": (0.45, 0.20, 0.15, 0.15, 0.05), "classic": (0.35, 0.20, 0.35, 0.05, 0.05), "recent": (0.45, 0.20, 0.05, 0.25, 0.05)}


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def score(concepts: list[str], profile: str, this_year: int) -> Column:
    return scores(concepts, [profile], this_year)[profile]


def scores(concepts: list[str], profiles: list[str], this_year: int) -> Column:
    """A struct with the score under each profile; the text is normalised once."""
    text = norm_text(F.concat_ws(" ", "title", "abstract", _list("keywords"), _list("concepts"), _list("topics")))
    if concepts:
        covered = let(text, lambda t: reduce(lambda a, b: a + b, [F.contains(t, F.lit(c)).cast("int") for c in concepts])) / len(concepts)
    else:
        covered = F.lit(1.0)
    return let(covered, lambda share: F.struct(*[_weighted(share, p, this_year).alias(p) for p in profiles]))


def _weighted(covered: Column, profile: str, this_year: int) -> Column:
    parts = (covered, _unit(F.size("match_reasons") / 5.0), _unit(F.log10(F.coalesce(F.col("citation_count"), F.lit(0)) + 1.0) / 3.0),
             F.coalesce(_unit(1 - F.greatest(F.lit(0), this_year - F.col("year")) / 25.0), F.lit(0.0)), _unit(F.size("retrieved_from") / 3.0))
    return _unit(reduce(lambda a, b: a + b, [p * w for p, w in zip(parts, PROFILES[profile])]))


def rank_order() -> list[Column]:
    return [F.desc("relevance_score"), F.desc(F.coalesce(F.col("citation_count"), F.lit(0))), F.desc(F.coalesce(F.col("year"), F.lit(0))),
            F.lower(F.coalesce(F.col("title"), F.lit(""))).asc(), F.col("pos").asc()]


def rank_papers(records: DataFrame, concepts: list[str], profile: str = "balanced", this_year: int = 2026) -> DataFrame:
    return records.withColumn("relevance_score", score(concepts, profile, this_year)).orderBy(*rank_order())


def rank_positions(records: DataFrame, concepts: list[str], profiles: list[str] | None = None, this_year: int = 2026) -> DataFrame:
    """(profile, pos, relevance_score, rank): the place of each record under each profile, in one pass over the texts.

    Scores are compared to nine decimals, so that the order does not hang on the last bits.
    Places are counted per chunk of the score; no task orders a whole profile.
    """
    names = profiles or list(PROFILES)
    judged = records.select("pos", F.coalesce("citation_count", F.lit(0)).alias("_c"), F.coalesce("year", F.lit(0)).alias("_y"),
                            F.lower(F.coalesce("title", F.lit(""))).alias("_t"), scores(concepts, names, this_year).alias("_s"))
    rows = judged.select("pos", "_c", "_y", "_t", F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.col(f"_s.{p}").alias("relevance_score")) for p in names])).alias("_p"))
    rows = rows.select("_p.*", "pos", "_c", "_y", "_t")
    key = F.round("relevance_score", 9)
    order = [Down(key), Down(F.col("_c")), Down(F.col("_y")), F.col("_t"), F.col("pos")]
    return with_prefix(rows, ["profile"], order, F.floor(key * -4096).cast("long"), pos="rank").select("profile", "pos", "relevance_score", (F.col("rank") + 1).alias("rank"))


def lit_search(records: DataFrame, node: tuple, profile: str = "balanced", limit: int = 50, recall: bool = False, this_year: int = 2026,
               watch: dict[str, Observation] | None = None) -> DataFrame:
    """Filter, merge, rank, limit.  Filtering comes first: a record stands on its own fields.

    ``watch`` names observations for the stage counts (candidates, filtered, merged),
    which are filled by the one action that runs the search.
    """
    def seen(df, name):
        return df.observe(watch[name], F.count(F.lit(1)).alias("n")) if watch and name in watch else df

    kept = seen(bool_filter(seen(records, "candidates"), node, recall), "filtered")
    merged = seen(merge_papers(dedupe_papers(kept)), "merged")
    from tallyloom.operators.sorting import limit_clamp
    return limit_clamp(merged.withColumn("relevance_score", score(concept_terms(node), profile, this_year)), rank_order(), limit)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- citations ---------------------------------------------------------------------------------

def with_index(records: DataFrame, pos: str = "pos") -> DataFrame:
    """1-based running number in position order, without a one-task window."""
    at = with_prefix(records, [], [F.col(pos)], F.floor(F.col(pos) / 65536), pos="_idx")
    return at.withColumn("index", F.col("_idx") + 1).drop("_idx")


def _said(c: str, lead: str, tail: str = "") -> Column:
    return F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.concat(F.lit(lead), F.col(c).cast("string"), F.lit(tail))).otherwise("")


def _venue() -> Column:
    return F.when(F.trim(F.coalesce("venue", F.lit(""))) != "", F.col("venue")).otherwise(F.col("journal"))


def citation(index: Column) -> Column:
    """Numbered reference line."""
    n = F.size("authors")
    authors = F.when(n == 0, "Unknown").otherwise(F.concat(F.array_join(F.slice("authors", 1, 3), ", "), F.when(n > 3, ", et al").otherwise("")))
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "Untitled").otherwise(F.col("title"))
    venue = F.when(F.trim(F.coalesce(_venue(), F.lit(""))) != "", F.concat(_venue(), F.lit(", "))).otherwise("")
    return F.trim(F.concat(index.cast("string"), F.lit(". "), authors, F.lit(". "), title, F.lit("[J]. "), venue,
                           F.coalesce(F.col("year").cast("string"), F.lit("")), _said("volume", ", "), _said("issue", "(", ")"),
                           _said("pages", ": "), _said("doi", ". DOI: ")))


def bibtex_key(index: Column) -> Column:
    who = F.left(F.lower(F.regexp_replace(F.coalesce(F.col("first_author"), F.get("authors", F.lit(0)), F.lit("ref")), r"[^\p{L}\p{Nd}]", "")), F.lit(16))
    return F.when(who == "", F.concat(F.lit("ref"), index.cast("string"))).otherwise(
        F.concat(who, F.coalesce(F.col("year").cast("string"), F.lit("nd")), F.lit("_"), index.cast("string")))


def bibtex(index: Column) -> Column:
    """A BibTeX entry with its fields in name order; braces in values are escaped."""
    venue = F.nullif(F.trim(F.coalesce(_venue(), F.lit(""))), F.lit(""))
    article = venue.isNotNull() & F.col("year").isNotNull()
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    fields = [
        ("author", F.when(F.size("authors") > 0, F.array_join("authors", " and "))), ("doi", blank("doi")),
        ("howpublished", F.when(~article, venue)), ("journal", F.when(article, venue)), ("number", blank("issue")), ("pages", blank("pages")),
        ("title", F.coalesce(blank("title"), F.lit("Untitled"))), ("volume", blank("volume")), ("year", F.col("year").cast("string")),
    ]
    body = F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"  {n} = {{"), v, F.lit("}"))) for n, v in fields])), ",\n")
    return F.concat(F.lit("@"), F.when(article, "article").otherwise("misc"), F.lit("{"), bibtex_key(index), F.lit(",\n"), body, F.lit("\n}"))


def ref_gbt(kind: Column) -> Column:
    """Typed reference entry; a ``raw`` text wins, unknown kinds are articles.

    Columns used: author (list), title, journal, year, volume, issue, pages, doi,
    publisher, degree, number, url, access_date, raw.
    """
    opt = lambda c, lead="", tail="": F.coalesce(F.concat(F.lit(lead), F.col(c).cast("string"), F.lit(tail)), F.lit(""))
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    n = F.size("author")
    who = F.when(n <= 3, F.array_join("author", ", ")).otherwise(F.concat(F.array_join(F.slice("author", 1, 3), ", "), F.lit(", 等")))
    line = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    forms = {
        "book": line(who, ". ", say("title"), "[M]. ", opt("publisher", "", ", "), say("year"), opt("pages", ": "), "."),
        "thesis": line(who, ". ", say("title"), F.coalesce(F.concat(F.lit("["), F.col("degree"), F.lit("]")), F.lit("[D]")), ". ", say("journal"), opt("publisher", ". "), ", ", say("year"), "."),
        "conference": line(who, ". ", say("title"), "[C]. ", say("journal"), ", ", say("year"), opt("pages", ": "), "."),
        "patent": line(F.coalesce(F.get("author", F.lit(0)), F.lit("")), ". ", say("title"), "[P]", opt("number", ": "), ". ", say("year"), "."),
        "report": line(who, ". ", say("title"), "[R]", opt("publisher", ". "), ", ", say("year"), "."),
        "standard": line(opt("number", "", ", "), say("title"), "[S]. ", say("publisher"), ", ", say("year"), "."),
        "online": line(who, ". ", say("title"), "[EB/OL]. ", say("url"), opt("access_date", "[引用日期 ", "]"), "."),
    }
    out = F.when(F.col("raw").isNotNull(), F.col("raw"))
    for name, text in forms.items():
        out = out.when(kind == name, text)
    return out.otherwise(line(who, ". ", say("title"), "[J]. ", say("journal"), ", ", say("year"), opt("volume", ", "), opt("issue", "(", ")"),
                              opt("pages", ": "), ".", opt("doi", ". DOI: ")))
