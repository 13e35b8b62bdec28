"""Bibliographic records from landed JSON, and record exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.operators.corpus import let
from tallyloom.operators.papers import SCHEMA, as_records, bibtex, citation, norm_doi, with_index

_RECORDS = f"array<struct<{SCHEMA.replace(' string', ':string').replace(' array<', ':array<').replace(' int', ':int').replace(' boolean', ':boolean').replace(' map<', ':map<')}>>"


def parse_papers(raw: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """JSON texts holding a bare record array or an object with ``records``."""
    bare = F.ltrim(F.col(column)).startswith("[")
    wrapped = F.from_json(column, f"struct<records:{_RECORDS}>")["records"]
    rows = raw.select(*(keep or []), F.explode_outer(F.when(bare, F.from_json(column, _RECORDS)).otherwise(wrapped)).alias("_r")).where("_r is not null")
    return as_records(rows.select(*(keep or []), "_r.*")) if not keep else rows.select(*keep, "_r.*")


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    return parse_papers(spark.read.text(path, wholetext=True))


def _filled(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _names(items: Column, field: str) -> Column:
    return F.filter(F.transform(items, lambda x: _filled(x[field])), lambda x: x.isNotNull())


def invert_abstract(text: Column) -> Column:
    """Inverted index {word: [positions]} of a text, inside its row: sorted (word, position) pairs are cut into runs of one word."""
    def runs(ws):
        at = F.filter(F.transform(ws, lambda x, i: F.when((i == 0) | (x["w"] != F.get(ws, i - 1)["w"]), i)), lambda i: i.isNotNull())
        return let(at, lambda a: F.transform(a, lambda s, k: F.struct(
            F.get(ws, s)["w"].alias("w"), F.transform(F.slice(ws, s + 1, F.coalesce(F.get(a, k + 1), F.size(ws)) - s), lambda x: x["p"]).alias("ps"))))

    pairs = F.transform(F.split(text, " ", -1), lambda w, p: F.struct(w.alias("w"), p.alias("p")))
    return F.map_from_entries(let(F.sort_array(pairs), runs))


def restore_abstract(index: Column) -> Column:
    """Text of an inverted index {word: [positions]}: one word per position, the later word wins."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, k: F.transform(
        e["value"], lambda p: F.struct(p.alias("p"), k.alias("k"), e["key"].alias("w")))))
    kept = let(F.array_sort(pairs), lambda ps: F.filter(ps, lambda x, i: F.coalesce(F.get(ps, i + 1)["p"] != x["p"], F.lit(True))))
    return let(kept, lambda ws: F.when(F.size(ws) > 0, F.array_join(F.transform(ws, lambda x: x["w"]), " ")))


_OPENALEX = """id string, display_name string, title string, doi string, publication_year int, cited_by_count int,
 primary_location struct<source:struct<display_name:string>>, abstract_inverted_index map<string,array<int>>,
 open_access struct<is_oa:boolean,oa_status:string,oa_url:string>, best_oa_location struct<pdf_url:string,license:string,landing_page_url:string>,
 authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>,
 concepts array<struct<display_name:string>>, topics array<struct<display_name:string>>"""


def norm_openalex(raw: DataFrame, column: str = "value", pos: str = "pos") -> DataFrame:
    w = raw.select(pos, F.from_json(column, _OPENALEX).alias("w")).select(F.col(pos).alias("pos"), "w.*")
    authors = _names(F.transform("authorships", lambda a: a["author"]), "display_name")
    return as_records(w.select(
        "pos", "id", F.coalesce("display_name", "title").alias("title"), norm_doi(F.col("doi")).alias("doi"), F.col("publication_year").alias("year"),
        F.col("primary_location.source.display_name").alias("venue"), F.col("primary_location.source.display_name").alias("journal"),
        F.col("cited_by_count").alias("citation_count"), restore_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        F.col("open_access.is_oa").alias("is_open_access"), F.col("open_access.oa_status").alias("oa_status"),
        F.coalesce("open_access.oa_url", "best_oa_location.landing_page_url").alias("landing_page_url"),
        F.coalesce("best_oa_location.pdf_url", "open_access.oa_url").alias("pdf_url"), F.col("best_oa_location.license").alias("license"),
        authors.alias("authors"), F.get(authors, F.lit(0)).alias("first_author"),
        F.array_distinct(_names(F.flatten(F.transform("authorships", lambda a: F.coalesce(a["institutions"], F.array()))), "display_name")).alias("affiliations"),
        _names(F.col("concepts"), "display_name").alias("concepts"), _names(F.col("topics"), "display_name").alias("topics"),
        F.array(F.lit("openalex")).alias("retrieved_from"), F.create_map(F.lit("openalex"), F.col("id")).alias("source_ids")))


_DATE = "struct<`date-parts`:array<array<int>>>"
_CROSSREF = f"""DOI string, title array<string>, `container-title` array<string>, publisher string, volume string, issue string, page string,
 `is-referenced-by-count` int, `published-print` {_DATE}, `published-online` {_DATE}, published {_DATE}, issued {_DATE},
 author array<struct<given:string,family:string,affiliation:array<struct<name:string>>>>, license array<struct<URL:string>>, funder array<struct<name:string>>"""


def norm_crossref(raw: DataFrame, column: str = "value", pos: str = "pos") -> DataFrame:
    w = raw.select(pos, F.from_json(column, _CROSSREF).alias("w")).select(F.col(pos).alias("pos"), "w.*")
    year = F.coalesce(*[F.get(F.get(F.col(f"`{p}`")["date-parts"], F.lit(0)), F.lit(0)) for p in ("published-print", "published-online", "published", "issued")])
    authors = F.filter(F.transform("author", lambda a: F.concat_ws(" ", _filled(a["given"]), _filled(a["family"]))), lambda x: x != "")
    doi = norm_doi(F.col("DOI"))
    return as_records(w.select(
        "pos", doi.alias("doi"), F.get("title", F.lit(0)).alias("title"), F.get("`container-title`", F.lit(0)).alias("venue"),
        F.get("`container-title`", F.lit(0)).alias("journal"), "publisher", "volume", "issue", F.col("page").alias("pages"), year.alias("year"),
        F.col("`is-referenced-by-count`").alias("citation_count"), authors.alias("authors"), F.get(authors, F.lit(0)).alias("first_author"),
        F.array_distinct(_names(F.flatten(F.transform("author", lambda a: F.coalesce(a["affiliation"], F.array()))), "name")).alias("affiliations"),
        F.get(_names(F.col("license"), "URL"), F.lit(0)).alias("license"), _names(F.col("funder"), "name").alias("funders"),
        F.array(F.lit("crossref")).alias("retrieved_from"),
        F.when(doi.isNotNull(), F.create_map(F.lit("crossref"), doi)).otherwise(F.create_map().cast("map<string,string>")).alias("source_ids")))


_UNPAYWALL = "doi string, title string, is_oa boolean, oa_status string, year int, best_oa_location struct<url_for_pdf:string,url:string,license:string,host_type:string>"


def norm_unpaywall(raw: DataFrame, column: str = "value", pos: str = "pos") -> DataFrame:
    w = raw.select(pos, F.from_json(column, _UNPAYWALL).alias("w")).select(F.col(pos).alias("pos"), "w.*")
    doi, host = norm_doi(F.col("doi")), _filled(F.col("best_oa_location.host_type"))
    return as_records(w.select(
        "pos", doi.alias("doi"), "title", F.col("is_oa").alias("is_open_access"), "oa_status", "year", F.col("best_oa_location.url_for_pdf").alias("pdf_url"),
        F.col("best_oa_location.url").alias("landing_page_url"), F.col("best_oa_location.license").alias("license"),
        F.when(host.isNotNull(), F.array(F.concat(F.lit("unpaywall_host_type="), host))).alias("match_reasons"),
        F.array(F.lit("unpaywall")).alias("retrieved_from"),
        F.when(doi.isNotNull(), F.create_map(F.lit("unpaywall"), doi)).otherwise(F.create_map().cast("map<string,string>")).alias("source_ids")))


_AMINER = """id string, title string, title_zh string, doi string, year int, n_citation int, abstract string, abstract_zh string, venue string,
 authors array<struct<name:string,name_zh:string,org:string,org_zh:string>>, keywords array<string>, keywords_zh array<string>"""


def norm_aminer(raw: DataFrame, column: str = "value", pos: str = "pos") -> DataFrame:
    w = raw.select(pos, F.from_json(column, _AMINER).alias("w")).select(F.col(pos).alias("pos"), "w.*")
    pick = lambda a, b: F.array_distinct(F.filter(F.transform("authors", lambda x: _filled(F.coalesce(x[a], x[b]))), lambda x: x.isNotNull()))
    doi = norm_doi(F.col("doi"))
    none = F.array().cast("array<string>")
    return as_records(w.select(
        "pos", "id", F.coalesce("title", "title_zh").alias("title"), doi.alias("doi"), "year", F.col("n_citation").alias("citation_count"),
        F.coalesce("abstract", "abstract_zh").alias("abstract"), F.col("venue"), F.col("venue").alias("journal"), pick("name", "name_zh").alias("authors"),
        F.get(pick("name", "name_zh"), F.lit(0)).alias("first_author"), pick("org", "org_zh").alias("affiliations"),
        F.array_distinct(F.filter(F.concat(F.coalesce("keywords", none), F.coalesce("keywords_zh", none)), lambda x: F.trim(x) != "")).alias("keywords"),
        F.array(F.lit("aminer")).alias("retrieved_from"),
        F.when(F.coalesce(doi, _filled(F.col("id"))).isNotNull(), F.create_map(F.lit("aminer"), F.coalesce(doi, F.col("id"))))
        .otherwise(F.create_map().cast("map<string,string>")).alias("source_ids")))


_METASO = "title string, link string, snippet string, date string, authors array<string>"


def norm_metaso(raw: DataFrame, column: str = "value", pos: str = "pos") -> DataFrame:
    w = raw.select(pos, F.from_json(column, _METASO).alias("w")).select(F.col(pos).alias("pos"), "w.*")
    authors = F.array_distinct(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    link = F.coalesce("link", F.lit(""))
    return as_records(w.select(
        "pos", F.coalesce(F.nullif(link, F.lit("")), F.md5(F.coalesce("title", F.lit("")))).alias("id"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("snippet", F.lit("")).alias("abstract"), F.left("date", F.lit(4)).try_cast("int").alias("year"), link.alias("landing_page_url"),
        authors.alias("authors"), F.get(authors, F.lit(0)).alias("first_author"), F.array(F.lit("metaso")).alias("retrieved_from"),
        F.when(link != "", F.create_map(F.lit("metaso"), link)).otherwise(F.create_map().cast("map<string,string>")).alias("source_ids")))


# --- exports -----------------------------------------------------------------------------

def to_json_lines(records: DataFrame) -> DataFrame:
    return records.select("pos", F.to_json(F.struct(*[c for c in records.columns if c != "pos"])).alias("value"))


def to_markdown_lines(records: DataFrame) -> DataFrame:
    return with_index(records).select("index", citation(F.col("index")).alias("value"))


def to_bibtex(records: DataFrame) -> DataFrame:
    return with_index(records).select("index", bibtex(F.col("index")).alias("value"))


def save_lines(lines: DataFrame, order: str, path: str) -> None:
    """Text files in order: range-partitioned, so a part file holds a contiguous run."""
    lines.orderBy(order).select("value").write.mode("overwrite").text(path)
