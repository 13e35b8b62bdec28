"""Block packages: content, structure and asset tables, and block rows of plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.operators.corpus import let, normalize_text, strip

CONTENT = "blockId string, id string, index int, kind string, level int, text string, attributes map<string,string>"
PROVENANCE = ("struct<format:string,position:string,source:string,page:int,bbox:array<double>,sheet:string,address:string,"
              "slide:int,layout:map<string,string>>")
ASSETS = "struct<items:array<struct<id:string,name:string,shapeId:string,usedBy:array<string>>>>"


def parse_content(raw: DataFrame, doc: str, column: str) -> DataFrame:
    """One JSON line per block."""
    return raw.where(F.trim(column) != "").select(doc, F.from_json(column, CONTENT).alias("_b")).select(
        doc, F.coalesce("_b.blockId", "_b.id").alias("block_id"), F.col("_b.index").alias("idx"), "_b.kind", "_b.level", "_b.text", "_b.attributes")


def parse_structure(raw: DataFrame, doc: str, column: str) -> DataFrame:
    """The blockIndex map as rows."""
    index = F.from_json(column, f"struct<blockIndex:map<string,struct<provenance:{PROVENANCE}>>>")["blockIndex"]
    return raw.select(doc, F.explode_outer(index).alias("block_id", "_e")).where("block_id is not null").select(doc, "block_id", F.col("_e.provenance").alias("provenance"))


def parse_assets(raw: DataFrame, doc: str, column: str) -> DataFrame:
    return raw.select(doc, F.explode_outer(F.from_json(column, ASSETS)["items"]).alias("_a")).where("_a is not null").select(
        doc, "_a.id", "_a.name", F.col("_a.shapeId").alias("shape_id"), F.col("_a.usedBy").alias("used_by"))


def read_package(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages under ``root``/<doc>/: content.jsonl, structure.json, assets.json."""
    doc = F.element_at(F.split(F.input_file_name(), "/"), -2)
    lines = lambda name, whole: spark.read.text(f"{root}/*/{name}", wholetext=whole).withColumn("doc_id", doc)
    return (parse_content(lines("content.jsonl", False), "doc_id", "value"), parse_structure(lines("structure.json", True), "doc_id", "value"),
            parse_assets(lines("assets.json", True), "doc_id", "value"))


def block_kind(line: Column) -> Column:
    pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    return F.when(line.rlike(r"^#{1,6}\s"), "heading").when(pipes >= 2, "table").otherwise("paragraph")


def src_md_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Block rows in order: headings with level, paragraphs, tables of consecutive pipe rows.

    A table block starts at a pipe row whose line above is none; rule rows are left out.
    """
    def rows(lines):
        kinds = F.transform(lines, lambda x: F.when(x == "", "blank").otherwise(block_kind(x)))
        return let(kinds, lambda ks: F.filter(F.transform(lines, lambda x, i: F.struct(
            i.alias("i"), F.get(ks, i).alias("kind"), x.alias("line"),
            ((F.get(ks, i) != "table") | (F.coalesce(F.get(ks, i - 1), F.lit("")) != "table")).alias("opens"))), lambda r: r["kind"] != "blank"))

    lined = F.transform(F.split(normalize_text(F.col(text)), "\n", -1), strip)

    def blocks(rs):
        at = F.filter(F.transform(rs, lambda r, i: F.when(r["opens"], i)), lambda i: i.isNotNull())
        return let(at, lambda starts: F.transform(starts, lambda s, k: let(
            F.slice(rs, s + 1, F.coalesce(F.get(starts, k + 1), F.size(rs)) - s), lambda part: let(F.get(part, F.lit(0)), lambda head: F.struct(
                head["kind"].alias("kind"),
                F.when(head["kind"] == "heading", F.length(F.regexp_extract(head["line"], "^#+", 0))).otherwise(0).alias("level"),
                F.when(head["kind"] == "heading", strip(F.regexp_replace(head["line"], "^#+", ""))).when(head["kind"] == "paragraph", head["line"]).alias("text"),
                F.when(head["kind"] == "table", F.filter(F.transform(part, lambda r: r["line"]), lambda x: ~x.rlike(r"^\|?[\s:|-]+\|?$"))).alias("rows"))))))

    packed = let(let(lined, rows), blocks)
    return df.select(key, F.posexplode_outer(packed).alias("idx", "_b")).where("idx is not null").select(
        key, "idx", F.concat(F.lit("b"), F.col("idx").cast("string")).alias("block_id"), "_b.kind", "_b.level", "_b.text", "_b.rows")
