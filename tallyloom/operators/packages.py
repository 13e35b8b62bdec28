"""Views, metrics and integrity checks of block packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def block_view(blocks: DataFrame, structure: DataFrame, assets: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Every block with its structure entry and the ids of the assets that name or use it, without regard to case."""
    low = lambda c: F.lower(F.col(c))
    mentions = F.array_distinct(F.filter(F.concat(F.array(low("id"), low("name"), low("shape_id")), F.coalesce(
        F.transform("used_by", F.lower), F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    used = assets.select(doc, F.col("id").alias("_asset"), F.explode_outer(mentions).alias("_bid")).where("_bid is not null")
    per = used.groupBy(doc, "_bid").agg(F.array_sort(F.collect_set("_asset")).alias("asset_ids"))
    entries = structure.select(doc, F.lower("block_id").alias("_bid"), "provenance")
    return blocks.withColumn("_bid", F.lower("block_id")).join(entries, [doc, "_bid"], "left").join(per, [doc, "_bid"], "left").drop("_bid") \
        .withColumn("asset_ids", F.coalesce("asset_ids", F.array().cast("array<string>")))


def package_metrics(blocks: DataFrame, doc: str = "doc_id", warnings: DataFrame | None = None) -> DataFrame:
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    out = blocks.groupBy(doc).agg(
        F.count(F.lit(1)).alias("blocks"), n("paragraph").alias("paragraphs"), n("heading").alias("headings"), n("table").alias("tables"),
        n("figure").alias("figures"), n("image").alias("images"), n("references", "reference").alias("references"))
    if warnings is None:
        return out.withColumn("warnings", F.lit(0).cast("long"))
    per = warnings.groupBy(doc).agg(F.count(F.lit(1)).alias("warnings"))
    return out.join(per, doc, "left").withColumn("warnings", F.coalesce("warnings", F.lit(0)))


def package_check(structure: DataFrame, expected: Column, doc: str = "doc_id") -> DataFrame:
    """Evidence problems (doc, block, severity, problem) of the structure entries against the package format."""
    p = F.col("provenance")
    fmt = F.lower(expected)
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    has = p.isNotNull()
    rules = [
        ("error", "provenance missing", ~has), ("error", "format missing", has & blank(p["format"])),
        ("error", "format differs", has & ~blank(p["format"]) & (fmt != "") & (F.lower(p["format"]) != fmt)),
        ("error", "position missing", has & p["position"].isNull()), ("error", "source missing", has & blank(p["source"])),
        ("error", "page missing", has & (fmt == "pdf") & p["page"].isNull()),
        ("error", "bbox incomplete", has & (fmt == "pdf") & (F.coalesce(F.size(p["bbox"]), F.lit(-1)) != 4)),
        ("error", "sheet missing", has & (fmt == "xlsx") & blank(p["sheet"])), ("error", "address missing", has & (fmt == "xlsx") & blank(p["address"])),
        ("error", "slide missing", has & (fmt == "pptx") & p["slide"].isNull()), ("warning", "layout missing", has & (fmt == "pptx") & p["layout"].isNull()),
        ("error", "word position missing", has & (fmt == "docx") & p["position"].isNull()),
    ]
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("problem"))) for s, m, c in rules]), lambda x: x.isNotNull())
    return structure.select(doc, "block_id", F.explode_outer(found).alias("_f")).where("_f is not null").select(doc, "block_id", "_f.*")


def font_counts(runs: DataFrame, fields: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Uses per font and script role, and the total over roles (role ``any``)."""
    keys = keys or []
    roles = F.flatten(F.array(*[F.array(F.struct(F.lit(r).alias("role"), F.col(c).alias("font")), F.struct(F.lit("any").alias("role"), F.col(c).alias("font")))
                                for r, c in fields.items()]))
    long = runs.select(*keys, F.explode_outer(roles).alias("_f")).where("_f is not null").select(*keys, "_f.*").where(F.trim("font") != "")
    return long.groupBy(*keys, "role", "font").agg(F.count(F.lit(1)).alias("uses"))
