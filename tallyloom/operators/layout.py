"""Page geometry: words to lines, line features, reading order, tables, headings.

Groups are pages; the number of words on a page is small whatever the corpus holds, so
plain windows per page are safe, and the lines of a page are gathered into one row, inside
which columns, reading order and tables are found without a join.  Baselines and edges are
grouped by chained gaps over sorted values, where the source toolkit takes the first group in reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.operators.corpus import let, quality_score
from tallyloom.operators.ordering import join_same

PAGE = ["doc_id", "page"]
_WIDE = ["page_width", "page_height"]


def _cut(items: Column, opens) -> Column:
    """A bound array as the array of its runs; ``opens(x, before)`` marks the first of a run, as does the array's start."""
    at = F.filter(F.transform(items, lambda x, i: F.when((i == 0) | opens(x, F.get(items, i - 1)), i)), lambda i: i.isNotNull())
    return let(at, lambda a: F.transform(a, lambda s, j: F.slice(items, s + 1, F.coalesce(F.get(a, j + 1), F.size(items)) - s)))


def _falling(v: Column) -> Column:
    """A sort key that falls with ``v``: NaN first and NULL last, as in a descending sort."""
    return F.struct(F.when(v.isNull(), 2).when(F.isnan(v), 0).otherwise(1).alias("kind"), (-v).alias("v"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x) / F.size(values)


def _runs(df: DataFrame, keys: list[str], order: list[Column], opens: Column, name: str) -> DataFrame:
    """Numbers runs 0, 1, … along the order; ``opens`` marks the first row of a run."""
    w = W.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_o", F.when(opens, 1).otherwise(0))
    return flagged.withColumn(name, (F.sum("_o").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")).drop("_o")


def line_build(words: DataFrame) -> DataFrame:
    """Adds ``line_no`` to words (doc_id, page, word_id, x0, y0, x1, y1, text, font, size, page_width, page_height)."""
    down = [F.col("y0").desc(), F.col("x0"), F.col("word_id")]
    above = W.partitionBy(*PAGE).orderBy(*down)
    step = F.lag("y0").over(above) - F.col("y0")
    reach = F.greatest(F.lit(2.0), F.col("size") * 0.45)
    flagged = words.withColumn("_n", step.isNull() | (step > reach))
    based = _runs(flagged, PAGE, down, F.col("_n"), "_base").drop("_n")
    row = W.partitionBy(*PAGE, "_base").orderBy("x0", "word_id")
    # the whole row in the order of the gaps, so that one sort serves both
    whole = row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    spread = based.withColumn("_g", F.col("x0") - F.lag("x1").over(row)).withColumn("_s", F.collect_list("size").over(whole)).withColumn("_k", F.count(F.lit(1)).over(whole))
    mid, tenth = F.get(F.sort_array("_s"), F.floor(F.col("_k") / 2).cast("int")), F.col("page_width") * 0.10
    # most gaps are narrower than a tenth of the page, and only the others look at the sizes
    wide = F.when(F.col("_g") <= tenth, False).otherwise(F.col("_g") > F.greatest(mid * 3, tenth))
    split = spread.withColumn("_open", F.col("_g").isNull() | wide).drop("_s", "_k", "_g")
    return _runs(split, PAGE, [F.col("_base"), F.col("x0"), F.col("word_id")], F.col("_open"), "line_no").drop("_base", "_open")


def _most_common(fonts: Column) -> Column:
    """Most frequent value; the earliest one wins a tie."""
    return let(fonts, lambda all_: F.array_max(F.transform(F.array_distinct(all_), lambda f: F.struct(
        F.size(F.filter(all_, lambda g: g == f)).alias("n"), (-F.array_position(all_, f)).alias("p"), f.alias("f"))))["f"])


def _boxed(words: DataFrame, *more: Column) -> DataFrame:
    """One row per line that has a text: its box, the page's size and ``more``."""
    written = F.max(F.trim("text") != "")
    lines = words.groupBy(*PAGE, "line_no").agg(
        F.min("x0").alias("left"), F.min("y0").alias("bottom"), F.max("x1").alias("right"), F.max("y1").alias("top"),
        *[F.max(c).alias(c) for c in _WIDE], written.alias("_some"), *more)
    return lines.where("_some").drop("_some")


def line_boxes(words: DataFrame) -> DataFrame:
    """The boxes of :func:`line_features`, for what needs no text."""
    return _boxed(words)


def line_features(words: DataFrame, suspects: DataFrame | None = None) -> DataFrame:
    """One row per line: box, text, font, median size, bold, italic, gibberish."""
    at = F.sort_array(F.collect_list(F.struct("x0", "word_id", "text", "font", "size")))
    lines = _boxed(words, at.alias("_w"), F.bool_or(F.lower("font").contains("bold")).alias("bold"), F.bool_or(F.lower("font").rlike("italic|oblique")).alias("italic"))
    get = lambda f: F.transform("_w", lambda x: x[f])
    sizes = F.sort_array(F.filter(get("size"), lambda x: x.isNotNull()))
    out = lines.withColumn("text", F.array_join(get("text"), " ")).withColumn("font", _most_common(get("font"))) \
        .withColumn("size", F.get(sizes, F.floor(F.size("_w") / 2).cast("int"))).drop("_w")
    if suspects is not None:
        out = out.join(suspects.select("doc_id", "font").withColumn("_bad", F.lit(True)), ["doc_id", "font"], "left")
        score = F.when(F.coalesce("_bad", F.lit(False)), 1.0).otherwise(quality_score(F.col("text")))
    else:
        score = quality_score(F.col("text"))
    return out.withColumn("gibberish_score", score).withColumn("gibberish", F.col("gibberish_score") > 0.25).drop("_bad")


def _gathered(lines: DataFrame) -> DataFrame:
    """One row per page with the array ``lines``, which a frame of pages has already."""
    if "lines" in lines.columns:
        return lines
    rest = [c for c in lines.columns if c not in [*PAGE, *_WIDE]]
    wide = [F.max(c).alias(c) for c in _WIDE if c in lines.columns]
    return lines.groupBy(*PAGE).agg(*wide, F.collect_list(F.struct(*rest)).alias("lines"))


def _mid(x: Column) -> Column:
    return (x["left"] + x["right"]) / 2


def _split_x(lines: Column, width: Column) -> Column:
    """The boundary of a two-column page, from the left edges of its narrow lines or else their widest gap; or NULL."""
    def by_edge(lefts):
        runs = _cut(lefts, lambda x, p: (x["left"] - p["left"]).isNull() | (x["left"] - p["left"] > F.greatest(F.lit(18.0), width * 0.04)))
        means = F.transform(F.filter(runs, lambda r: F.size(r) >= 3), lambda r: _mean(F.transform(r, lambda x: x["left"])))
        return let(means, lambda m: F.when((F.size(m) >= 2) & (F.array_max(m) - F.array_min(m) >= width * 0.18), (F.array_min(m) + F.array_max(m)) / 2))

    def by_gap(mids):
        def gap(x, i):
            p = F.get(mids, i - 1)
            found = (x["mid"] - p["mid"] > width * 0.10) & (i >= 3) & (F.size(mids) - i >= 3)
            return F.when(found, F.struct((x["mid"] - p["mid"]).alias("gap"), (-i).alias("i"), ((p["mid"] + x["mid"]) / 2).alias("x")))
        return F.array_max(F.transform(mids, gap))["x"]

    def split(narrow):
        lefts = F.sort_array(F.transform(narrow, lambda x: F.struct(x["left"].alias("left"), x["line_no"].alias("line_no"))))
        mids = F.sort_array(F.transform(narrow, lambda x: F.struct(_mid(x).alias("mid"), x["line_no"].alias("line_no"))))
        return F.when(F.size(narrow) >= 6, F.coalesce(let(lefts, by_edge), let(mids, by_gap)))

    return let(F.filter(lines, lambda x: x["right"] - x["left"] < width * 0.62), split)


def column_split(lines: DataFrame) -> DataFrame:
    """Adds ``split_x``: the boundary of a two-column page, or NULL."""
    pages = _gathered(lines)
    found = pages.withColumn("split_x", _split_x(F.col("lines"), F.col("page_width")))
    return found if pages is lines else found.select(*PAGE, *_WIDE, F.explode("lines").alias("_l"), "split_x").select(*PAGE, *_WIDE, "_l.*", "split_x")


def reading_order(lines: DataFrame) -> DataFrame:
    """Adds ``position``: full-width lines cut a two-column page into bands; in a band the left column comes first."""
    sx, pw = F.col("split_x"), F.col("page_width")

    def marked(x):
        mid, width = _mid(x), x["right"] - x["left"]
        full = ((x["left"] < sx - 4) & (x["right"] > sx + 4)) | (width > pw * 0.60) | ((F.abs(mid - sx) < pw * 0.08) & (width > pw * 0.25))
        rest = ~F.coalesce(sx.isNotNull() & full, F.lit(False))
        # a full line stands before the others of its height, so that it opens the band of all that are not above it
        return F.struct(_falling(x["top"]).alias("top"), rest.alias("rest"), x["left"].alias("left"), x["line_no"].alias("line_no"),
                        F.when(~rest | sx.isNull() | (mid <= sx), 0).otherwise(1).alias("side"), x.alias("l"))

    down = F.sort_array(F.transform("lines", marked))
    bands = let(down, lambda d: _cut(d, lambda x, p: ~x["rest"]))
    inside = lambda b: F.sort_array(F.transform(b, lambda x: F.struct(*[x[n].alias(n) for n in ("rest", "side", "top", "left", "line_no", "l")])))
    ordered = F.flatten(F.transform(bands, inside))
    placed = column_split(_gathered(lines)).select(*PAGE, *_WIDE, "split_x", F.posexplode(ordered).alias("position", "_l"))
    return placed.select(*PAGE, *_WIDE, "_l.l.*", "split_x", "position")


def table_regions(lines: DataFrame) -> DataFrame:
    """Runs of four or more multi-cell rows with 2–12 column bands and at least three aligned rows."""
    known = "split_x" in lines.columns and "lines" not in lines.columns
    pages = _gathered(lines).withColumn("split_x", F.array_max(F.transform("lines", lambda x: x["split_x"]))) if known else column_split(_gathered(lines))
    sx, pw = F.col("split_x"), F.col("page_width")

    def rows(down):
        tall = lambda x: x["l"]["top"] - x["l"]["bottom"]
        step = lambda x, p: p["l"]["bottom"] - x["l"]["bottom"]
        return _cut(down, lambda x, p: step(x, p).isNull() | (step(x, p) > F.greatest(F.lit(3.0), F.greatest(tall(x), tall(p)) * 0.45)))

    def row(r, i):
        get = lambda n: F.transform(r, lambda x: x["l"][n])
        mids = F.transform(r, lambda x: _mid(x["l"]))
        two = F.coalesce((F.size(r) == 2) & (F.array_min(mids) < sx) & (F.array_max(mids) > sx), F.lit(False))
        return F.when((F.size(r) >= 2) & ~two, F.struct(
            i.alias("row"), F.filter(get("left"), lambda x: x.isNotNull()).alias("cells"), F.array_min(get("left")).alias("left"),
            F.array_min(get("bottom")).alias("bottom"), F.array_max(get("right")).alias("right"), F.array_max(get("top")).alias("top")))

    def region(rs):
        def of(centres):
            edges = F.zip_with(F.slice(centres, 1, F.size(centres) - 1), F.slice(centres, 2, F.size(centres) - 1), lambda a, b: (a + b) / 2)
            slots = lambda e: F.transform(rs, lambda r: F.size(F.array_distinct(F.transform(r["cells"], lambda x: F.size(F.filter(e, lambda y: y <= x))))))
            get = lambda n: F.transform(rs, lambda r: r[n])
            aligned = let(edges, lambda e: F.size(F.filter(slots(e), lambda n: n >= 2)))
            return F.when(F.size(centres).between(2, 12), F.struct(
                rs[0]["row"].alias("first_row"), F.size(rs).cast("long").alias("rows"), F.size(centres).alias("columns"), aligned.alias("aligned_rows"),
                F.array_min(get("left")).alias("left"), F.array_min(get("bottom")).alias("bottom"), F.array_max(get("right")).alias("right"), F.array_max(get("top")).alias("top")))

        xs = F.sort_array(F.flatten(F.transform(rs, lambda r: r["cells"])))
        bands = let(xs, lambda a: _cut(a, lambda x, p: x - p > F.greatest(F.lit(12.0), pw * 0.015)))
        return let(F.sort_array(F.transform(F.filter(bands, lambda b: F.size(b) >= 2), _mean)), of)

    down = F.sort_array(F.transform("lines", lambda x: F.struct(_falling(x["bottom"]).alias("k"), x["left"].alias("left"), x["line_no"].alias("line_no"), x.alias("l"))))
    multi = F.filter(F.transform(let(down, rows), row), lambda r: r.isNotNull())
    islands = let(multi, lambda m: _cut(m, lambda x, p: x["row"] != p["row"] + 1))
    found = F.transform(F.filter(islands, lambda rs: F.size(rs) >= 4), region)
    return pages.select(*PAGE, F.explode(F.filter(found, lambda t: t["aligned_rows"] >= 3)).alias("_t")).select(*PAGE, "_t.*")


def heading_infer(lines: DataFrame) -> DataFrame:
    """Adds ``kind`` from font sizes relative to the document's median and 95th percentile.

    Sizes are counted per (document, size) first; order statistics read that small table.
    """
    whole = W.partitionBy("doc_id")
    counted = F.when(F.col("size") > 0, F.col("size"))
    sizes = lines.groupBy("doc_id", counted.alias("size")).agg(F.count(counted).alias("_n"), F.min(F.struct("page", "line_no")).alias("_f"))
    run = sizes.withColumn("_hi", F.sum("_n").over(whole.orderBy("size").rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(whole))
    at = lambda i: F.min(F.when(F.col("_hi") > i, F.col("size")))
    marks = run.groupBy("doc_id").agg(at(F.floor(F.col("_all") / 2)).alias("_med"), at(F.floor((F.col("_all") - 1) * 0.95)).alias("_p95"), F.min("_f").alias("_f"))
    short, size = F.col("_len") <= 120, F.col("size")
    first = F.struct("page", "line_no") == F.col("_f")
    d = join_same(lines.withColumn("_len", F.length("text")), marks, ["doc_id"], "left")
    head = (first & (F.col("_len") <= 100)) | (short & (
        ((F.col("_p95") > 0) & (size >= F.col("_p95") * 0.97)) | ((F.col("_med") > 0) & (size > F.col("_med") * 1.25)) | (F.col("bold") & (size > F.col("_med") * 1.05))))
    return d.withColumn("kind", F.when(head, "heading").otherwise("paragraph")).drop("_len", "_med", "_p95", "_f")


def page_block_order(blocks: DataFrame, page: str, idx: str, block: str, doc: str = "doc_id") -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct(idx, block))), lambda x: x[block])
    return blocks.groupBy(doc, page).agg(ids.alias("block_ids"))


def page_layout_class(pages: DataFrame, doc: str, chars: str, image_ratio: str) -> DataFrame:
    """text / hybrid / scan / unknown per document from characters per page and image coverage."""
    per = pages.groupBy(doc).agg(F.count(chars).alias("pages"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"), F.coalesce(F.avg(image_ratio), F.lit(0.0)).alias("coverage"))
    density = F.try_divide("chars", "pages")
    kind = F.when(F.col("pages") == 0, "unknown").when((density >= 80) & (F.col("coverage") < 0.55), F.when(F.col("coverage") >= 0.20, "hybrid").otherwise("text")) \
        .when((F.col("chars") == 0) | ((density < 20) & (F.col("coverage") >= 0.55)), "scan").otherwise("hybrid")
    return per.withColumn("class", kind)
