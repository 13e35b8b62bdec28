"""Frames that Spark derives from the given tables where a shape is missing, each with its SQL.

A derivation is one projection over the whole table; the SQL text builds the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.sources.tables import table

# Text put in front of a document's n-th line, so that papers have sections, tables and references.
LINE_HEADS = {
    1: "Author: group\nAbstract\n", 2: "Keywords: soil, rare earth；model、data\n# Introduction\n", 3: "第二章 研究方法\n",
    4: "2.1 Data and sample\n", 5: "Table 1: Sample size\n| name | n |\n|---|---|\n| a | ", 6: "3. Results\n", 7: "4.1.2 Deep notes\n",
    8: "References\n[1] ", 9: "[2] ", 10: "3. Zhang W. 2011. ", 12: "Appendix\n",
}
# Fragments exchanged everywhere in the text for citations, terms and secrets.
SWAPS = [
    (" this ", " [1] "), (" are ", " [2,3] "), (" was ", " (Smith et al., 2004) "), (" for ", " [@k1; @k2] "), (" as ", " [@k3] "), (" be ", " [7] "),
    ("ndst", "问卷"), ("thst", "量表"), ("ouha", "实验组"), ("onre", "因变量为产量、水分和"), ("hein", "因果"), ("ened", "机制"), ("edly", "数据来源"),
    ("inan", "DID"), ("ntes", "访谈"), ("erst", "样本"), ("stly", "导致"), ("lyer", "研究问题"), ("shin", "投入对增长的影响"), ("wher", "相关"),
    ("tand", "填补空白"), ("thea", "控制变量: 年龄，收入 "), ("ehe", "样本量"), ("hath", " ~/data "), ("esed", "http://a.example.com/x"),
    ("thwh", "ghp_0123456789abcdefghijABCDEFGHIJ012345"), ("whsh", "api_key = 'abcdefghij0123456789xyz'"), ("lyly", "/home/anna/x"),
]


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """documents rewritten as papers: doc_id, source, lang, text."""
    d = table(spark, sf, "documents")

    def lead(x, n):
        out = None
        for at, words in LINE_HEADS.items():
            out = F.when(n == at, F.concat(F.lit(words), x)) if out is None else out.when(n == at, F.concat(F.lit(words), x))
        return out.otherwise(x)

    text = F.array_join(F.transform(F.split("text", "\n", -1), lead), "\n")
    for a, b in SWAPS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return d.select("doc_id", "source", "lang", text.alias("text"))


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def papers_sql() -> str:
    cases = " ".join(f"when {at} then {quote(w)} || x" for at, w in LINE_HEADS.items())
    text = f"array_to_string(list_transform(string_split(text, chr(10)), lambda x, n: case n-1 {cases} else x end), chr(10))"
    for a, b in SWAPS:
        text = f"replace({text}, {quote(a)}, {quote(b)})"
    return f"paper as materialized (select doc_id, source, lang, {text} \"text\" from documents)"


def page_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words with geometry: each text line is a page, set in rows over two columns, or three on every third page."""
    from pyspark.sql import Window as W

    # texts are dealt out by document before they are unrolled: the windows per page then shuffle nothing, and a part
    # holds so few texts that its words are sorted in memory
    d = table(spark, sf, "documents").select("doc_id", "text")
    d = d.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-d.count() // 2500)), "doc_id")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "_line"))
    w = lines.select("doc_id", "page", F.posexplode(F.split("_line", " ", -1)).alias("word_id", "text")).where(F.col("text") != "")
    n = F.length("text")
    before = W.partitionBy("doc_id", "page").orderBy("word_id").rowsBetween(W.unboundedPreceding, -1)
    o = F.coalesce(F.sum(n + 1).over(before), F.lit(0))
    three = F.col("page") % 3 == 0
    w = w.withColumn("_o", o).withColumn("_row", F.when(three, F.floor(F.col("_o") / 66)).otherwise(F.floor(F.col("_o") / 90))) \
        .withColumn("_r", F.when(three, F.col("_o") % 66).otherwise(F.col("_o") % 90))
    x0 = F.when(three, F.floor(F.col("_r") / 22) * 180 + F.col("_r") % 22 * 5 + 50.0).when(
        F.col("_r") < 45, F.col("_r") * 5 + 50.0).otherwise((F.col("_r") - 45) * 5 + 320.0)
    size = F.when(F.col("_row") == 0, 16.0).otherwise(n % 3 + 10.0)
    y0 = F.lit(780.0) - F.col("_row") * 14
    font = F.when(F.col("text").rlike("^[A-Z]"), "ABCDEF+Times-Bold").when(n % 7 == 0, "Arial-Italic").otherwise("Times")
    return w.select("doc_id", "page", "word_id", "text", x0.alias("x0"), y0.alias("y0"), (x0 + n * 5).alias("x1"), (y0 + size).alias("y1"), size.alias("size"),
                    font.alias("font"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))


PAGE_WORDS_SQL = """w0 as (select doc_id, cast(unnest(range(len(l))) as int) page, unnest(l) line from (select doc_id, string_split(text, chr(10)) l from documents)),
w1 as (select doc_id, page, unnest(range(len(k))) word_id, unnest(k) t from (select doc_id, page, string_split(line, ' ') k from w0)),
w2 as (select *, length(t) n, coalesce(sum(length(t)+1) over (partition by doc_id, page order by word_id rows between unbounded preceding and 1 preceding), 0) o from w1 where t<>''),
w3 as (select *, case when page%3=0 then o//66 else o//90 end rw, case when page%3=0 then (o%66)//22*180+o%66%22*5+50 when o%90<45 then o%90*5+50 else (o%90-45)*5+320 end x from w2),
wd as materialized (select doc_id, page, cast(word_id as int) word_id, t "text", n, x::double x0, (780-rw*14)::double y0, (x+n*5)::double x1, (case when rw=0 then 16 else n%3+10 end)::double sz,
 (780-rw*14)::double + (case when rw=0 then 16 else n%3+10 end)::double y1,
 case when regexp_matches(t,'^[A-Z]') then 'ABCDEF+Times-Bold' when n%7=0 then 'Arial-Italic' else 'Times' end font from w3)"""
