"""Shared steps of the corpus diagnostics against their plain forms."""

import re

from pyspark.sql import functions as F

from tallyloom.functions import lexicon as lx
from tallyloom.operators import corpus as co

TEXTS = [
    "", " \n ", "plain", "  a   ", "　a\t b\r\rc\r\n", "# Data\nx\n方法\ny", "第一章 结果 \n样本量 问卷KİD\nDID 编码员",
    "问\n卷 问 卷", "本研究因变量为产量、水分。处理组变量：甲", "政策对增长的影响\n对增长的影响\nA促进B对CD的 作用", "时间变量：\n年份", "x" * 40 + "影响" + "y" * 40, None,
]


def rows(spark, c, texts=TEXTS):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).sortWithinPartitions("i").select(c).collect()]


def test_strip_leaves_blanks_before_a_line_separator(spark):
    assert rows(spark, co.strip(F.col("t")), ["  a   ", "\x0b a\n"]) == ["a   ", "a"]


def test_normalised_text_is_that_of_the_patterns(spark):
    want = [None if t is None else re.sub(r"[ \t]+", " ", re.sub("\r\n?", "\n", t).replace("　", " ")).strip(" \t\n\x0b\f\r") for t in TEXTS]
    assert rows(spark, co.normalize_text(F.col("t"))) == want


def test_section_names_are_those_of_the_sections_but_need_no_bodies(spark):
    t = F.col("t")
    assert rows(spark, co.section_names(t)) == rows(spark, F.transform(co.section_list(co.normalize_text(t)), lambda s: s["canonical"]))
    assert "array_join" not in str(co.section_names(t))


def test_words_are_found_in_the_short_text_as_in_the_lower_cased_one(spark):
    words = ["问卷", "编码", "DID", "Likert", "t检验", "样本", "k", "一", ""]
    both = F.array(*[F.struct(co.holds(co.seen(d), w).alias("a"), F.contains(F.lower("t"), F.lit(w.lower())).alias("b")) for w in words
                     for d in [F.struct(*co.seen_of(F.col("t")))]])
    assert all(x["a"] == x["b"] for r in rows(spark, both) for x in r)
    # all but words with letters need the runs beyond ASCII only
    assert "wide" in str(co.holds(co.Seen(F.col("low"), F.col("wide")), "问卷")) and "low" in str(co.holds(co.Seen(F.col("low"), F.col("wide")), "t检验"))


def test_effects_are_searched_once_in_lines_with_their_literals(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t], "i int, t string")
    got = {(r["i"], r["label"], r["role"]) for r in co.var_candidates(df, "i", "t").collect()}
    want = set()
    clean = lambda x: re.sub("^[ ：:，,。；;]+|[ ：:，,。；;]+$", "", re.sub("^(本文|本研究|主要|核心)", "", re.sub("[\"'“”‘’（）()]", "", x.strip())))
    for i, t in enumerate(TEXTS):
        for p in (lx.EFFECT_OF, lx.AFFECTS):
            for m in re.finditer(p, t or ""):
                want |= {(i, clean(m[1]), "自变量"), (i, clean(m[2]), "因变量")}
    assert want and {w for w in want if w[1] not in lx.VARIABLE_STOP} <= got
    assert all(re.search("|".join(map(re.escape, lits)), m) for p, m in ((lx.EFFECT_OF, "甲乙对丙丁的作用"), (lx.AFFECTS, "甲乙抑制丙丁")) for lits in lx.EFFECT_LITERALS[p])


def test_lines_of_blank_texts_and_titles_with_odd_blanks(spark):
    texts = ["", " \n ", None, "\x0ba", "1. Foo\x0b\nx", "\x0b\nabstract\nx", "İNTRODUCTION\ny"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = sorted((r["i"], r["line_no"], r["line"], r["section"]) for r in co.section_assign(df, "i", "t").collect())
    assert [(i, n, line, s or "") for i, n, line, s in got] == [
        (0, 1, "", ""), (1, 1, "", ""), (3, 1, "\x0ba", "全文"), (4, 1, "1. Foo\x0b", "Foo\x0b"), (4, 2, "x", "Foo\x0b"), (5, 1, "\x0b", ""),
        (5, 2, "abstract", "abstract"), (5, 3, "x", "abstract"), (6, 1, "İNTRODUCTION", "İNTRODUCTION"), (6, 2, "y", "İNTRODUCTION")]
    assert [s for i, n, _, s in got if n == 1 and i in (0, 1, 5)] == [None, None, None]
