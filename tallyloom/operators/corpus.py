"""Corpus diagnostics: a document is a row, and its lines are an array inside the row.

Splitting, segmenting and rule checks are array expressions, so text is never
shuffled between tasks and each whole text is read once.

Arrays are unrolled with the outer form of explode and a null check behind it: for the
plain form the optimizer adds a size check in front, which would evaluate the whole
array expression again.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import lexicon as lx
from tallyloom.functions.cells import ERRORS


_BLANKS = " \\t\\n\\f\\r"  # what a blank is in the SQL twins; Java's \\s has one character more
_HEADING = lx.HEADING.replace("[、.．\\s]", f"[、.．{_BLANKS}]").replace("\\s", f"[{_BLANKS}]")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def bare(c: Column) -> Column:
    """Texts and lines of sections without the blanks around them; a vertical tab is none here."""
    return F.btrim(c, F.lit(" \t\n\f\r"))


def normalize_text(text: Column) -> Column:
    """Line ends as one character, runs of blanks as one; patterns run only where a plain search finds something to replace."""
    has = lambda t, x: F.contains(t, F.lit(x))
    ends = let(text, lambda t: F.when(has(t, "\r"), F.regexp_replace(t, "\r\n?", "\n")).otherwise(t))
    blanks = let(F.replace(ends, F.lit("\u3000"), F.lit(" ")), lambda t: F.when(has(t, "  ") | has(t, "\t"), F.regexp_replace(t, r"[ \t]+", " ")).otherwise(t))
    return bare(blanks)


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression, so that no optimizer rule copies its computation."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Seen(NamedTuple):
    """A lower-cased text, and with it what its ideographs are searched in: the text's runs beyond ASCII, a blank between them."""

    low: Column
    wide: Column


def seen_of(text: Column) -> list[Column]:
    """The fields of a struct that :func:`seen` reads."""
    return [F.lower(text).alias("low"), F.regexp_replace(text, r"[\x00-\x7f]+", " ").alias("wide")]


def seen(d: Column) -> Seen:
    return Seen(d["low"], d["wide"])


def holds(low: Column | Seen, word: str) -> Column:
    """Does a lower-cased text contain the word?  Ideographs have no case and stand in one run, so the short text tells it as well."""
    if not isinstance(low, Seen):
        return F.contains(low, F.lit(word.lower()))
    return F.contains(low.wide if word and all("\u4e00" <= x <= "\u9fff" for x in word) else low.low, F.lit(word.lower()))


def has_any(low: Column | Seen, words: list[str]) -> Column:
    """Does an already lower-cased text contain any of the words?"""
    return reduce(lambda a, b: a | b, [holds(low, w) for w in words])


def _slices(starts: Column, size: Column) -> Column:
    """Start/end of the runs opened by sorted 0-based ``starts``."""
    return F.transform(starts, lambda s, k: F.struct(s.alias("s"), F.coalesce(F.get(starts, k + 1), size).alias("e")))


def _where(lines: Column, test) -> Column:
    """0-based indices of the lines meeting ``test``."""
    flagged = F.transform(lines, lambda x, i: F.when(test(x), i))
    return F.filter(flagged, lambda i: i.isNotNull())


# --- sections -------------------------------------------------------------------

def canonical_section(title: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    def pick(low):
        out = None
        for name, words in (aliases or lx.SECTION_ALIASES).items():
            out = F.when(has_any(low, words), name) if out is None else out.when(has_any(low, words), name)
        return out.otherwise("other")

    return let(F.lower(F.replace(bare(title), F.lit("İ"), F.lit("i"))), pick)


def is_heading(line: Column) -> Column:
    return let(bare(line), lambda s: F.length(s).between(1, 80) & (
        s.rlike(_HEADING) | ((F.length(s) <= 24) & (canonical_section(s) != "other"))))


def heading_title(line: Column) -> Column:
    return let(bare(line), lambda s: F.regexp_replace(
        F.when(s.rlike(_HEADING), F.regexp_extract(s, _HEADING, 2)).otherwise(bare(F.regexp_replace(s, "^#+", ""))),
        "^[ ：:]+|[ ：:]+$", ""))


def heading_level(line: Column) -> Column:
    s = bare(line)
    return F.when(s.startswith("#"), F.least(F.length(F.regexp_extract(s, "^#+", 0)), F.lit(3))) \
        .when(s.rlike(r"^\d+\.\d+\.\d+"), 3).when(s.rlike(r"^\d+\.\d+"), 2).otherwise(1)


def section_list(norm: Column) -> Column:
    """Sections of a normalised text: (title, level, canonical, start_line, end_line, body)."""
    def section(lines, r):
        return let(F.get(lines, r["s"]), lambda head: let(heading_title(head), lambda title: F.struct(
            title.alias("title"), heading_level(head).alias("level"), canonical_section(title).alias("canonical"),
            (r["s"] + 1).alias("start_line"), r["e"].alias("end_line"),
            bare(F.array_join(F.slice(lines, r["s"] + 2, r["e"] - r["s"] - 1), "\n")).alias("body"))))

    def build(lines):
        whole = F.array(F.struct(F.lit("全文").alias("title"), F.lit(1).alias("level"), F.lit("other").alias("canonical"),
                                 F.lit(1).alias("start_line"), F.size(lines).alias("end_line"), F.array_join(lines, "\n").alias("body")))
        none = F.filter(whole, lambda w: w["body"] != "")
        return let(_where(lines, is_heading), lambda heads: F.when(
            F.size(heads) > 0, F.transform(_slices(heads, F.size(lines)), lambda r: section(lines, r))).otherwise(none))

    return let(F.split(norm, "\n", -1), build)


def with_sections(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_p``: the normalised text, its lines and its sections, each computed once."""
    packed = let(normalize_text(F.col(text)), lambda t: F.struct(
        t.alias("norm"), F.split(t, "\n", -1).alias("lines"), section_list(t).alias("sections")))
    return df.withColumn("_p", packed)


def doc_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    return with_sections(df, text).select(key, F.posexplode_outer("_p.sections").alias("section_no", "_s")).where("section_no is not null").select(key, "section_no", "_s.*")


def section_assign(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each line with the latest heading at or above it (NULL before the first heading); a blank text is one empty line of no section."""
    def spans(p):
        lead = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.lit(0).alias("s"),
                                F.coalesce(F.get(p["sections"], F.lit(0))["start_line"] - 1, F.size(p["lines"])).alias("e")))
        runs = F.concat(lead, F.transform(p["sections"], lambda r: F.struct(
            r["title"].alias("title"), (r["start_line"] - 1).alias("s"), r["end_line"].alias("e"))))
        return F.transform(runs, lambda r: F.struct(r["title"].alias("title"), r["s"].alias("s"),
                                                    F.slice(p["lines"], r["s"] + 1, r["e"] - r["s"]).alias("l")))

    packed = let(normalize_text(F.col(text)), lambda t: F.struct(F.split(t, "\n", -1).alias("lines"), section_list(t).alias("sections")))
    parts = df.select(key, F.explode_outer(let(packed, spans)).alias("_r")).where("_r is not null")
    body = parts.select(key, "_r.title", "_r.s", F.posexplode_outer("_r.l").alias("_i", "line")).where("_i is not null")
    return body.select(key, (F.col("s") + F.col("_i") + 1).alias("line_no"), "line", F.col("title").alias("section"))


def _title_lines(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, "^[ #]+|[ #]+$", "")), lambda x: x != "")


def _title(lines: Column) -> Column:
    good = F.filter(F.slice(lines, 1, 8), lambda x: (~F.lower(x).isin(lx.TITLE_SKIP)) & (F.length(x) <= 80))
    return F.coalesce(F.get(good, F.lit(0)), F.get(lines, F.lit(0)), F.lit("未识别标题"))


def doc_title_authors(df: DataFrame, key: str, text: str) -> DataFrame:
    lines = _title_lines(F.split(normalize_text(F.col(text)), "\n", -1))
    made = let(lines, lambda ls: F.struct(
        _title(ls).alias("title"), F.filter(F.slice(ls, 2, 7), lambda x: x.rlike(lx.AUTHOR_LINE)).alias("authors")))
    return df.select(key, made.alias("_m")).select(key, "_m.*")


def _abstract(p: Column) -> Column:
    named = F.get(F.filter(p["sections"], lambda s: s["canonical"] == "abstract"), F.lit(0))["body"]
    return F.coalesce(named, strip(F.regexp_extract(p["norm"], lx.ABSTRACT_BODY, 1)))


def doc_abstract(df: DataFrame, key: str, text: str) -> DataFrame:
    return with_sections(df, text).select(key, _abstract(F.col("_p")).alias("abstract"))


def keyword_list(norm: Column) -> Column:
    parts = F.split(F.regexp_extract(norm, lx.KEYWORD_BODY, 1), lx.KEYWORD_SPLIT, -1)
    return F.filter(parts, lambda x: x != "")


def doc_keywords(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode_outer(keyword_list(normalize_text(F.col(text)))).alias("rank", "keyword")).where("rank is not null")


def doc_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """Tables: a caption opens one, rows with two or more pipes fill it, rule rows are dropped."""
    def cell_rows(part):
        wide = F.filter(part, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
        cells = F.transform(wide, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|", -1), strip))
        return F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike(lx.TABLE_RULE_CELL)))

    def tables(lines, caps):
        spans = F.concat(F.array(F.struct(F.lit(-1).alias("s"), F.coalesce(F.get(caps, F.lit(0)), F.size(lines)).alias("e"))),
                         _slices(caps, F.size(lines)))
        made = F.transform(spans, lambda r: F.struct(
            F.when(r["s"] >= 0, F.get(lines, r["s"])).alias("caption"), (r["s"] + 1).alias("source_line"),
            cell_rows(F.slice(lines, r["s"] + 2, r["e"] - r["s"] - 1)).alias("rows")))
        return F.filter(made, lambda t: t["caption"].isNotNull() | (F.size(t["rows"]) > 0))

    lines = F.transform(F.split(normalize_text(F.col(text)), "\n", -1), strip)
    kept = let(lines, lambda ls: let(_where(ls, lambda x: x.rlike(lx.TABLE_CAPTION)), lambda caps: tables(ls, caps)))
    return df.select(key, F.posexplode_outer(kept).alias("_i", "_t")).where("_i is not null").select(
        key, (F.col("_i") + 1).alias("table_no"), F.coalesce("_t.caption", F.concat(F.lit("表"), (F.col("_i") + 1).cast("string"))).alias("caption"),
        F.col("_t.source_line").alias("source_line"), F.col("_t.rows").alias("rows"))


def corpus_stats(blocks: DataFrame, key: str, kind: str, text: str) -> DataFrame:
    """Paragraphs, tables, characters and words (half the characters) per document from block rows."""
    para = F.col(kind) == "paragraph"
    chars = F.sum(F.when(para, F.length(text)).otherwise(0))
    return blocks.groupBy(key).agg(
        F.count_if(para).alias("paragraphs"), F.count_if(F.col(kind) == "table").alias("tables"), chars.alias("characters"),
        F.floor(chars / 2).cast("long").alias("words"))


# --- classification and diagnostics ------------------------------------------------

def _score(found: Column, of: Column) -> Column:
    return F.least(F.lit(100), F.bround(found / of * 100)).cast("int")


def _class_scores(low: Column | Seen, classes: dict[str, list[str]]) -> Column:
    rows = []
    for i, (name, words) in enumerate(classes.items()):
        found = F.array(*[F.when(holds(low, w), F.lit(w)) for w in words])
        rows.append(F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("label"), F.array_compact(found).alias("found"), F.lit(len(words)).alias("of")))
    return F.transform(F.array(*rows), lambda r: F.struct(
        _score(F.size(r["found"]), r["of"]).alias("score"), r["ord"].alias("ord"),
        r["label"].alias("label"), F.array_join(r["found"], "、").alias("hits")))


def doc_classify(df: DataFrame, key: str, text: str, classes: dict[str, list[str]] | None = None) -> DataFrame:
    """Score of every class per document; ``rank`` 1 is the label (class order breaks ties)."""
    scores = let(F.struct(*seen_of(F.col(text))), lambda d: _class_scores(seen(d), classes or lx.PAPER_CLASSES))
    best = F.array_sort(scores, lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).otherwise(a["ord"] - b["ord"]))
    out = df.select(key, F.posexplode_outer(best).alias("_i", "_c")).where("_i is not null")
    return out.select(key, (F.col("_i") + 1).alias("rank"), "_c.label", "_c.score", "_c.hits",
                      F.when(F.col("_c.score") == 0, "high").when(F.col("_c.score") < 50, "medium").otherwise("low").alias("risk"))


def top_score(low: Column | Seen, classes: dict[str, list[str]] | None = None) -> Column:
    count = lambda words: reduce(lambda a, b: a + b, [F.when(holds(low, w), 1).otherwise(0) for w in words], F.lit(0))
    return F.array_max(F.array(*[_score(count(words), F.lit(len(words))) for words in (classes or lx.PAPER_CLASSES).values()]))


def causal_design(low: Column | Seen) -> Column:
    return has_any(low, lx.CAUSAL_DESIGN)


def causal_claim(low: Column | Seen) -> Column:
    return has_any(low, lx.CAUSAL_CLAIM)


def evidence_checks(low: Column | Seen, names: Column) -> dict[str, Column]:
    """Ten checks from the lower-cased text and the canonical section names."""
    w = lx.EVIDENCE_WORDS
    has = lambda name: F.array_contains(names, name)
    return {
        "question": has_any(low, w["question"]), "object": has_any(low, w["object"]),
        "concept": has("theory") | has_any(low, w["concept"]), "hypothesis": has_any(low, w["hypothesis"]),
        "variables": has_any(low, w["variables"]), "causal_language": causal_design(low) | ~causal_claim(low),
        "material": has("results") & (has("data") | has_any(low, w["material"])),
        "no_overreach": ~has_any(low, w["overreach"]), "no_hype": ~has_any(low, lx.NOVELTY),
        "theory_backed": ~(has("theory") & ~has("data") & ~has("results")),
    }


def data_checks(text: Column, low: Column | Seen) -> dict[str, Column]:
    w = lx.DATA_WORDS
    return {
        "support": has_any(low, w["support"]), "source": has_any(low, w["source"]), "sample_size": text.rlike(lx.SAMPLE_SIZE),
        "sampling": has_any(low, w["sampling"]), "operational": has_any(low, w["operational"]),
        "instrument": has_any(low, w["instrument"]), "method": has_any(low, w["method"]), "robustness": has_any(low, w["robustness"]),
        "qualitative": ~has_any(low, lx.QUALITATIVE) & has_any(low, lx.MECHANISM_TALK),
    }


def _flags(checks: dict[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("item"), c.alias("ok")) for n, c in checks.items()])


def section_names(text: Column) -> Column:
    """The canonical names of :func:`section_list`, without the sections' bodies."""
    def names(norm):
        heads = F.filter(F.split(norm, "\n", -1), is_heading)
        return let(heads, lambda h: F.when(F.size(h) > 0, F.transform(h, lambda x: canonical_section(heading_title(x))))
                   .otherwise(F.when(norm != "", F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))))

    return let(normalize_text(text), names)


def _evidence(text: Column) -> Column:
    return let(F.struct(*seen_of(text), section_names(text).alias("names")), lambda d: _flags(evidence_checks(seen(d), d["names"])))


def _data(text: Column) -> Column:
    return let(F.struct(*seen_of(text)), lambda d: _flags(data_checks(text, seen(d))))


def _flag_rows(df: DataFrame, key: str, flags: Column) -> DataFrame:
    return df.select(key, F.explode_outer(flags).alias("_r")).where("_r is not null").select(
        key, "_r.item", "_r.ok", F.when(F.col("_r.ok"), "medium").otherwise("high").alias("priority"))


def doc_evidence(df: DataFrame, key: str, text: str) -> DataFrame:
    return _flag_rows(df, key, _evidence(F.col(text)))


def doc_data_req(df: DataFrame, key: str, text: str) -> DataFrame:
    return _flag_rows(df, key, _data(F.col(text)))


def _bad(flags: Column) -> Column:
    return F.filter(flags, lambda x: ~x["ok"])


def _grade(gaps: Column, top: Column) -> Column:
    return F.when((gaps <= 2) & (top >= 50), "A").when(gaps <= 4, "B").when(gaps <= 7, "C").when(top < 20, "D").otherwise("E")


def doc_gap_grade(df: DataFrame, key: str, text: str, classes=None) -> DataFrame:
    t = F.col(text)
    made = let(F.struct(*seen_of(t), section_names(t).alias("names")), lambda d: F.struct(
        F.size(_bad(F.concat(_flags(evidence_checks(seen(d), d["names"])), _flags(data_checks(t, seen(d)))))).alias("gaps"),
        top_score(seen(d), classes).alias("top_match")))
    graded = let(made, lambda m: F.struct(m["gaps"].alias("gaps"), m["top_match"].alias("top_match"), _grade(m["gaps"], m["top_match"]).alias("grade")))
    return df.select(key, graded.alias("_g")).select(key, "_g.*")


def doc_charts_needed(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = let(F.lower(text), lambda low: F.array(*[
        F.struct(F.lit(n).alias("item"), has_any(low, w).alias("present")) for n, w in lx.CHART_WORDS.items()]))
    return df.select(key, F.explode_outer(rows).alias("_r")).where("_r is not null").select(key, "_r.*")


def doc_semantics(df: DataFrame, key: str, text: str, label: Column | None = None) -> DataFrame:
    """Rule hits on the research design; a document with none gets one ``none`` row."""
    t, low = F.col(text), F.lower(text)
    has = lambda w: F.contains(t, F.lit(w))
    any_ = lambda *w: has_any(low, list(w))
    mixed = F.contains(label, F.lit("混合方法")) if label is not None else F.lit(False)
    rules = [
        ("causal_without_design", "high", causal_claim(low) & ~causal_design(low)),
        ("correlation_as_cause", "high", has("相关") & causal_claim(low)),
        ("mechanism_without_evidence", "medium", has("机制") & ~any_("中介", "访谈", "过程追踪", "田野", "机制检验")),
        ("mixed_methods_patchwork", "medium", mixed & ~(has("问卷") & (has("访谈") | has("田野") | has("编码")))),
        ("did_conditions", "high", (has("DID") | has("双重差分")) & ~any_("平行趋势", "政策前", "政策后", "事件研究")),
        ("psm_diagnostics", "medium", (has("PSM") | has("倾向得分")) & ~any_("平衡性", "common support", "匹配前后", "卡尺")),
        ("empty_novelty", "medium", has_any(low, lx.NOVELTY) & ~any_("不同于", "机制", "边界条件", "解释")),
    ]
    hits = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(r).alias("risk"))) for n, r, c in rules]), lambda x: x.isNotNull())
    none = F.array(F.struct(F.lit("none").alias("rule"), F.lit("low").alias("risk")))
    return df.select(key, hits.alias("_h")).select(key, F.explode_outer(F.when(F.size("_h") > 0, F.col("_h")).otherwise(none)).alias("_r")).where("_r is not null").select(key, "_r.*")


# Verdict by grade.
VERDICT = {"D": "redesign", "E": "redesign", "C": "major revision", "B": "strengthen", "A": "sound"}


def doc_quality(df: DataFrame, key: str, text: str, classes=None) -> DataFrame:
    """Issues by class (fatal, structural, surface), the core issues and the verdict."""
    t = F.col(text)
    deadly = F.array(F.lit("causal_language"), F.lit("material"))
    name = lambda level, prefix, flags: F.transform(flags, lambda x: F.struct(
        F.lit(level).alias("level"), F.concat(F.lit(prefix), x["item"]).alias("issue")))

    def judge(d):
        ev = _bad(d["ev"])
        core = F.concat(name("fatal", "", F.filter(ev, lambda x: F.array_contains(deadly, x["item"]))),
                        name("structural", "", F.filter(ev, lambda x: ~F.array_contains(deadly, x["item"]))),
                        name("structural", "data_", _bad(d["da"])))
        bare = ~F.array_contains(d["names"], "results") | ~t.rlike(r"(表|Table)\s*\d")
        surface = F.array(F.struct(F.lit("novelty_claim").alias("item"), (~has_any(seen(d), lx.NOVELTY_SURFACE)).alias("ok")),
                          F.struct(F.lit("few_tables").alias("item"), (~bare).alias("ok")))
        gaps = F.size(ev) + F.size(_bad(d["da"]))
        return F.struct(_grade(gaps, top_score(seen(d), classes)).alias("grade"), core.alias("core"), name("surface", "", _bad(surface)).alias("surface"))

    read = let(F.struct(*seen_of(t), section_names(t).alias("names")), lambda d: F.struct(
        d["low"].alias("low"), d["wide"].alias("wide"), d["names"].alias("names"), _flags(evidence_checks(seen(d), d["names"])).alias("ev"), _flags(data_checks(t, seen(d))).alias("da")))
    verdict = F.create_map(*[F.lit(x) for kv in VERDICT.items() for x in kv])
    out = let(let(read, judge), lambda j: F.struct(
        j["grade"].alias("grade"), verdict[j["grade"]].alias("verdict"), F.concat(j["core"], j["surface"]).alias("issues"),
        F.transform(j["core"], lambda x: x["issue"]).alias("core_issues")))
    return df.select(key, out.alias("_q")).select(key, "_q.*")


# --- variables ------------------------------------------------------------------------

def _clean_label(c: Column) -> Column:
    bare = F.regexp_replace(strip(c), "[\"'“”‘’（）()]", "")
    return F.regexp_replace(F.regexp_replace(bare, "^(本文|本研究|主要|核心)", ""), "^[ ：:，,。；;]+|[ ：:，,。；;]+$", "")


def var_candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Variables named by role phrases and "A affects B" phrases, unique, in order."""
    pair = lambda label, role: F.struct(label.alias("label"), F.lit(role).alias("role"))

    def named(scan):
        none = F.array().cast("array<string>")
        found = []
        for role, name in lx.VARIABLE_ROLES.items():
            bodies = F.when(F.contains(scan, F.lit(lx.VARIABLE_LITERALS.get(name, name))), F.regexp_extract_all(scan, F.lit(name + r"(?:为|是|包括|：|:)\s*([^。；;\n]+)"), 1)).otherwise(none)
            found.append(F.transform(bodies, lambda b: F.struct(F.split(b, r"[、，,及和与\s]+", -1).alias("labels"), F.lit(role).alias("role"))))
        roles = F.flatten(F.transform(F.concat(*found), lambda r: F.transform(
            r["labels"], lambda x: F.struct(_clean_label(x).alias("label"), r["role"].alias("role")))))

        def effect(pattern, literals):
            # a match lies in one line, and only lines with the pattern's literals are searched; its parts are taken from the match
            able = F.filter(F.split(scan, "\n", -1), lambda x: reduce(lambda a, b: a & b, [has_any(x, either) for either in literals]))
            matches = F.flatten(F.transform(able, lambda x: F.regexp_extract_all(x, F.lit(pattern), 0)))
            return F.flatten(F.transform(matches, lambda m: F.array(
                pair(_clean_label(F.regexp_extract(m, pattern, 1)), "自变量"), pair(_clean_label(F.regexp_extract(m, pattern, 2)), "因变量"))))

        effects = [effect(p, lx.EFFECT_LITERALS[p]) for p in (lx.EFFECT_OF, lx.AFFECTS)]
        return F.concat(roles, *effects)

    def complete(d):
        did = (F.contains(d["scan"], F.lit("DID")) | F.contains(d["scan"], F.lit("双重差分"))) & ~F.exists(d["c"], lambda x: x["role"] == "处理组变量")
        extra = F.array(pair(F.lit("处理组"), "处理组变量"), pair(F.lit("政策后时期"), "时间变量"), pair(F.lit("政策冲击"), "政策冲击变量"))
        every = F.when(did, F.concat(d["c"], extra)).otherwise(d["c"])
        return F.array_distinct(F.filter(every, lambda x: (x["label"] != "") & ~x["label"].isin(lx.VARIABLE_STOP)))

    scan = let(F.col("_p"), lambda p: F.concat_ws("\n", let(_title_lines(p["lines"]), _title), _abstract(p), F.array_join(keyword_list(p["norm"]), "、"), F.col(text)))
    kept = let(let(scan, lambda t: F.struct(t.alias("scan"), named(t).alias("c"))), complete)
    return with_sections(df, text).select(key, F.posexplode_outer(kept).alias("_i", "_v")).where("_i is not null").select(key, (F.col("_i") + 1).alias("rank"), "_v.label", "_v.role")


# --- references and citations -------------------------------------------------------------

def reference_block(text: Column) -> Column:
    after = F.when(text.rlike(lx.REFERENCE_HEADING), F.get(F.split(text, lx.REFERENCE_HEADING, 2), F.lit(1))).otherwise("")
    return strip(F.get(F.split(after, lx.BACK_MATTER, 2), F.lit(0)))


def entry_list(text: Column) -> Column:
    """Entries of the reference list; lines that open no entry continue the one above."""
    lines = F.filter(F.transform(F.split(reference_block(text), "\n", -1), strip), lambda x: x != "")
    opens = lambda ls: F.filter(F.transform(ls, lambda x, i: F.when((i == 0) | x.rlike(lx.ENTRY_START), i)), lambda i: i.isNotNull())
    return let(lines, lambda ls: let(opens(ls), lambda starts: F.transform(
        _slices(starts, F.size(ls)), lambda r: F.array_join(F.slice(ls, r["s"] + 1, r["e"] - r["s"]), " "))))


def ref_extract(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode_outer(entry_list(F.col(text))).alias("_i", "entry")).where("_i is not null").select(key, (F.col("_i") + 1).alias("entry_no"), "entry")


def entry_number(entry: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(entry, lx.ENTRY_NUMBER, 1), F.lit("")), F.regexp_extract(entry, lx.ENTRY_NUMBER, 2))


def _entry_parts(entry: Column) -> dict[str, Column]:
    body = strip(F.regexp_replace(entry, lx.ENTRY_NUMBER, ""))
    cut = lambda sep: strip(F.substring_index(body, sep, 1))
    year = F.regexp_extract(entry, r"(?:19|20)\d{2}", 0)
    before = F.regexp_replace(F.get(F.split(body, r"(?:19|20)\d{2}", 2), F.lit(0)), "^[ .，,()（）]+|[ .，,()（）]+$", "")
    author = F.when(body == "", "").when(F.contains(body, F.lit(".")), cut(".")) \
        .when(F.contains(body, F.lit("，")), cut("，")).when(F.contains(body, F.lit(",")), cut(",")) \
        .when(body.rlike(r"(?:19|20)\d{2}"), before).when(F.length(body) <= 60, body).otherwise("")
    second = strip(F.get(F.split(body, "[.。]", 2), F.lit(1)))
    no_year = F.regexp_replace(body, r"[\(（]?(?:19|20)\d{2}[\)）]?[.，, ]*", "")
    rest = F.regexp_replace(F.when(author == "", no_year).otherwise(F.replace(no_year, author, F.lit(""))), "^[ .，,]+|[ .，,]+$", "")
    title = F.when(F.coalesce(second, F.lit("")) != "", second).otherwise(rest)
    risks = F.filter(F.array(
        F.when(year == "", "year missing"), F.when(F.length(body) < 12, "too short"), F.when(author == "", "author unclear"),
        F.when(title == "", "title unclear")), lambda x: x.isNotNull())
    return {"number": entry_number(entry), "year": year, "doi": F.regexp_extract(entry, lx.DOI_PATTERN, 0),
            "author_hint": author, "title_hint": title, "risks": F.array_join(risks, "; ")}


def ref_parse(entries: DataFrame, entry: str = "entry") -> DataFrame:
    parts = _entry_parts(F.col(entry))
    return entries.select("*", *[c.alias(n) for n, c in parts.items()])


def cite_inline(df: DataFrame, key: str, text: str) -> DataFrame:
    """Inline citations of four forms with their line number."""
    lines = df.select(key, F.posexplode_outer(F.split(text, "\n", -1)).alias("_i", "_line")).where("_i is not null")
    tagged = lambda n, p: F.transform(F.regexp_extract_all("_line", F.lit(p), 0), lambda x: F.struct(F.lit(n).alias("form"), x.alias("citation")))
    found = F.concat(*[tagged(n, p) for n, p in enumerate(lx.INLINE_CITATIONS, 1)])
    return lines.select(key, (F.col("_i") + 1).alias("line_no"), F.explode_outer(found).alias("_c")).where("_c is not null").select(key, "line_no", "_c.*")


def _numbers_cited(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1))


def _numbers_listed(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(entry_list(text), entry_number), lambda x: x != ""))


def _in_order(numbers: Column) -> Column:
    # a digit string beyond the range of longs is no entry number
    return F.array_sort(F.array_compact(F.transform(numbers, lambda x: x.try_cast("long"))))


def cite_crosscheck(df: DataFrame, key: str, text: str) -> DataFrame:
    """Cited numbers without an entry and entries never cited: in numeric order."""
    t = F.col(text)
    tag = lambda kind, arr: F.transform(_in_order(arr), lambda n: F.struct(F.lit(kind).alias("problem"), n.alias("number")))
    pair = F.struct(_numbers_cited(t).alias("c"), _numbers_listed(t).alias("l"))
    rows = let(pair, lambda p: F.when((F.size(p["c"]) > 0) & (F.size(p["l"]) > 0), F.concat(
        tag("cited_not_listed", F.array_except(p["c"], p["l"])), tag("listed_not_cited", F.array_except(p["l"], p["c"])))))
    return df.select(key, F.explode_outer(rows).alias("_r")).where("_r is not null").select(key, "_r.*")


def ref_risks(df: DataFrame, key: str, text: str) -> DataFrame:
    """All reference risks of a document, one row each."""
    t = F.col(text)
    row = lambda kind, where: F.struct(F.lit(kind).alias("risk"), where.cast("string").alias("place"))

    def risks(d):
        single = F.array_compact(F.array(F.when(F.size(d["e"]) == 0, row("no_list", F.lit("references"))), F.when(~d["i"], row("no_citations", F.lit("text")))))
        formal = F.array_compact(F.transform(d["e"], lambda e, i: F.when(_entry_parts(e)["risks"] != "", row("format", i + 1))))
        listed = F.array_distinct(F.filter(F.transform(d["e"], entry_number), lambda x: x != ""))
        cross = let(listed, lambda l: F.concat(F.transform(_in_order(F.array_except(d["c"], l)), lambda n: row("cited_not_listed", n)),
                                               F.transform(_in_order(F.array_except(l, d["c"])), lambda n: row("listed_not_cited", n))))
        none = F.slice(F.array(row("none", F.lit(""))), 1, 0)
        return F.concat(single, formal, F.when((F.size(d["e"]) > 0) & d["i"], cross).otherwise(none), F.array(row("not_verified", F.lit("all"))))

    inline = reduce(lambda a, b: a | b, [t.rlike(p) for p in lx.INLINE_CITATIONS])
    parts = F.struct(entry_list(t).alias("e"), inline.alias("i"), _numbers_cited(t).alias("c"))
    return df.select(key, F.explode_outer(let(parts, risks)).alias("_r")).where("_r is not null").select(key, "_r.*")


def cited_keys(text: Column) -> Column:
    groups = F.regexp_extract_all(text, F.lit(lx.CITE_GROUP), 1)
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ";"), lambda k: F.regexp_replace(strip(k), "^@", ""))))


def cite_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """Citation number = order of first appearance in the document."""
    return df.select(key, F.posexplode_outer(F.array_distinct(cited_keys(F.col(text)))).alias("_i", "cite_key")).where("_i is not null").select(
        key, "cite_key", (F.col("_i") + 1).alias("number"))


def cite_resolve(text: Column) -> Column:
    """Replace each citation group by its numbers; text between groups is kept as it is."""
    number = lambda order, k: F.coalesce(F.nullif(F.array_position(order, k), F.lit(0)).cast("string"), F.lit("??"))
    marks = lambda order: F.transform(F.regexp_extract_all(text, F.lit(lx.CITE_GROUP), 1), lambda g: F.concat(F.lit("["), F.array_join(
        F.transform(F.split(g, ";"), lambda k: number(order, F.regexp_replace(strip(k), "^@", ""))), ","), F.lit("]")))
    return let(F.array_distinct(cited_keys(text)), lambda order: F.array_join(
        F.zip_with(F.split(text, lx.CITE_GROUP, -1), marks(order), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""))


def cite_missing(df: DataFrame, key: str, text: str, references: DataFrame, ref_key: str) -> DataFrame:
    cited = df.select(key, F.explode_outer(F.array_distinct(cited_keys(F.col(text)))).alias("cite_key")).where("cite_key is not null")
    return cited.join(references, cited["cite_key"] == references[ref_key], "left_anti")


def cite_uncited(df: DataFrame, text: str, references: DataFrame, ref_key: str) -> DataFrame:
    cited = df.select(F.explode_outer(F.array_distinct(cited_keys(F.col(text)))).alias("cite_key")).where("cite_key is not null").distinct()
    return references.join(cited, references[ref_key] == cited["cite_key"], "left_anti")


def keys_except(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).distinct().join(b.select(*on), on, "left_anti")


def batch_queries(df: DataFrame, key: str, text: str, pattern: str, section_pattern: str) -> DataFrame:
    """Query strings found in text files with the section line above them, counted per file and section."""
    def parts(lines, heads):
        spans = F.concat(F.array(F.struct(F.lit(-1).alias("s"), F.coalesce(F.get(heads, F.lit(0)), F.size(lines)).alias("e"))),
                         _slices(heads, F.size(lines)))
        return F.transform(spans, lambda r: F.struct(
            F.when(r["s"] >= 0, F.get(lines, r["s"])).otherwise("").alias("section"),
            F.array_join(F.slice(lines, r["s"] + 2, r["e"] - r["s"] - 1), "\n").alias("_t")))

    cut = let(F.split(text, "\n", -1), lambda ls: let(_where(ls, lambda x: x.rlike(section_pattern)), lambda heads: parts(ls, heads)))
    part = df.select(key, F.explode_outer(cut).alias("_p")).where("_p is not null").select(key, "_p.*")
    hits = part.select(key, "section", F.explode_outer(F.regexp_extract_all("_t", F.lit(pattern), 1)).alias("query")).where("query is not null")
    return hits.groupBy(key, "section", "query").agg(F.count(F.lit(1)).alias("uses"))


# --- scans ---------------------------------------------------------------------------------

def secret_scan(df: DataFrame, key: str, text: str, ext: Column | None = None) -> DataFrame:
    """Findings (key, rule, severity, line_no) of the line rules.

    Texts and lines without any literal of a rule are dropped before its pattern runs.
    """
    kind = F.lower(ext) if ext is not None else F.lit("")
    allowed = lambda kinds: F.lit(True) if kinds is None else F.col("_kind").isin(kinds)
    src = df.select(key, F.col(text).alias("_t"), kind.alias("_kind"))

    def holds(low, rule):
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in lx.SECRET_LITERALS[rule]])

    touched = src.where(let(F.lower("_t"), lambda t: reduce(lambda a, b: a | b, [allowed(k) & holds(t, rule) for rule, _, _, k in lx.SECRET_RULES])))
    lines = touched.select(key, "_kind", F.posexplode_outer(F.split("_t", "\n", -1)).alias("_i", "_line")).where("_i is not null")
    line = F.col("_line")
    guard = {
        "EMAIL_EXPOSED": ~strip(line).startswith("//"), "UNSAFE_INNERHTML": ~line.rlike(lx.INNERHTML_SAFE),
        "HTTP_URL": ~F.regexp_extract(line, r"http://[^\s\"'<>]+", 0).rlike(r"localhost|127\.0\.0\.1"),
    }
    low = F.col("_low")
    # a line with no literal at all costs no pattern
    lines = lines.withColumn("_low", F.lower("_line")).where(reduce(lambda a, b: a | b, [holds(low, rule) for rule in lx.SECRET_LITERALS]))
    found = F.filter(F.array(*[
        F.when(allowed(k) & holds(low, rule) & line.rlike(p) & guard.get(rule, F.lit(True)), F.struct(F.lit(rule).alias("rule"), F.lit(sev).alias("severity")))
        for rule, sev, p, k in lx.SECRET_RULES]), lambda x: x.isNotNull())
    return lines.select(key, (F.col("_i") + 1).alias("line_no"), F.explode_outer(found).alias("_f")).where("_f is not null").select(key, "_f.rule", "_f.severity", "line_no")


def dedupe_findings(findings: DataFrame, key: str) -> DataFrame:
    """One finding per (file, rule): the highest severity, then the first line."""
    best = F.struct(F.col("severity"), (-F.col("line_no")).alias("l"))
    return findings.groupBy(key, "rule").agg(F.max(best).alias("_b")).select(
        key, "rule", F.col("_b.severity").alias("severity"), (-F.col("_b.l")).alias("line_no"))


def allowlist_filter(df: DataFrame, path: str, allowed: list[str]) -> DataFrame:
    """Sources under an allow-list entry are left out whole; the list is a small configuration."""
    p = F.lower(path)
    return df.where(~reduce(lambda a, b: a | b, [p.startswith(a.lower()) for a in allowed], F.lit(False)))


def label_leakage(df: DataFrame, label: str, path: str | None = None, meta: str | None = None) -> DataFrame:
    """Anonymity checks of artifact labels, paths and metadata; identity keys are stripped from the JSON."""
    lab = F.col(label)
    out = df.withColumn("anonymous", F.coalesce(lab.rlike("^[A-Z]$") | F.lower(lab).startswith("artifact-") | F.lower(lab).startswith("output-"), F.lit(False))) \
        .withColumn("label_leaks", has_any(F.lower(lab), lx.LEAK_FIELDS))
    if path:
        out = out.withColumn("path_leaks", F.arrays_overlap(F.split(F.lower(path), r"[/\\]"), F.array(*[F.lit(s) for s in lx.LEAK_SEGMENTS])))
    if meta:
        fields = F.from_json(meta, "map<string,string>")
        clean = F.map_filter(fields, lambda k, v: ~F.lower(k).isin(lx.LEAK_FIELDS))
        out = out.withColumn("leaking_keys", F.size(fields) - F.size(clean)).withColumn(
            "clean_meta", F.to_json(F.map_concat(clean, F.create_map(F.lit("_blind_anonymized"), F.lit("true")))))
    return out


def eval_readiness(items: DataFrame, keys: list[str], prompt: str, expected: str, missing_files: Column | None = None) -> DataFrame:
    """Counts of ready, invalid and model-needing evaluation items."""
    no_prompt = F.coalesce(strip(F.col(prompt)) == "", F.lit(True))
    bad = no_prompt | (missing_files if missing_files is not None else F.lit(False))
    warn = F.coalesce(strip(F.col(expected)) == "", F.lit(True))
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("ready"), F.count_if(no_prompt).alias("invalid"),
        F.count_if(~bad).alias("needs_model"), F.count_if(warn).alias("smoke_only"))


def formula_audit(df: DataFrame, key: list[str], formula: str, value: str) -> DataFrame:
    f = F.upper(formula)
    risky = (F.contains(f, F.lit("/")) | F.contains(f, F.lit("VLOOKUP"))) & ~F.contains(f, F.lit("IFERROR"))
    found = F.filter(F.array(F.when(risky, F.lit("unguarded")), F.when(F.col(value).isin(*ERRORS), F.lit("error_value"))), lambda x: x.isNotNull())
    return df.select(*key, F.explode_outer(found).alias("problem")).where("problem is not null")


# --- text quality ----------------------------------------------------------------------------

def suspicious_chars(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, lx.SUSPICIOUS, ""))


def scored_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, lx.NOT_SCORED, ""))


def quality_score(text: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(suspicious_chars(text) * 1.5, scored_chars(text))), F.lit(0.0))


def text_quality(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(text)
    return df.select(key, scored_chars(t).alias("characters"), suspicious_chars(t).alias("suspicious"),
                     F.coalesce(F.try_divide(suspicious_chars(t), scored_chars(t)), F.lit(0.0)).alias("ratio"), quality_score(t).alias("score"))


def suspect_fonts(words: DataFrame, keys: list[str], font: str, text: str) -> DataFrame:
    """Fonts whose characters look wrongly encoded."""
    per = words.groupBy(*keys, F.coalesce(F.nullif(strip(F.col(font)), F.lit("")), F.lit("__unknown__")).alias(font)).agg(
        F.sum(scored_chars(F.col(text))).alias("characters"), F.sum(suspicious_chars(F.col(text))).alias("suspicious"))
    ratio = F.try_divide("suspicious", "characters")
    subset = F.col(font).rlike("^[A-Z]{6}\\+.")
    return per.withColumn("ratio", ratio).where((F.col("characters") >= 3) & ((F.col("ratio") > 0.30) | (subset & (F.col("ratio") > 0.05))))


def fingerprint(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), r"\s+", " ")


def boilerplate_lines(lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Line fingerprints repeated on at least max(2, pages/2) distinct pages of documents with three or more pages.

    Distinct (document, fingerprint, page) first, then counts: a line repeated all over
    a large source is combined before it is shuffled.
    """
    fp = lines.select(doc, page, fingerprint(F.col(text)).alias("fp")).where(F.length("fp").between(3, 120))
    seen = fp.distinct().groupBy(doc, "fp").agg(F.count(F.lit(1)).alias("pages_with"))
    pages = lines.select(doc, page).distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("pages"))
    return seen.join(pages, doc).where((F.col("pages") >= 3) & (F.col("pages_with") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2))))


def drop_boilerplate(lines: DataFrame, repeated: DataFrame, doc: str, text: str, at_edge: Column) -> DataFrame:
    """Lines without the repeated ones found in the top or bottom band of a page."""
    marked = lines.withColumn("fp", fingerprint(F.col(text))).join(
        repeated.select(doc, "fp").withColumn("_rep", F.lit(True)), [doc, "fp"], "left")
    return marked.where(~(F.coalesce("_rep", F.lit(False)) & at_edge)).drop("_rep", "fp")
