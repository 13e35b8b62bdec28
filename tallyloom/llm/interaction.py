"""How text filters interact: what each removes, after which others, in every order.

Each filter writes one table of the ids of the documents that fail it.  For a filter x
and a set S of filters that ran before,

    survivors of S   = all ids        left-anti  tables of S
    removed by x     = table of x     left-anti  tables of S
    redundant for x  = table of x     left-semi  tables of S

A set is a bit mask in the join condition, so that one join on the id serves all sets: the
tables are shuffled by id once, and sets are unrolled after that shuffle.  There are 32
survivor sets and 80 pairs (x, S); the 120 orders only read them.

Everything stays in built-in expressions.  Copies are found by digest and smallest id; a
digest or a doc_id that many rows share is joined without shuffling those rows.

Defined cases: a null or empty text has no words and fails A only (and E, if a smaller
doc_id is empty too); a null source is the part ''; rows without doc_id have no labels,
are no copies and make no row a copy; rows that repeat a doc_id count each, and none is a
copy of the other; of repeated labels one that says 1 suffices; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import hot_keys, join_spread, stored

FILTERS = "ABCDE"
_BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
_ALL = (1 << len(FILTERS)) - 1


def text_flags(text: Column) -> Column:
    """struct(A, B, C, D): which of the filters on one text it fails."""
    # bound as an array of one, so that the words are split once
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("k")))
    large = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return F.transform(counts, lambda c: F.struct(
        (c["n"] < 200).alias("A"), (100 * c["k"] < 50 * c["n"]).alias("B"),
        (100 * large.cast("long") > 2 * F.length(text).cast("long")).alias("C"), text.rlike("[#$%&*|]").alias("D")))[0]


def failing_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, dict[str, DataFrame]]:
    """All rows (key, part, doc_id) and, per filter, the written table of the keys that fail it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("key"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_flags(text).alias("fails")), "rows")
    tables = {f: stored(rows.where(F.col("fails")[f]).select("key"), f"fails_{f}") for f in "ABCD"}
    named = rows.where("doc_id is not null")
    heads = stored(named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last"), "heads")
    hot = heads.where(F.col("n") * 1000 > rows.count()).select("digest")  # fewer than a thousand
    copies = join_spread(named.select("key", "doc_id", "digest"), heads.select("digest", "first"), "digest", hot)
    tables["E"] = stored(copies.where(F.col("doc_id") > F.col("first")).select("key"), "fails_E")
    return rows.select("key", "part", "doc_id"), tables


def _marks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, good, toxic) of rows whose doc_id has a label."""
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1), F.lit(False)).cast("long"))
    known = labels.groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).where("doc_id is not null and good + toxic > 0")
    return join_spread(rows.select("key", "doc_id"), known, "doc_id", hot_keys(rows, "doc_id", rows.count())).select("key", "good", "toxic")


def relations(rows: DataFrame, tables: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """Counts per (part, bit, prior): kept, removed, redundant, good_lost, toxic_lost; ``prior`` is the mask of earlier filters."""
    ids = rows.select("key", "part").repartition("key").join(_marks(rows, labels).repartition("key"), "key", "left")
    failing = reduce(DataFrame.unionByName, [t.withColumn("bit", F.lit(_BIT[f])) for f, t in tables.items()]).repartition("key")
    other = failing.select(F.col("key").alias("_key"), F.col("bit").alias("_bit"))
    hit = (F.col("key") == F.col("_key")) & (F.col("_bit").bitwiseAND(F.col("prior")) != 0)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    good, toxic = F.coalesce("good", none).alias("good_lost"), F.coalesce("toxic", none).alias("toxic_lost")

    survivors = ids.select("key", "part", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("prior")).join(other, hit, "left_anti")
    kept = survivors.groupBy("part", "prior").agg(F.count(F.lit(1)).alias("kept"))
    # what survives S with x is what x leaves after S
    bits = F.filter(F.array(*map(F.lit, _BIT.values())), lambda b: F.col("prior").bitwiseAND(b) != 0)
    kept = kept.select("part", "kept", "prior", F.explode(bits).alias("bit")).select("part", "bit", F.col("prior").bitwiseXOR(F.col("bit")).alias("prior"), "kept",
                                                                                   *[none.alias(c) for c in ("removed", "redundant", "good_lost", "toxic_lost")])
    sets = F.filter(F.sequence(F.lit(0), F.lit(_ALL)), lambda m: m.bitwiseAND(F.col("bit")) == 0)
    steps = failing.join(ids, "key").select("key", "bit", "part", good, toxic, F.explode(sets).alias("prior"))
    removed = steps.join(other, hit, "left_anti").select("part", "bit", "prior", none.alias("kept"), one.alias("removed"), none.alias("redundant"), "good_lost", "toxic_lost")
    redundant = steps.join(other, hit, "left_semi").select("part", "bit", "prior", none.alias("kept"), none.alias("removed"), one.alias("redundant"),
                                                           none.alias("good_lost"), none.alias("toxic_lost"))
    every = rows.select("part").distinct().select("part", F.explode(F.array(*map(F.lit, _BIT.values()))).alias("bit")).select(
        "part", "bit", F.explode(sets).alias("prior"), *[none.alias(c) for c in ("kept", "removed", "redundant", "good_lost", "toxic_lost")])
    return removed.unionByName(redundant).unionByName(kept).unionByName(every).groupBy("part", "bit", "prior").agg(
        *[F.sum(c).alias(c) for c in ("kept", "removed", "redundant", "good_lost", "toxic_lost")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters, and step, with what the step's filter does there."""
    spark = docs.sparkSession
    rows, tables = failing_tables(docs)
    counts = relations(rows, tables, labels)
    # of 120 orders, |S|! (4 - |S|)! have exactly S before x
    weight = F.element_at(F.array(*map(F.lit, (24, 6, 4, 6, 24))), F.bit_count("prior") + 1).cast("long")
    of_filter = counts.groupBy("part", "bit").agg(F.sum(F.col("removed") * weight).alias("shapley"),
                                                  F.max(F.when(F.col("prior").bitwiseOR(F.col("bit")) == _ALL, F.col("removed"))).alias("unique_fails"))
    orders = [("".join(o), i + 1, _BIT[f], sum(_BIT[g] for g in o[:i])) for o in permutations(FILTERS) for i, f in enumerate(o)]
    steps = spark.createDataFrame(orders, "filter_order string, step int, bit int, prior int")  # 600 rows, always
    return counts.join(of_filter, ["part", "bit"]).join(F.broadcast(steps), ["bit", "prior"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
