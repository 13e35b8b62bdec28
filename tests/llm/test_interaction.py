"""Filter interaction against brute force over all orders."""

import random
import re
from itertools import permutations

from tallyloom.llm import interaction

DOC = "doc_id long, text string, lang string, source string, n_chars long, key long, part string, bit int"
COLS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def by_hand(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
             "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        fails.append((source or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, shapley = [], {}
    for part in {p for p, *_ in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for s, x in enumerate(order, 1):
                before = set(order[:s - 1])
                gone = [f for f in mine if x in f[1] and not f[1] & before]
                out.append([part, order, s, sum(not f[1] & (before | {x}) for f in mine), len(gone), sum(x in f[1] and bool(f[1] & before) for f in mine),
                            sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)])
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def frames(spark, docs, labels):
    rows = [(i, t, "en", s, 0, 7, "zz", 3) for i, t, s in docs]
    return spark.createDataFrame(rows, DOC).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_matches_brute_force(spark):
    rng = random.Random(8)
    words = ["ab", "cd", "Ef", "gh#", "é", "日本", "x|y", "QQ"] + [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(rng.choices(words[:4] if i % 5 == 0 else words, k=rng.choice([3, 199, 200, 230]))), rng.choice(["a", "b", None, ""])) for i in range(150)]
    docs += [(200 + i, docs[i % 7][1], "hot") for i in range(120)]  # copies, one text very common
    docs += [(400 + i, "Same text", "hot") for i in range(80)]
    docs += [(3, docs[3][1], "a"), (3, "other", "a"), (None, docs[4][1], "b"), (None, None, None), (600, None, "a"), (601, "", "a"), (602, " \t\n\x0b ", "a"),
             (603, "one word " * 300, "a"), (604, "A" * 3 + "b" * 147, "c"), (605, "A" * 4 + "b" * 146, "c"), (606, "long " * 40_000, "c")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 600, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (9999, 1, 1)]
    got = interaction.audit(*frames(spark, docs, labels)).select(*COLS).collect()
    assert sorted(map(tuple, got)) == by_hand(docs, labels)


def test_no_rows_no_labels(spark):
    docs, labels = frames(spark, [], [])
    assert interaction.audit(docs, labels).count() == 0
    docs, labels = frames(spark, [(1, "clean words here", "s"), (2, "clean words here", "s")], [])
    got = interaction.audit(docs, labels).select(*COLS).collect()
    assert sorted(map(tuple, got)) == by_hand([(1, "clean words here", "s"), (2, "clean words here", "s")], [])
    assert len(got) == 600


def test_one_shuffle_of_ids_serves_all_sets(spark):
    """Sets are unrolled after the shuffle by id: no exchange lies above a mask before it is counted."""
    docs, labels = frames(spark, [(i, f"t{i} " * i, "s") for i in range(20)], [(1, 1, 0)])
    rows, tables = interaction.failing_tables(docs)
    counts = interaction.relations(rows, tables, labels)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    keyed = [x for x in plan.splitlines() if "Exchange hashpartitioning(key" in x]
    assert keyed and all("REPARTITION_BY_COL" in x for x in keyed) and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
