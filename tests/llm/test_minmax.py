"""Near-duplicates against a brute-force similarity join."""

import random
import re
import string

import pyarrow as pa
import pytest

from tallyloom.llm import minmax

SCHEMA = "doc_id long, text string, component_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        n = min(size, len(w))
        out[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()
    return out


def brute(rows, size, percent):
    sets = sets_of(rows, size)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, n = [], 0
    for _ in range(6):
        base = [word() for _ in range(rng.choice([8, 60, 200]))]
        for edits in [0, 0, 1, 2, 4, 8, 12, 20]:
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = word().upper()
            rows.append((n, " ".join(t)))
            n += 1
    return rows + [(n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, "É one"), (n + 7, "é one")]


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_brute_force(spark, size):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(df, size=size).collect()}
    assert got == brute(rows, size, 80)


def test_edge_tables(spark):
    assert minmax.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "x"), (2, "a b c d", "x")]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minmax.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_a_group_of_candidates_is_not_spelled_out_in_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    # each text has words of its own in place of a tenth: all pairs stand near 0.7, a few below one another at 0.9
    rows = []
    for n in range(60):
        t = [word() if rng.random() < 0.055 else w for w in base]
        rows.append((n, " ".join(t)))
        if n % 20 == 0:
            rows.append((n + 1000, " ".join(t[:280])))
    df = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(df, leaders=1).collect()}
    assert got == brute(rows, 2, 80)
    ids, sets = [i for i, _ in rows], minmax.shingle_sets([t for _, t in rows], 2)
    low, high = minmax.signatures(sets, 64)
    keys = minmax.band_keys(low, high, 4)
    sign = [b.column(1)[i].as_py() for b in minmax._long_signatures(2, 64)(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array([t for _, t in rows])], ["i", "t"])])) for i in range(b.num_rows)]
    shared = sorted({int(k) for k in keys.ravel() if (keys == k).sum() > 1})
    groups = [(k, ids[i], ids[i], len(sets[i]), len(sets[i]), keys[i].tolist(), sign[i]) for k in shared for i in range(len(ids)) if k in keys[i]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*groups)], ["key", "id", "comp", "n", "common", "keys", "sig"])
    for block in (4096, 8):
        met = [r for b in minmax._across(0, 50, block)(iter([batch])) for r in b.to_pylist()]
        pairs = [(r["id"], x) for r in met for x in r["others"]]
        assert len({frozenset(p) for p in pairs}) == len(pairs) > 0  # every pair once
        if block == 4096:
            assert len(met) <= len(groups)  # a row per document and bucket at most
        else:
            assert max(len([r for r in met if (r["bucket"], r["part"]) == k]) for k in {(r["bucket"], r["part"]) for r in met}) <= 16
