"""Exact substring dedup against a brute-force pass, and the index against plain search."""

import hashlib
import random

import numpy as np
import pytest

from tallyloom.llm import suffix

SCHEMA = "doc_id long, text string, extra string"


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                mark[p:p + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out[i] = (len(b), sum(mark), len([x for x in bytes(mark).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    hot, rows = text(40), []
    base = text(120)
    for i in range(60):
        t = text(rng.choice([0, 3, 20, 90]))
        if i % 3 == 0:
            t += " " + hot + " " + text(5)
        if i % 4 == 1:
            cut = rng.randint(0, 200)
            t = base[cut:cut + rng.randint(100, 500)] + t
        if i % 7 == 2:
            t = "spam! " * 80 + t
        rows.append((i, t))
    return rows + [(60, base), (61, base), (62, None), (63, ""), (64, "x" * 99), (65, "x" * 100), (66, "x" * 5000)]


@pytest.mark.parametrize("hot", [50_000, 3])
def test_dedup_matches_brute_force(spark, hot):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df, hot=hot).collect()}
    assert got == brute(rows, 100)


def test_copies_go_whole_and_heavy_texts_are_joined_in_parts(spark):
    rng = random.Random(8)
    a, b = ("".join(rng.choice("abcdef ") for _ in range(n)) for n in (400, 150))
    rows = [(i, a) for i in range(40)] + [(40, b), (41, b), (42, a[50:300] + b), (43, "é" * 60), (44, "é" * 60), (45, "short"), (46, "short")]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df, hot=3).collect()}
    assert got == brute(rows, 100)
    texts = df.selectExpr("doc_id as doc", "cast(text as binary) as body")
    copies = {r.doc: r.n for r in suffix.whole_copies(texts.union(spark.createDataFrame([(41, b"other")], texts.schema))).collect()}
    assert copies == {i: 400 for i in range(1, 40)} | {44: 120, 46: 5}


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    rng = random.Random(1)
    t = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = t(300), t(150), t(260)
    rows = [(1, a), (5, a[:150] + b), (5, c + b), (5, c + b), (6, c), (-7, t(200) + b), (None, a)]
    sums = lambda x: hashlib.sha256(x.encode()).hexdigest()
    order = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], sums(r[1])))
    want = {order[n]: v for n, v in brute([(n, x) for n, (_, x) in enumerate(order)], 100).items()}
    want[(None, a)] = (300, 0, 0, sums(a))
    got = suffix.dedup(spark.createDataFrame([(i, x, "e") for i, x in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((i or 0, *want[(i, x)]) for i, x in rows)


def test_edge_tables(spark):
    assert suffix.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    t = "lorem ipsum " * 20
    got = suffix.dedup(spark.createDataFrame([(None, t, "e"), (1, t, "e")], SCHEMA)).collect()
    assert {r.doc_id: r.n_removed > 0 for r in got}[None] is False


def test_statistics_find_exactly_the_earlier_windows():
    rng = random.Random(3)
    for _ in range(60):
        length = rng.choice([3, 5, 10])
        base = bytes(rng.choice(b"ab") for _ in range(40))
        group = []
        for _ in range(rng.randint(1, 7)):
            i = rng.randint(0, 20)
            s = bytearray(base[i:i + rng.randint(length, 20)])
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = rng.choice(b"abc")
            group.append(bytes(s))
        group = list(dict.fromkeys(group))
        seen, want = set(), []
        for s in group:
            w = [s[i:i + length] for i in range(len(s) - length + 1)]
            want.append([x in seen for x in w])
            seen.update(w)
        assert [m.tolist() for m in suffix.earlier([group], length)[0]] == want


def test_index_is_run_compressed():
    s = np.frombuffer(b"abracadabra" * 200, np.uint8)
    index = suffix.RunIndex([s])
    assert len(index.start) < index.n // 20


def test_runs_cover_every_window_once():
    rng = random.Random(4)
    for n in (0, 99, 100, 350, 2000):
        data = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(n)), np.uint8)
        _, at, first, last = suffix.runs(data, 100, 24)
        assert [i for a, z in zip(first, last) for i in range(a, z + 1)] == list(range(max(0, n - 99)))
        assert all(z <= p and p + 24 <= a + 100 for a, z, p in zip(first, last, at))
