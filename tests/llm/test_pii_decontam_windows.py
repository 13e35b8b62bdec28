"""PII spans, spaced seeds and compact windows against brute force."""

import hashlib
import random
import re

import numpy as np

from tallyloom.llm import decontam, pii, windows
from tallyloom.llm.common import mix64

DOCS = "doc_id long, text string, spans string, item_id string, found int"
RULES = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
         ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
         ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
         ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15)]


def base(text):
    found = [(m.start(), m.end(), kind) for kind, rx, ok in RULES for m in rx.finditer(text or "") if ok(m.group())]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def texts():
    rng = random.Random(1)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "1.2.3.4", "256.1.1.1", ".", "@", "4111111111111111", "4111-1111 1111 1111", " ", "-", "+1 (555) 123-4567", "9", "é", "5", "+1",
             "\n", "call 555 123 4567", "1.2.3.4.5.6.7.8"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]


def test_base_spans_match_the_plain_patterns():
    for t in texts():
        assert [s[:3] for s in pii.base_matches(t) if s[3]] == base(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1 " * 70_000, "a@" * 100_000, "1 " * 100_000):
        pii.base_matches(t)


def test_pii_query_and_redaction(spark):
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts()[:300])] + [(900, None, "", "", 0), (901, "", "", "", 0), (902, "mail a@b.c or 1.2.3.4", "", "", 0), (902, "mail a@b.c or 1.2.3.4", "", "", 0), (None, "a@b.c", "", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = pii.pii(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        want = base(t)
        r = by_id[i]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, z, k in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, _, k in want) for x in pii.KINDS)
        assert {f"{k}:{a}:{z}" for a, z, k in want} <= set(r.spans.split(","))
    model, cut = pii.train(df)
    red = {r.doc_id: r.text for r in pii.redact(df, model, cut).collect()}
    assert red[902] == "mail <email> or <ip>" and red[900] is None and red[901] == ""
    assert pii.pii(spark.createDataFrame([], DOCS)).count() == 0


def test_written_out_forms_are_added(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    prose = lambda n=6: " ".join(word() for _ in range(n))
    number = lambda a, b: rng.randint(a, b)
    rows = []
    for i in range(400):
        mail = f"{word()}.{word()}@{word()}.{rng.choice(['org', 'com', 'net', 'de'])}"
        ips = [".".join(str(number(1, rng.choice([9, 99, 255]))) for _ in range(4)), ".".join(str(number(256, 999)) for _ in range(4))]
        phone = f"+{number(1, 99)} ({number(100, 999)}) {number(100, 999)}-{number(1000, 9999)}"
        said = [f"write to {mail}", f"host {ips[0]}", f"build {ips[1]}", f"call {phone}", f"id {number(10**8, 10**11)}", f"we met at {word()}. {word()}"]
        rng.shuffle(said)
        rows.append((i, prose() + " " + "".join(f"{x} {prose()} " for x in said), "", "", 0))
    cases = {"email": "please write to jane.roe (at) example dot org for more", "ip": "the host is 10[.]20[.]30[.]40 for now", "phone": "call 44 (555) 123-4567 now"}
    rows += [(1000 + j, t, "", "", 0) for j, t in enumerate(cases.values())] + [(2000, "we met at noon. Then it rained at home. Nobody", "", "", 0)]
    spans = {r.doc_id: r.spans for r in pii.pii(spark.createDataFrame(rows, DOCS)).collect()}
    for j, (kind, span) in enumerate(zip(cases, ("jane.roe (at) example dot org", "10[.]20[.]30[.]40", "44 (555) 123-4567"))):
        lo = cases[kind].index(span)
        assert f"{kind}:{lo}:{lo + len(span)}" in spans[1000 + j].split(","), (kind, spans[1000 + j])
    assert spans[2000] == ""


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = pii.Trees(trees=60).fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_every_overlap_of_13_words_with_two_changes_is_hit():
    rng = random.Random(2)
    for n, changes in ((13, 2), (20, 4), (40, 8)):
        for _ in range(200):
            spots = set(rng.sample(range(n), changes))
            assert any(all(c == "0" or p + j not in spots for j, c in enumerate(m)) for m in decontam.MASKS for p in range(n - len(m) + 1))


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n)), "z") for i, n in enumerate([30, 14, 8, 4, 50])] + [(90, None, "z"), (None, "x y z", "z")]
    def changed(t, k):
        w = t.split()
        for p in rng.sample(range(len(w)), k):
            w[p] = word()
        return " ".join(w)
    pad = lambda: " ".join(word() for _ in range(40))
    rows = [(0, pad(), "", "", 0), (1, pad() + " " + items[0][1].upper() + " " + pad(), "", "", 0), (2, changed(items[0][1], 5), "", "", 0), (3, pad() + " " + changed(items[1][1], 2), "", "", 0),
            (4, items[2][1], "", "", 0), (5, " ".join(items[4][1].split()[10:30]), "", "", 0), (6, None, "", "", 0), (7, " ".join(items[4][1].split()[:9]), "", "", 0), (None, items[0][1], "", "", 0)]
    df, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = decontam.overlaps(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (2, 0), (3, 1), (4, 2), (5, 4)} and len(got) == 5
    whole = next(r for r in got if r.doc_id == 1)
    assert (whole.doc_start, whole.item_start, whole.length, whole.matches) == (40, 0, 30, 30)
    few = decontam.overlaps(df, bench, bits=6).collect()  # a full screen changes nothing
    assert sorted(map(tuple, few)) == sorted(map(tuple, got))
    assert decontam.overlaps(df, bench.limit(0)).count() == 0 and decontam.overlaps(df.limit(0), bench).count() == 0


def test_compact_windows_match_the_definition():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(0, 60, 4)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        s = mix64(rng.integers(0, rng.choice([5, 1000]), int(bounds[-1])).astype(np.uint64))
        width = int(rng.integers(2, 12))
        turn, odd = mix64(np.array([80, 7780], np.uint64))
        v = (((s ^ turn) * (odd | np.uint64(1))) & ~windows._LOW).tolist()
        want = set()
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for c in range(a, z):
                lo = hi = c
                while lo > a and v[lo - 1] >= v[c]:
                    lo -= 1
                while hi < z - 1 and v[hi + 1] >= v[c]:
                    hi += 1
                if hi - lo + 1 >= width:
                    want.add((lo, hi))
        got = windows.compact_windows(s, bounds, 3, width)
        assert set(zip(got[1].tolist(), got[2].tolist())) == want


def test_window_keys_tell_shingles_apart():
    turn, odd = (int(x) for x in mix64(np.array([80, 7780], np.uint64)))
    back = pow(odd | 1, -1, 1 << 64)
    values = [((v * back) % (1 << 64)) ^ turn for v in (1, 2)]  # their hashes differ in the low bits only
    got = [windows.compact_windows(np.array([x], np.uint64), np.array([0, 1]), 3, 1)[3].tolist() for x in values]
    assert got[0] != got[1] and [len(x) for x in got] == [1, 1]


def test_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    shared, other = text(60), text(200)
    edited = list(other)
    for p in range(20, 200, 60):
        edited[p] = word()
    rows = [(1, text(30) + shared + text(40)), (2, text(100) + shared), (3, shared + text(10)), (4, other), (5, text(7) + edited + text(9)), (6, text(300)), (7, shared[:40] + text(60)), (8, []), (9, text(3))]
    df = spark.createDataFrame([(i, " ".join(w), "", "", 0) for i, w in rows] + [(10, None, "", "", 0), (None, " ".join(shared), "", "", 0)], DOCS)
    got = windows.passages(df).collect()
    covered: dict = {}
    for r in got:
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert r.source_id < r.doc_id and 100 * r.shared >= 80 * r.combined
    assert set(covered) == {2, 3, 5}
    assert covered[2] >= set(range(100, 160)) and covered[3] >= set(range(60))
    assert len(covered[5] & set(range(7, 207))) > 150
    assert windows.passages(df.limit(0)).count() == 0


def test_passages_of_chains_and_frequent_shingles(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    rows, want, n = [], [], 0
    for _ in range(8):  # the last is the last but one word for word; five before have each ninth word changed and take the keys
        b = text(90)
        rows += [(n + j, [word() if p % 9 == 2 * j % 9 else w for p, w in enumerate(b)]) for j in range(5)]
        rows += [(n + 5, text(20) + b), (n + 6, b + text(20))]
        want.append((n + 6, 0, 90))
        n += 7
    for _ in range(6):  # B is A with every tenth word changed, C is B with every tenth (other) word changed
        a = text(120)
        b = [word() if p in range(3, 120, 20) else w for p, w in enumerate(a)]
        c = [word() if p in range(13, 120, 20) else w for p, w in enumerate(b)]
        rows += [(n, a), (n + 1, b), (n + 2, c)]
        n += 3
    line = text(12)
    for _ in range(20):  # a line that all have, first twice in one text; each second text repeats the one before
        b = text(30) + line + text(30)
        rows += [(n, line + text(80) + line), (n + 1, b), (n + 2, text(9) + b)]
        want.append((n + 2, 9, 81))
        n += 3
    df = spark.createDataFrame([(i, " ".join(w), "", "", 0) for i, w in rows], DOCS)
    words_of = dict(rows)
    for block in (1000, 3):
        covered: dict = {}
        got = windows.passages(df, block=block).collect()
        for r in got:
            x, y = ({tuple(words_of[d][p:p + 5]) for p in range(lo, hi - 4)} for d, lo, hi in ((r.doc_id, r.start, r.end), (r.source_id, r.source_start, r.source_end)))
            assert r.source_id < r.doc_id and 100 * len(x & y) >= 80 * len(x | y)
            covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert all(covered.get(i, set()) >= set(range(lo, hi)) for i, lo, hi in want)


def test_trees_learn_from_every_example(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, (3000, 3)).astype(float)
    y = ((x[:, 0] > 20) ^ (x[:, 1] > 10)).astype(int)
    n = np.ones(3000, int)
    x[0], y[0], n[0] = (99.0, 99.0, 99.0), 1, 500  # one row that stands for many counts as many
    rows = spark.createDataFrame([(int(b), int(c), a.tolist()) for a, b, c in zip(x, y, n)], "label int, n long, x array<double>")
    model = pii.boosted(rows.repartition(5), trees=12)
    again = pii.boosted(rows.repartition(2), trees=12)
    same = pii.Trees(trees=12).fit(np.repeat(x, n, axis=0), np.repeat(y, n).astype(float))
    assert np.array_equal(model.predict(x), again.predict(x))
    assert np.abs(model.predict(x) - same.predict(x)).max() < 1e-3


def _alike_places(x, y, width, percent):
    """Places of x in stretches of ``width`` that are alike to one of y."""
    out = set()
    for i in range(len(x) - width + 1):
        a = set(x[i:i + width])
        if any(100 * len(a & b) >= percent * len(a | b) for b in (set(y[j:j + width]) for j in range(len(y) - width + 1))):
            out |= set(range(i, i + width))
    return out


def test_even_parts_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        width, kinds = int(rng.integers(3, 9)), int(rng.choice([4, 12, 1000]))
        x = rng.integers(0, kinds, int(rng.integers(width, 26))).astype(np.uint64)
        y = np.array([v if rng.random() < .85 else rng.integers(0, 2000) for v in x], np.uint64)[int(rng.integers(0, 3)):]
        got = set()
        for a, z, c, d, shared, combined in windows.even_parts(x, y, 80, width, []):
            p, q = set(x[a:z].tolist()), set(y[c:d].tolist())
            assert (len(p & q), len(p | q)) == (shared, combined) and 100 * shared >= 80 * combined
            got |= set(range(a, z))
        assert got == _alike_places(x.tolist(), y.tolist(), width, 80)


def test_passages_leave_no_stretch_out(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(12):  # near copies whose edits differ, so that few min-hashes agree
        b = [word() for _ in range(60)]
        for _ in range(6):
            rows.append((len(rows), [word() if rng.random() < .012 * (g % 4 + 1) else w for w in b]))
    df = spark.createDataFrame([(i, " ".join(w), "", "", 0) for i, w in rows], DOCS)
    got: dict = {}
    for r in windows.passages(df).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end - 4))
    cut = [(i, [tuple(w[p:p + 5]) for p in range(56)]) for i, w in rows]
    for i, x in cut:
        want = set().union(*[_alike_places(x, y, 46, 80) for j, y in cut if j < i and j // 6 == i // 6])
        assert want <= got.get(i, set())
