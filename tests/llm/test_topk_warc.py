"""Top-k search and WARC archives against brute force and round trips."""

import math
import random

import pytest

from tallyloom.llm import topk, warc

VEC = "vec_id long, embedding array<float>, label int, id string, rank int"


def test_topk_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(20)], 1, "x", 0) for i in range(400)]
    rows += [(i, list(rows[7][1]), 1, "x", 0) for i in range(400, 480)]  # ties
    rows += [(480, None, 1, "x", 0), (481, [None] * 20, 1, "x", 0), (482, [math.nan] * 20, 1, "x", 0), (483, [math.inf] * 20, 1, "x", 0), (None, [0.1] * 20, 1, "x", 0),
             (484, [0.5] * 3, 1, "x", 0), (500, [0.25] * 3, 1, "x", 0)]
    df = spark.createDataFrame(rows, VEC)
    stored = {r.vec_id: r.embedding for r in df.collect()}
    q = {i: [math.floor(1024 * float(x)) for x in v] for i, v in stored.items()
         if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for i in (i for i in q if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i and len(q[j]) == len(q[i]))[:10]
        want |= {(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)}
    got = topk.top_k(df.where("vec_id % 100 = 0"), df, k=10, block=64, query_block=2, seeds=50).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_topk_large_components_and_empty(spark):
    df = spark.createDataFrame([(0, [1e9, 1.0]), (1, [2e3, 3.0]), (2, [1e3, 9.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df.where("vec_id = 0"), df, k=2).orderBy("rank").collect()]
    assert [g[2] for g in got] == [1, 2] and got[0][3] == 1024 * 10**9 * 1024 * 2000 + 1024 * 3072
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(empty, empty).count() == 0


PAGES = "page_id long, url string, html string, archive string, record_type string"


def test_warc_round_trip(spark):
    rng = random.Random(2)
    body = "<html>" + "".join(rng.choice("abc <p>é\r\n") for _ in range(3000))
    rows = [(i, f"http://x/{i}\n", f"{body[i:]}", "a", "b") for i in range(40)] + [(100 + i, None, body, "a", "b") for i in range(30)]
    rows += [(200, "u", None, "", ""), (201, "u", "", "", ""), (202, "u", "\r\n\r\nWARC/1.1\r\n", "", ""), (None, "u", body, "", ""), (None, "u", "alone", "", ""), (129, "again", body, "", "")]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(4), archive_bytes=20_000, sample_bytes=4_000, dictionary_bytes=1_000).collect()
    heads: dict = {}
    for i, _, b, *_ in rows:
        b = (b or "").encode()
        if i is not None:
            heads[b] = max(i, heads.get(b, -1))
    want = []
    for i, _, b, *_ in rows:
        b = (b or "").encode()
        head = heads.get(b)
        lone = head is None or head == i
        want.append((i, len(b), warc.payload_digest(b), "response" if lone else "revisit", None if lone else head))
    key = lambda r: (r[0] or -1, r[1], str(r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_come_back_and_records_stand_alone(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 50, "a", "b") for i in range(200)]
    folder = str(tmp_path / "w")
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), folder, dictionary_bytes=2_000)
    assert {(r.page_id, bytes(r.payload).decode(), r.url) for r in warc.read_archives(manifest, folder).collect()} == {(i, b, u) for i, u, b, *_ in rows}
    raw = (tmp_path / "w" / manifest.first().archive).read_bytes()
    magic, size = warc._FRAME.unpack(raw[:8])
    assert magic == warc.MAGIC and size > 0
    # the last record alone, with the dictionary of the first frame
    import zstandard
    dec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:8 + size]))
    last = raw[raw.rindex(b"\x28\xb5\x2f\xfd"):]
    assert warc.parse(dec.decompress(last))[0] == 199


@pytest.mark.parametrize("bad", [b"", b"\0" * 8])
def test_foreign_files_are_refused(bad):
    import io
    with pytest.raises(Exception):
        list(warc.read_archive(io.BytesIO(bad)))
