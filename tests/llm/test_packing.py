"""Packing: the encoder against the file's own engine, the plan, and whole packings."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tallyloom.llm import packing

SCHEMA = "doc_id long, text string, extra string, length int"


def test_encoder_equals_the_file_engine():
    own, ref = packing.encoder(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    rng = random.Random(1)
    texts = ["", "a<|endoftext|>b", "  \n\n x  ", "²½ 12３", "'s 'S don't "] + ["".join(rng.choice("ab '\n\t1²é中😀_") for _ in range(50)) for _ in range(300)]
    for t in texts:
        assert own(t).tolist() == ref.encode(t, add_special_tokens=False).ids


def test_plan_places_every_piece_once_and_never_overfills():
    rng = random.Random(2)
    for cap in (10, 64):
        counts = {k: rng.choice([0, 1, 2, 7, 40]) for k in range(1, cap + 1)}
        used, seen = {}, {k: set() for k in counts}
        for length, rank, n, first, offset in packing.plan(counts, cap):
            for j in range(n):
                assert rank + j not in seen[length]
                seen[length].add(rank + j)
                used.setdefault(first + j, []).append((offset, length))
        assert {k: len(v) for k, v in seen.items()} == counts
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= cap
            assert sum(3 * x > cap for _, x in spans) <= 2


def test_pack_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "béta", "x", "42"]) for _ in range(rng.choice([0, 1, 5, 30, 300]))), "e", 1) for i in range(60)]
    rows += [(60, None, None, None), (61, "", "", 0), (61, "", "", 0), (None, "no id", None, None)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity=64, with_ids=True).collect()
    encode = packing.encoder(packing.TOKENIZER)
    want = sorted((-1 if i is None else i, [*encode(t or "").tolist(), 0]) for i, t, *_ in rows)
    docs: dict = {}
    for r in got:
        assert r["length"] == len(r["ids"]) <= 64
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        docs.setdefault(r["doc_id"], []).append(r)
    assert sorted(x for r in got for x in r["ids"]) == sorted(x for _, ids in want for x in ids)
    for i, ids in want:
        if i not in (61, -1):
            parts = sorted(docs[i], key=lambda r: r["piece"])
            assert [x for r in parts for x in r["ids"]] == ids
            assert [r["length"] for r in parts[1:]] == [64] * (len(parts) - 1)
            assert [r["start"] for r in parts] == np.cumsum([0, *[r["length"] for r in parts[:-1]]]).tolist()
    for spans in {r["sequence_id"]: [(s["offset"], s["length"]) for s in got if s["sequence_id"] == r["sequence_id"]] for r in got}.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
