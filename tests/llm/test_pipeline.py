"""The pipeline against a plain version of its stages, and the registered queries against their SQL."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import rows_of
from tallyloom.llm import packing, pii
from tallyloom.llm.queries import ORACLES, QUERIES
from test_minmax import brute as near
from test_pii_decontam_windows import base


def corpus():
    rng = random.Random(8)
    kinds = {"xx": ["tha", "ing", "wor", "le"], "yy": ["öß", "schu", "gen", "ei"]}
    word = lambda k: "".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3)))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    items = [(i, text("xx", 20)) for i in range(3)]
    rows = []
    for i in range(40):
        k = "xx" if i % 3 else "yy"
        rows.append((i, text(k, rng.choice([25, 80, 300])), k))
    rows[5] = (5, rows[2][1], "xx")  # exact copy
    w = rows[4][1].split()
    w[7] = "changed"
    rows[7] = (7, " ".join(w) + " " + text("xx", 1), "xx")  # near copy, if long enough
    rows[8] = (8, text("xx", 30) + " " + items[1][1] + " " + text("xx", 30), "xx")  # leak
    rows[10] = (10, text("xx", 30) + " write to a.b@c.org or +1 (555) 123-4567 now " + text("xx", 30), "xx")
    rows += [(40, None, "xx"), (41, "", None), (42, "12 34 ... !!", "xx"), (43, "thaing " * 30_000, None), (None, text("xx", 40), None)]
    return [(i, t, k, "src", None if t is None else len(t)) for i, t, k in rows], items


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def plain(rows, items):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = near([(r[0], r[1]) for r in rows if r[0] is not None], 5, 80)
    rows = [r for r in rows if r[0] is None or groups[r[0]][2]]
    rows = [r for r in rows if r[0] is None or not any(t in r[1] for _, t in items)]
    out = []
    for i, t, *_ in rows:
        for lo, hi, kind in reversed(base(t)):
            t = f"{t[:lo]}<{kind}>{t[hi:]}"
        out.append((i, t))
    return out


def test_run_matches_the_plain_version(spark, made):
    folder, rows, items = made
    encode = packing.encoder(packing.TOKENIZER)
    want = {i: np.append(encode(t), np.uint32(0)).astype("<u4") for i, t in plain(rows, items)}
    got: dict = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(want)
    assert 5 not in got and 8 not in got and 10 in got and None in got
    for i, parts in got.items():
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(want[i][r.start:r.start + r.length].tobytes())
        assert sum(r.length for r in parts) == len(want[i])


def test_stages_keep_the_columns(spark, made):
    folder, *_ = made
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("keys", F.lit(1)).withColumn("score", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_stages_take_an_empty_table(spark, made):
    folder, *_ = made
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_redaction_of_overlapping_spans(spark):
    df = spark.createDataFrame([(1, "x +378282246310005 y")], "doc_id long, text string")
    assert [k for *_, k in base("x +378282246310005 y")] == ["phone", "card"]
    assert pii.redact(df, None, {}).first().text == "x <phone> y"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    rel = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
