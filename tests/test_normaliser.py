"""One normaliser for texts and search terms."""

import re
import unicodedata

from pyspark.sql import functions as F

from tallyloom.operators import papers as pa


def test_stable_characters_never_change():
    stable = [c for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF and re.match(f"[{pa.STABLE}]", chr(c))]
    text = "".join(map(chr, stable))
    assert unicodedata.normalize("NFKC", text) == text and not any(unicodedata.combining(chr(c)) for c in stable)


def test_text_and_term_meet(spark):
    rows = [(0, "ＡＢＣ  Ｔｅｓｔ"), (1, "ﬁne ½"), (2, "Café\tBar"), (3, None), (4, "plain Éa 中文")]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, s string").select("i", pa.norm_text(F.col("s")).alias("t")).collect()}
    assert got == {0: "abc test", 1: "fine 1⁄2", 2: "cafébar", 3: "", 4: "plain éa 中文"}
    for i, s in rows:
        assert pa.norm_term(s or "") == got[i]
