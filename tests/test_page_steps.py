"""Page words are dealt out by document once; no window over a page shuffles them again."""

import re

from tallyloom.operators import layout as ly
from tallyloom.plans import catalog
from tallyloom.plans.derived import page_words


def test_lines_need_one_exchange_of_texts(spark):
    plan = ly.line_build(page_words(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and "REPARTITION_BY_NUM" in plan


def test_page_block_order_runs(spark):
    rows = catalog.QUERIES["page_block_order"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["ids"].startswith("w") for r in rows)
