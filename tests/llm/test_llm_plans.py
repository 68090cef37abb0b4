"""What the plans must and must not hold."""

import re

import pytest

from wayfind.llm import queries

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_url_filter", "op6_chat_format", "op7_line_dedup"])
def test_native_queries_run_no_python(spark, name, monkeypatch):
    from wayfind.llm.common import Scratch

    plans = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, *a, **b: (plans.append(plan(df)), keep(self, df, *a, **b))[1])
    plans.append(plan(queries.queries()[name](spark, SMALL)))
    for p in plans:
        assert not re.search("Python|Pandas|InArrow|ExistingRDD", p), p
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", p) or name == "op2_url_filter"  # its one-row prior


@pytest.mark.parametrize(("name", "columns"), [("op2_url_filter", "page_id url"), ("op6_chat_format", "conv_id role text turn"), ("op1_exact_topk", "embedding vec_id")])
def test_scans_read_only_what_is_needed(spark, name, columns):
    df = queries.queries()[name](spark, SMALL)
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"/(?:pages|conversations|embeddings)\.parquet.*?ReadSchema: struct<([^>]*)", plan(df)))))
    assert read == set(columns.split())
