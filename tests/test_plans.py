"""What the plans must and must not hold."""

import re

from paths import SMALL

import __spark_entry__ as entry


def plan(spark, name):
    return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_index_and_scoring_run_no_python(spark):
    for name in ("postings_boost", "pairs_index", "geo_cells_index", "zinter_topk", "final_score_topk", "reverse_housenumber", "fuzzy_neighbors", "sim_bigram_jaccard"):
        assert not re.search("Python|Pandas|InArrow|CartesianProduct", plan(spark, name)), name


def test_scans_read_two_columns(spark):
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan(spark, "tokenize_docs"))


def test_best_hits_are_cut_before_they_move(spark):
    assert "WindowGroupLimit" in plan(spark, "zinter_topk")
