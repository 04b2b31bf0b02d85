"""Physical plans: pruned scans, no row-at-a-time Python, no cross joins, few shuffles."""

import pytest

from aspectra.operators import metrics
from aspectra.plans import fixtures as fx
from aspectra.plans.queries import QUERIES

NARROW = [
    "text_lower", "text_punct", "text_numbers", "text_allowlist", "abbrev_expand",
    "abbrev_expand_raw", "prepare_text", "one_hot_encode", "one_hot_decode", "aspect_unpivot",
    "head_softmax", "head_argmax", "head_top_class", "threshold_decode", "head_scores",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_pickled_python(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in text
    if name not in ("head_scores", "evaluate_heads", "compound_merge_list", "compound_best_path", "sequence_encode_subword"):
        assert "ArrowEvalPython" not in text


@pytest.mark.parametrize("name", NARROW)
def test_reviews_are_not_shuffled(spark, sf, name, monkeypatch):
    # Small test files are spread over the cores first; that is not part of the operator.
    monkeypatch.setattr(fx, "spread", lambda df, key: df)
    assert "Exchange hashpartitioning" not in plan(QUERIES[name](spark, sf))


def test_scans_read_only_needed_columns(spark, sf):
    text = plan(QUERIES["token_counts"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text or "struct<text:string>" in text
    text = plan(QUERIES["score_report_large"](spark, sf))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text


def test_report_is_one_shuffle_with_partial_aggregation(spark, sf):
    text = plan(metrics.score_report(fx.large_pairs(spark, sf)))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text and "Union" not in text
