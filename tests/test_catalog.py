"""Every registered query: against its SQL where there is one, else rows; and plan shapes."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, small, name):
    assert compare(QUERIES[name](spark, small), duck, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


RELATIONAL = [
    "engagement_normalised", "target_summary", "sample_of_groups", "anova_share_by_group", "chi_square", "burt_table",
    "normalised_indicators", "name_lookup", "histogram_quantity", "term_document_matrix", "smoothed_tfidf",
    "sentiment_profile", "nearest_vectors", "docs_for_terms", "wiki_links", "stop_word_file",
]


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cross_join(spark, small, name):
    plan = _plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark, small):
    plan = _plan(QUERIES["group_profile_price"](spark, small))
    assert "l_quantity" in plan and "l_extendedprice" not in plan.split("ReadSchema")[-1]


def test_filter_reaches_the_scan(spark, small):
    plan = _plan(QUERIES["event_flags"](spark, small))
    assert "Not(EqualTo(event_type,error))" in plan


def test_top_per_concept_limits_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in _plan(QUERIES["top_per_concept"](spark, small))


def test_token_lists_are_not_worked_out_twice(spark, small):
    plan = _plan(QUERIES["document_frequencies"](spark, small))
    assert plan.count("regexp_extract_all") == 1
