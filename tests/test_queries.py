"""Every registered query against its own SQL, and shape and plan of some."""

import pytest
from comparing import rows

from sparkvq.plans.queries import QUERIES


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_matches_sql(spark, sf_dir, tables, name):
    run, sql = QUERIES[name]
    got, want = rows(run(spark, sf_dir)), rows(tables.sql(sql))
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name][0](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["query_id", "rank", "vec_id"] and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan(spark, sf_dir):
    text = plan(QUERIES["filtered_topk"][0](spark, sf_dir))
    assert "PushedFilters" in text and "WindowGroupLimit" in text


def test_projection_prunes_columns(spark, sf_dir):
    text = plan(QUERIES["vec_norm"][0](spark, sf_dir))
    assert "label" not in text.split("ReadSchema")[1]


def test_encoding_does_not_shuffle(spark, sf_dir):
    assert "Exchange" not in plan(QUERIES["pack4_hex"][0](spark, sf_dir))


def test_group_top_k_limits_before_the_exchange(spark, sf_dir):
    assert plan(QUERIES["label_topk"][0](spark, sf_dir)).count("WindowGroupLimit") == 2
