"""Registered queries against their SQL. ``check.py`` runs all of them; these are the quick ones."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from railbird.plans import catalog

SF = "/root/testdata/sf0.001"
QUICK = (
    "keep_last", "insert_only", "upsert", "remove_evaluated", "days_to_load", "price_open_recent", "price_days_from_hours",
    "apply_prices", "meeting_rows", "rating_rows", "sectional_rows", "payload_envelopes", "strike_rates", "net_ratings",
)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL) and set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    text, same = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert same, text


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["race_id", "run_id", "votes", "first_signal", "total_signals"] and not df.isEmpty()


def test_top_k_and_keep_last_are_cut_before_the_shuffle(spark):
    for name in ("keep_last", "topk_per_signal"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_one_shuffle_for_the_nested_record(spark):
    plan = entry.queries()["race_payload"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
