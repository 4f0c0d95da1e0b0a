"""Each query against its SQL; those without SQL give rows of a stable shape."""

from __future__ import annotations

import pytest

from tests.oracle import DATA, assert_same, connection
from tidemark import catalog
from tidemark.streaming import running, stateful

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", ["str4_stream_repeat_zip", "str6_stream_sma", "str6_stream_lag", "str6_stream_width_sum", "str8_late_rows", "str11_state_is_given_up"])
def test_series_of_a_stream_share_states(spark, monkeypatch, name):
    monkeypatch.setattr(stateful, "GROUPS", 2, raising=False)
    results, stepped = [], running.stepped
    monkeypatch.setattr(running, "stepped", lambda *a: results.append(stepped(*a)) or results[-1])
    assert_same(spark, QUERIES[name], SQL[name])
    assert spark.read.format("statestore").load(results[0]._state_path).count() <= 2


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize(("name", "table"), [("srt1_key_order_whole", "SELECT count(*) FROM events"), ("srt2_reverse_order_whole", "SELECT count(DISTINCT o_orderdate::DATE) FROM orders")])
def test_whole_series_are_ordered(spark, name, table):
    n = connection(DATA).sql(table).df().iloc[0, 0]
    assert sorted(r["place"] for r in QUERIES[name](spark, DATA).collect()) == list(range(1, n + 1))
