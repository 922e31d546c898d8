"""Every query of the log engine against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from ledgerline.plans import catalog
from tests.compare import oracle, same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    same(catalog.queries()[name](spark, small).toPandas(), oracle(small, catalog.oracle_sql()[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("width", [1, 3, 1 << 20])
def test_evictions_of_an_lru_table(spark, width):
    from ledgerline.operators.views import evictions

    seen = [1, 2, 3, 1, 4, 2, 0, 5]  # cap 3: 4 evicts 2, 2 evicts 3, 5 evicts 1
    r = evictions(spark.createDataFrame(list(enumerate(seen)), "seq long, session long"), 3, width).first()
    assert (r.evicted, r.held) == (3, 3)
    r = evictions(spark.createDataFrame([], "seq long, session long"), 3, width).first()
    assert (r.evicted, r.held) == (0, 0)


def test_floor_of_no_and_of_too_many_replicas(spark):
    from ledgerline.operators import retain

    schema = "event long, slot int, live boolean, durable long"
    assert retain.floor(spark.createDataFrame([], schema), 2).count() == 0
    many = spark.createDataFrame([(k, k, True, k + 5) for k in range(65)], schema)
    with pytest.raises(ValueError, match="64"):
        retain.floor(many, 2)
    assert [r.floor for r in retain.floor(many.where("slot < 64"), 64).orderBy("event").collect()] == [0] * 63 + [5]


def test_text_of_metrics(spark):
    from ledgerline.operators import metrics

    rows = [("role", "leader", 1), ("follower_ack_age_seconds", "0", 1_500_000_000), ("writes_total", "", 7)]
    text = metrics.render(spark.createDataFrame(rows, "metric string, label string, value long"), "log")
    assert text == 'log_follower_ack_age_seconds{label="0"} 1.500000000\nlog_role{label="leader"} 1\nlog_writes_total 7\n'
