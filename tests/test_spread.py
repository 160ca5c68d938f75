"""Tasks that sort or group order lines hold a bounded number of them, however many lines there are."""

import pytest

from tidemark.functions import lineage
from tidemark.plans.adapter import orders_dataset
from tidemark.plans.tables import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tokens", "output_files", "context_sources", "context_cost"])
def test_partitions_grow_with_the_lines(spark, monkeypatch, name):
    lines = table(spark, SF, "lineitem").count()
    usual = getattr(orders_dataset(spark, SF), name)
    monkeypatch.setattr(lineage, "ROWS_OF_A_TASK", lines // 9)
    dealt = getattr(orders_dataset(spark, SF), name)
    assert dealt.rdd.getNumPartitions() == -(-lines // (lines // 9))
    assert usual.rdd.getNumPartitions() < dealt.rdd.getNumPartitions()
    assert sorted(map(str, usual.collect())) == sorted(map(str, dealt.collect()))
