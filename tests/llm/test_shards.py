"""Shards: contiguous, gapless, of nearly equal bytes."""

import pytest
from pyspark.sql import functions as F

from railbird.llm import shards
from tests.llm import cases


def cut(spark, docs, n):
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("size")
    return shards.byte_shards(docs.select("doc_id", size, F.lit("x").alias("slot"), F.lit(1).alias("shard")), n, ["doc_id"], "size")


@pytest.mark.parametrize("n", [1, 3, 24])
def test_contiguous_and_balanced(spark, n):
    rows = cut(spark, cases.documents(spark), n).collect()
    assert len(rows) == len(cases.ROWS)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
    assert set(by_shard) <= set(range(n))
    last = None
    for shard in sorted(by_shard):
        own = sorted(by_shard[shard], key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in own]
        assert ids == sorted(ids) and (last is None or last <= ids[0])
        last = ids[-1]
        assert abs(sum(r["size"] for r in own) - total / n) <= largest


def test_small_rows_differ_by_less_than_one_row(spark):
    rows = [cases.row(i % 7, "abcd" * (i % 5)) for i in range(2000)]
    sums = cut(spark, cases.documents(spark, rows), 24).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(sums) == 24 and max(r["s"] for r in sums) - min(r["s"] for r in sums) <= 2 * 24


def test_empty_table(spark):
    assert cut(spark, cases.documents(spark).where("doc_id < 0"), 24).count() == 0


def test_no_python_in_the_plan(spark):
    plan = cut(spark, cases.documents(spark), 24)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
