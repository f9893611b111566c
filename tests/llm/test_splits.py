"""Results where a later scan of the same files has other splits than an earlier one."""

import contextlib

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from railbird.llm import katz, warc
from railbird.operators.groups import shared_dir
from tests.llm import cases, test_warc

SIZE, COST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


@contextlib.contextmanager
def splits(spark, size):
    spark.conf.set(SIZE, size)
    spark.conf.set(COST, 1)
    try:
        yield
    finally:
        spark.conf.unset(SIZE)
        spark.conf.unset(COST)


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("splits")
    table = cases.documents(spark, [r for r in cases.ROWS if r[0] != 12], 1).toArrow()
    pq.write_table(table, f"{folder}/documents.parquet", row_group_size=7)
    return f"{folder}/documents.parquet"


def found(spark, work):
    """What ``work`` gives, its last scans with the splits of the first ones, and with others."""
    out = []
    for later in (2000, 1 << 24):
        with splits(spark, 2000):
            df = work()
        with splits(spark, later):
            out.append(sorted(map(tuple, df.collect()), key=repr))
    return out


@pytest.mark.parametrize("stage", [corpus_pipeline.without_near_duplicates, corpus_pipeline.sharded])
def test_stages(spark, path, stage):
    same, other = found(spark, lambda: stage(spark, spark.read.parquet(path).select("doc_id", "text"), ""))
    assert len(same) > 20 and [r[:2] for r in same] == [r[:2] for r in other]


def test_katz_scores(spark, path):
    def work():
        docs = katz.read_chunks(spark, path, 10).select("doc_id", "text", "chunk")
        return katz.score(docs.withColumn("held_out", katz.F.coalesce(docs.doc_id, katz.F.lit(0)) % 3 == 1))

    same, other = found(spark, work)
    assert [r[:5] for r in same] == [r[:5] for r in other]
    assert [r[5:] for r in same] == [pytest.approx(r[5:]) for r in other]


def test_archives(spark):
    folder = f"{shared_dir(spark)}/warc-splits"
    warc.write(test_warc.frame(spark, test_warc.PAGES, 1), folder)
    with splits(spark, 500):
        read = warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    with splits(spark, 1 << 20):
        rows = read.collect()
    assert sorted(map(tuple, rows), key=repr) == test_warc.expected(test_warc.PAGES)
