"""The stages of the pipeline, each against its input, and the registered queries against their SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, connect
from railbird.llm import neardup, queries
from railbird.operators.groups import shared_dir
from tests.llm import cases
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    folder, docs, out = f"{shared_dir(spark)}/stages", spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.mode("overwrite").parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_all_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(queries.SQL) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    text, same = compare(spark, connect(SF), SF, name, queries.QUERIES[name], queries.SQL[name])
    assert same, text


def test_stages_keep_the_columns(stages):
    assert all(after.columns == COLUMNS for _, after in stages[:-1])
    assert stages[-1][1].columns == [*COLUMNS, "shard", "slot"]
    for before, after in stages[:3]:
        assert after.exceptAll(before).isEmpty()


def test_quality_drops_the_bad_and_keeps_the_good(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(before, "doc_id")
    kept = set(ids(after))
    by = {q: [r["doc_id"] in kept for r in labels.where(F.col("quality") == q).collect()] for q in (0, 1)}
    assert sum(by[1]) >= 0.95 * len(by[1]) and sum(by[0]) <= 0.2 * len(by[0])


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == sorted(i for i, _, _, kept in brute(rows, neardup.Near()) if kept)


def test_benchmark_documents_go(spark, stages):
    before, after = stages[2]
    found = queries.QUERIES["op7_benchmark_passages"](spark, SF).where("contaminated")
    bad = {r["doc_id"] for r in found.collect()}
    assert ids(after) == [i for i in ids(before) if i not in bad] and bad


def test_mixture_and_shards(stages):
    before, after = stages[3]
    assert set(ids(after)) < set(ids(before)) and max(ids(after).count(i) for i in ids(after)) <= corpus_pipeline.EPOCHS
    before, after = stages[4]
    assert ids(before) == ids(after)
    assert after.select("shard", "slot").distinct().count() == after.count()


def test_stages_stand_odd_rows(spark):
    path = f"{shared_dir(spark)}/odd"
    cases.documents(spark).write.mode("overwrite").parquet(path)
    docs = spark.read.parquet(path)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for some in (docs, docs.where("doc_id < 0")):
            out = stage(spark, some, SF)
            columns = docs.columns if k < 4 else [*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot"]
            assert out.columns == columns, name
            n = out.count()
            assert n > 0 if some is docs else n == 0, name
    deduped = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in deduped.where("doc_id < 15").collect()) == [1, 4, 5, 6, 7, 8, 10, 12, 13, 14]


def test_run_applies_all_stages(spark, stages):
    assert ids(corpus_pipeline.run(spark, SF)) == ids(stages[-1][1])
