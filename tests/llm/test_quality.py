"""Quality scores: held-out accuracy, calibration, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from railbird.llm import quality
from tests.llm import cases

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stats = quality.with_statistics(docs).select("doc_id", "stats")
    train = quality.training_rows(stats.where(quality.remainder("doc_id", 4) != 2), labels, "quality")
    model = quality.fit(train)
    rows = quality.score(stats, model, 0.7).join(labels, "doc_id").where(quality.remainder("doc_id", 4) == 2)
    return model, rows.select("score", "predicted", "quality").collect()


def test_held_out_accuracy(scored):
    _, rows = scored
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    assert len(rows) > 50 and right > 0.95
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_calibration_never_falls(scored):
    model, _ = scored
    assert (np.diff(model.chance) >= 0).all() and (np.diff(model.grid) > 0).all()


def test_odd_texts_get_the_same_score_either_way(spark, scored):
    model, _ = scored
    docs = cases.documents(spark)
    direct = quality.score_texts(docs, model, 0.7)
    assert set(docs.columns) <= set(direct.columns)
    stats = quality.score(quality.with_statistics(docs).select("doc_id", "stats"), model, 0.7)
    a, b = (sorted([(r["doc_id"], r["score"]) for r in x.collect()], key=repr) for x in (direct, stats))
    assert a == b and len(a) == len(cases.ROWS)
    by_id = {}
    for i, s in a:
        by_id.setdefault(i, set()).add(s)
    assert by_id[1] == by_id[2] and by_id[5] == by_id[6]


def test_nothing_to_learn_from(spark):
    docs = cases.documents(spark)
    none = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    train = quality.training_rows(quality.with_statistics(docs), none, "quality")
    out = quality.score_texts(docs, quality.fit(train), 0.7)
    assert {(r["score"], r["predicted"]) for r in out.collect()} == {(0.5, 0)}
    assert quality.score_texts(docs.where("doc_id < 0"), quality.fit(train), 0.7).count() == 0


def test_one_class_only(spark):
    docs = cases.documents(spark)
    ones = docs.where("doc_id > 20").select("doc_id", F.lit(1).alias("quality"))
    train = quality.training_rows(quality.with_statistics(docs), ones, "quality")
    assert {r["predicted"] for r in quality.score_texts(docs.where("doc_id > 20"), quality.fit(train), 0.7).collect()} == {1}


def test_features_approximate_a_gaussian_kernel():
    draw = np.random.default_rng(2)
    stats = draw.normal(size=(40, quality.N_STATS))
    zero = np.zeros(quality.N_STATS)
    z = quality.Model(zero, zero + 1, zero, zero, zero).features(stats)[:, :-1]
    near = np.exp(-((stats[:, None] - stats[None]) ** 2).sum(-1) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - near).max() < 0.3 and np.abs(z @ z.T - near).mean() < 0.06


def test_partitions_are_summed_in_steps(spark):
    docs = cases.documents(spark).where("doc_id is not null")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")).distinct()
    train = quality.training_rows(quality.with_statistics(docs), labels, "quality")
    few, many = quality.fit(train.coalesce(1)), quality.fit(train.repartition(70))
    assert np.allclose(few.weights, many.weights, atol=1e-6)


def test_isotonic():
    got = quality.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.1, 0.5, 0.2, 0.9]))
    assert np.allclose(got, [0.1, 0.3, 0.3, 0.9])
