"""Languages: held-out accuracy, filters against sets, and odd inputs."""

import numpy as np
import pytest

from railbird.llm import langid, quality
from tests.llm import cases

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def filters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(docs.where(quality.remainder("doc_id", 5) != 0))


def test_held_out_accuracy(spark, filters):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(quality.remainder("doc_id", 5) == 0)
    rows = langid.identify(docs, filters).select("lang", "lang_pred", "score").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_texts(spark, filters):
    docs = cases.documents(spark)
    out = langid.identify(docs, filters)
    assert set(docs.columns) <= set(out.columns)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["score"]))
    assert sum(map(len, got.values())) == len(got)
    for i in (5, 6, 7, 14):
        assert got[i] == {("und", 0.0)}
    assert all(next(iter(got[i]))[0] in ("en", "de", "es", "fr") for i in (1, 8, 10, 12, 13, 15, None))
    assert langid.identify(docs.where("doc_id < 0"), filters).count() == 0


def test_nothing_to_learn_from(spark):
    docs = cases.documents(spark)
    empty = langid.fit(docs.where("doc_id < 0"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs, empty).collect()} == {("und", 0.0)}
    assert langid.fit(docs.selectExpr("text", "cast(null as string) as lang")).languages == []


def test_filters_hold_all_members_and_few_others(spark, monkeypatch):
    rows = [cases.row(i, cases.prose(i, 60), f"l{i % 11:02}") for i in range(110)]
    monkeypatch.setattr(langid, "MIN_RATIO", 0.0)
    found = langid.fit(cases.documents(spark, rows))
    assert len(found.languages) == 11 and found.rows.shape == (langid.ROWS, 2)
    for r in rows:
        at = found.languages.index(r[2])
        for grams in langid.trigrams(r[1].encode()):
            masks = np.bitwise_and.reduce([found.rows[p] for p in langid.positions(grams)])
            assert ((masks[:, at // 8] >> (at % 8)) & 1).all()
    others = np.random.default_rng(3).integers(0, 2**63, 20000).astype(np.uint64)
    masks = np.bitwise_and.reduce([found.rows[p] for p in langid.positions(others)])
    assert np.unpackbits(masks, axis=1).mean() < 0.001 and (found.chance < 0.001).all()


def test_pieces_meet(monkeypatch):
    text = (cases.prose(4, 300) + " Ünï çödé. " * 20).encode()
    whole = np.concatenate(list(langid.trigrams(text)))
    monkeypatch.setattr(langid, "SLICE", 50)
    assert sorted(np.concatenate(list(langid.trigrams(text)))) == sorted(whole)


def test_documents_are_counted_once_each(spark, monkeypatch):
    monkeypatch.setattr(langid, "FLUSH", 50)
    docs = cases.documents(spark, [cases.row(i, "ab ab ab" if i % 2 else "cd", "xx") for i in range(10)])
    got = [(r["gram"], r["n"]) for r in langid.document_counts(docs, "text", "lang").collect()]
    assert (None, 10) in got and all(n == 5 for gram, n in got if gram is not None) and len(got) == 5
