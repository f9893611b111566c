"""Fingerprints: the syncmers by their definition, the order of documents, and what edits leave."""

import hashlib

import numpy as np
import pytest

from railbird.llm import syncmers
from tests.llm import cases


def plain(text):
    """Places whose K characters have their smallest S-run first or last."""
    codes = syncmers.codes_of(text)
    up, down = syncmers.powers(len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(syncmers.mixed(codes + syncmers._FACTORS[0]) * up[: len(codes)])])
    inner = syncmers._runs(sums.astype(np.uint64), syncmers.S, down).tolist()
    ends = syncmers.K - syncmers.S
    return [
        i
        for i in range(len(text) - syncmers.K + 1)
        if min(inner[i : i + ends + 1]) in (inner[i], inner[i + ends])
    ]


@pytest.mark.parametrize("slice_", [1 << 20, 64])
def test_syncmers_by_definition(monkeypatch, slice_):
    monkeypatch.setattr(syncmers, "SLICE", slice_)
    text = cases.prose(7, 100) + " ñandú 日本語"
    got = [int(p) for places, _ in syncmers.syncmers(syncmers.codes_of(text)) for p in places]
    assert got == plain(text) and len(got) > len(text) / 8


def test_anchors_do_not_depend_on_what_is_around():
    passage = cases.prose(8, 60)
    sets = []
    for around in ("", "some words before ", "x" * 77):
        found = [h for _, hashes in syncmers.syncmers(syncmers.codes_of(around + passage + " " + around)) for h in hashes.tolist()]
        sets.append(set(found))
    assert len(sets[0] & sets[1] & sets[2]) >= 0.97 * len(sets[0])


def test_positional_matches(spark):
    passage = cases.prose(9, 50)
    a = cases.documents(spark, [cases.row(1, passage), cases.row(5, None)])
    b = cases.documents(spark, [cases.row(2, "y" * 33 + passage), cases.row(3, cases.prose(10, 50))])
    best = syncmers.matches(syncmers.anchors(a), syncmers.anchors(b)).orderBy("n", ascending=False).head()
    assert (best["a"], best["b"], best["shift"]) == (1, 2, 33) and best["n"] > 30


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        out.append((r[0], len(text), hashlib.sha256(changed.encode()).hexdigest()))
    return sorted(out, key=repr)


# rows of one id have equal texts here, so their order does not matter
@pytest.mark.parametrize("slices", [1, 2, 16, 400])
def test_each_document_meets_the_next(spark, slices, monkeypatch):
    real = syncmers.in_order
    monkeypatch.setattr(syncmers, "in_order", lambda d, i, t: real(d, i, t, slices))
    out = syncmers.compare_next(cases.documents(spark))
    rows = out.collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows], key=repr) == expected(cases.ROWS)
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[1] == prints[2] and prints[5] == prints[6] and len({len(p) for p in prints.values()}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    long = {r["doc_id"]: r for r in rows}[12]
    assert 0.4 < long["near_edited"] <= 1 and long["near_next"] < 0.3


def test_lone_and_no_documents(spark):
    lone = syncmers.compare_next(cases.documents(spark, [cases.row(3, "abcdef")])).collect()
    assert [(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in lone] == [(3, hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    assert syncmers.compare_next(cases.documents(spark).where("doc_id < 0")).count() == 0


def test_fingerprints_keep_other_columns(spark):
    out = syncmers.fingerprints(cases.documents(spark))
    assert dict(out.dtypes)["fingerprint"] == "string" and "score" in out.columns and out.count() == len(cases.ROWS)
