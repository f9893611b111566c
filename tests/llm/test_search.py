"""Ranked search: scores by their definition, ties, strata that are not visited, odd documents and queries."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from railbird.llm import search
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    held, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for query, text in queries:
        found = []
        for (doc, c), n in zip(counts, sizes, strict=True):
            score = 0
            for t in set(terms(text)) & set(c):
                m = 50 + (50 * n * held) // total
                w = math.floor(1000 * math.log((2 * held + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc, score))
        for rank, (_, _, _, doc, score) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1):
            out.append((query, rank, doc, score))
    return sorted(out, key=repr)


ITEMS = [
    ("a", "thand onat ering" + " " + cases.BASE[:200]),
    ("a", "thand"),
    (None, "THAND, thand; stong-retand"),
    ("b", None),
    ("c", ""),
    ("d", "nothingofthekind"),
    ("e", "日本語 ñandú é 12345"),
    ("f", cases.prose(99, 50)),
]


@pytest.mark.parametrize(("k", "size"), [(50, 8 << 20), (3, 1500), (1, 1)])
def test_ranking_by_definition(spark, monkeypatch, k, size):
    monkeypatch.setattr(search, "SEGMENT_BYTES", size)
    docs = cases.documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    index = search.build(docs)
    got = search.search(index, items, k)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([r[:2] for r in cases.ROWS], ITEMS, k)
    monkeypatch.setattr(search, "QUERY_BYTES", 10)
    assert sorted(map(tuple, search.search(index, items, k).collect()), key=repr) == brute([r[:2] for r in cases.ROWS], ITEMS, k)
    index.delete()


def test_strata_that_cannot_matter_are_not_visited(monkeypatch):
    short = [b"red fox"] * 5 + [b"red " + b"x " * (10 * i) for i in range(1, 60)]
    batch = search._segment(0, list(range(len(short))), short, len(short), sum(len(search.terms_of(x)) for x in short))
    numbers = {t: i for i, t in enumerate(sorted({b"red", b"fox"}))}
    rows = [batch.filter(search.pc.or_(search.pc.is_null(batch["term"]), search.pc.is_in(batch["term"], search.pa.array(list(numbers)))))]
    visited = []
    score = search._Segment._score
    monkeypatch.setattr(search._Segment, "_score", lambda self, r, g, best: (visited.append(len(r)), score(self, r, g, best)))
    best = search._Best(5)
    search._Segment(rows, numbers).search(np.arange(2), np.array([3000, 500]), best)
    assert best.ids.tolist() == [0, 1, 2, 3, 4] and sum(visited) < 10


def test_empty_tables(spark):
    none = cases.documents(spark, []).limit(0)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert search.search_once(none, items, 5).count() == 0
    assert search.search_once(cases.documents(spark), items.limit(0), 5).count() == 0
    blank = cases.documents(spark, [cases.row(1, None), cases.row(2, "!!")])
    assert search.search_once(blank, items, 5).count() == 0
