"""Benchmark passages against all windows of all documents."""

import re

import pytest

from railbird.llm import wumanber
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, cases.prose(301, 30), "x"),
    (2, cases.prose(302, 13), "x"),
    (3, "short item", "x"),
    (4, "solo", "x"),
    (5, "", "x"),
    (6, None, "x"),
    (None, cases.prose(303, 14), "x"),
    (2, cases.prose(304, 20), "x"),
    (7, " ".join(cases.prose(301, 30).split()[5:25]), "x"),
    (8, "été à la plage no 7", "x"),
    (9, "a a a a a a a a a a a a a a", "x"),
]


def split(text):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return WORD.findall((text or "").translate(str.maketrans(upper, lower)))


def texts():
    item = ITEMS[0][1]
    return [
        None,
        "",
        "!!! ???",
        f"{cases.prose(400, 50)} {item.upper()} {cases.prose(401, 50)}",
        f"{cases.prose(402, 500)} {' '.join(item.split()[3:18])}",
        f"x{item}",
        " ".join(item.split()[:12]),
        item.replace(" ", "\n -- "),
        f"before {ITEMS[1][1]} and {ITEMS[6][1]} after",
        ITEMS[7][1] * 2,
        "a short item and a SOLO, short-item",
        "Été À la plage",
        "a " * 40,
        "a " * 13 + "b " + "a " * 12,
        cases.prose(12, 30_000) + " " + item,
        "solo",
        "solo",
    ]


def brute(text):
    words, hits, found = split(text), set(), set()
    for i, item, _ in ITEMS:
        own = split(item)
        n = min(13, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in windows:
                hits |= set(range(k, k + n))
                found.add("null" if i is None else str(i))
    return len(words), len(hits), sorted(found), sorted(hits)


@pytest.mark.parametrize("slice_bytes", [wumanber.SLICE_BYTES, 200])
def test_same_as_all_windows(spark, slice_bytes):
    rows = [cases.row(i, t) for i, t in enumerate(texts())]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string, n_words string")
    out = wumanber.find_passages(cases.documents(spark, rows), bench, slice_bytes=slice_bytes)
    assert "score" in out.columns and dict(out.dtypes)["items"] == "array<string>"
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, text in enumerate(texts()):
        r = got[i]
        covered = [w for s in r["spans"] for w in range(s["start"], s["stop"])]
        assert (r["n_words"], r["n_hit"], r["items"], covered) == brute(text), i


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string, n_words string")
    docs = cases.documents(spark)
    assert wumanber.find_passages(docs.where("doc_id < 0"), bench).count() == 0
    out = wumanber.find_passages(docs, bench.where("item_id < 0"))
    assert out.where("n_hit > 0 or size(items) > 0").count() == 0 and out.count() == len(cases.ROWS)


def test_shifts_skip_most_places():
    (search,) = wumanber.tables([("1", ITEMS[0][1].encode())], 13)
    assert search.shift and max(search.shift.values()) <= 11 and min(search.shift.values()) == 0
