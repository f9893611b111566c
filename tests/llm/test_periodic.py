"""Periodic runs: the convolution, runs by their definition, and the operator over odd documents."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from railbird.llm import periodic, queries
from railbird.llm.periodic import Run
from tests.llm import cases


def brute(words):
    """All runs, by comparing words at every distance."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(24, 3 * q):
                found.setdefault((start, length), q)
    return sorted((Run(s, n_, q) for (s, n_), q in found.items()), key=lambda r: (r.start, r.period))


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_mismatches_are_sums_of_squared_differences(size):
    draw = np.random.default_rng(size)
    blocks = draw.integers(0, periodic.P, (5, size)).astype(np.uint64)
    windows = draw.integers(0, periodic.P, (5, 3 * size)).astype(np.uint64)
    windows[0, size : 2 * size] = blocks[0]
    got = periodic.mismatches(blocks, windows)
    for row in range(5):
        for at in range(2 * size + 1):
            want = sum((int(a) - int(b)) ** 2 for a, b in zip(blocks[row], windows[row, at : at + size], strict=True))
            assert int(got[row, at]) == want % periodic.P
    assert got[0, size] == 0


def sequences():
    draw = random.Random(5)
    for letters in (1, 2, 3, 50):
        for length in (0, 1, 23, 24, 25, 100, 301):
            yield [draw.randrange(letters) for _ in range(length)]
    for period in (1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 100):
        for length in (24, 3 * period - 1, 3 * period, 3 * period + 5, 7 * period):
            for before in (0, 1, 5, 13):
                unit = [draw.randrange(60) for _ in range(period)]
                repeated = (unit * (length // period + 1))[:length]
                yield [100 + draw.randrange(900) for _ in range(before)] + repeated + [100 + draw.randrange(900) for _ in range(draw.randrange(9))]
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    yield b  # the Fibonacci word has runs within runs
    yield ([0] * 30 + [1]) * 5
    yield ([0, 1] * 20 + [2]) * 4 + [0] * 50


def test_runs_by_definition():
    for codes in sequences():
        assert periodic.find_runs(np.array(codes, dtype=np.int64)) == brute(codes), codes


def test_documents_do_not_meet():
    words = [b"a"] * 23
    assert periodic.runs_of_documents([words, words, [], words + [b"a"]]) == [[], [], [], [Run(0, 24, 1)]]


def test_strongest_run_and_ties():
    runs = [Run(10, 30, 10), Run(50, 24, 8), Run(5, 40, 13), Run(90, 24, 8)]
    assert periodic.strongest(runs) == Run(5, 40, 13) and periodic.strongest([]) is None
    assert periodic.strongest([runs[3], runs[1], runs[0]]) == runs[0]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = brute(words)
    gone = {i for r in runs for i in range(r.start + r.period, r.stop)}
    best = periodic.strongest(runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
    four = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    rows = [r for r in cases.ROWS if r[0] != 12]
    rows += [cases.row(300 + i, " ".join(cases.prose(i, 1 + i % 37).split() * (1 + i % 9))) for i in range(60)]
    rows += [cases.row(400, "a " * 700), cases.row(401, "A a " * 300), cases.row(402, "x\ty\x0bz\n" * 50 + "é é " * 40)]
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert sum(r["n_runs"] for r in got.collect()) > 40


def test_no_rows_and_long_texts(spark, monkeypatch):
    assert periodic.periodic_runs(cases.documents(spark, []).limit(0)).count() == 0
    text = "p q " * 30_000 + cases.prose(3, 20_000)
    row = periodic.periodic_runs(cases.documents(spark, [cases.row(1, text)])).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 60_000, 2)] and row["collapsed"] == "p q " + cases.prose(3, 20_000)
