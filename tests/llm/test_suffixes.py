"""Repeated passages: anchors, runs, the loser tree and removal against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from railbird.llm import queries, suffixes
from tests.llm import cases


def brute(data, width):
    """The removed bytes of each text, by counting all strings of the width."""
    counts = Counter(t[i : i + width] for t in data for i in range(len(t) - width + 1))
    out = []
    for t in data:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def spans(gone):
    edges = [i for i in range(len(gone) + 1) if (i > 0 and gone[i - 1]) != (i < len(gone) and gone[i])]
    return list(zip(edges[::2], edges[1::2], strict=True))


def piece_of(data):
    ends = np.cumsum([len(x) for x in data])
    return suffixes.Piece(np.frombuffer(b"".join(data), dtype=np.uint8), ends - [len(x) for x in data], ends)


def test_every_string_has_its_anchor_wherever_it_is(monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 97)
    width, text = 40, cases.prose(3, 300).encode()
    whole, hashes = suffixes.anchors(piece_of([text]), width)
    assert len(whole) == len(set(whole.tolist())) == len(hashes) and 0.05 < len(whole) / len(text) < 0.15
    for i in range(0, len(text) - width + 1, 7):
        alone, own = suffixes.anchors(piece_of([b"short", text[i : i + width], b"", b"short"]), width)
        assert len(alone) == 1 and i + int(alone[0]) - 5 in whole
        assert own[0] == hashes[whole.tolist().index(i + int(alone[0]) - 5)]


def test_anchors_are_dealt_evenly():
    _, hashes = suffixes.anchors(piece_of([cases.prose(5, 20_000).encode()]), 200)
    shares = np.bincount((hashes >> np.uint64(61)).astype(int), minlength=8) / len(hashes)
    assert len(hashes) > 1000 and shares.min() > 0.08 and shares.max() < 0.17


@pytest.mark.parametrize("count", [1, 2, 3, 7, 16])
def test_loser_tree(count):
    draw = random.Random(count)
    runs = [sorted({bytes(draw.choice(b"ab") for _ in range(6)) for _ in range(draw.randrange(0, 20))}) for _ in range(count)]

    def coded(run):
        last = b""
        for entry in run:
            same = 0
            while same < len(last) and last[same] == entry[same]:
                same += 1
            yield entry, same
            last = entry

    got = list(suffixes.LoserTree([coded(r) for r in runs], 6))
    assert [e for e, _, _ in got] == sorted(e for r in runs for e in r)
    last = b""
    for entry, run, same in got:
        assert entry in runs[run]
        assert same == next((i for i in range(6) if last[i : i + 1] != entry[i : i + 1]), 6)
        last = entry


def test_known_prefixes_are_not_compared_again(monkeypatch):
    seen = []

    class Watched(bytes):
        def __getitem__(self, at):
            if isinstance(at, slice):
                seen.append(at.start)
            return bytes.__getitem__(self, at)

    runs = [[b"aaaaa%d" % (i + 3 * k) for k in range(3)] for i in range(3)]
    tree = suffixes.LoserTree([iter([(Watched(x), 0 if k == 0 else 5) for k, x in enumerate(r)]) for r in runs], 6)
    seen.clear()
    assert [bytes(e) for e, _, _ in tree] == sorted(x for r in runs for x in r)
    assert seen and min(seen) == 5


def texts_of(seed, width):
    """Documents of shared and own passages that meet at all offsets, and of periods."""
    draw = random.Random(seed)

    def letters(n, some="abcdefgh "):
        return "".join(draw.choice(some) for _ in range(n))

    shared = [letters(draw.randrange(width // 2, 3 * width)) for _ in range(6)]
    out = [letters(draw.randrange(0, width)) for _ in range(5)]
    for _ in range(40):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            s = draw.choice(shared)
            a = draw.randrange(len(s))
            parts += [s[a : a + draw.randrange(1, 2 * width)], letters(draw.choice([0, 0, 1, 5, width]))]
        out.append("".join(parts))
    out += ["x" * width, "x" * (width - 1), "ab" * width, "ab" * 3 + letters(5), shared[0], shared[0], "", "ñ日" * width]
    return out


@pytest.mark.parametrize(("seed", "width", "size"), [(1, 8, 100), (2, 10, 1 << 20), (3, 20, 1), (4, 50, 400), (5, 200, 2000), (6, 2, 60)])
def test_removal_by_definition(spark, monkeypatch, seed, width, size):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", size)
    monkeypatch.setattr(suffixes, "PART_BYTES", 3000)
    rows = [cases.row(i, t) for i, t in enumerate(texts_of(seed, width))]
    data = [r[1].encode() for r in rows]
    want = {i: (len(t), spans(g), bytes(b for b, x in zip(t, g, strict=True) if not x)) for i, (t, g) in enumerate(zip(data, brute(data, width), strict=True))}
    got = {r[0]: (r[1], [tuple(s) for s in r[2]], bytes(r[3])) for r in suffixes.remove_repeats(cases.documents(spark, rows), width=width).collect()}
    assert got == want
    assert sum(len(s) for _, s, _ in want.values()) > 5


def test_query_against_brute_force(spark, tmp_path):
    rows = [r for r in cases.ROWS if r[0] not in (12, 15)] + [cases.row(15, "x" * 3000), cases.row(16, "y" * 199), cases.row(17, None)]
    cases.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    data = [(r[1] or "").encode() for r in rows]
    want = []
    for r, t, gone in zip(rows, data, brute(data, 200), strict=True):
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        want.append((r[0], len(t), sum(gone), len(spans(gone)), hashlib.sha256(kept).hexdigest()))
    got = queries.QUERIES["op11_repeated_passages"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_no_rows(spark):
    assert suffixes.remove_repeats(cases.documents(spark, []).limit(0)).count() == 0
    assert [tuple(r) for r in suffixes.remove_repeats(cases.documents(spark, [cases.row(None, None)])).collect()] == [(None, 0, [], b"")]


def test_long_periodic_text_has_few_entries():
    piece = piece_of([b"ab" * 100_000])
    places, hashes = suffixes.anchors(piece, 200)
    runs = suffixes.sorted_runs(piece, 0, np.ones(len(np.unique(hashes)), dtype=bool), 1, 200)
    assert sum(len(suffixes.unpacked(r["shared"], np.uint16)) for r in runs) < 1000
    gone = suffixes.removed_from(piece, suffixes.merge(runs, 200))
    assert gone == [[(0, 200_000)]]
