"""Components against all pairs of full sets."""

import re

import numpy as np
import pytest

from railbird.llm import neardup
from railbird.llm.components import components
from tests.llm import cases

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, width):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = WORD.findall((text or "").translate(str.maketrans(upper, lower)))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, near):
    sets = [shingles(r[1], near.width) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= near.percent * len(a | b):
                group[root(i)] = root(j)
    out = []
    for i, (row, own) in enumerate(zip(rows, sets, strict=True)):
        ids = [r[0] for k, r in enumerate(rows) if root(k) == root(i) and r[0] is not None]
        least = (min(ids) if ids else None) if own else row[0]
        out.append((row[0], len(own), least, row[0] == least))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("near", [neardup.Near(), neardup.Near(3, 85)])
def test_same_as_all_pairs(spark, near):
    assert found(neardup.near_duplicates(cases.documents(spark), near)) == brute(cases.ROWS, near)


@pytest.mark.parametrize("small", [3, 64])
def test_group_linked_only_through_some(spark, monkeypatch, small):
    """A large group of copies, each a few words from the next: no class links to all others."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    monkeypatch.setattr(neardup, "CELL", 4)
    monkeypatch.setattr(neardup, "SKETCH_CELL", 5)
    monkeypatch.setattr(neardup, "BLOCK", 128)
    texts, text = [], cases.prose(5, 120)
    for i in range(60):
        text = cases.edited(text, i, 1)
        texts.append(text)
    rows = [cases.row(i, t) for i, t in enumerate(texts)] + [cases.row(100 + i, cases.prose(50 + i, 60)) for i in range(10)]
    got = found(neardup.near_duplicates(cases.documents(spark, rows)))
    assert got == brute(rows, neardup.Near())


def test_empty_table(spark):
    assert found(neardup.near_duplicates(cases.documents(spark).where("doc_id < 0"))) == []


def test_sketches_tell_high_similarities():
    near, draw = neardup.Near(3, 85), np.random.default_rng(1)
    pool = draw.integers(0, 2**63, 3000).astype(np.uint64)
    for similar in (0.95, 0.9, 0.85):
        common = round(2 * 1000 * similar / (1 + similar))
        a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:common], pool[1000 : 2000 - common]]))
        x, y = (near.odd_sketch(near.minhash(s)).view(np.uint8) for s in (a, b))
        apart = int(np.unpackbits(x ^ y).sum())
        estimate = 1 + neardup.BITS * np.log(1 - 2 * apart / neardup.BITS) / (4 * near.samples)
        assert abs(estimate - similar) < 0.08 and apart <= near.far


def test_long_texts_are_hashed_in_slices(monkeypatch):
    from railbird.llm import text as words

    data = cases.prose(3, 5000).encode() + b"  \n" + "é日本".encode() * 400
    whole = words.word_hashes(data, words.SPACED)
    monkeypatch.setattr(words, "slices", lambda d, t, s=97, real=words.slices: real(d, t, s))
    assert (words.word_hashes(data, words.SPACED) == whole).all() and len(whole) == 5001


def test_sets_are_connected_exactly(monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 64)
    draw = np.random.default_rng(4)
    base = draw.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[draw.random(300) < 0.93], draw.integers(0, 2**63, draw.integers(0, 40)).astype(np.uint64)])) for _ in range(50)]
    label = neardup.connect(sets, 80)
    group = list(range(50))
    for i in range(50):
        for j in range(50):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert [group.index(g) for g in group] == label.tolist() and 1 < len(set(group)) < 50


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_a_chain(spark, monkeypatch, few):
    monkeypatch.setattr("railbird.llm.components.FEW", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100}
